"""Well depths over arriving reads with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seq


def well_depths(reads: DataFrame, time: str = "ts", lateness: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Reads per (window, well) of a stream (or a table) with fbc_name, rbc_name and an event time.

    The watermark bounds the state: windows older than it are final and leave memory.
    """
    wells = reads.withColumn("well_pos", seq.barcode_to_well("fbc_name", "rbc_name")).where("well_pos is not null")
    return wells.withWatermark(time, lateness).groupBy(F.window(time, window), "well_pos").agg(F.count("*").alias("depth"))
