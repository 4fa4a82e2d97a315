"""The shared folder for intermediate tables and files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Folders that this driver was given and has not removed.
_SCRATCH: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, local mode has a temporary one and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="plateforge-"))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder in any store that Spark reaches; what is not there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession) -> str:
    """A new folder's path under the shared one; clean() removes it."""
    path = f"{shared_dir(spark)}/plateforge/{uuid.uuid4().hex}"
    _SCRATCH.add(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """df written as a Parquet table under the shared folder and read back: what several steps read is computed once, and its size is known."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    remove(spark, path)
    _SCRATCH.discard(path)


def clean(spark: SparkSession) -> None:
    """Remove every folder that scratch() gave, once results are taken or written."""
    for path in list(_SCRATCH):
        discard(spark, path)
