"""Every query with SQL agrees with DuckDB on the same tables."""

import inspect
import os

import duckdb
import pytest

from plateforge.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("customer", "documents", "events", "lineitem", "orders", "part", "supplier")


def _value(x):
    if isinstance(x, float):
        return round(x, 6)
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    found = catalog.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    wanted = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(columns, wanted.fetchall())


def test_simulations_have_the_reference_volumes(spark, monkeypatch):
    """funnel and coverage_sweep run as often, and over as much, as the reference by default, as it is coded."""
    asked, real = [], catalog.simulate.funnel

    def spy(session, *args, **options):
        call = inspect.signature(real).bind(session, *args, **options)
        call.apply_defaults()
        asked.append(call.arguments)
        return real(session, 1, 2)

    monkeypatch.setattr(catalog.simulate, "funnel", spy)
    catalog.queries()["funnel"](spark, SF)
    catalog.queries()["coverage_sweep"](spark, SF)
    volumes = [(a["n_sims"], a["lib_size"], a["scale"], a["semantics"]) for a in asked]
    assert volumes == [(10_000, 1000, 50, "coded")] + [(10_000, 328, 30, "coded")] * 25
    assert asked[0]["fold"] == 10 and [round(a["fold"] * 328, 6) for a in asked[1::24]] == [1, 5000]


def test_one_row_group_is_many_tasks(spark, monkeypatch, tmp_path):
    """Orders in one row group are written by tasks that grow with the rows: no compressed file, which one task reads, has more than its share; results are the same."""
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(catalog, "SPREAD_ROWS", 20)
    roots, real = [], catalog.records.read_fastq
    monkeypatch.setattr(catalog.records, "read_fastq", lambda session, root, *args, **options: roots.append(root) or real(session, root, *args, **options))
    found = catalog.queries()["fastq_scan"](spark, str(tmp_path))
    assert sum(r.n for r in found.collect()) == orders.count()
    packed = real(spark, roots[0], "*.gz").groupBy("path").count().collect()
    assert sum(r["count"] for r in packed) == orders.where("o_orderkey % 2 = 1").count() and max(r["count"] for r in packed) <= 45
