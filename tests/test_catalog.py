"""Every query with SQL against DuckDB over the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lociform.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def norm(rows):
    cell = lambda x: "" if x is None or isinstance(x, float) and math.isnan(x) else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert norm(got.select(*[f"`{c}`" for c in cols]).collect()) == norm(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def without_hits(spark, tmp_path_factory):
    """Tables in which no feature's mean discount is far enough from 0.05 to be significant."""
    d = str(tmp_path_factory.mktemp("without_hits"))
    spark.createDataFrame([(k, f"Brand#{k}", "SMALL") for k in range(3)], "p_partkey bigint, p_brand string, p_type string").write.parquet(f"{d}/part.parquet")
    rows = [(k, x / 100, f"{1994 + y}-05-01 00:00:00") for k in range(3) for x in (4, 5, 6) for y in range(4)]
    li = spark.createDataFrame(rows, "l_partkey bigint, l_discount double, day string")
    li.selectExpr("l_partkey", "l_discount", "CAST(day AS timestamp) AS l_shipdate").write.parquet(f"{d}/lineitem.parquet")
    return d


def _same_as_sql(spark, d, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, d)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert norm(got.collect()) == norm(want)
    return len(want)


def test_comparison_table_without_hits(spark, without_hits):
    assert _same_as_sql(spark, without_hits, "de_comparison_table") == 0


def test_gene_lists_without_hits(spark, without_hits):
    assert _same_as_sql(spark, without_hits, "gene_lists_loaded") == 0


def test_results_exported_without_hits(spark, without_hits):
    assert _same_as_sql(spark, without_hits, "results_exported") == 4


def test_results_exported_of_names_with_line_breaks(spark, without_hits, tmp_path):
    parts = [(0, "Brand\n0", "SMALL"), (1, "Brand\r\n1", "SMALL"), (2, "Brand#2", "SMALL\n")]
    spark.createDataFrame(parts, "p_partkey bigint, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{without_hits}/lineitem.parquet").withColumn("l_discount", F.when(F.col("l_partkey") == 0, float("nan")).otherwise(F.col("l_discount") + F.col("l_partkey") / 100)).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert _same_as_sql(spark, str(tmp_path), "results_exported") == 12
