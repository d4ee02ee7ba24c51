"""Every query with SQL against DuckDB, on the whole tables of the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from trialforge.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(FOLDER)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows(got, columns):
    return sorted((tuple(plain(r[c]) for c in columns) for r in got), key=repr)


@pytest.mark.parametrize("name", list(catalogue.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    got = duck.sql(catalogue.ORACLE[name])
    assert sorted(df.columns) == sorted(got.columns)
    want = [dict(zip(got.columns, r)) for r in got.fetchall()]
    assert rows([r.asDict() for r in df.collect()], sorted(df.columns)) == rows(want, sorted(df.columns))


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLE])
def test_query_without_sql_runs(spark, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() > 0


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() == 12
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


FOUND = {
    "p1_found": [("candidate_id", "string"), ("status", "string"), ("valid_from_us", "bigint"), ("valid_to_us", "bigint")],
    "p2_found": [("rel", "string"), ("parent_key", "string"), ("child_key", "string"), ("found_text", "string")],
    "p3_found": [("src", "string"), ("src_key", "string"), ("ref_id", "string"), ("kind", "string"), ("ref_month", "string")],
    "p4_found": [("candidate_id", "string"), ("root_id", "string"), ("node_depth", "bigint"), ("n_descendants", "bigint"), ("cycle_state", "bigint")],
    "p5_found": [("family", "string"), ("rank_no", "bigint"), ("candidate_id", "string")],
}


@pytest.mark.parametrize("name", FOUND)
def test_found_columns_and_distinct_rows(spark, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    assert df.dtypes == FOUND[name]
    assert df.count() == df.distinct().count()


def test_empty_tables(spark, tmp_path):
    """The general problems' queries over tables without rows."""
    for t in ("candidates", "evaluations", "workers", "frontier", "removals"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in ("p1_found", "p1_score_versions", "p2_found", "p3_found", "p3_counts", "p4_found", "p4_paths", "p4_descendants", "p5_found"):
        assert catalogue.QUERIES[name](spark, str(tmp_path)).count() == 0, name
