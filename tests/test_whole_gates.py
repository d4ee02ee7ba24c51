"""Every gate of a rejection counts, at whatever place it stands."""

import duckdb
import pytest
from test_catalogue import FOLDER, rows

from trialforge.plans import catalogue


@pytest.mark.parametrize("name", ["gate_failures", "binding_gates", "failure_histogram", "dominant_failure"])
def test_gates_of_every_place(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    whole = con.sql(catalogue.ORACLE[name].replace(" WHERE pos <= 2", ""))
    want = [dict(zip(whole.columns, r)) for r in whole.fetchall()]
    df = catalogue.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    assert columns == sorted(whole.columns)
    assert rows([r.asDict() for r in df.collect()], columns) == rows(want, columns)
