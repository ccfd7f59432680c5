"""The corpus queries against their DuckDB SQL, over whole tables."""

import glob
import os

import duckdb
import pytest

from courierlake.llm import queries

SF = "/root/testdata/sf0.01"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = db.execute(queries.oracle_sql()[name])
    types = {c[0]: str(c[1]) for c in want.description}
    got = queries.queries()[name](spark, SF)
    assert {c: TYPES[t] for c, t in got.dtypes} == types
    rows = [tuple(r[c] for c in types) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))
