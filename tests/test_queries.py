"""Registered queries give the rows of their SQL, on the smallest tables or those of $TEST_SF_DIR."""

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from spikeframe.plans import analysis, extended, populations, preparation, registry, responses, scores  # noqa: E402, F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = df.collect()
    if name in registry.ORACLES:
        sql = duck.sql(registry.ORACLES[name])
        assert sorted(sql.columns) == sorted(df.columns)
        assert rows(df.columns, found) == rows(sql.columns, sql.fetchall())
