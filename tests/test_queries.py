"""Every registered query against its SQL on the smallest tables, where these are there."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Those that take long on any input are left to the driver's comparison.
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return "~"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.8g}" if not v.is_integer() else str(int(v))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(FOLDER)).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False, name=None)) for d in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables here")
def test_entry(spark):
    assert entry.entry(spark).count() == 77
