"""Every registered query against its SQL."""
import glob
import os

import duckdb
import pytest

from portcullis.queries import load

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()
NAMES = sorted(QUERIES)


def normal(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([normal(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name in ORACLES:
        r = duck.execute(ORACLES[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        want = sorted(([normal(row[names.index(c)]) for c in columns] for row in r.fetchall()), key=repr)
        assert got == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
