"""One local session for all tests."""

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from evigraph.session import session

    folder = tempfile.mkdtemp(prefix="evigraph-tests-")
    s = session(
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__checkpoint__dir=f"file://{folder}/shared",
        spark__sql__warehouse__dir=f"{folder}/warehouse",
        spark__ui__showConsoleProgress="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    """DuckDB over the driver's tables, and a comparison of results without order."""
    import duckdb

    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def value(x):
        if isinstance(x, float):
            return repr(round(x, 6))
        return None if x is None else str(x)

    def same(df, sql, sf_dir):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        rel = con.sql(sql)
        names = sorted(rel.columns)
        assert names == sorted(df.columns)
        at = [rel.columns.index(n) for n in names]
        want = sorted(repr([value(r[i]) for i in at]) for r in rel.fetchall())
        got = sorted(repr([value(r[n]) for n in names]) for r in df.collect())
        assert got == want

    return same
