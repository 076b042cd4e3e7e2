"""Every genomics query with a DuckDB twin gives the same rows on the smallest tables."""

import os

import duckdb
import pytest

from strandloom import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(value):
    if value is None or isinstance(value, float) and value != value:
        return None
    if isinstance(value, (float, int)) and not isinstance(value, bool):
        return float(f"{value:.9g}")
    return value.tolist() if hasattr(value, "tolist") else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_twin(spark, duck, name):
    frame = catalog.queries()[name](spark, DIR)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall()), key=str)
    assert got == wanted


def test_view_of_deep_nodes_is_whole(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{DIR}/part.parquet' WHERE p_partkey < 6) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT l.* REPLACE (l_orderkey + k * 3000 AS l_orderkey) FROM '{DIR}/lineitem.parquet' AS l, range(21) AS r(k) WHERE l_partkey < 6) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    for table in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    frame = catalog.queries()["h17_pileup_view"](spark, str(tmp_path))
    got = sorted(tuple(plain(x) for x in r) for r in frame.collect())
    wanted = sorted(tuple(plain(x) for x in r) for r in con.sql(catalog.oracle_sql()["h17_pileup_view"]).select(*frame.columns).fetchall())
    assert got == wanted and max(r[5] for r in got) > 400  # more than the pileup ranks
