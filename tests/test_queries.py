"""Every query of the engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from treeline.queries import ORACLE_SQL, QUERIES

DIR = os.environ.get("TREELINE_TABLES", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()[:10]
    return round(float(x), 6) if isinstance(x, float) or type(x).__name__ == "Decimal" else x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df, want = QUERIES[name](spark, DIR), duck.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("eps", [1, 8])
@pytest.mark.parametrize("lost", ["lineitem", "customer", "both", "neither"])
def test_protected_size_of_a_chain_where_an_edge_meets_nothing(spark, tmp_path, eps, lost):
    """a join without answers has no greatest count, in Spark as in SQL; NULL keys and repeated keys are there too."""
    c, folder = duckdb.connect(), tmp_path
    far = {"lineitem": (1000, 0), "customer": (0, 1000), "both": (1000, 1000), "neither": (0, 0)}[lost]
    tables = {
        "lineitem": f"SELECT CASE WHEN i % 11 > 0 THEN i % 8 * (i % 3) + {far[0]} END AS l_orderkey, 1 AS l_linenumber FROM range(60) t(i)",
        "orders": "SELECT i % 18 AS o_orderkey, CASE WHEN i % 7 > 0 THEN i % 5 * (i % 2) END AS o_custkey FROM range(20) t(i)",
        "customer": f"SELECT i % 9 + {far[1]} AS c_custkey, 0 AS c_nationkey FROM range(10) t(i)",
        "nation": "SELECT 0 AS n_nationkey, 0 AS n_regionkey",
    }
    for t, text in tables.items():
        c.sql(f"COPY ({text}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    name = f"protected_size_chain3_eps{eps}"
    want = c.sql(ORACLE_SQL[name])
    assert [tuple(r) for r in QUERIES[name](spark, str(folder)).select(*want.columns).collect()] == want.fetchall()


def test_protected_size_of_a_chain_over_a_million_rows(spark, tmp_path):
    """counts of so many rows enter the sensitivity as in SQL, however far below the products of degrees."""
    c, name = duckdb.connect(), "protected_size_chain3_eps8"
    tables = {
        "lineitem": "SELECT i % 2 * i AS l_orderkey, 1 AS l_linenumber FROM range(800000) t(i)",
        "orders": "SELECT i AS o_orderkey, i - i % 3 AS o_custkey FROM range(300000) t(i)",
        "customer": "SELECT i AS c_custkey, 0 AS c_nationkey FROM range(10) t(i)",
        "nation": "SELECT 0 AS n_nationkey, 0 AS n_regionkey",
    }
    for t, text in tables.items():
        c.sql(f"COPY ({text}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name])
    rows = want.fetchall()
    assert [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()] == rows
    found = dict(zip(want.columns, rows[0], strict=True))
    assert found["sensitivity"] == found["by_exact"] < found["by_estimates"]
