"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from leafmill import catalogue_of_queries as c

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "null"
        return f"{float(v):.6f}" if hasattr(v, "__float__") and not isinstance(v, (str, bool)) and type(v).__name__ != "bool" else str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(c.oracle_sql()))
def test_query_matches_sql(spark, small, db, name):
    got, want = c.queries()[name](spark, small).toPandas(), db.execute(c.oracle_sql()[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(c.queries()) - set(c.oracle_sql())))
def test_query_runs(spark, small, name):
    assert c.queries()[name](spark, small).count() > 0


def test_layout_types_take_the_first_row_of_many(spark, tmp_path):
    # Spark reads the larger file first, and the smaller one holds the first rows.
    (tmp_path / "lineitem.parquet").mkdir()
    con = duckdb.connect()
    con.execute(f"COPY (SELECT range AS o_orderkey, range AS o_custkey, '1-URGENT' AS o_orderpriority, 'O' AS o_orderstatus FROM range(300)) TO '{tmp_path}/orders.parquet'")
    con.execute(f"COPY (SELECT range AS l_orderkey, range AS l_suppkey, 2 AS l_linenumber FROM range(300)) TO '{tmp_path}/lineitem.parquet/a.parquet'")
    con.execute(f"COPY (SELECT range % 300 AS l_orderkey, range + range // 300 % 2 + 1 AS l_suppkey, 2 AS l_linenumber FROM range(3000)) TO '{tmp_path}/lineitem.parquet/b.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    con.execute("SET threads = 1")
    got, want = c.queries()["layout_types"](spark, str(tmp_path)).toPandas(), con.execute(c.oracle_sql()["layout_types"]).df()
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
