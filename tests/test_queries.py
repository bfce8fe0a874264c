"""Registered queries against DuckDB on the smallest tables; plans of the hot paths."""

import os

import duckdb
import pytest

from larkspur import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_as_sql(spark, duck, name):
    out = queries.QUERIES[name](spark, FOLDER)
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(out.columns)
    assert _rows(out.columns, map(tuple, out.collect())) == _rows(names, cursor.fetchall())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(df):
    """(filters, columns) of the plan's scans, from the plan's own nodes, whose text nothing shortens."""
    out, todo = [], [df._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        if "FileSourceScan" in node.getClass().getSimpleName():
            out.append((node.dataFilters().mkString(" "), node.requiredSchema().catalogString()))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_pruning_and_pushdown(spark):
    ((filters, columns),) = _scans(queries.QUERIES["tpch_q6"](spark, FOLDER))
    assert all(x in filters for x in ("(l_shipdate", "(l_discount", "(l_quantity")) and filters.count("(l_shipdate") >= 2
    assert "l_orderkey" not in columns and "l_extendedprice" in columns
    plan = _plan(queries.QUERIES["scan_bounds_pushed"](spark, FOLDER))
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan


def test_no_python_and_no_nested_loops(spark):
    for name, run in queries.QUERIES.items():
        plan = _plan(run(spark, FOLDER))
        assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_whole_tables_are_read(spark, duck):
    """The queries that go over all segments, orders and events have as many rows as there are."""
    want = {"join_range": "select count(distinct event_id // 100) from events", "fn_unixtime": "select count(*) from orders", "bitpack_decode": "select count(*) from events"}
    for name, sql in want.items():
        assert queries.QUERIES[name](spark, FOLDER).count() == duck.execute(sql).fetchone()[0], name


def test_ranges_reach_the_scan(spark):
    """The bounds of ranges that are written out are filters of the scan, so what is read, and may be broadcast, is what they span."""
    ((filters, _),) = _scans(queries.QUERIES["ts_m6"](spark, FOLDER))
    assert "event_id" in filters and "720" in filters


def test_long_ranges_build_no_array(spark):
    """A range of 10^9 positions is a row for each bucket that it touches."""
    from larkspur.operators.positions import _pieces, range_join

    ranges = spark.createDataFrame([(5, 10**9 + 5, "x"), (7, 8, "y"), (9, 9, "z")], "a long, b long, name string")
    df = spark.createDataFrame([(4,), (5,), (7,), (10**9 + 4,), (10**9 + 5,)], "pos long")
    got = sorted((r.pos, r.name) for r in range_join(df, "pos", ranges, "a", "b").collect())
    assert got == [(5, "x"), (7, "x"), (7, "y"), (10**9 + 4, "x")]
    assert _pieces(ranges.selectExpr("a range__a", "b range__b")).count() < 10**9 / 60_000


def test_partial_table_of_any_ids(spark, tmp_path):
    """Ids with gaps, that come twice, or null, give what the SQL gives."""
    rows = "select if(id % 50 = 7, null, id * 1000003 div 3 * if(id % 11 = 0, 0, 1)) event_id, if(id % 5 = 1, 'purchase', 'view') event_type, id * 0.5D value from range(2000)"
    spark.sql(rows).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    name = "partial_table"
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(con.execute(queries.ORACLES[name]).fetchall(), key=key) and len(got) == 400
