"""The engine's registered queries, one for each operator and workload query, with DuckDB SQL beside them.

A query is an expression; `engine` opens <sf_dir>/<table>.parquet.  Sums of
doubles are rounded, as their last digits depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .expr import Expr, Sym, q, read_path, read_sexpr, s, to_json
from .functions.scalar import column
from .operators import codec
from .operators.positions import add_indices, gather, radix_partition, range_join
from .operators.relational import interpolate
from .plans.control import evaluate_staged
from .session import Engine
from .sources.tables import parquet_columns
from .workloads import timeseries, tpch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(column(c), n) for c, n in digits.items()}) if digits else df


def expression(name: str, e, sql: str, digits: dict[str, int] | None = None, staged: bool = False) -> None:
    """Registers a query that is an expression, or a function of the folder that gives one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine.over_parquet(spark, sf_dir)
        query = e(sf_dir) if callable(e) and not isinstance(e, (Expr, Sym)) else e
        out = evaluate_staged(engine, query) if staged else engine.evaluate(query)
        return _rounded(out, digits or {})

    QUERIES[name], ORACLES[name] = run, sql


def frames(name: str, sql: str, digits: dict[str, int] | None = None):
    """Registers a query that is a function of (engine, folder)."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: _rounded(f(Engine.over_parquet(spark, sf_dir), sf_dir), digits or {})
        ORACLES[name] = sql
        return f

    return put


# -- star schema -------------------------------------------------------------------

_Q1 = """select l_returnflag, l_linestatus, sum(l_quantity) sum_qty, round(sum(l_extendedprice), 2) sum_base_price,
 round(sum(l_extendedprice * (1 - l_discount)), 2) sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) sum_charge,
 round(avg(l_quantity), 4) avg_qty, round(avg(l_extendedprice), 4) avg_price, round(avg(l_discount), 6) avg_disc, count(*) count_order
 from lineitem where l_shipdate < date '1998-08-31' group by all"""
_Q1_DIGITS = {"sum_base_price": 2, "sum_disc_price": 2, "sum_charge": 2, "avg_qty": 4, "avg_price": 4, "avg_disc": 6}
_Q3 = """select l_orderkey, o_orderdate, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue
 from customer, orders, lineitem where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey
 and o_orderdate < date '1995-03-15' and l_shipdate > date '1995-03-15' group by all order by sum(l_extendedprice * (1 - l_discount)) desc, o_orderdate, l_orderkey limit 10"""
_Q6 = """select round(sum(l_extendedprice * l_discount), 2) revenue from lineitem where l_quantity < 24 and l_discount > 0.0499
 and l_discount < 0.07001 and l_shipdate < date '1997-01-01' and l_shipdate > date '1995-12-31'"""
_PARTSUPP = "select l_partkey ps_partkey, l_suppkey ps_suppkey, min(l_extendedprice / l_quantity) * 0.6 ps_supplycost from lineitem group by all"
_Q9 = f"""select n_name nation, cast(year(o_orderdate) as integer) o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 2) sum_profit
 from part, ({_PARTSUPP}) ps, lineitem, supplier, nation, orders where p_partkey = ps_partkey and ps_partkey = l_partkey and ps_suppkey = l_suppkey
 and s_suppkey = ps_suppkey and s_nationkey = n_nationkey and o_orderkey = l_orderkey and p_retailprice > 906.05 and p_retailprice < 980.1 group by all"""
_Q18 = """select c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(sum_l_quantity) sum_l_quantity
 from (select l_orderkey, sum(l_quantity) sum_l_quantity from lineitem group by all having sum(l_quantity) > 300) l, orders, customer
 where l_orderkey = o_orderkey and c_custkey = o_custkey group by all order by o_totalprice desc, o_orderdate, o_orderkey limit 100"""
_Q8 = """select cast(year(o_orderdate) as integer) o_year, round(sum(case when n2.n_name = 'NATION_1' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) mkt_share
 from part, supplier, lineitem, orders, customer, nation n1, nation n2, region where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey
 and o_custkey = c_custkey and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and r_name = 'AMERICA' and s_nationkey = n2.n_nationkey
 and o_orderdate between date '1996-01-01' and date '1997-12-31' and p_type = 'ECONOMY' group by all"""
_Q10 = """select c_custkey, c_name, c_acctbal, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue from customer, orders, lineitem, nation
 where c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate between date '1996-10-01' and date '1997-01-01' and l_returnflag = 'R' and c_nationkey = n_nationkey
 group by all order by sum(l_extendedprice * (1 - l_discount)) desc, c_custkey limit 20"""

_TPCH = {
    "q1": (tpch.q1, {}, _Q1, _Q1_DIGITS),
    "q3": (tpch.q3, {}, _Q3, {"revenue": 2}),
    "q6": (tpch.q6, {"first": "1995-12-31", "last": "1997-01-01"}, _Q6, {"revenue": 2}),
    "q8": (tpch.q8, {}, _Q8, {"mkt_share": 6}),
    "q9": (tpch.q9, {"low": 906.05, "high": 980.1}, _Q9, {"sum_profit": 2}),
    "q10": (tpch.q10, {}, _Q10, {"revenue": 2}),
    "q18": (tpch.q18, {}, _Q18, {}),
}
for _name, (_build, _given, _sql, _digits) in _TPCH.items():
    expression(f"tpch_{_name}", _build(**_given), _sql, _digits)
    expression(f"tpch_{_name}_staged", _build(**_given, staged=True), _sql, _digits, staged=True)

# Q1 and Q6 over positions that the dates pick, and over a scan that has the dates as bounds.
_SHIPPED, _YEAR = q.Greater(tpch.date("1998-08-31"), s.l_shipdate), q.And(q.Greater(tpch.date("1997-01-01"), s.l_shipdate), q.Greater(s.l_shipdate, tpch.date("1995-12-31")))
_Q6_GIVEN = _TPCH["q6"][1]
for _form, _lines1, _lines6 in (
    ("gathered", lambda d: tpch.gathered(f"{d}/lineitem.parquet", _SHIPPED, s.l_shipdate, *tpch.Q1_COLUMNS), lambda d: tpch.gathered(f"{d}/lineitem.parquet", _YEAR, s.l_shipdate, *tpch.Q6_COLUMNS)),
    ("bounded", lambda d: tpch.bounded(f"{d}/lineitem.parquet", {"l_shipdate": (q.DateObject("1900-01-01"), q.DateObject("1998-08-30"))}, *tpch.Q1_COLUMNS), lambda d: tpch.bounded(f"{d}/lineitem.parquet", {"l_shipdate": (q.DateObject("1996-01-01"), q.DateObject("1996-12-31")), "l_discount": (0.0499, 0.07001)}, *tpch.Q6_COLUMNS)),
):
    expression(f"tpch_q1_{_form}", lambda d, f=_lines1: tpch.q1(lines=f(d)), _Q1, _Q1_DIGITS)
    expression(f"tpch_q6_{_form}", lambda d, f=_lines6: tpch.q6(**_Q6_GIVEN, lines=f(d)), _Q6, {"revenue": 2})

# -- time series -------------------------------------------------------------------

_SEGMENTS = "(select event_id // 100 c_seq_no, min(ts) start_time from events group by 1)"
expression("ts_m0", timeseries.m0(), f"select user_id station, round(sum(value), 4) total from events, {_SEGMENTS} c where event_id // 100 = c_seq_no and start_time > date '2024-01-03' and start_time < date '2024-01-05' and event_type = 'click' group by all", {"total": 4})
expression("ts_m1", timeseries.m1(), "select round(sum(value), 4) total, count(*) n from events where event_type = 'view' and user_id = 7 and ts > date '2024-01-02' and ts < date '2024-01-20'", {"total": 4})
expression("ts_m2", timeseries.m2(), f"select round(sum(value), 4) total, count(*) n from events, {_SEGMENTS} c where event_id // 100 = c_seq_no and start_time > date '2024-01-02' and start_time < date '2024-01-06' and event_type = 'view' and ts > date '2024-01-03' and ts < date '2024-01-05'", {"total": 4})
expression("ts_m3", timeseries.m3(), "select event_type channel, round(avg(value), 6) mean from events where user_id = 7 group by all", {"mean": 6})
expression("ts_m4", timeseries.m4(), "select value sample_value, ts sample_time, event_type channel from events where user_id = 7")
expression("ts_m5", timeseries.m5(), "select user_id station, round(avg(value), 6) mean, round(sum(value), 4) total from events where event_type = 'purchase' group by all", {"mean": 6, "total": 4})
expression("ts_m6", timeseries.m6(), "select ts sample_time, value sample_value from events where event_id >= 0 and event_id < 720")
expression("ts_m7", timeseries.m7(), "select ts sample_time, value sample_value from events where event_id >= 6336 and event_id < 7056")

# -- projection and predicates -------------------------------------------------------

T = lambda n: q.Table(Sym(n))

expression("scan_table", q.Project(q.Table(q.key(q.List(1, 2, 3)), q.label(q.List("a", "b", "c"))), q.As(s.key, s.key, s.label, s.label)), "select * from (values (1::bigint, 'a'), (2, 'b'), (3, 'c')) t(key, label)")
expression("project_arith", q.Project(T("part"), q.As(s.p_partkey, s.p_partkey, s.total, q.Plus(s.p_size, s.p_size, 1), s.scaled, q.Times(s.p_size, 2, s.p_size), s.less, q.Minus(s.p_partkey, s.p_size))), "select p_partkey, p_size + p_size + 1 total, p_size * 2 * p_size scaled, p_partkey - p_size less from part")
expression("project_predicate", q.Project(T("part"), q.As(s.p_partkey, s.p_partkey, s.large, q.Greater(s.p_size, 25), s.small, q.Greater(25, s.p_size), s.both, q.And(q.Greater(s.p_size, 10), q.Greater(40, s.p_size)))), "select p_partkey, p_size > 25 large, p_size < 25 small, p_size > 10 and p_size < 40 as both from part")
expression("select_equal", q.Select(T("nation"), q.Where(q.Equal(s.n_regionkey, 2))), "select * from nation where n_regionkey = 2")
expression("select_greater_swapped", q.Project(q.Select(T("customer"), q.Where(q.Greater(0.0, s.c_acctbal))), tpch.keep("c_custkey", "c_acctbal")), "select c_custkey, c_acctbal from customer where c_acctbal < 0")
expression("select_and", q.Project(q.Select(T("orders"), q.Where(q.And(q.Equal(s.o_orderstatus, "F"), q.Greater(s.o_totalprice, 100000.0), q.Greater(q.DateObject("1997-01-01"), s.o_orderdate)))), tpch.keep("o_orderkey", "o_totalprice")), "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000 and o_orderdate < date '1997-01-01'")
expression("select_between", q.Project(q.Select(T("orders"), q.Where(q.Between(s.o_orderdate, q.Date("1996-01-01"), q.Date("1996-03-31")))), tpch.keep("o_orderkey", "o_orderdate")), "select o_orderkey, o_orderdate from orders where o_orderdate between date '1996-01-01' and date '1996-03-31'")
expression("select_or_not_less", q.Project(q.Select(T("part"), q.Where(q.Or(q.Less(s.p_size, 5), q.Not(q.Less(s.p_size, 48))))), tpch.keep("p_partkey", "p_size")), "select p_partkey, p_size from part where p_size < 5 or not p_size < 48")
expression("select_if", q.Project(T("orders"), q.As(s.o_orderkey, s.o_orderkey, s.kind, q.If(q.Greater(s.o_totalprice, 150000.0), "large", "small"))), "select o_orderkey, case when o_totalprice > 150000 then 'large' else 'small' end kind from orders")
expression("select_contains", q.Project(q.Select(T("part"), q.Where(q.StringContainsQ(s.p_name, "red"))), tpch.keep("p_partkey", "p_name")), "select p_partkey, p_name from part where contains(p_name, 'red')")
expression("select_contains_wildcards", q.Group(q.Select(T("documents"), q.Where(q.StringContains(s.text, "%%%"))), q.As(s.n, q.Count("*"))), "select count(*) n from documents where contains(text, '%%%')")
expression("select_true", q.Select(T("region"), q.Where(q.Function(True))), "select * from region")
expression("select_false", q.Select(T("region"), q.Where(q.Function(False))), "select * from region where false")
expression("project_all_selfjoin", q.Project(q.Join(q.ProjectAll(T("nation"), "a"), q.ProjectAll(T("nation"), "b"), q.Where(q.Equal(Sym("a.n_regionkey"), Sym("b.n_regionkey")))), q.As(s.left, Sym("a.n_name"), s.right, Sym("b.n_name"))), "select a.n_name \"left\", b.n_name \"right\" from nation a join nation b using (n_regionkey)")
expression("sexpr_query", lambda _: read_sexpr('(Group (Select (Table lineitem) (Where (Greater l_quantity 45))) (By l_returnflag) (As n (Count "*")))'), "select l_returnflag, count(*) n from lineitem where l_quantity > 45 group by all")

# -- joins ---------------------------------------------------------------------------

expression("join_single", q.Project(q.Join(T("nation"), T("supplier"), q.Where(q.Equal(s.n_nationkey, s.s_nationkey))), tpch.keep("s_suppkey", "n_name")), "select s_suppkey, n_name from nation join supplier on n_nationkey = s_nationkey")
expression("join_composite", q.Group(q.Join(tpch.partsupp(), T("lineitem"), q.Where(q.Equal(q.List(s.ps_partkey, s.ps_suppkey), q.List(s.l_partkey, s.l_suppkey)))), q.By(s.ps_suppkey), q.As(s.n, q.Count("*"), s.cost, q.Sum(s.ps_supplycost))), f"select ps_suppkey, count(*) n, round(sum(ps_supplycost), 2) \"cost\" from ({_PARTSUPP}) join lineitem on ps_partkey = l_partkey and ps_suppkey = l_suppkey group by all", {"cost": 2})
expression("join_composite_and", q.Group(q.Join(tpch.partsupp(), T("lineitem"), q.Where(q.And(q.Equal(s.ps_partkey, s.l_partkey), q.Equal(s.l_suppkey, s.ps_suppkey)))), q.As(s.n, q.Count("*"))), "select count(*) n from lineitem")
expression("join_nway", q.Group(q.Join(q.Join(T("region"), T("nation"), q.Where(q.Equal(s.r_regionkey, s.n_regionkey))), q.Join(T("customer"), T("orders"), q.Where(q.Equal(s.c_custkey, s.o_custkey))), q.Where(q.Equal(s.n_nationkey, s.c_nationkey))), q.By(s.r_name), q.As(s.n, q.Count("*"), s.most, q.Max(s.o_totalprice))), "select r_name, count(*) n, max(o_totalprice) most from region, nation, customer, orders where r_regionkey = n_regionkey and n_nationkey = c_nationkey and c_custkey = o_custkey group by all")
expression("join_semi_idiom", q.Group(q.Join(q.Select(q.Group(tpch.table("lineitem", "l_orderkey", "l_quantity"), q.By(s.l_orderkey), q.As(s.qty, q.Sum(s.l_quantity))), q.Where(q.Greater(s.qty, 200.0))), T("orders"), q.Where(q.Equal(s.l_orderkey, s.o_orderkey))), q.By(s.o_orderstatus), q.As(s.n, q.Count("*"))), "select o_orderstatus, count(*) n from orders where o_orderkey in (select l_orderkey from lineitem group by 1 having sum(l_quantity) > 200) group by all")


@frames("join_partitioned", "select o_orderpriority, count(*) n from orders join lineitem on o_orderkey = l_orderkey group by all")
def _join_partitioned(engine, sf_dir):
    """Both sides dealt alike by key, then joined with no other shuffle."""
    left = radix_partition(engine.named("orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], 16)
    right = radix_partition(engine.named("lineitem").select("l_orderkey"), ["l_orderkey"], 16)
    return left.hint("shuffle_hash").join(right, left["o_orderkey"] == right["l_orderkey"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@frames("join_position", "select event_id, event_type, value from events where user_id in (select user_id from events where event_type = 'error' and value > 150)")
def _join_position(engine, sf_dir):
    """A join reduced to positions, then a late gather of the other columns."""
    events = engine.named("events")
    users = events.where("event_type = 'error' and value > 150").select(F.col("user_id").alias("wanted_user")).distinct()
    at = events.select("event_id", "user_id").join(users, F.col("user_id") == F.col("wanted_user")).select(F.col("event_id").alias("want"))
    return gather(events, "event_id", at, "want", ["event_id", "event_type", "value"])


@frames("join_range", "select c_seq_no, count(*) n, round(sum(value), 4) total from (select event_id // 100 c_seq_no, min(event_id) a, max(event_id) + 1 b from events group by 1) c join events on event_id >= a and event_id < b group by all", {"total": 4})
def _join_range(engine, sf_dir):
    """Every segment with the samples in its range."""
    events = engine.named("events").select("event_id", "value")
    seg = events.groupBy(F.call_function("div", "event_id", F.lit(100)).alias("c_seq_no")).agg(F.min("event_id").alias("a"), (F.max("event_id") + 1).alias("b"))
    return range_join(events, "event_id", seg, "a", "b").groupBy("c_seq_no").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# -- aggregation -----------------------------------------------------------------------

expression("group_keyed", q.Group(T("orders"), q.By(s.o_orderstatus, s.o_orderpriority), q.As(s.n, q.Count("*"), s.total, q.Sum(s.o_totalprice))), "select o_orderstatus, o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total from orders group by all", {"total": 2})
expression("group_global", q.Group(T("orders"), q.As(s.n, q.Count("*"), s.total, q.Sum(s.o_totalprice))), "select count(*) n, round(sum(o_totalprice), 2) total from orders", {"total": 2})
expression("group_unnamed", q.Group(T("lineitem"), q.By(s.l_returnflag), q.Sum(s.l_quantity)), "select l_returnflag, sum(l_quantity) l_quantity from lineitem group by all")
expression("group_unnamed_several", q.Group(T("lineitem"), q.By(s.l_linestatus), q.Sum(s.l_quantity), q.Max(s.l_tax)), "select l_linestatus, sum(l_quantity) l_quantity, max(l_tax) l_tax from lineitem group by all")
expression("agg_sum", q.Group(T("part"), q.As(s.total, q.Sum(s.p_size))), "select cast(sum(p_size) as bigint) total from part")
expression("agg_count", q.Group(T("documents"), q.As(s.n, q.Count(s.text), s.n_rows, q.Count("*"))), "select count(text) n, count(*) n_rows from documents")
expression("agg_avg", q.Group(T("part"), q.By(s.p_brand), q.As(s.mean, q.Avg(s.p_retailprice))), "select p_brand, round(avg(p_retailprice), 6) mean from part group by all", {"mean": 6})
expression("agg_min", q.Group(T("orders"), q.By(s.o_orderstatus), q.As(s.first, q.Min(s.o_orderdate))), "select o_orderstatus, min(o_orderdate) \"first\" from orders group by all")
expression("agg_max", q.Group(T("orders"), q.By(s.o_orderstatus), q.As(s.most, q.Max(s.o_totalprice))), "select o_orderstatus, max(o_totalprice) most from orders group by all")
expression("agg_bare_count", q.Group(T("supplier"), s.Count), "select count(*) count from supplier")
expression("agg_constant_key", q.Group(T("supplier"), q.Function(0), s.Count), "select count(*) count, 0 as key from supplier")
expression("having_idiom", q.Select(q.Group(T("lineitem"), q.By(s.l_suppkey), q.As(s.qty, q.Sum(s.l_quantity))), q.Where(q.Greater(s.qty, 15000.0))), "select l_suppkey, sum(l_quantity) qty from lineitem group by all having sum(l_quantity) > 15000")
expression("agg_arith", q.Project(q.Group(T("lineitem"), q.By(s.l_linestatus), q.As(s.a, q.Sum(s.l_quantity), s.n, q.Count("*"))), q.As(s.l_linestatus, s.l_linestatus, s.mean, q.Divide(s.a, s.n))), "select l_linestatus, round(sum(l_quantity) / count(*), 6) mean from lineitem group by all", {"mean": 6})

# -- order -------------------------------------------------------------------------------

expression("order_multi", q.Order(tpch.table("nation", "n_regionkey", "n_name"), q.By(s.n_regionkey, s.desc, s.n_name)), "select n_regionkey, n_name from nation order by 1 desc, 2")
expression("order_aliases", q.SortBy(q.Sort(q.OrderBy(tpch.table("region", "r_name"), q.By(s.r_name)), q.By(s.r_name, s.desc)), q.By(s.r_name)), "select r_name from region order by 1")
expression("top_n", q.Top(tpch.table("orders", "o_orderkey", "o_totalprice"), q.By(s.o_totalprice, s.o_orderkey), 15), "select o_orderkey, o_totalprice from orders order by 2, 1 limit 15")
expression("top_n_desc", q.TopN(tpch.table("orders", "o_orderkey", "o_totalprice"), q.By(s.o_totalprice, s.desc, s.o_orderkey), 15), "select o_orderkey, o_totalprice from orders order by 2 desc, 1 limit 15")

# -- sets --------------------------------------------------------------------------------

expression("union_rows", q.Union(q.Project(T("region"), q.As(s.id, s.r_regionkey, s.name, s.r_name)), q.Project(T("nation"), q.As(s.name, s.n_name, s.id, s.n_nationkey))), "select r_regionkey id, r_name name from region union all select n_nationkey, n_name from nation")
expression("append_positional", q.Append(tpch.table("region", "r_regionkey", "r_name"), T("nation")), "select r_regionkey, r_name from region union all select n_nationkey, n_name from nation")

# -- scalar functions ------------------------------------------------------------------

expression("fn_year", q.Group(q.Project(T("orders"), q.As(s.y, q.Year(s.o_orderdate))), q.By(s.y), q.As(s.n, q.Count("*"))), "select cast(year(o_orderdate) as integer) y, count(*) n from orders group by all")
expression("fn_date", q.Project(T("orders"), q.As(s.o_orderkey, s.o_orderkey, s.late, q.Greater(s.o_orderdate, q.DateObject("1998-08-31T00:00")), s.on_day, q.Equal(s.o_orderdate, q.Date("1995-03-15")), s.y, q.Year(q.Date("1995-03-15")))), "select o_orderkey, o_orderdate > date '1998-08-31' late, o_orderdate = date '1995-03-15' on_day, 1995::integer y from orders")
expression("fn_unixtime", q.Project(T("orders"), q.As(s.o_orderkey, s.o_orderkey, s.t, q.UnixTime(s.o_orderdate), s.fixed, q.UnixTime("2024-07-01 12:00:00", q.Rule(s.TimeZone, "Europe/Berlin")))), "select o_orderkey, cast(epoch(o_orderdate) as bigint) t, 1719828000::bigint fixed from orders")
expression("fn_concat", q.Project(T("nation"), q.As(s.n_nationkey, s.n_nationkey, s.label, q.StringJoin("<", s.n_name, ">"))), "select n_nationkey, concat('<', n_name, '>') label from nation")
expression("fn_divide", q.Project(T("part"), q.As(s.p_partkey, s.p_partkey, s.ratio, q.Divide(s.p_partkey, 2), s.whole, q.IntDivide(s.p_partkey, 2))), "select p_partkey, p_partkey / 2 ratio, p_partkey // 2 whole from part")
expression("fn_multiply_subtract", q.Project(T("part"), q.As(s.p_partkey, s.p_partkey, s.x, q.Multiply(s.p_size, 3), s.y, q.Subtract(s.p_size, 3))), "select p_partkey, p_size * 3 x, p_size - 3 y from part")


@frames("fn_span_sum", "select user_id, sum(event_id)::bigint total, 1 + 2 + 3 + user_id as written from events group by all")
def _span_sum(engine, sf_dir):
    """Plus over an array column and over a span that is written out."""
    spans = engine.named("events").groupBy("user_id").agg(F.collect_list("event_id").alias("ids"))
    return engine.evaluate(q.Project(_as_table(engine, spans), q.As(s.user_id, s.user_id, s.total, q.Plus(q.Span(s.ids)), s.written, q.Plus(q.List(1, 2, 3, s.user_id)))))


@frames(
    "fn_interpolate",
    """with e as (select event_id, user_id, case when event_id % 3 = 1 then null else value end v from events),
 n as (select *, last_value(v ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) b,
 first_value(v ignore nulls) over (partition by user_id order by event_id rows between 1 following and unbounded following) a from e)
 select event_id, user_id, round(coalesce(v, (b + a) / 2), 6) v from n""",
    {"v": 6},
)
def _interpolate(engine, sf_dir):
    events = engine.named("events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 1, F.col("value")).alias("v"))
    return interpolate(events, "event_id", "v", ["user_id"])


# -- sources and positions ---------------------------------------------------------------

expression("scan_parquet_bounds", lambda d: q.GetColumnsFromParquet("parquet", f"{d}/orders.parquet", q.List(q.o_orderkey(q.List(100, 2000)), q.o_totalprice(q.ALL()), q.o_orderdate(q.List(q.DateObject("1995-06-01"), q.DateObject("1997-06-01"))))), "select o_orderkey, o_totalprice, o_orderdate from orders where o_orderkey between 100 and 2000 and o_orderdate between date '1995-06-01' and date '1997-06-01'")
expression("gather_rows", lambda d: q.Gather(f"{d}/events.parquet", "parquet", q.List(q.List(5, 77, 5, 902)), q.List(s.event_id, s.event_type), q.IndexColumn(s.pos)), "select event_id, event_type, event_id pos from events join (values (5), (77), (5), (902)) w(i) on event_id = i")
expression("gather_all", lambda d: q.Gather(f"{d}/events.parquet", "parquet", q.List(), q.List(s.event_id, s.value), q.IndexColumn(s.pos)), "select event_id, value, event_id pos from events")
expression("gather_from_table", lambda d: q.Gather(f"{d}/events.parquet", "parquet", q.As(s.want, q.Project(q.Select(T("events"), q.Where(q.Equal(s.event_type, "signup"))), q.As(s.want, s.event_id))), q.List(s.event_id, s.user_id)), "select event_id, user_id from events where event_type = 'signup'")
expression("gather_tables", lambda d: q.GatherTables("parquet", s.url, q.Table(q.url(q.List(f"{d}/nation.parquet", f"{d}/nation.parquet"))), q.List(), q.List(s.n_nationkey, s.n_name)), "select n_nationkey, n_name from nation")
expression("parse_tables", lambda d: q.ParseTables("parquet", q.List(f"{d}/region.parquet")), "select * from region")


_RANGES = q.Table(q.a(q.List(10, 15, 100, 500, 990)), q.b(q.List(20, 30, 100, 490, 1000)))
expression("gather_ranges", q.GatherRanges(q.Project(T("events"), q.As(s.pos, s.event_id, s.event_id, s.event_id, s.value, s.value)), "parquet", s.a, s.b, _RANGES, q.List(s.event_id, s.value), q.Keep(s.a), q.RangeIndex(s.r)), "select event_id, value, a::bigint a, r::bigint r from (values (10, 20, 0), (15, 30, 1), (100, 100, 2), (500, 490, 3), (990, 1000, 4)) r(a, b, r) join events on event_id >= a and event_id < b")


@frames("gather_ranges_url", "select event_id, user_id from (values (10, 20), (15, 30), (700, 710)) r(a, b) join events on event_id >= a and event_id < b")
def _gather_ranges_url(engine, sf_dir):
    ranges = q.Table(q.a(q.List(10, 15, 700)), q.b(q.List(20, 30, 710)))
    return engine.evaluate(q.GatherRanges(f"{sf_dir}/events.parquet", "parquet", s.a, s.b, ranges, q.List(s.event_id, s.user_id)))


@frames("partial_table", "select event_id pos, value, event_id wanted from events where event_type = 'purchase'")
def _partial_table(engine, sf_dir):
    """The table's own column `wanted` holds the positions of the rows that stay.  Ids are not positions:
    they may have gaps, come twice or be null; rows that tie are alike in all that is read."""
    numbered = add_indices(engine.named("events").select("event_id", "event_type", "value"), "pos", ["event_id", "event_type", "value"])
    wanted = F.when(F.col("event_type") == "purchase", F.col("pos"))
    out = engine.evaluate(q.PartialTable(_as_table(engine, numbered.select("pos", "event_id", "value", wanted.alias("wanted"))), s.wanted))
    return out.select(F.col("event_id").alias("pos"), "value", F.col("event_id").alias("wanted"))


@frames("add_indices", "select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) - 1 pos from orders")
def _add_indices(engine, sf_dir):
    return add_indices(engine.named("orders").select("o_orderkey", "o_totalprice"), "pos", ["o_orderkey"])


@frames("add_indices_select", "select event_id, event_id as idx from events where value > 120")
def _add_indices_select(engine, sf_dir):
    return engine.evaluate(q.Project(q.Select(q.AddIndices(tpch.table("events", "event_id", "value"), s.idx), q.Where(q.Greater(s.value, 120.0))), tpch.keep("event_id", "idx")))


@frames("radix_partition", "select l_suppkey, count(*) n from lineitem group by all")
def _radix_partition(engine, sf_dir):
    return engine.evaluate(q.Group(q.RadixPartition(tpch.table("lineitem", "l_suppkey"), q.By(s.l_suppkey), 16), q.By(s.l_suppkey), q.As(s.n, q.Count("*"))))


@frames("scan_bounds_pushed", "select l_orderkey, l_quantity from lineitem where l_quantity between 10 and 12")
def _scan_bounds_pushed(engine, sf_dir):
    return parquet_columns(engine.spark, f"{sf_dir}/lineitem.parquet", {"l_orderkey": None, "l_quantity": (10.0, 12.0)})


# -- encodings and named tables ------------------------------------------------------------

_CODES = "(select event_type, row_number() over (order by min(event_id)) - 1 code from events group by 1)"


@frames("encode_table", f"select event_id, cast(code as integer) event_type from events join {_CODES} using (event_type)")
def _encode(engine, sf_dir):
    return engine.codec.encode(engine.named("events").select("event_id", "event_type"), "event_id")


@frames("decode_table", "select event_id, case when event_id % 100 = 0 then 'INVALID_ENCODING' else event_type end event_type from events")
def _decode(engine, sf_dir):
    coded = engine.codec.encode(engine.named("events").select("event_id", "event_type"), "event_id")
    broken = coded.withColumn("event_type", F.when(F.col("event_id") % 100 == 0, F.lit(99)).otherwise(F.col("event_type")))
    return engine.codec.decode(broken)


@frames("get_encoding", "select event_id from events where event_type = 'purchase'")
def _get_encoding(engine, sf_dir):
    coded = engine.codec.encode(engine.named("events").select("event_id", "event_type"), "event_id")
    return engine.evaluate(q.Project(q.Select(q.Project(_as_table(engine, coded), tpch.keep("event_id", "event_type")), q.Where(q.Equal(s.event_type, q.GetEncodingFor("purchase", s.event_type)))), tpch.keep("event_id")))


def _as_table(engine, df: DataFrame) -> Sym:
    engine.catalog["given"] = df
    return s.given


@frames("save_get_table", "select o_orderstatus, count(*) n from orders where o_totalprice > 200000 group by all")
def _save_get(engine, sf_dir):
    engine.evaluate(q.SaveTable(q.Select(T("orders"), q.Where(q.Greater(s.o_totalprice, 200000.0))), s.kept))
    return engine.evaluate(q.Group(q.GetTable(s.kept), q.By(s.o_orderstatus), q.As(s.n, q.Count("*"))))


@frames("for_decode", "select event_id pos, user_id v from events")
def _for_decode(engine, sf_dir):
    events = engine.named("events").select(F.col("event_id").alias("pos"), "user_id").withColumn("frame", F.call_function("div", "pos", F.lit(64)))
    books = events.groupBy("frame").agg(F.min("user_id").alias("ref"))
    diffs = events.join(books, "frame").select("pos", (F.col("user_id") - F.col("ref")).alias("diff"))
    return codec.decode_frames(diffs, "pos", "diff", books, "frame", "ref", 64, "v")


@frames("bitpack_decode", "select event_id pos, event_id % 16 v from events")
def _bitpack(engine, sf_dir):
    """The last word need not be full: as many values come out as went in."""
    events = engine.named("events").select(F.call_function("div", "event_id", F.lit(4)).alias("word"), (F.col("event_id") % 4).alias("i"), (F.col("event_id") % 16).alias("v"))
    packed = events.groupBy("word").agg(F.expr("cast(sum(shiftleft(v, cast(i * 4 as int))) as bigint)").alias("packed"), F.count(F.lit(1)).alias("n"))
    each = packed.select("word", "packed", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return codec.unpack_bits(each, "packed", 4, "i", "v").select((F.col("word") * 4 + F.col("i")).alias("pos"), "v")


@frames("sequence_decode", "select i pos, 1000 + 7 * i v from range(500) t(i)")
def _sequence(engine, sf_dir):
    return codec.decode_sequence(engine.spark, 1000, 7, 500, "v")


@frames("constant_decode", "select 42 v from range(100)")
def _constant(engine, sf_dir):
    return codec.decode_constant(engine.spark, 42, 100, "v")


@frames("dictionary_decode", "select event_id, event_type from events")
def _dictionary(engine, sf_dir):
    events = engine.named("events").select("event_id", "event_type")
    coded = engine.codec.encode(events, "event_id")
    return codec.decode_dictionary(coded.withColumnRenamed("event_type", "code"), "code", engine.codec.dictionaries["event_type"], "code", "value", "event_type").select("event_id", "event_type")


@frames("rle_decode", "select event_id pos, event_id // 250 v from events")
def _rle(engine, sf_dir):
    events = engine.named("events").select(F.col("event_id").alias("pos"))
    runs = events.groupBy(F.call_function("div", "pos", F.lit(250)).alias("value")).agg(F.min("pos").alias("start"))
    total = events.agg(F.max("pos") + 1).first()[0]
    return codec.decode_runs(events, "pos", runs, "start", "value", total, "v")


# -- columns that are encoded in the query ---------------------------------------------------

_ENCODED = q.Table(
    q.runs(q.RLEList(q.List(0, 3, 4), q.List(7, 8, 9))), q.frames(q.FORList(3, 6, q.List(100, 200), q.List(0, 1, 2, 0, 5, 6))),
    q.packed(q.BitPackedList(4, 6, "INT16", "INT64", q.List(0x4321, 0x65))), q.one(q.SingleValueList(64, 6, "INT64", 42)),
    q.steps(q.SequenceEncodedList(10, -3, 6)), q.numbers(q.DictionaryEncodedList(q.List(1.5, 2.5), q.List(0, 1, 0, 1, 1, 0))),
    q.codes(q.DictionaryEncodedList(q.List("x", "y"), q.List(1, 0, 1, 0, 0, 1))), q.plain(q.List("a", "b", "c", "d", "e", "f")),
)
_ENCODED_SQL = """(select i, [7, 7, 7, 8, 9, 9][i + 1]::bigint runs, [100, 101, 102, 200, 205, 206][i + 1]::bigint frames, (i + 1)::bigint packed, 42::bigint one,
 (10 - 3 * i)::bigint steps, [1.5, 2.5, 1.5, 2.5, 2.5, 1.5][i + 1]::double numbers, [1, 0, 1, 0, 0, 1][i + 1]::integer codes, ['a', 'b', 'c', 'd', 'e', 'f'][i + 1] plain from range(6) t(i))"""
expression("encoded_columns", _ENCODED, f"select * exclude (i) from {_ENCODED_SQL}")
expression("encoded_texts", q.DecodeTable(q.Project(_ENCODED, tpch.keep("plain", "codes"))), f"select plain, ['x', 'y'][codes + 1] codes from {_ENCODED_SQL}")
expression("get_encoding_url", lambda d: q.GetEncodingForFromURL("purchase", s.event_type, f"{d}/events.parquet"), f"select code from {_CODES} where event_type = 'purchase'")
expression("get_encoding_url_absent", lambda d: q.GetEncodingForFromURL("no such type", s.event_type, f"{d}/events.parquet"), "select -1::bigint code")

# -- bytes, files, local positions -------------------------------------------------------------

expression("gather_local", q.GatherRows(q.Table(q.k(q.List(10, 20, 30, 40)), q.v(q.List("a", "b", "c", "d"))), q.List(3, 0, 3)), "select * from (values (40::bigint, 'd'), (10, 'a'), (40, 'd')) t(k, v)")
expression("merge_columns", q.MergeColumns(q.Order(tpch.table("nation", "n_nationkey"), q.By(s.n_nationkey)), q.Order(tpch.table("supplier", "s_suppkey"), q.By(s.s_suppkey))), "select n_nationkey, s_suppkey from (select n_nationkey, row_number() over (order by n_nationkey) i from nation) join (select s_suppkey, row_number() over (order by s_suppkey) i from supplier) using (i)")

# -- other forms of the time-series queries ------------------------------------------------------

for _name, _other in {"ts_m1": timeseries.m1_gathered(), "ts_m2": timeseries.m2_wide(), "ts_m3": timeseries.m3_gathered(), "ts_m4": timeseries.m4_gathered(), "ts_m5": timeseries.m5_gathered(), "ts_m6": timeseries.m6_wide()}.items():
    expression(f"{_name}_other", _other, ORACLES[_name], {"ts_m1": {"total": 4}, "ts_m2": {"total": 4}, "ts_m3": {"mean": 6}, "ts_m5": {"mean": 6, "total": 4}}.get(_name))

# -- control plane and data definition: each query is a table of what its expressions gave ---------


def control_plane(name: str, *steps, sql: str) -> None:
    """Registers a query whose row is what each of (column, expression or function of (engine, folder)) gave, as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine, out = Engine.over_parquet(spark, sf_dir), {}
        for step in steps:
            column_name, e = step if isinstance(step, tuple) else (None, step)
            got = e(engine, sf_dir) if callable(e) and not isinstance(e, (Expr, Sym)) else engine.evaluate(e)
            if column_name:
                if isinstance(got, DataFrame):
                    got = sorted(tuple(r) for r in got.collect())
                out[column_name] = str(got).lower() if isinstance(got, bool) else str(got)
        return spark.createDataFrame([tuple(out.values())], ", ".join(f"`{c}` string" for c in out))

    QUERIES[name], ORACLES[name] = run, sql


def _restored(key: str, *steps):
    """What the steps gave, with a session setting put back afterwards."""

    def run(engine, sf_dir):
        before = engine.spark.conf.get(key, None)
        try:
            return [engine.evaluate(e) for e in steps[:-1]] and steps[-1](engine)
        finally:
            engine.spark.conf.unset(key) if before is None else engine.spark.conf.set(key, before)

    return run


_COUNT = lambda e: q.Group(e, q.As(s.n, q.Count("*")))
control_plane("ddl_tables", q.CreateTable(s.made, Sym("id:BIGINT"), Sym("name:VARCHAR:10"), Sym("at:DATE")), q.InsertInto(s.made, 1, "one", q.DateObject("2024-02-03")), q.InsertInto(s.made, 2, "two", q.DateObject("2024-02-04")), ("n_rows", _COUNT(q.Table(s.made))), ("schema", q.Schema(s.made)), ("some", q.Project(q.Select(q.Table(s.made), q.Where(q.Equal(s.id, 2))), tpch.keep("id", "name"))), sql="select '[(2,)]' n_rows, 'List(List(id, ''bigint''), List(name, ''string''), List(at, ''date''))' as schema, '[(2, ''two'')]' \"some\"")
control_plane("ddl_load", lambda engine, d: engine.evaluate(q.Load(s.loaded, f"{d}/nation.parquet")), ("n_rows", _COUNT(q.Table(s.loaded))), sql="select '[(' || count(*) || ',)]' n_rows from nation")
control_plane("control_variables", q.Set(s.x, 5), ("x", s.x), ("more", q.Increment(s.x)), ("none", q.Increment("text")), ("same", q.Equals(s.x, 5)), ("other", q.NotEquals(q.List(1, s.x), q.List(1, 6))), ("sum", q.Plus(s.x, 2)), ("symbol", q.Symbol("y")), sql="select '5' x, '6' more, '0' none, 'true' same, 'true' other, '7' sum, 'y' symbol")
control_plane("control_guards", ("open", q.EvaluateIf(q.Equals(1, 1), q.Plus(1, 2))), ("closed", q.EvaluateIf(q.Equals(1, 2), q.Plus(1, 2))), ("cycle", q.NonLECycle(q.Plus(20, 3))), ("passes", q.EvaluateInEngines(q.List(s.identity), q.Plus(1, 1))), ("pipeline", q.SetDefaultEnginePipeline(s.identity)), ("after", q.Plus(2, 2)), ("reset", q.ResetEngines()), sql="select '3' \"open\", 'EvaluateIf(Equals(1, 2), __Plus(1, 2))' closed, '23' \"cycle\", '2' passes, 'true' pipeline, '4' \"after\", 'true' \"reset\"")
control_plane("control_settings", ("knob", _restored("spark.sql.shuffle.partitions", q.Set(s.maxThreads, 7), lambda engine: engine.spark.conf.get("spark.sql.shuffle.partitions"))), ("threads", _restored("spark.sql.files.minPartitionNum", q.SetNumThreads(3), lambda engine: engine.spark.conf.get("spark.sql.files.minPartitionNum"))), ("spans", _restored("spark.sql.files.minPartitionNum", q.SetNumSpansOut(5), lambda engine: engine.spark.conf.get("spark.sql.files.minPartitionNum"))), ("parallel", q.Let(_COUNT(q.Table(s.nation)), q.Parallel(2))), ("cleared", q.ClearCaches()), sql="select '7' knob, '3' threads, '5' spans, '[(' || count(*) || ',)]' parallel, 'true' cleared from nation")
control_plane("control_errors", ("unknown", q.NoSuchHead(q.Plus(1, 2))), ("failed", lambda engine, d: engine.safe_evaluate(q.Table(s.no_such_table)).head), ("knows", lambda engine, d: Sym("Group") in engine.evaluate(q.GetEngineCapabilities()).args), ("absent", q.GetEncodingFor("x", s.no_such_column)), sql="select 'NoSuchHead(3)' unknown, case when true then 'ErrorWhenEvaluatingExpression' end failed, 'true' knows, 'InvalidKeyForColumn(''x'', no_such_column)' \"absent\"")
control_plane("control_tables", q.SaveTable(T("region"), s.kept), ("kept", _COUNT(q.GetTable(s.kept))), ("cleared", q.ClearTables()), ("gone", lambda engine, d: engine.safe_evaluate(q.GetTable(s.kept)).head), sql="select '[(' || count(*) || ',)]' kept, 'true' cleared, 'ErrorWhenEvaluatingExpression' gone from region")
def _tracked(e, url: str = ""):
    """The bytes that tracking tells for a query."""

    def run(engine) -> int:
        engine.evaluate(q.StartTrackingOverhead())
        engine.evaluate(e)
        return engine.evaluate(q.GetOverhead(url) if url else q.GetTotalOverhead())

    return run


_whole, _narrow = _tracked(T("orders")), _tracked(tpch.table("orders", "o_orderkey"))
control_plane("control_overhead", ("some", lambda engine, d: 0 < _narrow(engine) < _whole(engine)), ("same", lambda engine, d: _tracked(T("orders"), "orders")(engine) == _whole(engine)), ("other", lambda engine, d: _tracked(T("orders"), "nation")(engine)), ("length", lambda engine, d: engine.evaluate(q.GetFileLength(f"{d}/orders.parquet")) > _whole(engine)), ("stopped", q.StopTrackingOverhead()), sql="select 'true' \"some\", 'true' same, '0' other, 'true' length, 'true' stopped")
control_plane("control_readers", ("parsed", q.Parse(to_json(q.Plus(1, q.Times(2, 3))))), ("bytes", q.Parse(q.ByteSequence(to_json(q.Plus(1, 1))))), ("path", lambda engine, d: engine.evaluate(read_path("1/:Plus/2"))), ("fetched", lambda engine, d: _files_read(engine.evaluate(q.Fetch(f"{d}/region.parquet", f"{d}/nation.parquet")))), sql="select '7' parsed, '2' bytes, '3' path, '2' fetched")


def _files_read(df: DataFrame) -> int:
    return df.where("length > 0 and length(content) = length").count()
