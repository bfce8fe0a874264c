"""Relational heads: Project, Select, Join, Group, Order, Top, Union and their like.

All give lazy DataFrames; join order, strategy and partial aggregation are the planner's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expr import Expr, Sym
from ..functions.aggregates import compile_aggregate, default_name, is_aggregate
from ..functions.scalar import column, compile_scalar
from ..registry import relation


def aliases(args) -> list[tuple[str, object]]:
    """(name, expression) of As(name, expression, ...) heads."""
    out = []
    for a in args:
        if not (isinstance(a, Expr) and a.head == "As"):
            raise ValueError(f"As(...) is wanted, not {a!r}")
        if len(a.args) % 2:
            raise ValueError("As takes names and expressions by turns")
        out += [((n.name if isinstance(n, Sym) else str(n)).lower(), e) for n, e in zip(a.args[::2], a.args[1::2])]
    return out


@relation("Project")
def project(engine, args) -> DataFrame:
    """Project(input, As(name, expression, ...)): these columns and no others."""
    df = engine.frame(args[0])
    return df.select(*[compile_scalar(e, engine).alias(n) for n, e in aliases(args[1:])])


@relation("ProjectAll")
def project_all(engine, args) -> DataFrame:
    """ProjectAll(input, prefix): every column renamed to prefix.column, for self joins."""
    df, prefix = engine.frame(args[0]), (args[1].name if isinstance(args[1], Sym) else str(args[1])).lower()
    return df.select(*[column(c).alias(f"{prefix}.{c.lower()}") for c in df.columns])


@relation("Select")
def select(engine, args) -> DataFrame:
    """Select(input, Where(predicate))."""
    return engine.frame(args[0]).where(compile_scalar(args[1], engine))


def _keys(e) -> list[str]:
    items = e.args if isinstance(e, Expr) and e.head in ("List", "By") else (e,)
    if not all(isinstance(x, Sym) for x in items):
        raise ValueError(f"join keys are columns, not {e!r}")
    return [x.name.lower() for x in items]


def _owned(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


@relation("Join")
def join(engine, args) -> DataFrame:
    """Join(build, probe, Where(Equal(key, key))): inner equi-join, build columns
    first.  Keys of several columns are Equal(List(a, b), List(c, d)) or And(Equal(a, c), Equal(b, d))."""
    build, probe, where = args
    left, right = engine.frame(build), engine.frame(probe)
    test = where.args[0] if isinstance(where, Expr) and where.head == "Where" else where
    parts = test.args if isinstance(test, Expr) and test.head == "And" else (test,)
    pairs: list[tuple[str, str]] = []
    for p in parts:
        if not (isinstance(p, Expr) and p.head == "Equal" and len(p.args) == 2):
            raise ValueError(f"an equality of keys is wanted, not {p!r}")
        a, b = map(_keys, p.args)
        if len(a) != len(b):
            raise ValueError("the two sides have different numbers of keys")
        pairs += zip(a, b)
    # Either side of an equality may name either input.
    own = {c.lower() for c in left.columns}
    pairs = [(a, b) if a in own else (b, a) for a, b in pairs]
    on = reduce(lambda x, y: x & y, [_owned(left, a) == _owned(right, b) for a, b in pairs])
    return left.join(right, on, "inner")


@relation("Group")
def group(engine, args) -> DataFrame:
    """Group(input [, By(key, ...)] [, Function(constant)], aggregate ...): keys, then
    aggregates.  Aggregates are As(name, aggregate, ...) or stand alone."""
    df, keys, constant, found = engine.frame(args[0]), [], None, []
    for a in args[1:]:
        if isinstance(a, Expr) and a.head == "By":
            keys += [column(k.name).alias(k.name.lower()) for k in a.args]
        elif isinstance(a, Expr) and a.head == "Function":
            constant = a.args[-1]
        elif isinstance(a, Expr) and a.head == "As":
            found += aliases([a])
        elif is_aggregate(a):
            found.append((default_name(a), a))
        else:
            raise ValueError(f"not an aggregate: {a!r}")
    out = [compile_aggregate(e, engine).alias(n) for n, e in found]
    if constant is not None:
        # The constant is a key that the aggregate's column comes before.
        return df.groupBy(F.lit(constant).alias("key")).agg(*out).select(*[n for n, _ in found], "key")
    return df.groupBy(*keys).agg(*out) if keys else df.agg(*out)


def sort_keys(by) -> list[Column]:
    """By(key [desc], ...); nulls are last either way."""
    out: list[Column] = []
    items = list(by.args)
    for i, k in enumerate(items):
        if k == Sym("desc"):
            if not i or items[i - 1] == Sym("desc"):
                raise ValueError("desc stands behind a key")
            continue
        down = i + 1 < len(items) and items[i + 1] == Sym("desc")
        out.append(column(k.name).desc_nulls_last() if down else column(k.name).asc_nulls_last())
    return out


@relation("Order")
def order(engine, args) -> DataFrame:
    """Order(input, By(key [desc], ...))."""
    return engine.frame(args[0]).orderBy(*sort_keys(args[1]))


@relation("Top")
def top(engine, args) -> DataFrame:
    """Top(input, By(key [desc], ...), n)."""
    return engine.frame(args[0]).orderBy(*sort_keys(args[1])).limit(int(args[2]))


@relation("Union")
def union(engine, args) -> DataFrame:
    """Union(input, ...): the rows of all inputs, columns by name."""
    return reduce(lambda a, b: a.unionByName(b), map(engine.frame, args))


@relation("Append")
def append(engine, args) -> DataFrame:
    """Append(input, ...): rows of all inputs, columns by place under the first input's
    names; of further inputs no more columns than the narrowest has are taken."""
    frames = list(map(engine.frame, args))
    width = min(len(f.columns) for f in frames)
    cut = [f.select(*[column(c) for c in f.columns[:width]]) for f in frames]
    return reduce(lambda a, b: a.union(b), cut)


@relation("Interpolate")
def interpolate_head(engine, args) -> DataFrame:
    """Interpolate(input, x, y [, By(key, ...)])."""
    df, x, y = engine.frame(args[0]), args[1].name, args[2].name
    keys = [k.name for a in args[3:] for k in a.args]
    return interpolate(df, x, y, keys)


#: Rows of one sorted run in an interpolation.
RUN = 1 << 16


def interpolate(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """`df` with nulls of y filled by the mean of the nearest values before and
    after in the order of x; whole numbers are divided as such.  At either end,
    where one neighbour is missing, the null stays.

    Rows are numbered in the order of the groups and of x, and each RUN of them is sorted by itself;
    what reaches across runs are their first and last values, a row for each run and group."""
    from pyspark.sql import Window

    from .positions import add_indices

    keys = [f"ip__k{i}" for i in range(len(by))]
    rows = add_indices(df.withColumns({k: column(c) for k, c in zip(keys, by)}), "ip__n", [*keys, x, y]).withColumn("ip__run", F.floor(F.col("ip__n") / RUN))
    own, value = Window.partitionBy(*keys, "ip__run").orderBy("ip__n"), column(y)
    before = F.last(value, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing))
    known = rows.where(value.isNotNull()).groupBy(*keys, "ip__run").agg(F.min_by(value, "ip__n").alias("ip__first"), F.max_by(value, "ip__n").alias("ip__last"))
    ends = rows.select(*keys, "ip__run").distinct().alias("e").join(known.alias("k"), [F.col(f"e.{c}").eqNullSafe(F.col(f"k.{c}")) for c in [*keys, "ip__run"]], "left")
    ends = ends.select(*[F.col(f"e.{c}").alias(f"{c}_") for c in [*keys, "ip__run"]], "ip__first", "ip__last")
    runs = Window.partitionBy(*[f"{k}_" for k in keys]).orderBy("ip__run_")
    ends = ends.withColumns({
        "ip__before": F.last("ip__last", ignorenulls=True).over(runs.rowsBetween(Window.unboundedPreceding, -1)),
        "ip__after": F.first("ip__first", ignorenulls=True).over(runs.rowsBetween(1, Window.unboundedFollowing)),
    }).drop("ip__first", "ip__last")
    rows = rows.withColumns({"ip__b": before, "ip__a": after})
    on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in [*keys, "ip__run"]]
    rows = rows.join(ends, on)
    low, high = F.coalesce("ip__b", "ip__before"), F.coalesce("ip__a", "ip__after")
    whole = dict(df.dtypes)[next(c for c in df.columns if c.lower() == y.lower())] in ("tinyint", "smallint", "int", "bigint")
    mean = F.call_function("div", low + high, F.lit(2)) if whole else (low + high) / 2
    filled = F.coalesce(value, mean).alias(y.lower())
    return rows.select(*[filled if c.lower() == y.lower() else column(c) for c in df.columns])
