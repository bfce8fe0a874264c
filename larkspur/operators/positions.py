"""Operators on row positions: numbering, gathering by position or range, partial tables, radix partitions.

A DataFrame has no order of its own.  A position is a column: the row's number in
its file, in the order of a key, or in the order of a table that was written out
in a query.  No operator here gathers rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..expr import Expr, Sym
from ..functions.scalar import column
from ..registry import relation


#: One key in SPARSE is looked at for the bounds of ranges, at most SEEN keys; a range has some PER of these rows.
SPARSE, SEEN, PER, MAX_RANGES = 256, 1 << 17, 512, 1023


def _with_range(df: DataFrame, name: str, order_by: list[str]) -> DataFrame:
    """`df` with the number of the range of keys that a row lies in, in the order of `order_by`.

    It follows from the row's key and from the set of all keys alone, however `df` is dealt
    into partitions and whichever of its columns are read: keys are taken for bounds by their hash."""
    keys = [column(c) for c in order_by]
    key = F.struct(*[f for i, c in enumerate(keys) for f in (c.isNull().alias(f"n{i}"), c.alias(f"k{i}"))])
    some = df.select(key.alias("key"), F.xxhash64(*keys).alias("h")).where(F.pmod("h", F.lit(SPARSE)) == 0)
    some = some.groupBy("key", "h").agg(F.count(F.lit(1)).alias("n")).orderBy("h", "key").limit(SEEN)
    everything = Window.partitionBy(F.lit(0))
    some = some.select("key", F.sum("n").over(everything.orderBy("key")).alias("upto"), F.sum("n").over(everything).alias("total"))
    step = F.greatest(F.lit(PER), F.ceil(F.col("total") / MAX_RANGES))
    first = some.groupBy(F.floor(F.col("upto") / step).alias("range")).agg(F.min("key").alias("key")).where("range > 0")
    bounds = first.agg(F.sort_array(F.collect_list("key")).alias("bounds")).scalar()
    # A search by halves for the bounds that are not beyond the key, a step to a column, as this is compiled.
    out = df.withColumns({f"{name}_bounds": bounds, f"{name}_key": key, name: F.lit(0)})
    for i in reversed(range(MAX_RANGES.bit_length())):
        # The planner writes a step out as often as the next one names it: twice.
        beyond = F.coalesce(F.get(column(f"{name}_bounds"), column(name) + ((1 << i) - 1)) <= column(f"{name}_key"), F.lit(False))
        out = out.withColumn(name, column(name) + (beyond.cast("int") * (1 << i)))
    return out.drop(f"{name}_bounds", f"{name}_key")


def add_indices(df: DataFrame, name: str, order_by: list[str] = ()) -> DataFrame:
    """`df` with a 0-based row number: in the order of `order_by`, in ranges of keys that
    are sorted each by itself, or in the order that the rows are in.

    A row's number is its place in its range, or partition, plus the sizes of those
    before; these sizes are the only thing that meets in one place.  The input is read
    several times and must give the same rows each time.  Ranges depend on the keys alone;
    without `order_by` rows must also be in the same partitions each time: scans, filters and projections
    are; after shuffles or sampling, write or checkpoint the input first.
    """
    part, place = f"{name}__part", f"{name}__place"
    if order_by:
        dealt = _with_range(df, part, order_by)
        sorted_ = Window.partitionBy(part).orderBy(*[column(c).asc_nulls_last() for c in order_by])
        numbered = dealt.withColumn(place, F.count(F.lit(1)).over(sorted_.rowsBetween(Window.unboundedPreceding, -1)))
    else:
        numbered = df.withColumn(place, F.monotonically_increasing_id())
        dealt = numbered = numbered.withColumns({part: F.shiftright(place, 33), place: column(place).bitwiseAND((1 << 33) - 1)})
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(part).alias("of_part"), F.coalesce(before, F.lit(0)).alias("start"))
    out = numbered.join(starts, numbered[part] == starts["of_part"])
    return out.select(*[column(c) for c in df.columns], (column(place) + F.col("start")).alias(name.lower()))


def gather(df: DataFrame, pos: str, wanted: DataFrame, wanted_col: str, columns: list[str] = (), keep_order: str | None = None) -> DataFrame:
    """The rows of `df` whose position `pos` is wanted, once for each time that it
    is; no columns named means all.  `keep_order` names a column of `wanted` to carry along."""
    extra = [wanted[keep_order].alias(keep_order.lower())] if keep_order else []
    joined = df.join(wanted, df[pos] == wanted[wanted_col])
    return joined.select(*[df[c].alias(c.lower()) for c in (columns or df.columns)], *extra)


#: Positions that meet in one bucket of a range join.
RANGE_BUCKET = 1 << 16


def expand_ranges(ranges: DataFrame, start: str, end: str, name: str = "pos") -> DataFrame:
    """One row for each position in [start, end), duplicates kept where ranges
    overlap; empty and reversed ranges give none.  Long ranges are cut into pieces
    first, so no array is longer than a bucket."""
    pieces = _pieces(ranges.select(*map(column, ranges.columns), column(start).cast("long").alias("range__a"), column(end).cast("long").alias("range__b")))
    low = F.greatest("range__a", F.col("range__bucket") * RANGE_BUCKET)
    high = F.least("range__b", (F.col("range__bucket") + 1) * RANGE_BUCKET)
    return pieces.withColumn(name, F.explode(F.sequence(low, high - 1))).drop("range__a", "range__b", "range__bucket")


def _pieces(ranges: DataFrame) -> DataFrame:
    """Ranges [range__a, range__b) with a row for each bucket of positions that they touch."""
    bucket = lambda c: F.floor(c / F.lit(RANGE_BUCKET)).cast("long")
    some = ranges.where("range__b > range__a")
    return some.withColumn("range__bucket", F.explode(F.sequence(bucket(F.col("range__a")), bucket(F.col("range__b") - 1))))


def range_join(df: DataFrame, pos: str, ranges: DataFrame, start: str, end: str, within: tuple[int, int] | None = None) -> DataFrame:
    """Every row of `df` with each range [start, end) that its position lies in.

    Positions and ranges are dealt into buckets of RANGE_BUCKET positions and meet in
    an equi-join on the bucket: no nested loop, and a range costs a row for each bucket
    that it touches, not for each position.  `within` are bounds of all ranges, where
    they are known; they reach the scan of `df`."""
    if within is not None:
        df = df.where((column(pos) >= within[0]) & (column(pos) < within[1]))
    side = ranges.withColumns({"range__a": column(start).cast("long"), "range__b": column(end).cast("long")})
    on = (F.floor(df[pos] / F.lit(RANGE_BUCKET)).cast("long") == F.col("range__bucket")) & (df[pos] >= F.col("range__a")) & (df[pos] < F.col("range__b"))
    return df.join(_pieces(side), on).drop("range__a", "range__b", "range__bucket")


def gather_ranges(
    df: DataFrame, pos: str, ranges: DataFrame, start: str, end: str, columns: list[str] = (), within: tuple[int, int] | None = None,
    keep: list[str] = (), number: str | None = None,
) -> DataFrame:
    """The rows of `df` at the positions of each range.  `keep` names columns of the
    ranges to carry along; `number` one that gets the range's place in `ranges`, by which, and by
    position, the result is in the order of the ranges."""
    given = ranges.select(column(start).alias("given__start"), column(end).alias("given__end"), *[column(c).alias(f"given_{c.lower()}") for c in keep])
    if number:
        given = add_indices(given, "given__number")
    joined = range_join(df, pos, given, "given__start", "given__end", within)
    more = [column(f"given_{c.lower()}").alias(c.lower()) for c in keep] + ([column("given__number").alias(number.lower())] if number else [])
    return joined.select(*[df[c].alias(c.lower()) for c in (columns or df.columns)], *more)


def partial_table(df: DataFrame, pos: str, index: DataFrame, index_col: str) -> DataFrame:
    """`df` cut down to the positions that an index column names, and that column."""
    joined = df.join(index.select(column(index_col).alias("index_of_row")), df[pos] == F.col("index_of_row"))
    return joined.select(*[df[c].alias(c.lower()) for c in df.columns if c.lower() != index_col.lower()], F.col("index_of_row").alias(index_col.lower()))


def radix_partition(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """`df` dealt into `parts` partitions by key: tables dealt alike join without another shuffle."""
    return df.repartition(parts, *map(column, keys))


def merge_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns of both tables side by side, row by row; rows that only one has are left out."""
    a, b = add_indices(left, "merge__a"), add_indices(right, "merge__b")
    return a.join(b, a["merge__a"] == b["merge__b"]).drop("merge__a", "merge__b")


# -- heads ----------------------------------------------------------------------


def _names(e) -> list[str]:
    return [x.name.lower() if isinstance(x, Sym) else str(x).lower() for x in e.args]


@relation("AddIndices")
def _add_indices(engine, args) -> DataFrame:
    """AddIndices(input, name [, By(key, ...)])."""
    name = args[1].name if isinstance(args[1], Sym) else str(args[1])
    return add_indices(engine.frame(args[0]), name, _names(args[2]) if len(args) > 2 else [])


@relation("GatherRows")
def _gather_rows(engine, args) -> DataFrame:
    """GatherRows(input, List(position, ...)): rows of a table by position, in that order, repeated as named."""
    df = add_indices(engine.frame(args[0]), "gather__pos")
    order = [(i, int(p)) for i, p in enumerate(args[1].args)]
    wanted = engine.spark.createDataFrame(order, "gather__at long, gather__want long")
    out = gather(df, "gather__pos", wanted, "gather__want", [c for c in df.columns if c != "gather__pos"], "gather__at")
    return out.orderBy("gather__at").drop("gather__at")


@relation("MergeColumns")
def _merge_columns(engine, args) -> DataFrame:
    """MergeColumns(input, input): their columns side by side."""
    return merge_columns(engine.frame(args[0]), engine.frame(args[1]))


@relation("PartialTable")
def _partial_table(engine, args) -> DataFrame:
    """PartialTable(table, name): the column `name` holds positions, and the other
    columns are cut down to these.  In a table that is written out, its list may be
    shorter than the others.  In any other table the column's rows that are not null
    are the positions, counted in the order of the column `pos` where there is one, of the rows else."""
    table, name = args[0], (args[1].name if isinstance(args[1], Sym) else str(args[1])).lower()
    if isinstance(table, Expr) and table.head == "Table" and not (len(table.args) == 1 and isinstance(table.args[0], (Sym, str))):
        rest = table.with_args(c for c in table.args if c.head.lower() != name)
        index = table.with_args(c for c in table.args if c.head.lower() == name)
        if len(index.args) != 1:
            raise ValueError(f"the table has no column {name}")
        df, at = add_indices(engine.frame(rest), "partial__pos"), engine.frame(index)
        return partial_table(df, "partial__pos", at, name).drop("partial__pos").orderBy(name)
    whole = engine.frame(table)
    if name not in [c.lower() for c in whole.columns]:
        raise ValueError(f"the table has no column {name}")
    at = whole.select(column(name).alias(name)).where(column(name).isNotNull())
    rest = whole.drop(name)
    df = add_indices(rest, "partial__pos", ["pos"] if "pos" in [c.lower() for c in rest.columns] else [])
    return partial_table(df, "partial__pos", at, name).drop("partial__pos")


@relation("RadixPartition")
def _radix(engine, args) -> DataFrame:
    """RadixPartition(input, By(key, ...), parts)."""
    return radix_partition(engine.frame(args[0]), _names(args[1]), int(args[2]))
