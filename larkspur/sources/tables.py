"""Sources: tables written out in a query, Parquet by URL, many files, whole files as bytes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..expr import Expr, Sym
from ..functions.scalar import column, literal_date
from ..operators import codec
from ..operators.positions import expand_ranges, gather, gather_ranges
from ..registry import relation

# -- tables written out ------------------------------------------------------------


def _cells(e) -> list:
    """The atoms of List(...), spans of spans included; dates become dates."""
    out: list = []
    for a in e.args:
        if isinstance(a, Expr) and a.head == "List":
            out += _cells(a)
        elif isinstance(a, Expr) and a.head == "DateObject":
            out.append(literal_date(a.args[0]))
        elif isinstance(a, Sym):
            out.append(a.name)
        else:
            out.append(a)
    return out


def _type_of(cells: list) -> T.DataType:
    kinds = {type(c) for c in cells if c is not None and not isinstance(c, Expr)}
    if kinds <= {int}:
        return T.LongType()
    if kinds <= {int, float}:
        return T.DoubleType()
    for kind, t in ((bool, T.BooleanType()), (str, T.StringType()), (dt.date, T.DateType())):
        if kinds == {kind}:
            return t
    raise ValueError(f"a column holds values of one type, not of {sorted(k.__name__ for k in kinds)}")


@relation("Table")
def table(engine, args) -> DataFrame:
    """Table(column(List(value, ...)), ...), or Table(name) for a table of the catalog.

    A value Interpolate(x) is the mean of its neighbours in the order of column x."""
    if len(args) == 1 and isinstance(args[0], (Sym, str)):
        return engine.named(args[0].name if isinstance(args[0], Sym) else args[0])
    if any(isinstance(a.args[0], Expr) and a.args[0].head in codec.ENCODED for a in args):
        return _with_encoded(engine, args)
    names = [a.head.lower() for a in args]
    cells = [[c for span in a.args for c in _cells(span if isinstance(span, Expr) and span.head == "List" else Expr("List", (span,)))] for a in args]
    if len({len(c) for c in cells}) > 1:
        raise ValueError("columns have different lengths")
    missing = [(n, c.args[0].name) for n, col in zip(names, cells) for c in col if isinstance(c, Expr) and c.head == "Interpolate"]
    schema = T.StructType([T.StructField(n, _type_of(c)) for n, c in zip(names, cells)])
    rows = []
    for row in zip(*cells):
        row = [None if isinstance(v, Expr) else v for v in row]
        rows.append(tuple(float(v) if isinstance(t.dataType, T.DoubleType) and v is not None else v for v, t in zip(row, schema.fields)))
    df = engine.spark.createDataFrame(rows, schema)
    for y, x in dict.fromkeys(missing):
        from ..operators.relational import interpolate

        df = interpolate(df, x, y)
    return df


def _with_encoded(engine, args) -> DataFrame:
    """A table some of whose columns are encoded: each column by position, side by side."""
    n, parts = None, []
    for a in args:
        if isinstance(a.args[0], Expr) and a.args[0].head in codec.ENCODED:
            parts.append((a.head.lower(), a.args[0]))
        else:
            n = len(_cells(Expr("List", a.args)))
            parts.append((a.head.lower(), a))
    lengths = {x for _, e in parts if e.head in codec.ENCODED and (x := codec.encoded_length(e)) is not None} | ({n} if n is not None else set())
    if len(lengths) != 1:
        raise ValueError("columns have different lengths" if lengths else "no column tells the table's length")
    (n,) = lengths
    out = engine.spark.range(n).select(F.col("id").alias("table__pos"))
    for name, e in parts:
        if e.head in codec.ENCODED:
            side = codec.decode_column(engine, e, name, n)
        else:
            cells = _cells(Expr("List", e.args))
            schema = T.StructType([T.StructField("side__pos", T.LongType()), T.StructField(name, _type_of(cells))])
            side = engine.spark.createDataFrame(list(enumerate(cells)), schema)
        out = out.join(side, F.col("table__pos") == F.col("side__pos")).drop("side__pos")
    return out.select(*[column(name) for name, _ in parts])


# -- Parquet by URL ------------------------------------------------------------------


def with_positions(df: DataFrame, name: str) -> DataFrame:
    """Rows of files with their 0-based position, files in the order of their paths.
    The reader knows a row's place in its file; only the sizes of files, of which there are
    several, meet in one place."""
    from pyspark.sql import Window

    if len(df.inputFiles()) < 2:
        return df.select(*map(column, df.columns), F.col("_metadata.row_index").alias(name))
    at = df.select(*map(column, df.columns), F.col("_metadata.file_path").alias("file__path"), F.col("_metadata.row_index").alias(name))
    sizes = at.groupBy("file__path").agg((F.max(name) + 1).alias("n"))
    before = F.sum("n").over(Window.orderBy("file__path").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("file__path").alias("of_path"), F.coalesce(before, F.lit(0)).alias("start"))
    out = at.join(starts, at["file__path"] == starts["of_path"])
    return out.select(*map(column, df.columns), (column(name) + F.col("start")).alias(name))


def _listed(e) -> list:
    return [x.name if isinstance(x, Sym) else x for x in e.args]


@relation("Gather")
def gather_url(engine, args) -> DataFrame:
    """Gather(url, loader, List(List(position, ...)) or List(), List(column, ...) [, options]):
    the named columns of a remote table (all, if none is named) at the positions
    (all rows, if there are none).  Positions are a list or a table's column,
    written As(column, table).  An option IndexColumn(name) keeps positions as a column."""
    url, _, positions, columns = args[:4]
    keep = next((x.args[0] for x in args[4:] if isinstance(x, Expr) and x.head == "IndexColumn"), None)
    keep = keep.name if isinstance(keep, Sym) else keep
    df = engine.spark.read.parquet(url)
    names = [c.lower() for c in _listed(columns)] or [c.lower() for c in df.columns]
    df = df.select(*map(column, names))
    pos = keep or "gather__pos"
    wanted = None
    if isinstance(positions, Expr) and positions.head == "As":
        wanted = engine.frame(positions.args[1]).select(column(positions.args[0].name).alias("gather__want"))
    else:
        flat = [int(i) for p in positions.args for i in (p.args if isinstance(p, Expr) else (p,))]
        if flat:
            wanted = engine.spark.createDataFrame([(i,) for i in flat], "gather__want long")
    if wanted is None:
        return with_positions(df, pos) if keep else df
    return gather(with_positions(df, pos), pos, wanted, "gather__want", [*names, *([pos] if keep else [])])


def _written_bounds(e, start: str, end: str) -> tuple[int, int] | None:
    """The least start and greatest end of a range table that is written out in the query."""
    if not (isinstance(e, Expr) and e.head == "Table" and all(isinstance(c, Expr) and c.args and isinstance(c.args[0], Expr) and c.args[0].head == "List" for c in e.args)):
        return None
    cells = {c.head.lower(): [v for v in _cells(c.args[0]) if v is not None] for c in e.args}
    low, high = cells.get(start.lower()), cells.get(end.lower())
    return (min(low), max(high)) if low and high else None


@relation("GatherRanges")
def gather_ranges_url(engine, args) -> DataFrame:
    """GatherRanges(url, loader, start column, end column, range table, List(column, ...) [, options]):
    for each row of the range table the rows of the remote table at [start, end).
    A url that is an expression is a table itself; its column `pos` holds the positions.
    Options: Keep(column, ...) carries columns of the range table along, RangeIndex(name)
    gives the range's place in it."""
    url, _, start, end, ranges, columns = args[:6]
    keep = [c for x in args[6:] if isinstance(x, Expr) and x.head == "Keep" for c in _listed(x)]
    number = next((_listed(x)[0] for x in args[6:] if isinstance(x, Expr) and x.head == "RangeIndex"), None)
    names = [c.lower() for c in _listed(columns)]
    within = _written_bounds(ranges, start.name, end.name)
    if isinstance(url, str):
        df = engine.spark.read.parquet(url)
        names = names or [c.lower() for c in df.columns]
        df, pos = with_positions(df.select(*map(column, names)), "range__pos"), "range__pos"
    else:
        df, pos = engine.frame(url), "pos"
    return gather_ranges(df, pos, engine.frame(ranges), start.name, end.name, names, within, keep, number)


def _urls(engine, e, url_column) -> list[str]:
    """Distinct URLs, which are a list that a query's author or a small catalog table gives."""
    if isinstance(e, Expr) and e.head == "List":
        return list(dict.fromkeys(_listed(e)))
    name = url_column.name if isinstance(url_column, Sym) else str(url_column)
    return sorted(r[0] for r in engine.frame(e).select(column(name)).distinct().toLocalIterator() if r[0] is not None)


def _read_all(engine, urls: list[str], columns: list[str]) -> DataFrame:
    if not urls:
        raise ValueError("no URL is given")
    df = engine.spark.read.parquet(*urls)
    return df.select(*map(column, columns)) if columns else df


@relation("GatherTables")
def gather_tables(engine, args) -> DataFrame:
    """GatherTables(loader, url column, url table, List(List(position, ...)), List(column, ...)):
    the columns from each of the table's distinct URLs, one after the other."""
    _, url_column, urls, positions, columns = args[:5]
    names = [c.lower() for c in _listed(columns)]
    flat = [int(i) for p in positions.args for i in (p.args if isinstance(p, Expr) else (p,))]
    df = _read_all(engine, _urls(engine, urls, url_column), names)
    if not flat:
        return df
    names = names or [c.lower() for c in df.columns]
    wanted = engine.spark.createDataFrame([(i,) for i in flat], "gather__want long")
    # Positions count within each file.
    at = df.select(*map(column, names), F.col("_metadata.row_index").alias("gather__pos"))
    return gather(at, "gather__pos", wanted, "gather__want", names)


@relation("ParseTables")
def parse_tables(engine, args) -> DataFrame:
    """ParseTables(loader, [url column,] url table): whole files."""
    urls = args[-1]
    return _read_all(engine, _urls(engine, urls, args[1] if len(args) > 2 else "url"), [])


def parquet_columns(spark, url: str, bounds: dict[str, tuple | None]) -> DataFrame:
    """The named columns, and of the rows those within the bounds; both reach the
    Parquet scan, which skips row groups by their statistics."""
    df = spark.read.parquet(url)
    for name, b in bounds.items():
        if b is not None:
            df = df.where(column(name).between(F.lit(b[0]), F.lit(b[1])))
    return df.select(*[column(n).alias(n.lower()) for n in bounds])


@relation("GetColumnsFromParquet")
def get_columns(engine, args) -> DataFrame:
    """GetColumnsFromParquet(loader, url, List(column(List(low, high)) or column(ALL()), ...))."""
    _, url, columns = args
    bounds: dict = {}
    for c in columns.args:
        if isinstance(c, Sym):
            bounds[c.name.lower()] = None
            continue
        b = c.args[0]
        cells = [] if b == Expr("ALL", ()) or b == Sym("ALL") else _cells(b)
        # Several pairs of bounds mean the span of all of them.
        bounds[c.head.lower()] = (min(cells[::2]), max(cells[1::2])) if cells else None
    return parquet_columns(engine.spark, url, bounds)


@relation("Ranges")
def ranges_head(engine, args) -> DataFrame:
    """Ranges(input, start column, end column, name): a row for each position of each range."""
    return expand_ranges(engine.frame(args[0]), args[1].name, args[2].name, args[3].name)


# -- bytes ----------------------------------------------------------------------------


def whole_files(spark, *urls: str) -> DataFrame:
    """(path, length, content) of whole files; the reader leaves out empty ones."""
    return spark.read.format("binaryFile").load(list(urls)).select("path", "length", "content")


@relation("Fetch")
def fetch(engine, args) -> DataFrame:
    """Fetch(url, ...): (path, length, content) of whole files."""
    return whole_files(engine.spark, *map(str, args))


def file_length(spark, url: str) -> int:
    """Bytes of a file, from its store's metadata."""
    path = spark._jvm.org.apache.hadoop.fs.Path(url)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return int(path.getFileSystem(conf).getFileStatus(path).getLen())
