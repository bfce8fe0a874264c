"""The control plane: variables, guards, stages, settings, named tables, encoding, pipelines.

Nothing here runs a job by itself, but for what must give a plain value.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame

from ..expr import Expr, Sym, rewrite
from ..registry import UnknownHead, control, controlling, heads, relation

#: What Set() may set in the session, under the names that queries use for them.
SETTINGS = {
    "maxThreads": "spark.sql.shuffle.partitions",
    "internalBatchNumRows": "spark.sql.inMemoryColumnarStorage.batchSize",
    "minimumOutputBatchNumRows": "spark.sql.parquet.columnarReaderBatchSize",
    "HashAdaptivityEnabled": "spark.sql.adaptive.enabled",
}


def _name(e) -> str:
    return e.name if isinstance(e, Sym) else str(e)


@controlling("Set")
def set_variable(engine, args):
    """Set(variable, value): the value.  Names of SETTINGS change the session."""
    name, value = _name(args[0]), engine._evaluate(args[1])
    if name in SETTINGS:
        engine.spark.conf.set(SETTINGS[name], str(value).lower() if isinstance(value, bool) else str(value))
        return value
    if isinstance(value, Sym):
        raise NameError(f"there is no variable {value.name}")
    engine.variables[name] = value
    return value


@controlling("Increment")
def increment(engine, args):
    """One more than a whole number; anything else gives 0."""
    x = engine._evaluate(args[0])
    return x + 1 if isinstance(x, int) and not isinstance(x, bool) else 0


@controlling("Equals")
def equals(engine, args):
    """Do the two expressions have the same form, once evaluated?"""
    return engine._evaluate(args[0]) == engine._evaluate(args[1])


@controlling("NotEquals")
def not_equals(engine, args):
    return not equals(engine, args)


@controlling("EvaluateIf")
def evaluate_if(engine, args):
    """EvaluateIf(condition, expression): the expression's value if the condition
    holds; else the guard itself with the expression's head held and its arguments evaluated."""
    condition, e = args
    test = engine._evaluate(condition)
    if test is True:
        return engine._evaluate(_released(e))
    if isinstance(e, Expr):
        e = Expr(e.head if e.head.startswith("__") else "__" + e.head, tuple(engine._evaluate(a) for a in e.args))
    return Expr("EvaluateIf", (condition, e))


def _released(e):
    return Expr(e.head.removeprefix("__"), e.args) if isinstance(e, Expr) else e


def held_stages(e) -> int:
    """Guards that an expression still has."""
    from ..expr import walk

    return sum(isinstance(x, Expr) and x.head == "EvaluateIf" for x in walk(e))


def evaluate_staged(engine, e, limit: int = 64):
    """Evaluates with guards on STAGE: the guard EvaluateIf(Equals(STAGE, k), e)
    opens in stage k.  Stages follow one another until no guard is left.  A stage is a step over
    the expression, not a job; opened guards become part of one lazy plan."""
    from ..session import normalise

    now = normalise(e)
    for stage in range(limit):
        engine.variables["STAGE"] = stage
        try:
            now = rewrite(now, lambda x: _open(engine, x))
        finally:
            engine.variables.pop("STAGE", None)
        if not held_stages(now):
            return engine.evaluate(now)
    raise RuntimeError(f"guards are left after {limit} stages")


def _open(engine, x):
    if isinstance(x, Expr) and x.head == "EvaluateIf" and engine._evaluate(x.args[0]) is True:
        return _released(x.args[1])
    return x


@controlling("EvaluateInEngines")
def evaluate_in_engines(engine, args):
    """EvaluateInEngines(List(pass, ...), expression, ...): each expression through
    each of the rewriting passes that are registered by these names; the last value."""
    names, *expressions = args
    out = None
    for e in expressions:
        for n in names.args:
            e = engine_passes(engine)[_name(n)](e)
        out = engine.evaluate(e)
    return out


def engine_passes(engine) -> dict:
    """Rewriting passes by name, for EvaluateInEngines and SetDefaultEnginePipeline."""
    return engine.__dict__.setdefault("passes", {"identity": lambda e: e})


@controlling("SetDefaultEnginePipeline")
def set_default_pipeline(engine, args):
    """Passes that every expression goes through from now on."""
    engine.pipeline = [engine_passes(engine)[_name(n)] for n in args]
    return True


@controlling("ResetEngines")
def reset(engine, args):
    """Forgets variables, passes and dictionaries, and drops caches."""
    from ..operators.codec import Codec

    engine.pipeline, engine.variables, engine.codec = [], {}, Codec(engine.spark)
    return clear_caches(engine, args)


@controlling("ClearCaches")
def clear_caches(engine, args):
    engine.spark.catalog.clearCache()
    return True


control["ClearParquetReaderCaches"] = clear_caches


@controlling("GetFileLength")
def length_of(engine, args):
    """GetFileLength(url): bytes."""
    from ..sources.tables import file_length

    return file_length(engine.spark, str(engine._evaluate(args[0])))


@controlling("Parse")
def parse(engine, args):
    """Parse(text): the value of the expression that a text of the serialised form holds; also ByteSequence(text)."""
    from ..expr import from_json

    e = args[0].args[0] if isinstance(args[0], Expr) and args[0].head == "ByteSequence" else engine._evaluate(args[0])
    return engine._evaluate(from_json(e))


@controlling("GetEngineCapabilities")
def capabilities(engine, args):
    return Expr("List", tuple(map(Sym, heads())))


@controlling("NonLECycle")
def unstaged(engine, args):
    """NonLECycle(expression): evaluated in one go, without stages; which is how everything is evaluated here."""
    return engine._evaluate(args[-1]) if args else Expr("NonLECycle", ())


@contextmanager
def session_setting(spark, key: str, value):
    """A session setting that holds for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@controlling("Let")
def let(engine, args):
    """Let(expression, Parallel(n)): the expression planned for n partitions per shuffle."""
    e, how = args
    if not (isinstance(how, Expr) and how.head == "Parallel"):
        raise UnknownHead(f"Let takes Parallel(n), not {how!r}")
    with session_setting(engine.spark, "spark.sql.shuffle.partitions", int(how.args[0])):
        out = engine._evaluate(e)
        if isinstance(out, DataFrame):
            out._jdf.queryExecution().executedPlan()  # planned while the setting holds
        return out


@controlling("SetNumThreads", "SetNumSpansOut")
def set_parallelism(engine, args):
    """How finely sources are split: so many partitions at least."""
    engine.spark.conf.set("spark.sql.files.minPartitionNum", str(int(engine._evaluate(args[-1]))))
    return True


# -- named tables and encodings ----------------------------------------------------


@relation("SaveTable")
def save_table(engine, args) -> DataFrame:
    """SaveTable(input, name): the table, kept under the name until ClearTables or another table of that name."""
    df = engine.frame(args[0])
    name = _name(args[1]).lower()
    if name in engine.saved:
        engine.saved[name].unpersist()
    engine.saved[name] = df.persist()
    df.createOrReplaceTempView(name)
    return df


@relation("GetTable")
def get_table(engine, args) -> DataFrame:
    name = _name(args[0]).lower()
    if name not in engine.saved:
        raise KeyError(f"no table is saved as {name}")
    return engine.saved[name]


@controlling("ClearTables")
def clear_tables(engine, args):
    for name, df in engine.saved.items():
        df.unpersist()
        engine.spark.catalog.dropTempView(name)
    engine.saved.clear()
    return True


@relation("EncodeTable")
def encode_table(engine, args) -> DataFrame:
    """EncodeTable(input): text columns as codes in the order of first sight."""
    return engine.codec.encode(engine.frame(args[0]))


@relation("DecodeTable")
def decode_table(engine, args) -> DataFrame:
    return engine.codec.decode(engine.frame(args[0]))


@controlling("GetEncodingFor")
def encoding_for(engine, args):
    """GetEncodingFor(text, column): a code, -1, or InvalidKeyForColumn(...) where the column has no dictionary."""
    from ..operators.codec import NoDictionary

    try:
        return engine.codec.code_of(args[0], _name(args[1]))
    except NoDictionary:
        return Expr("InvalidKeyForColumn", (args[0], args[1]))


@relation("GetEncodingForFromURL")
def encoding_for_from_url(engine, args) -> DataFrame:
    """GetEncodingForFromURL(text, column, url): a table of one row and column, `code`: the
    text's place in the dictionary of a Parquet column, the distinct texts in the order of
    their first rows, or -1.  A column that is not of texts has no dictionary: an error."""
    from pyspark.sql import functions as F

    from ..functions.scalar import column
    from ..operators.positions import add_indices
    from ..sources.tables import with_positions

    text, name, url = args[0], _name(args[1]).lower(), str(args[2])
    df = engine.spark.read.parquet(url).select(column(name).alias("value"))
    if df.schema["value"].dataType.typeName() != "string":
        raise KeyError(f"the column {name} of {url} has no dictionary")
    seen = with_positions(df, "at").where("value is not null").groupBy("value").agg(F.min("at").alias("at"))
    found = add_indices(seen, "code", ["at"]).where(F.col("value") == text)
    return found.agg(F.coalesce(F.max("code"), F.lit(-1)).cast("long").alias("code"))


# -- data definition ----------------------------------------------------------------


@controlling("CreateTable")
def create_table(engine, args):
    """CreateTable(name, attribute, ...): an empty table; an attribute is name or
    name:TYPE[:size], of type BIGINT, INT, DOUBLE, DECIMAL, DATE, CHAR, VARCHAR or BOOLEAN."""
    kinds = {"BIGINT": "bigint", "INT": "int", "INTEGER": "int", "DOUBLE": "double", "DECIMAL": "double", "DATE": "date", "CHAR": "string", "VARCHAR": "string", "BOOLEAN": "boolean"}
    parts = [_name(a).split(":") for a in args[1:]]
    schema = ", ".join(f"`{p[0].lower()}` {kinds[p[1].upper()] if len(p) > 1 else 'string'}" for p in parts)
    engine.catalog[_name(args[0]).lower()] = engine.spark.createDataFrame([], schema)
    return True


@controlling("InsertInto")
def insert_into(engine, args):
    """InsertInto(name, value, ...): one more row."""
    from ..sources.tables import _cells

    name = _name(args[0]).lower()
    base, rows = engine.inserted.get(name, (None, None))
    if base is None or engine.catalog.get(name) is not rows[0]:
        base, rows = engine.named(name), [None]
    rows.append(tuple(_cells(Expr("List", args[1:]))))
    # However many rows come one by one, they are one local table beside what was there.
    rows[0] = lambda base=base, rows=rows: base.unionByName(engine.spark.createDataFrame(rows[1:], base.schema))
    engine.inserted[name], engine.catalog[name] = (base, rows), rows[0]
    return True


@controlling("Load")
def load(engine, args):
    """Load(name, file): a table from a Parquet, CSV (with a header) or JSON file."""
    name, path = _name(args[0]).lower(), str(args[1])
    read = engine.spark.read
    engine.catalog[name] = (
        read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else read.json(path) if path.endswith(".json") else read.parquet(path)
    )
    return True


@controlling("Schema")
def schema(engine, args):
    """Schema(input): List(List(name, type), ...)."""
    return Expr("List", tuple(Expr("List", (Sym(n.lower()), t)) for n, t in engine.frame(args[0]).dtypes))


# -- bytes that scans read -------------------------------------------------------------


@controlling("StartTrackingOverhead")
def start_tracking(engine, args):
    engine.overhead = {}
    return True


@controlling("StopTrackingOverhead")
def stop_tracking(engine, args):
    engine.overhead = None
    return True


def input_bytes(df: DataFrame) -> dict[str, int]:
    """Bytes that a query's scans may read of each file, by path; nothing is run.  Of a Parquet
    file these are the column chunks of the columns that the scan asks for, as the file's
    footer tells; row groups that statistics let the scan skip count as well.  Of other files it is their length."""
    spark, out = df.sparkSession, {}
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    todo = [df._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.getClass().getSimpleName() != "FileSourceScanExec":
            continue
        columns = {c.lower() for c in node.requiredSchema().fieldNames()}
        parquet = "parquet" in str(node.relation().fileFormat()).lower()
        for path in node.relation().location().inputFiles():
            file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
            size = _chunk_bytes(jvm, file, conf, columns) if parquet else int(file.getFileSystem(conf).getFileStatus(file).getLen())
            out[path] = out.get(path, 0) + size
    return out


def _chunk_bytes(jvm, file, conf, columns: set[str]) -> int:
    """Bytes of the column chunks of some columns in a Parquet file."""
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, conf))
    try:
        return sum(int(c.getTotalSize()) for block in reader.getFooter().getBlocks() for c in block.getColumns() if c.getPath().toArray()[0].lower() in columns)
    finally:
        reader.close()


@controlling("GetTotalOverhead")
def total_overhead(engine, args):
    return sum((engine.overhead or {}).values())


@controlling("GetOverhead")
def overhead(engine, args):
    url = str(args[0])
    return sum(v for k, v in (engine.overhead or {}).items() if url in k)
