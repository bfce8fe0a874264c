"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that count as white space inside the contracts: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; one of our
    own only where none is named and all is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
    return named or os.path.join(tempfile.gettempdir(), "larkspur-shared")


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """What is run within leaves no shuffle files behind.  They would stay until the driver's
    garbage is collected, which may be long after the next stages have filled the disks;
    once a result is in the shared folder, nothing reads them any more."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder, and removes the shuffle files behind it."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with _shuffles_removed(df.sparkSession):
        return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a table written to the shared folder.  Other than after a checkpoint,
    the planner then knows its true size: in loops with joins, sizes that are
    estimated from sizes multiply until the planner itself runs out of memory."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Takes away a table that `written` made, when nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def worker_cache(name: str, make):
    """What `make` gives, kept in a Python worker for the tasks of an operator's stages.

    Workers outlive stages; what other stages kept is dropped first, and its memory
    goes back to the system, so that a pipeline's operators do not add up."""
    held = sys.modules.setdefault("_larkspur_worker_cache", types.ModuleType("_larkspur_worker_cache"))
    context = TaskContext.get()
    stage = context.stageId() if context else None
    # Stages that ask for the same thing first are of one operator; it keeps what it has.
    if getattr(held, "of_stage", stage) != stage and held.asked_first != name:
        for other in [x for x in vars(held) if not x.startswith("__")]:
            delattr(held, other)
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:  # glibc alone has it
            trim(0)
    if getattr(held, "of_stage", held) != stage:
        held.of_stage, held.asked_first = stage, name
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def small_batches(batches, rows: int = 1024):
    """Arrow batches cut into slices of some rows, so that few texts at a time become Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_mapped(df: DataFrame, run, added: list[T.StructField]) -> DataFrame:
    """`df` with further columns that `run` computes in Arrow batches.

    run(batches) gives (batch, arrays of the added columns) by turns.  Columns go
    by place on the way, so their names may be anything."""
    width = len(df.columns)
    fields = [*df.schema.fields, *added]
    names = [f"c{i}" for i in range(len(fields))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, fields)])

    def packed(batches):
        import pyarrow as pa

        for batch, more in run(small_batches(batches)):
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

    return df.toDF(*names[:width]).mapInArrow(packed, schema).toDF(*[f.name for f in fields])


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII alone take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def forget_partitioning(key: Column) -> Column:
    """The same key under an expression that the planner does not recognise, so
    that a join deals both sides out anew and can split a hot partition."""
    return key.bitwiseXOR(F.lit(0x5DEECE66D))


#: Words `[^\x20\x09-\x0D]+` of UTF-8 bytes: str.split() would also split at
#: Unicode spaces, bytes.split() splits at exactly these six bytes.
def byte_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.lower() touches ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_MIX1, _MIX2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of a 64-bit value (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(_MIX1)
    x ^= x >> np.uint64(27)
    x *= np.uint64(_MIX2)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    import xxhash

    known = worker_cache("word_hashes", dict)
    if len(known) > 400_000:
        known.clear()
    out = np.empty(len(words), np.uint64)
    get, digest = known.get, xxhash.xxh3_64_intdigest
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = known[w] = digest(w)
        out[i] = h
    return out


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit value by byte; which of the bytes are the six white ones."""
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), white


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all words of a run of texts, A-Z lower-cased, in order; bytes are worked on as arrays."""
    value, white = worker_cache("byte_tables", _byte_tables)
    raw = np.frombuffer(b"\n".join([b"", *texts, b""]).lower(), np.uint8)
    space = white[raw]
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
    of = np.searchsorted(ends, first, "left").astype(np.int64)
    if not len(first):
        return np.empty(0, np.uint64), of
    # A word's hash is a sum over its bytes, each weighted by its place.
    size = last - first
    at = np.flatnonzero(~space)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(len(at)) - np.repeat(begin, size)
    weight = np.cumprod(np.full(int(size.max()), 0xD1342543DE82EF95, np.uint64))
    return mix64(np.add.reduceat(value[raw[at]] * weight[place], begin) + size.astype(np.uint64)), of


def text_chunks(texts: list[str | None], most: int):
    """Runs (first, texts as bytes) of some `most` bytes; nulls are empty."""
    held, first, size = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t.encode("utf-8", "surrogatepass") if t else b"")
        size += len(held[-1])
        if size >= most:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words; one hash of the whole where there are fewer, none where there are none."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(k, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mix64((out * np.uint64(0x9E3779B97F4A7C15)) ^ words[i : n - size + 1 + i])
    return out


