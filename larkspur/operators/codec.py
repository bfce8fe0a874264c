"""Column encodings: dictionary codes of texts, and decoders of compressed columns.

Codes are numbered from 0 by where a value is first seen.  Numbering happens over
the distinct values, which is a dictionary's size, never over the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..expr import Expr, Sym
from ..functions.scalar import column
from .positions import add_indices, range_join

#: What a code that no dictionary has is decoded to.
INVALID = "INVALID_ENCODING"


class NoDictionary(KeyError):
    """The column has no dictionary."""


class Codec:
    """Dictionaries by column name; they grow as tables are encoded, codes never change."""

    def __init__(self, spark):
        self.spark = spark
        self.dictionaries: dict[str, DataFrame] = {}

    def learn(self, df: DataFrame, name: str, pos: str) -> DataFrame:
        """The dictionary (value, code) of the column with the values of `df` in it."""
        name = name.lower()
        seen = df.groupBy(column(name).alias("value")).agg(F.min(column(pos)).alias("first_pos")).where("value is not null")
        known = self.dictionaries.get(name)
        if known is None:
            fresh, base = seen, None
        else:
            fresh = seen.join(known, "value", "left_anti")
            base = known.agg((F.coalesce(F.max("code"), F.lit(-1)) + 1).alias("base"))
        numbered = add_indices(fresh, "code", ["first_pos", "value"]).select("value", F.col("code").cast("int").alias("code"))
        if known is not None:
            first = base.first()[0]
            numbered = known.unionByName(numbered.select("value", (F.col("code") + first).cast("int").alias("code")))
        self.dictionaries[name] = numbered
        return numbered

    def encode(self, df: DataFrame, pos: str | None = None) -> DataFrame:
        """Text columns become their codes; `pos` orders the rows (by default, the order they are in)."""
        own = pos is None
        if own:
            pos, df = "codec__pos", add_indices(df, "codec__pos")
        out = df
        for f in df.schema.fields:
            if f.dataType.typeName() == "string":
                book = self.learn(df, f.name, pos).select(F.col("value").alias("book__value"), F.col("code").alias("book__code"))
                out = out.join(book, out[f.name] == book["book__value"], "left").drop("book__value", f.name).withColumnRenamed("book__code", f.name)
        return out.select(*[column(c) for c in df.columns if not (own and c == pos)])

    def decode(self, df: DataFrame) -> DataFrame:
        """Whole-number columns whose name has a dictionary become texts; codes without a text become INVALID."""
        out = df
        for f in df.schema.fields:
            book = self.dictionaries.get(f.name.lower())
            if book is not None and f.dataType.typeName() in ("byte", "short", "integer", "long"):
                book = book.select(F.col("code").alias("book__code"), F.col("value").alias("book__value"))
                text = F.when(column(f.name).isNotNull(), F.coalesce("book__value", F.lit(INVALID)))
                out = out.join(book, out[f.name] == book["book__code"], "left").withColumn(f.name, text).drop("book__value", "book__code")
        return out.select(*map(column, df.columns))

    def code_of(self, text: str, name: str) -> int:
        """The code of a text in a column, -1 if it has none."""
        book = self.dictionaries.get(name.lower())
        if book is None:
            raise NoDictionary(f"InvalidKeyForColumn: {name}")
        row = book.where(F.col("value") == text).select("code").first()
        return -1 if row is None else int(row[0])


# -- decoders of compressed columns, as expressions over position ------------------


def decode_runs(positions: DataFrame, pos: str, runs: DataFrame, start: str, value: str, total: int, name: str) -> DataFrame:
    """Run-length encoding: runs (start, value), each up to the next start, the
    last up to `total`.  A run is a range of positions, however long; positions meet it in a range join by buckets."""
    numbered = add_indices(runs.select(column(start).alias("run__a"), column(value).alias(name)), "run__i", ["run__a"])
    after = numbered.select((F.col("run__i") - 1).alias("run__i"), F.col("run__a").alias("run__b"))
    ends = numbered.join(after, "run__i", "left").withColumn("run__b", F.coalesce("run__b", F.lit(total)))
    return range_join(positions, pos, ends, "run__a", "run__b").select(*[positions[c] for c in positions.columns], name)


def decode_frames(diffs: DataFrame, pos: str, diff: str, frames: DataFrame, frame: str, reference: str, size: int, name: str) -> DataFrame:
    """Frame of reference: value = reference of frame (pos div size) + difference."""
    side = frames.select(column(frame).alias("frame__of"), column(reference).alias("frame__ref"))
    joined = diffs.join(side, F.call_function("div", diffs[pos], F.lit(size)) == F.col("frame__of"))
    return joined.select(*[column(c) for c in diffs.columns if c != diff], (F.col("frame__ref") + column(diff)).alias(name))


def unpack_bits(df: DataFrame, packed: str, width: int, index: str, name: str) -> DataFrame:
    """Bit packing: value number `index` of `width` bits within a packed whole number, lowest bits first."""
    word = column(packed).cast("long")
    value = F.call_function("shiftrightunsigned", word, (column(index) * width).cast("int")).bitwiseAND(F.lit((1 << width) - 1))
    return df.withColumn(name, value)


def decode_sequence(spark, start: int, step: int, count: int, name: str) -> DataFrame:
    """value = start + i * step for i below count, with its position `pos`."""
    return spark.range(count).select(F.col("id").alias("pos"), (F.lit(start) + F.col("id") * step).cast("long").alias(name))


def decode_constant(spark, value, count: int, name: str) -> DataFrame:
    """`count` rows of one value."""
    return spark.range(count).select(F.lit(value).alias(name))


def decode_dictionary(codes: DataFrame, code: str, book: DataFrame, book_code: str, book_value: str, name: str) -> DataFrame:
    """Codes replaced by the dictionary's values; codes that it lacks become null."""
    side = book.select(column(book_code).alias("book__code"), column(book_value).alias(name))
    return codes.join(side, codes[code] == side["book__code"], "left").drop("book__code")


# -- encoded columns written out in a query ------------------------------------------

#: Bits of the whole-number types that packed columns name.
_TYPE_BITS = {"INT8": 8, "INT16": 16, "INT32": 32, "INT64": 64, "CHAR": 8, "SHORT": 16, "INT": 32, "LONG": 64}


def _span(e) -> list:
    return [v for a in e.args for v in (_span(a) if isinstance(a, Expr) and a.head == "List" else [a])]


def _column(engine, values: list, *names: str) -> DataFrame:
    """(position, value) of values that are written out."""
    kind = "string" if any(isinstance(v, str) for v in values) else "double" if any(isinstance(v, float) for v in values) else "long"
    return engine.spark.createDataFrame(list(enumerate(values)), f"`{names[0]}` long, `{names[1]}` {kind}")


def _positions(engine, n: int) -> DataFrame:
    return engine.spark.range(n).select(F.col("id").alias("side__pos"))


def _rle_list(engine, e, name, n):
    """RLEList(List(start, ...), List(value, ...) [, n])."""
    rows = engine.spark.createDataFrame(list(zip(_span(e.args[0]), _span(e.args[1]))), "a long, v " + dict(_column(engine, _span(e.args[1]), "i", "v").dtypes)["v"])
    return decode_runs(_positions(engine, n), "side__pos", rows, "a", "v", n, name)


def _for_list(engine, e, name, n):
    """FORList(frame size, n, List(reference, ...), List(difference, ...))."""
    diffs = _column(engine, _span(e.args[3]), "side__pos", "diff")
    return decode_frames(diffs, "side__pos", "diff", _column(engine, _span(e.args[2]), "frame", "ref"), "frame", "ref", int(e.args[0]), name)


def _bit_packed_list(engine, e, name, n):
    """BitPackedList(bits, n, packed type, type, List(word, ...)): as many values in a word as fit."""
    kind = e.args[2].name if isinstance(e.args[2], Sym) else str(e.args[2])
    bits, each = int(e.args[0]), _TYPE_BITS[kind.upper()] // int(e.args[0])
    words = _column(engine, _span(e.args[4]), "word", "packed")
    rows = _positions(engine, n).withColumns({"at": F.call_function("div", "side__pos", F.lit(each)), "i": F.col("side__pos") % each})
    return unpack_bits(rows.join(words, F.col("at") == F.col("word")), "packed", bits, "i", name).select("side__pos", name)


def _single_value_list(engine, e, name, n):
    """SingleValueList(bits, n, type, value)."""
    return _positions(engine, n).withColumn(name, F.lit(e.args[3]).cast("long") if isinstance(e.args[3], int) else F.lit(e.args[3]))


def _sequence_list(engine, e, name, n):
    """SequenceEncodedList(start, step, n)."""
    return decode_sequence(engine.spark, int(e.args[0]), int(e.args[1]), n, name).withColumnRenamed("pos", "side__pos")


def _dictionary_list(engine, e, name, n):
    """DictionaryEncodedList(List(value, ...), List(code, ...)): numbers are decoded; of a
    dictionary of texts the codes are the column, and DecodeTable gives the texts."""
    codes, values = _column(engine, _span(e.args[1]), "side__pos", "code"), _span(e.args[0])
    book = _column(engine, values, "book_code", "value")
    if any(isinstance(v, str) for v in values):
        engine.codec.dictionaries[name] = book.select("value", F.col("book_code").cast("int").alias("code"))
        return codes.select("side__pos", F.col("code").cast("int").alias(name))
    return decode_dictionary(codes, "code", book, "book_code", "value", name).select("side__pos", name)


#: Heads of encoded columns: what decodes them, and where they tell their length.
ENCODED = {
    "RLEList": (_rle_list, lambda e: int(e.args[2]) if len(e.args) > 2 else None),
    "FORList": (_for_list, lambda e: int(e.args[1])),
    "BitPackedList": (_bit_packed_list, lambda e: int(e.args[1])),
    "SingleValueList": (_single_value_list, lambda e: int(e.args[1])),
    "SequenceEncodedList": (_sequence_list, lambda e: int(e.args[2])),
    "DictionaryEncodedList": (_dictionary_list, lambda e: len(_span(e.args[1]))),
}


def encoded_length(e) -> int | None:
    """Rows of an encoded column, where it tells."""
    return ENCODED[e.head][1](e)


def decode_column(engine, e, name: str, n: int) -> DataFrame:
    """(side__pos, name) of an encoded column of n rows."""
    return ENCODED[e.head][0](engine, e, name, n)
