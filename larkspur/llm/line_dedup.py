"""Line dedup: lines that many documents share stay only in one of them.

Normalised lines are exploded and hashed (two independent 64-bit hashes), the
distinct documents of each hash are counted, and lines over the threshold are
dropped from all documents but the one with the largest id.  Texts come
together again by line position.

Scale: the count is a two-level aggregation, first by (hash, document) and then
by hash, so a line that a third of all documents hold is summed map-side.  The
lines to drop are found by a join that adaptive execution can split where one
hash is hot.  Only (document, positions) travels back to the texts.

Defined cases: a null or empty text is one empty line; a document without id
takes no part and keeps all its lines; rows that repeat a doc_id count as one
document, and each row is rewritten by itself; ties cannot occur, for the
largest id is one; a text of any length is split and put together whole, as one row's
array of lines; other columns pass through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, forget_partitioning, fresh, quoted


def _key(line: Column, min_chars: int) -> Column:
    stripped = F.btrim(line, F.lit(WHITE))
    return F.when(F.char_length(stripped) >= min_chars, ascii_lower(stripped))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3
) -> DataFrame:
    """`docs` with the text rewritten, and columns n_lines and n_dropped (long)
    put in or, where `docs` has such columns, replaced.

    A line's key is the line stripped of white space with A-Z lower-cased.  Keys
    of at least `min_chars` code points in at least `min_docs` documents lose
    their lines everywhere but in the largest id.
    """
    lines_of = lambda text: F.split(F.coalesce(text, F.lit("")), "\n", -1)
    # A row is known by its id and its text's hash: rows that repeat an id may differ in text.
    row = docs.select(
        quoted(id_col).cast("long").alias("id"), F.xxhash64(quoted(text_col)).alias("th"), quoted(text_col).alias("text")
    ).where(F.col("id").isNotNull() & (F.length("text") >= min_chars))
    line = row.select("id", "th", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    line = line.select("id", "th", "pos", _key(F.col("line"), min_chars).alias("key")).where(F.col("key").isNotNull())
    line = line.select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))

    shared = (
        line.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
    )
    shared = shared.select(forget_partitioning(F.col("h1")).alias("s1"), forget_partitioning(F.col("h2")).alias("s2"), "keeper")
    probe = line.select("id", "th", "pos", forget_partitioning(F.col("h1")).alias("s1"), forget_partitioning(F.col("h2")).alias("s2"))
    drops = (
        probe.join(shared, ["s1", "s2"]).where(F.col("id") != F.col("keeper"))
        .groupBy("id", "th").agg(F.collect_set("pos").alias("drops"))
    )

    key_id, key_hash, drop = (fresh(docs, x) for x in ("ld_id", "ld_hash", "ld_drops"))
    drops = drops.select(F.col("id").alias(key_id), F.col("th").alias(key_hash), F.col("drops").alias(drop))
    keyed = docs.withColumns({key_id: quoted(id_col).cast("long"), key_hash: F.xxhash64(quoted(text_col))})
    out = keyed.join(drops, [key_id, key_hash], "left")

    lines = lines_of(quoted(text_col))
    # The positions that stay, by hashing; then the lines of these positions.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), quoted(drop))
    text = F.when(
        quoted(drop).isNotNull(),
        # The one-element array binds the lines once, so that no element splits the text again.
        F.element_at(F.transform(F.array(lines), lambda all_: F.array_join(F.transform(stay, lambda i: F.get(all_, i)), "\n")), 1),
    ).otherwise(F.coalesce(quoted(text_col), F.lit("")))
    new = {
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.when(quoted(drop).isNull(), F.lit(0)).otherwise(F.size(quoted(drop))).cast("long"),
    }
    return out.withColumns(new | {text_col: text}).drop(key_id, key_hash, drop)
