"""Benchmark decontamination by Wu-Manber multi-pattern search.

The alphabet is words, not bytes: texts become word sequences, and patterns are
the windows of `window` consecutive words of the test items.  A shift table over
blocks of two words tells how far the search may jump; where the shift is zero,
the block is the suffix of some pattern, and the bucket of that suffix holds the
patterns to compare with the text directly.  Items with fewer words than a
window are one pattern each; patterns of each length have tables of their own.

Scale: one pass over the documents, no shuffle.  Items are read block by block, of
at most `block_bytes` of text, and broadcast; a worker builds a block's tables once,
as arrays of numbers (some 10 bytes for each byte of text at most, and the distinct
words).  Each further block is a pass of its own over what the one before has
checkpointed, so that a worker holds one block at a time; the hits of the blocks are
put together per document.  The documents are never collected.

Defined cases: a null text has no words; an item without words has no window;
repeated items (same id) and items of equal text all count, and a window of several
items counts for each; an item id that is null is left out; documents pass through in
any number, also with equal ids, and texts of any length are searched whole (a
text's words are in memory); empty tables give no hits.
"""

from __future__ import annotations

import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, fresh, mix64, quoted, with_mapped, worker_cache

#: Bytes that are no part of a word become spaces, A-Z become a-z; all bytes from 0x80 on are word bytes.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def _ints(x: np.ndarray) -> array:
    return array("i", x.astype(np.int32).tobytes())


def _starts(numbers: np.ndarray, n: int) -> np.ndarray:
    """Where each of the numbers from 0 to n - 1 begins, and the last ends, once they are sorted."""
    return np.concatenate([[0], np.cumsum(np.bincount(numbers, minlength=n))])


class WuManber:
    """Search tables for patterns of one length, counted in words.

    Words are numbers from 1; a pattern is a place in `stream`, the words of all
    items one after the other.  A block of words is known by its hash: blocks of one
    hash share the lesser shift and the bucket, which costs comparisons, never results."""

    def __init__(self, stream: np.ndarray, at: np.ndarray, owner: np.ndarray, length: int):
        """Patterns begin at `at` and belong to the items `owner`, by number."""
        self.length, self.block = length, min(2, length)
        bits = max(16, min(22, len(at).bit_length() + 1))
        self.mask = (1 << bits) - 1
        far = length - self.block
        shift = np.full(1 << bits, far + 1, np.int32)
        for end in range(self.block, length + 1):
            np.minimum.at(shift, self._hashes(stream, at + end), length - end)
        self.shift = _ints(shift)
        # Equal patterns are one, with all their items.  They have one hash; should unlike ones have it too, each run of equal ones is one.
        content = np.full(len(at), length, np.uint64)
        for i in range(length):
            content = mix64(content ^ stream[at + i].astype(np.uint64))
        order = np.argsort(content, kind="stable")
        del content
        at, owner = at[order], owner[order]
        new = np.ones(len(at), bool)
        new[1:] = False
        for i in range(length):
            new[1:] |= stream[at[1:] + i] != stream[at[:-1] + i]
        pairs = np.unique((np.cumsum(new) - 1) << 32 | owner)
        self.item_start = _ints(_starts(pairs >> 32, int(new.sum())))
        self.items = _ints(pairs & 0xFFFFFFFF)
        at = at[new]
        bucket = self._hashes(stream, at + length)
        order = np.argsort(bucket, kind="stable")
        self.bucket_start = _ints(_starts(bucket, 1 << bits))
        self.group, self.at = _ints(order), _ints(at[order])

    def _hashes(self, stream: np.ndarray, end: np.ndarray) -> np.ndarray:
        last = stream[end - 1].astype(np.int64)
        return (last if self.block == 1 else last * 0x9E3779B1 + stream[end - 2]) & self.mask

    def search(self, stream: array, words: list[bytes], number, found) -> None:
        """Calls found(first word, items by number) for each occurrence of a pattern in
        `words`.  number(word, 0) is asked for the words that the search looks at, no others."""
        end, n, length = self.length, len(words), self.length
        shift, starts, ats, mask, one = self.shift, self.bucket_start, self.at, self.mask, self.block == 1
        while end <= n:
            last = number(words[end - 1], 0)
            key = (last if one else last * 0x9E3779B1 + number(words[end - 2], 0)) & mask
            if jump := shift[key]:
                end += jump
                continue
            text = array("i", [number(w, 0) for w in words[end - length : end]])
            for p in range(starts[key], starts[key + 1]):
                if stream[ats[p] : ats[p] + length] == text:
                    g = self.group[p]
                    found(end - length, self.items[self.item_start[g] : self.item_start[g + 1]])
            end += 1


class Tables:
    """The search tables of a block of (item id, text) rows: one for each length of pattern."""

    def __init__(self, items: list[tuple], window: int):
        self.number: dict[bytes, int] = {}
        self.names: list[str] = []
        stream, begins, sizes = array("i"), [], []
        for item, text in items:
            words = words_of(text)
            if not words or item is None:
                continue
            begins.append(len(stream))
            sizes.append(len(words))
            self.names.append(str(item))
            number = self.number
            stream.extend([number.setdefault(w, len(number) + 1) for w in words])
        self.stream = stream
        flat, begins, sizes = np.array(stream, np.int32), np.array(begins, np.int64), np.array(sizes, np.int64)
        self.by_length = []
        for length in np.unique(np.minimum(sizes, window)).tolist():
            mine = np.flatnonzero(np.minimum(sizes, window) == length)
            count = sizes[mine] - length + 1
            owner = np.repeat(mine, count)
            at = np.repeat(begins[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())
            self.by_length.append(WuManber(flat, at, owner, length))

    def hits_of(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Hit word runs as a flat list start, end, start, end ... and the items found."""
        runs, items = [], set()
        for t in self.by_length:
            def found(start, owners, length=t.length):
                runs.append((start, start + length))
                items.update(owners)

            t.search(self.stream, words, self.number.get, found)
        flat: list[int] = []
        for start, end in sorted(runs):
            if flat and start <= flat[-1]:
                flat[-1] = max(flat[-1], end)
            else:
                flat += [start, end]
        return flat, {self.names[i] for i in items}


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Blocks of items of at most `block_bytes` of text (a larger item is a block of its own)."""
    held, size = [], 0
    for row in benchmark.select(quoted(id_col), quoted(text_col)).toLocalIterator():
        more = len(row[1].encode("utf-8", "surrogatepass")) if row[1] else 0
        if held and size + more > block_bytes:
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += more
    yield held


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, block_bytes: int = 16 << 20,
) -> DataFrame:
    """`docs` with columns put in, or replaced where the names are taken: n_words
    and n_hit (long), hit_runs (array of long: first and next word of each run of
    hit words), item_ids (sorted array of string), contaminated (boolean)."""
    spark = docs.sparkSession
    added = ["n_words", "n_hit", "hit_runs", "item_ids", "contaminated"]
    base = docs.drop(*added)
    out = base
    blocks = _item_blocks(benchmark, item_id, item_text, block_bytes)
    runs_cols, item_cols = [], []
    for k, block in enumerate(blocks):
        runs, items = fresh(base, f"wm_runs_{k}"), fresh(base, f"wm_items_{k}")
        out = _search(checkpointed(out) if k else out, spark.sparkContext.broadcast((block, window)), text_col, runs, items, fresh(base, "wm_words"), k == 0)
        runs_cols.append(runs)
        item_cols.append(items)
    words, runs, items = fresh(base, "wm_words"), _merged(runs_cols), F.array_sort(F.array_distinct(F.flatten(F.array(*map(quoted, item_cols)))))
    out = out.withColumn(runs_cols[0], runs) if len(runs_cols) > 1 else out
    runs = quoted(runs_cols[0])
    hit = F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: x - a)
    # Alternating sum: ends minus starts, as the runs are a flat list of an even length.
    out = out.withColumns({"n_words": quoted(words), "n_hit": hit, "hit_runs": runs, "item_ids": items})
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop(words, *runs_cols, *item_cols)


def _merged(cols: list[str]):
    """Flat run lists of several blocks as one, overlapping runs joined."""
    pairs = lambda c: F.transform(
        F.sequence(F.lit(0), (F.size(c) / 2).cast("int") - 1), lambda i: F.struct(F.get(c, i * 2).alias("s"), F.get(c, i * 2 + 1).alias("e"))
    )
    some = F.flatten(F.array(*[F.when(F.size(quoted(c)) > 0, pairs(quoted(c))).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>")) for c in cols]))
    return F.aggregate(
        F.array_sort(some), F.array().cast("array<bigint>"),
        lambda a, r: F.when((F.size(a) > 0) & (r.s <= F.element_at(a, -1)), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.greatest(r.e, F.element_at(a, -1)))))
        .otherwise(F.concat(a, F.array(r.s, r.e))),
    )


def _search(df: DataFrame, held, text_col: str, runs: str, items: str, words_col: str, first: bool) -> DataFrame:
    added = [T.StructField(words_col, T.LongType())] if first else []
    added += [T.StructField(runs, T.ArrayType(T.LongType())), T.StructField(items, T.ArrayType(T.StringType()))]
    at = df.columns.index(text_col)
    token = uuid.uuid4().hex

    def run(batches):
        kept = worker_cache("wu_manber", dict)
        if token not in kept:
            kept.clear()  # one block at a time
            kept[token] = Tables(*held.value)
        tables = kept[token]
        for batch in batches:
            counts, all_runs, all_items = [], [], []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                flat, names = tables.hits_of(words)
                counts.append(len(words))
                all_runs.append(flat)
                all_items.append(sorted(names))
            more = [pa.array(counts, pa.int64())] if first else []
            yield batch, [*more, pa.array(all_runs, pa.list_(pa.int64())), pa.array(all_items, pa.list_(pa.string()))]

    return with_mapped(df, run, added)
