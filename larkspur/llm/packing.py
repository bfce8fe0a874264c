"""Packing: documents into token windows by order-preserving dynamic programming.

Documents are encoded, each with an end id behind it, and laid end to end in
their order.  The cut points are the document ends, the sentence ends and, where
a sentence is long, a point in every `hard_every` ids.  The windows between
chosen cuts minimise the sum of

* padding: a window of n < window ids costs window - n, none if n is a power of
  two (such a window needs no padding), and
* truncation: a cut costs 0 at a document end, `sentence_cost` at a sentence
  end, `hard_cost` within a sentence.

For windows that are padded, cost(i -> j) = window - (j - i), so the best start
is the minimum of best(i) + i over the window's span: a monotone queue gives it
in constant time per cut point.  Power-of-two lengths are one look-up each.

Scale: no shuffle.  Each input partition is one stream in its own order; a
document lies wholly in one partition.  Ids are held for `block_ids` ids at a
time.  When a block is full, whatever follows it goes on from a cut within its last
window, so the cuts that the best ways to all of those have in common are settled and
written; the others wait, and where none is settled yet, a block is twice as long.  The
windows are thus those of one programme over the whole partition.  Partition number and
window number make sequence_id, so a task that runs again writes the same rows.

Defined cases: a null or empty text is its end id alone; equal rows are
documents of their own; of windows that cost the same, the earliest start wins, and a
padded one over a power of two; documents of any length are cut as needed; an empty
table gives no rows; columns of `docs` other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import quoted, small_batches, worker_cache
from .tokens import Encoder, default_vocabulary

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _ways(points: list[int], costs: list[float], window: int) -> list[int]:
    """For each of `points` (ascending positions, the first is where the sequence
    begins) the cut before it on the way of least padding plus cost of cuts.
    Neighbouring points are at most `window` apart."""
    n = len(points)
    best = [0.0] * n
    back = [0] * n
    index = {p: i for i, p in enumerate(points)}
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    queue: deque[int] = deque([0])
    value = [points[0] + 0.0] * n  # best(i) + i
    get = index.get
    for j in range(1, n):
        at = points[j]
        while points[queue[0]] < at - window:
            queue.popleft()
        i = queue[0]
        low, via = window - at + value[i], i
        for p in powers:
            k = get(at - p)
            if k is not None and best[k] < low:
                low, via = best[k], k
        low += costs[j]
        best[j], back[j] = low, via
        v = value[j] = low + at
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    return back


def _way_to(back: list[int], j: int) -> list[int]:
    cuts = []
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def best_cuts(points: list[int], costs: list[float], window: int) -> list[int]:
    """Indices into `points` of the cuts that minimise padding plus cost of cuts; the last point is always a cut."""
    return _way_to(_ways(points, costs, window), len(points) - 1)


def settled_cuts(points: list[int], costs: list[float], window: int) -> list[int]:
    """The cuts that are the best ones whatever points follow: those on the ways to
    all points of the last window, from one of which every longer way goes on."""
    back, n = _ways(points, costs, window), len(points)
    ends = [p > points[-1] - window for p in points]
    left = sum(ends)
    for j in range(n - 1, 0, -1):
        if left == 1:
            break
        if ends[j]:
            ends[j] = False
            left -= ends[back[j]]
            ends[back[j]] = True
    return _way_to(back, ends.index(True))




def _sentence_ends(vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """By id: does its text end a sentence; does its text begin with white space or stand for a new line."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary)
    size = max(tok.get_vocab().values()) + 1
    ends, starts = np.zeros(size, bool), np.zeros(size, bool)
    for text, i in tok.get_vocab().items():
        # In such vocabularies Ġ stands for a space and Ċ for a new line.
        ends[i] = text.rstrip("\"')]»”").endswith((".", "!", "?", "…", "。")) or text.endswith("Ċ")
        starts[i] = text.startswith(("Ġ", "Ċ"))
    return ends, starts


class _Stream:
    """One partition's documents; gives pieces as lists of columns."""

    def __init__(self, window: int, sentence_cost: float, hard_cost: float, hard_every: int, first_sequence: int):
        self.window, self.sentence_cost, self.hard_cost, self.hard_every = window, sentence_cost, hard_cost, hard_every
        self.sequence = first_sequence
        self.points, self.costs = [0], [0.0]
        self.docs: deque = deque()  # (doc_id, ids, where it begins)
        self.end = 0

    def add(self, doc_id, ids: np.ndarray, sentence_end: np.ndarray) -> None:
        n = len(ids)
        last = 0
        points, costs, base, hard = self.points, self.costs, self.end, self.hard_every
        for p in [*(np.flatnonzero(sentence_end) + 1).tolist(), n]:
            while p - last > hard:
                last += hard
                points.append(base + last)
                costs.append(self.hard_cost)
            if p > last:
                points.append(base + p)
                costs.append(self.sentence_cost)
                last = p
        costs[-1] = 0.0
        self.docs.append((doc_id, ids, base))
        self.end += n

    def pieces(self, final: bool) -> list[list]:
        """Rows for the windows that are settled: all of them, if `final`."""
        out: list[list] = [[] for _ in range(7)]
        if len(self.points) < 2:
            return out
        cuts = (best_cuts if final else settled_cuts)(self.points, self.costs, self.window)
        begin = self.points[0]
        for c in cuts:
            stop, at = self.points[c], begin
            while at < stop:
                doc_id, ids, base = self.docs[0]
                upto = min(stop, base + len(ids))
                piece = ids[at - base : upto - base]
                for column, v in zip(out, (doc_id, at - base, upto - at, zlib.crc32(piece.tobytes()), len(ids), self.sequence, at - begin)):
                    column.append(v)
                if upto == base + len(ids):
                    self.docs.popleft()
                at = upto
            begin = stop
            self.sequence += 1
        if cuts:
            self.points, self.costs = self.points[cuts[-1] :], self.costs[cuts[-1] :]
            self.costs[0] = 0.0
        return out


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, window: int = 1024,
    end_id: int = 0, sentence_cost: float = 2.0, hard_cost: float = 24.0, hard_every: int = 256, block_ids: int = 1 << 19,
) -> DataFrame:
    """One row per piece: doc_id, start (ids of the document before it), length,
    ids_crc32 (of the piece's ids as little-endian uint32), doc_tokens (with the
    end id), sequence_id and offset in the sequence.  Each id is in one piece."""
    vocabulary = vocabulary or default_vocabulary()
    hard_every = min(hard_every, window)

    def run(batches):
        encoder = Encoder.shared(vocabulary, False)
        ends, starts = worker_cache("sentence_ends", lambda: _sentence_ends(vocabulary))
        stream = _Stream(window, sentence_cost, hard_cost, hard_every, TaskContext.get().partitionId() << 40)
        types = [pa.int64()] * 7
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        give = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)
        held, full = 0, block_ids
        for batch in small_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encoder.encode_one(text), np.uint32(end_id)).astype("<u4")
                end = ends[ids]
                end[:-1] &= starts[ids[1:]]
                end[-1] = True
                stream.add(doc_id, ids, end)
                held += len(ids)
                if held >= full:
                    out = stream.pieces(False)
                    held = stream.end - stream.points[0]
                    full = max(block_ids, 2 * held)
                    if out[0]:
                        yield give(out)
        out = stream.pieces(True)
        if out[0]:
            yield give(out)

    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def padding_of(length: int, window: int = 1024) -> int:
    """Ids of padding that a sequence of this length takes."""
    return 0 if length & (length - 1) == 0 else window - length
