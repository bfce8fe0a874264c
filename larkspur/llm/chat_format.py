"""Chat formatting: token-level assembly of conversations into training samples.

Role and text of each row are encoded apart from one another, and reserved ids
that no text can give are spliced around them:

    START role SEP text END

The loss mask is a prefix sum over boundary marks: +1 where an assistant text
begins, -1 where it ends; the mask is where the running sum is positive.

Ids keep control from content by themselves.  For the rendered string, where
they would be told apart by spelling alone, control strings in contents are
escaped: a backslash goes in between "<" and "|" (one more where backslashes
already stand there), which is undone exactly by taking one out.

Scale: rows are encoded where they lie, in parallel and without a group.  Only
the encoded rows are dealt by conversation and sorted by turn; each conversation
is then streamed, row by row, and no conversation is ever held in memory as a
whole.  A conversation is one sample, and its digest runs over it in order, so
one that holds much of the table is one long stream, though a cheap one.

Defined cases: null texts and roles are empty; rows of equal turn are ordered by
role, then text, and all stay; a null turn comes first; rows whose conv_id is
null are one conversation without id; an empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted
from .tokens import Encoder, default_vocabulary

#: Reserved ids, from the first one that the vocabulary leaves free.
START, SEP, END = 0, 1, 2
RESERVED_TEXT = ("<|im_start|>", "\n", "<|im_end|>\n")

_TO_ESCAPE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(content: str) -> str:
    """No "<|" is left in what this gives."""
    return _TO_ESCAPE.sub(r"<\1\\|", content)


def unescape(content: str) -> str:
    return _ESCAPED.sub(r"<\1|", content)


def assemble(turns: list[tuple[np.ndarray, np.ndarray, bool]], base: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of (role ids, text ids, is it learnt) turns."""
    parts, marks, at = [], [], 0
    for role, text, learnt in turns:
        parts += [[base + START], role, [base + SEP], text, [base + END]]
        begin = at + len(role) + 2
        at = begin + len(text) + 1
        if learnt:
            marks += [(begin, 1), (at - 1, -1)]
    delta = np.zeros(at + 1, np.int8)
    for where, step in marks:
        delta[where] += step
    ids = np.concatenate([np.asarray(p, np.uint32) for p in parts]) if parts else np.empty(0, np.uint32)
    return ids, np.cumsum(delta[:-1]) > 0


class Reader:
    """Reads assembled ids back, one chunk after the other, in bounded memory: nothing but the turn at hand is held."""

    def __init__(self, decode, base: int):
        self.decode, self.base = decode, base
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def feed(self, ids: np.ndarray, mask: np.ndarray) -> None:
        """Takes whole turns."""
        starts, seps, ends = (np.flatnonzero(ids == self.base + k) for k in (START, SEP, END))
        for a, b, c in zip(starts.tolist(), seps.tolist(), ends.tolist(), strict=True):
            role, text = self.decode(ids[a + 1 : b].tolist()), self.decode(ids[b + 1 : c].tolist())
            self.chars += sum(map(len, RESERVED_TEXT)) + len(role) + len(text)
            plain = unescape(text).encode("utf-8", "surrogatepass")
            self.turns.update(unescape(role).encode("utf-8", "surrogatepass") + b"\n" + plain + b"\n")
            self.n_turns += 1
        # The text under the mask, run by run; what lies in one run is decoded together.
        inside = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
        for a, b in zip(inside[::2].tolist(), inside[1::2].tolist()):
            text = unescape(self.decode(ids[a:b].tolist()))
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)


def encode_rows(conversations: DataFrame, vocabulary: str | None = None, learnt_role: str = "assistant") -> DataFrame:
    """conv_id, turn, role, text, piece (the row's ids, uint32 little-endian, made of the escaped role and text), loss_begin and loss_end, row by row."""
    vocabulary = vocabulary or default_vocabulary()
    rows = conversations.select(
        quoted("conv_id").cast("long").alias("conv_id"), quoted("turn").cast("long").alias("turn"),
        F.coalesce(quoted("role").cast("string"), F.lit("")).alias("role"), F.coalesce(quoted("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches):
        encoder = Encoder.shared(vocabulary, True)
        base = encoder.tokenizer.get_vocab_size(True)
        for batch in batches:
            role = [escape(x) for x in batch.column(2).to_pylist()]
            text = [escape(x) for x in batch.column(3).to_pylist()]
            learnt = [x == learnt_role for x in batch.column(2).to_pylist()]
            piece, begin, end = [], [], []
            for r, t, x in zip(encoder.encode(role), encoder.encode(text), learnt):
                ids, mask = assemble([(r, t, x)], base)
                piece.append(ids.astype("<u4").tobytes())
                # An empty text has an empty run.
                begin.append(int(mask.argmax()) if mask.any() else 0)
                end.append(begin[-1] + int(mask.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(piece, pa.binary()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                names=["conv_id", "turn", "role", "text", "piece", "loss_begin", "loss_end"],
            )

    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, piece binary, loss_begin long, loss_end long")


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per conversation of encode_rows(), all of it read from the assembled ids."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        encoder = Encoder.shared(vocabulary, True)
        base = encoder.tokenizer.get_vocab_size(True)
        decode = lambda ids: encoder.tokenizer.decode(ids, skip_special_tokens=False) if ids else ""
        current, reader, done = None, None, []

        def close():
            if reader is not None:
                done.append((current, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))

        def give():
            out = list(zip(*done)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(out, kinds)], names=names)

        for batch in batches:
            for conv, piece, begin, end in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if reader is None or conv != current:
                    close()
                    current, reader = conv, Reader(decode, base)
                ids = np.frombuffer(piece, "<u4")
                mask = np.zeros(len(ids), bool)
                mask[begin:end] = True
                reader.feed(ids, mask)
            yield give()
            done.clear()
        close()
        yield give()

    ordered = encoded.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"
    )
    return ordered.select("conv_id", "piece", "loss_begin", "loss_end").mapInArrow(run, SCHEMA)


def render(encoded: DataFrame) -> DataFrame:
    """conv_id and formatted: the rendered string of each conversation.  This holds each conversation in memory; read_back() does not."""
    esc = lambda c: F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")
    turn = F.concat(F.lit(RESERVED_TEXT[0]), esc(F.col("role")), F.lit(RESERVED_TEXT[1]), esc(F.col("text")), F.lit(RESERVED_TEXT[2]))
    row = F.struct(F.col("turn").alias("a"), F.col("role").alias("b"), F.col("text").alias("c"), turn.alias("t"))
    return encoded.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r.t), "").alias("formatted"))
