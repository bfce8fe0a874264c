"""Encoding of whole texts with a public byte-level BPE vocabulary.

The vocabulary file is the one of the `tokenizers` library; ids are exactly that
library's (tests compare them), but merges are done by `tiktoken`, which reads
the same vocabulary as ranks and needs a fraction of the time for a word.

A text is cut before each single space that a non-space follows.  The
pre-tokeniser always has a boundary there, so the pieces' ids, one after the
other, are the text's ids; pieces repeat much, and a worker keeps them.  Where a
piece would begin or end inside a run of white space, or a special token's
string occurs, the whole text goes to the `tokenizers` library.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .common import worker_cache

_RUN = re.compile(r" (?:\s|$)")
#: Pieces that a worker keeps in each of two generations: 100-200 bytes each, some 80 MB at most.
KEPT_PIECES = 250_000
#: Fixed value: the public pre-tokenisation pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Vocabulary files write each byte as a printable character; the others are numbered from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    """The ids of " " + piece, as bytes, by piece; a piece that is missing is encoded and kept."""

    def __init__(self, core, tail: dict[str, bytes]):
        self.core, self.single, self.tail, self.before = core, core.encode_single_piece, tail, {}

    def __missing__(self, p: str) -> bytes:
        ids = self.before.get(p)
        if ids is None:
            # A word of Latin letters, with or without one mark behind it, needs no pre-tokeniser.
            word, mark = (p[:-1], self.tail[p[-1]]) if p and p[-1] in self.tail else (p, b"")
            if word.isalpha() and max(word) < "ɐ":
                ids = array("I", self.single((" " + word).encode())).tobytes() + mark
            else:
                ids = array("I", self.core.encode_ordinary(" " + p)).tobytes()
        self[p] = ids
        return ids


class Encoder:
    """encode() gives ids as uint32 arrays; `ordinary`: special tokens' strings are text like any other."""

    def __init__(self, path: str, ordinary: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = [] if ordinary else sorted(added)
        byte = _byte_of_char()
        ranks = {bytes(map(byte.__getitem__, k)): v for k, v in self.tokenizer.get_vocab(False).items() if k not in added}
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.known = _Pieces(self.core, {c: array("I", [ranks[c.encode()]]).tobytes() for c in ".,!?;:"})

    @staticmethod
    def shared(path: str, ordinary: bool) -> "Encoder":
        """The worker's encoder for this vocabulary file."""
        held = worker_cache("encoders", dict)
        if (path, ordinary) not in held:
            held[path, ordinary] = Encoder(path, ordinary)
        return held[path, ordinary]

    def encode_one(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if _RUN.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        first, *pieces = text.split(" ")
        head = array("I", self.core.encode_ordinary(first)).tobytes() if first else b""
        known = self.known
        if len(known) > KEPT_PIECES:
            known.before = dict(known)
            known.clear()
        ids = b"".join(map(known.__getitem__, pieces))
        return np.frombuffer(head + ids, np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [self.encode_one(t) for t in texts]
