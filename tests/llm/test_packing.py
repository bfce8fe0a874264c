import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from larkspur.llm.packing import best_cuts, pack, padding_of, settled_cuts
from larkspur.llm.tokens import Encoder, default_vocabulary

from .conftest import words


def cheapest(points, costs, window):
    best = [0.0] + [float("inf")] * (len(points) - 1)
    for j in range(1, len(points)):
        best[j] = min(best[i] + padding_of(points[j] - points[i], window) + costs[j] for i in range(j) if points[j] - points[i] <= window)
    return best[-1]


def test_best_cuts():
    for seed in range(200):
        r = random.Random(seed)
        points, costs = [0], [0.0]
        for _ in range(30):
            points.append(points[-1] + r.randint(1, 9))
            costs.append(r.choice([0, 1, 5]))
        cuts = best_cuts(points, costs, 16)
        total, at = 0, 0
        for j in cuts:
            assert points[j] - points[at] <= 16
            total, at = total + padding_of(points[j] - points[at], 16) + costs[j], j
        assert at == 30 and total == pytest.approx(cheapest(points, costs, 16))


def test_settled_cuts_stay():
    """Whatever follows, the settled cuts begin the best way; and they come to something."""
    settled = 0
    for seed in range(300):
        r = random.Random(seed)
        points, costs = [0], [0.0]
        for _ in range(60):
            points.append(points[-1] + r.randint(1, 9))
            costs.append(r.choice([0, 1, 5]))
        m = r.randint(2, 50)
        first = settled_cuts(points[:m], costs[:m], 16)
        settled += len(first)
        assert best_cuts(points, costs, 16)[: len(first)] == first
    assert settled > 500


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def test_ids_are_the_librarys(tokenizer):
    r = random.Random(5)
    texts = ["a  b", "x\n \ny", " lead", "trail ", "a \n b", "don't  stop", "a b c", "tab\t x", "<|endoftext|> hi", "x <|endoftext|>", "", "é, ñ. 日本!", "a" * 5000]
    texts += ["".join(x + r.choice([" ", ", ", ".\n", "  ", " \n", "'s ", "!! ", " "]) for x in words(r, 40, "abcdeé")) for _ in range(200)]
    encoder = Encoder(default_vocabulary(), False)
    for t in texts * 2:
        assert encoder.encode_one(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def read(rows, texts, tokenizer, window=1024):
    """Checks all that the contract says of pieces; gives the padding and all ids."""
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for d, t in texts}
    spans, sequences = defaultdict(list), defaultdict(list)
    for p in rows:
        spans[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
        some = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert p.length > 0 and p.ids_crc32 == zlib.crc32(some.tobytes()) and p.doc_tokens == len(ids[p.doc_id])
    for d, full in ids.items():
        at = 0
        for start, n in sorted(spans[d]):
            assert start == at
            at += n
        assert at == len(full)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
        padding += padding_of(at, window)
    return padding, sum(map(len, ids.values()))


def test_pieces(documents, tokenizer):
    r = random.Random(6)
    texts = [(i, ". ".join(" ".join(words(r, r.randint(3, 25))) for _ in range(r.randint(0, 60)))) for i in range(150)]
    texts += [(500, None), (501, ""), (502, "z" * 20000), (503, "<|endoftext|> é"), (504, "  \n\n")]
    for blocks in (1 << 19, 3000):
        rows = pack(documents(texts), block_ids=blocks).collect()
        padding, total = read(rows, texts, tokenizer)
        assert padding < 0.05 * total
    assert sorted(rows) == sorted(pack(documents(texts), block_ids=3000).collect())  # a second run writes the same


def test_null_ids_repeats_and_nothing(documents):
    rows = pack(documents([(None, "a b"), (None, None), (7, "same"), (7, "same")])).collect()
    assert sorted(p.length for p in rows if p.doc_id == 7) == [2, 2] and len(rows) == 4
    assert pack(documents([])).count() == 0
