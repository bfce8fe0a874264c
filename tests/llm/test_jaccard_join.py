import random
import re
from itertools import combinations

import numpy as np
import pytest

from larkspur.llm.components import components
from larkspur.llm.jaccard_join import Sets, _band, dense_bits, dense_sketches, jaccard_classes, most_different, segment_keys, shingle_set

from .conftest import words


def shingles(text, k=5):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + min(k, len(w))]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows):
    """{doc_id: component}, by all pairs; rows of one id are one document."""
    sets, up = {}, {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, set()).add(shingles(t))
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in sets}


def edited(r, w, n):
    w = list(w)
    for _ in range(n):
        at = r.randrange(len(w))
        w[at : at + r.randint(0, 1)] = words(r, r.randint(0, 2))
    return w


def _corpus(seed):
    r = random.Random(seed)
    passage = words(r, 30)
    texts = []
    for _ in range(12):
        base = words(r, r.choice([3, 8, 20, 60, 64, 65, 120, 300]))
        for _ in range(r.randint(1, 5)):
            texts.append(edited(r, base, r.randint(0, max(1, len(base) // 25))))
    many = words(r, 80)
    texts += [edited(r, many, r.randint(0, 8)) for _ in range(45)]  # a group of near copies, some of them apart
    texts += [passage + words(r, r.randint(5, 30)) for _ in range(40)]  # unlike but for a passage
    texts += [many, many, passage]
    r.shuffle(texts)
    return [(i * 3, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 16)])
def test_like_all_pairs(documents, edges, seed, block):
    rows = _corpus(seed) + [(10_000 + i if i is not None else None, t) for i, t, *_ in edges]
    got = jaccard_classes(documents(rows), block=block).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    sizes = {}
    for d, t in rows:
        sizes.setdefault(d, set()).add(len(shingles(t)))
    for x in got:
        assert x.component_id == want.get(x.doc_id) and x.n_shingles in sizes[x.doc_id], x


def test_same_id_joins_its_texts(documents):
    a, b = " ".join(words(random.Random(3), 30)), " ".join(words(random.Random(4), 30))
    got = jaccard_classes(documents([(1, a), (9, a), (9, b), (5, b)])).collect()
    assert {x.component_id for x in got} == {1}


def test_empty(documents):
    assert jaccard_classes(documents([])).count() == 0
    assert [tuple(x) for x in jaccard_classes(documents([(4, None)])).collect()] == [(4, 0, 4)]


def test_sets_hold_the_definition():
    r = random.Random(5)
    texts = ["", "a", "A b", "a b c d e", "a b c d e a b c d e", " \x0b x\ty "] + [" ".join(words(r, r.randint(0, 40), "abA")) for _ in range(100)]
    sets = Sets([t.encode() for t in texts], 5)
    assert sets.size.tolist() == [len(shingles(t)) for t in texts]
    for (i, a), (j, b) in combinations(enumerate(texts), 2):
        assert len(np.intersect1d(sets.set_of(i), sets.set_of(j))) == len(shingles(a) & shingles(b))
    assert shingle_set("x y") .tolist() == Sets([b"x y"], 5).token.tolist()


def test_sketches_bound_the_difference():
    """Hamming distance never exceeds the symmetric difference; linked sets share one of the first segments."""
    r = random.Random(6)
    for _ in range(150):
        base = words(r, r.choice([1, 6, 12, 40, 70, 200]))
        a, b = " ".join(base), " ".join(edited(r, base, r.randint(0, len(base) // 10 + 1)))
        sets = Sets([a.encode(), b.encode()], 5)
        x, y = shingles(a), shingles(b)
        if not x or not y:
            continue
        da, db = (np.frombuffer(d, np.uint8) for d in dense_sketches(sets))
        if dense_bits(len(x)) == dense_bits(len(y)):
            assert int(np.bitwise_count(da ^ db).sum()) <= len(x ^ y)
        if 100 * len(x & y) >= 75 * len(x | y):
            assert len(x ^ y) <= most_different(len(x), len(y), 75)
            n = sets.size
            counts = np.array([most_different(v, v * 100 // 75, 75) + 1 for v in n.tolist()])
            for band in {_band(int(n.min())), _band(int(n.min())) + 1}:
                hot = np.sort(sets.token[::3])
                key, owner = segment_keys(sets, np.full(2, band), counts, hot, np.arange(len(hot), dtype=np.uint64) % np.uint64(9))
                assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components(spark, one_task):
    r = random.Random(7)
    edges = [(r.randint(0, 120), r.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(500, 560)] + [(900, i) for i in range(901, 960)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    up = {v: v for e in edges for v in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert all(got.get(v, v) == root(v) for v in up)
    assert components(spark.createDataFrame([], "a long, b long"), one_task).count() == 0


def test_many_near_copies(documents):
    """A group of 600 near copies, some of them linked with few others, over many blocks."""
    r = random.Random(8)
    base = words(r, 60)
    rows = [(i, " ".join(edited(r, base, r.randint(0, 9)))) for i in range(600)]
    rows += [(1000 + i, " ".join(words(r, 40) + base[:20])) for i in range(60)]
    r.shuffle(rows)
    want = brute(rows)
    assert len({v for d, v in want.items() if d < 1000}) > 20
    assert {x.doc_id: x.component_id for x in jaccard_classes(documents(rows), block=32).collect()} == want


def test_too_few_segments_are_filled_up():
    """Sets with fewer segments in use than are to be told give their first empty ones."""
    sets = Sets([b"a b c d e f", b"a b c d e g", b""], 5)
    counts = np.array([5, 5, 0])
    key, owner = segment_keys(sets, np.array([1, 1, 0]), counts, np.empty(0, np.uint64), np.empty(0, np.uint64))
    assert np.bincount(owner, minlength=3).tolist() == [5, 5, 0]
    a, b = (set(key[owner == i].tolist()) for i in range(2))
    assert len(a) == len(b) == 5 and len(a & b) >= 3


def test_texts_beyond_a_chunk(documents):
    """Texts longer than what is worked on at once are whole sets, and link."""
    from larkspur.llm.jaccard_join import CHUNK_BYTES

    r = random.Random(11)
    long = words(r, CHUNK_BYTES // 5 + 1000)
    assert len(" ".join(long)) > CHUNK_BYTES
    rows = [(1, " ".join(long)), (2, " ".join(edited(r, long, 2000))), (3, " ".join(long[: len(long) // 2])), (4, "short text of a few words here")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_classes(documents(rows)).collect()}
    assert got[1] == (len(shingles(rows[0][1])), 1) and got[2][1] == 1 and got[3][1] == 3 and got[4][1] == 4
