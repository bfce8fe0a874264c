import random
import re

from larkspur.llm.decontamination import decontaminate, words_of

from .conftest import words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    w, hit, found = split(text), set(), set()
    for item, t in items:
        p = split(t)
        size = min(window, len(p))
        for i in range(len(p) - size + 1 if size and item is not None else 0):
            for at in range(len(w) - size + 1):
                if w[at : at + size] == p[i : i + size]:
                    hit |= set(range(at, at + size))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_words():
    for t in ["A b-C, é!Ü 9z", "", None, "日本 x\x00y\x7fz", " a b", "Ẍ[`{@"]:
        assert [w.decode() for w in words_of(t)] == split(t)


def _case(seed):
    r = random.Random(seed)
    items = [(i, " ".join(words(r, r.choice([0, 1, 3, 9, 10, 11, 25]), "abc"))) for i in range(12)] + [(3, "again, with the same id"), (None, "an item without an id at all"), (50, None)]
    docs = []
    for i in range(60):
        w = words(r, r.randint(0, 40), "abc")
        for _ in range(r.randint(0, 3)):
            p = split(r.choice(items)[1])
            at = r.randint(0, len(w))
            w[at:at] = p[r.randint(0, 2) :]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w).title()))
    return docs, items


def test_random(spark, documents, edges):
    for seed in range(3):
        docs, items = _case(seed)
        docs += edges
        bench = spark.createDataFrame(items, "item_id long, text string")
        for block in (1 << 24, 40):  # all items at once, and some at a time
            got = decontaminate(documents(docs), bench, block_bytes=block)
            assert got.count() == len(docs)
            for r in got.collect():
                assert (r.n_words, r.n_hit, r.item_ids) == brute(r.text, items), r
                assert r.contaminated == (r.n_hit > 0) and r["wm_words"] == "mine"
                assert sum(b - a for a, b in zip(r.hit_runs[::2], r.hit_runs[1::2])) == r.n_hit


def test_empty(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate(documents([(1, "a b")]), none).collect()] == [False]
    assert decontaminate(documents([]), none).count() == 0
