import random
import re
from collections import Counter

import numpy as np

from larkspur.llm.quality_rules import quality_rules, statistics

from .conftest import words


def brute(text):
    text = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    windows, covered, seen, dup = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
    for i in range(len(w) - 2):
        if windows[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_statistics(documents, edges):
    r = random.Random(2)
    rows = list(edges)
    for i in range(200, 300):
        w = words(r, r.randint(0, 60), "ab")
        rows.append((i, "".join(x + r.choice([" ", "\n", "\t", " #|", " "]) for x in w)))
    for row in statistics(documents(rows)).select("doc_id", "text", *STATS).collect():
        assert tuple(row[2:]) == brute(row.text), row


def _plain(r, n=None):
    return "\n".join(" ".join(words(r, 12, "abcdefghijklm")) for _ in range((n or r.randint(80, 400)) // 12))


def test_outliers(documents):
    r = random.Random(3)
    rows = [(i, _plain(r), r.choice(["en", "fr"]), r.choice(["a", "b"])) for i in range(400)]
    rows += [(1000 + i, _plain(r).replace(" ", "$$$ "), "en", "a") for i in range(8)]
    rows += [(2000 + i, _plain(r, 120), None, None) for i in range(3)]  # too few of their like
    rows += [(3000, "few words", "en", "a"), (3001, "one two three four " * 40, "en", "a"), (3002, None, "en", "a")]
    out = {x.doc_id: x for x in quality_rules(documents(rows)).collect()}
    assert len(out) == len(rows)
    assert all(out[i].kept for i in range(400))
    assert not any(out[1000 + i].kept or out[1000 + i].base_failed for i in range(8))
    assert all(out[2000 + i].kept and out[2000 + i].distance2 is None for i in range(3))
    assert all(out[i].base_failed and not out[i].kept for i in (3000, 3001, 3002))


def test_copies_are_no_outliers(documents):
    """Equal vectors have no spread at all."""
    text = _plain(random.Random(4), 200)
    out = quality_rules(documents([(i % 30, text) for i in range(60)])).collect()
    assert len(out) == 60 and all(x.kept and x.distance2 < 1 for x in out)


def test_edges_and_empty(documents, edges):
    assert quality_rules(documents(edges)).count() == len(edges)
    assert quality_rules(documents([])).count() == 0


def test_no_python(spark, documents):
    plan = quality_rules(documents([(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def _least_determinant(x, support, floors, starts=60):
    """(log determinant, mean, covariance) by concentration steps from many random subsets, to convergence."""
    from larkspur.llm.quality_rules import consistency

    r, best = np.random.default_rng(0), None
    h, factor = int(np.ceil(len(x) * support)), consistency(support)

    def moments(some):
        c = factor * np.cov(some.T, bias=True)
        np.fill_diagonal(c, np.maximum(np.diag(c), np.square(floors)))
        return some.mean(0), c

    for _ in range(starts):
        m, c = moments(x[r.choice(len(x), 5, replace=False)])
        was = np.inf
        for _ in range(200):
            d = np.einsum("ij,ij->i", (x - m) @ np.linalg.inv(c), x - m)
            m, c = moments(x[np.argsort(d)[:h]])
            now = np.linalg.slogdet(c)[1]
            if now > was - 1e-9:
                break
            was = now
        if best is None or now < best[0]:
            best = (now, m, c)
    return best


def test_estimate_has_the_least_determinant(spark):
    """Five groups with correlation and up to a fifth of outliers in one place: the determinant is that
    of a search from many random subsets, and distances of the others are chi-square."""
    from larkspur.llm.quality_rules import FLOORS, _with_distance, _with_model, estimate

    r = np.random.default_rng(1)
    rows, data = [], {}
    for g in range(5):
        a = r.normal(size=(4, 4)) + 2 * np.eye(4)
        good = r.normal(size=(800, 4)) @ a + 3 * g
        bad = r.normal(size=(50 * g, 4)) * 0.3 + 3 * g + 25 * r.normal(size=4)
        data[f"g{g}"] = (np.concatenate([good, bad]), len(good))
        rows += [(f"g{g}", i, *map(float, x)) for i, x in enumerate(data[f"g{g}"][0])]
    df = spark.createDataFrame(rows, "grp string, i int, x0 double, x1 double, x2 double, x3 double")
    model = estimate(df).cache()
    found = {m.grp: m for m in model.collect()}
    distances = {}
    for x in _with_distance(_with_model(df, model.drop("logdet"), ["grp"])).select("grp", "i", "d2").collect():
        distances.setdefault(x.grp, {})[x.i] = x.d2
    for g, (x, n) in data.items():
        want, mean, cov = _least_determinant(x, 0.75, FLOORS)
        assert abs(found[g].logdet - want) < 0.05, (g, found[g].logdet, want)
        d = np.array([distances[g][i] for i in range(len(x))])
        exact = np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(cov), x - mean)
        # Beside outliers the nearest share is more than that share of the others, whose distances are lower then.
        assert abs(np.median(d[:n]) - 3.36) < (0.25 if n == len(x) else 0.7) and np.median(np.abs(d / exact - 1)) < 0.1
        assert (d[n:] > 36).all() and (d[:n] <= 36).all()


def test_consistency_factor():
    """The covariance of the nearest share of a normal sample, times the factor, is the sample's."""
    from larkspur.llm.quality_rules import consistency

    x = np.random.default_rng(2).normal(size=(400_000, 4))
    near = x[np.argsort((x**2).sum(1))[: 300_000]]
    assert abs(consistency(0.75) * np.trace(np.cov(near.T)) / 4 - 1) < 0.01
