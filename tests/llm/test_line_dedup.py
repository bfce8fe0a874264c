import hashlib
import random
import re

from larkspur.llm.line_dedup import line_dedup

from .conftest import words

WHITE = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=20, min_docs=3):
    """{(doc_id, text): (n_lines, n_dropped, kept text)} by the definition."""
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))
    holders = {}
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders.setdefault(key(line), set()).add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or not (len(h := holders.get(key(x), ())) >= min_docs and d != max(h))]
        out[d, t] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def check(documents, rows):
    df = line_dedup(documents(rows))
    got = df.select("doc_id", "n_lines", "n_dropped", "text").collect()
    want = brute([r[:2] for r in rows])
    by_id = {}
    for (d, _), v in want.items():
        by_id.setdefault(d, set()).add(v)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_lines, r.n_dropped, r.text) in by_id[r.doc_id], r
    return df


def test_random(documents):
    r = random.Random(1)
    pool = [" ".join(words(r, 5)) for _ in range(40)] + ["Ünïcode LINE of twenty characters", "short", ""]
    rows = []
    for i in range(120):
        lines = [r.choice(pool) for _ in range(r.randint(0, 12))]
        rows.append((i, "\n".join(x.upper() if r.random() < 0.3 else f" \t{x}\x0b" if r.random() < 0.2 else x for x in lines)))
    check(documents, rows)


def test_edges(documents, edges):
    df = check(documents, edges)
    assert df.filter("key = 'mine' and `a.b` = 'mine'").count() == len(edges)


def test_empty(documents):
    assert line_dedup(documents([])).count() == 0


def test_same_id_with_other_texts(documents):
    line = "this line is long enough to count"
    got = {r.text for r in line_dedup(documents([(1, line), (2, line), (3, line + "\nmore"), (3, "other\n" + line), (4, "x")])).collect()}
    assert got == {"", line + "\nmore", "other\n" + line, "x"}


def test_digest_column(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.sha2(F.lit("é\n").cast("binary"), 256)).first()[0] == hashlib.sha256("é\n".encode()).hexdigest()
