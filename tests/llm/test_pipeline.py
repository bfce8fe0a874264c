"""The pipeline's stages against brute force, each on its own input."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from larkspur.llm.queries import QUERIES

from .conftest import words
from .test_decontamination import brute as contamination
from .test_jaccard_join import edited, shingles
from .test_line_dedup import brute as lines_of
from .test_packing import read


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(1)
    path = str(tmp_path_factory.mktemp("tables"))
    items = [(i, " ".join(words(r, 14))) for i in range(5)]
    banner = "a banner that every document has at its top"
    rows = []
    for i in range(90):
        w = words(r, r.randint(20, 90))
        if i % 9 == 0:
            w[5:5] = items[i % 5][1].split()
        rows.append((i, banner + "\n" + " ".join(w), "en", "s", 0))
    rows += [(200 + i, " ".join(edited(r, rows[i][1].split("\n")[1].split(), 1)), "en", "s", 0) for i in range(1, 9)]
    rows += [(300, None, "en", "s", 0), (301, "123 456", None, None, None), (302, "", "fr", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages(spark, folder):
    from tokenizers import Tokenizer

    from larkspur.llm.tokens import default_vocabulary

    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = [(x.doc_id, x.text, x.n_chars) for x in docs.collect()]
        columns = docs.columns
        stage(spark, docs, path).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        assert name == "packing" or docs.columns == columns
    after = {a: inputs[b] for a, b in zip([n for n, _ in corpus_pipeline.STAGES], [n for n, _ in corpus_pipeline.STAGES][1:])}

    assert {d for d, *_ in inputs["language_id"]} - {d for d, *_ in after["language_id"]} == {300, 301, 302}
    want = lines_of([x[:2] for x in inputs["line_dedup"]])
    assert {d: t for d, t, _ in after["line_dedup"]} == {d: v[2] for (d, _), v in want.items()}
    assert all(n == len(t) for d, t, n in after["line_dedup"] if want[d, dict((x[0], x[1]) for x in inputs["line_dedup"])[d]][1])

    sets = {d: shingles(t) for d, t, _ in inputs["jaccard_join"]}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            up[max(root(a), root(b))] = min(root(a), root(b))
    assert {d for d, *_ in after["jaccard_join"]} == {d for d in sets if root(d) == d} and any(root(d) != d for d in sets)
    clean = {d for d, t, _ in inputs["decontamination"] if not contamination(t, items)[1]}
    assert {d for d, *_ in after["decontamination"]} == clean and len(clean) < len(inputs["decontamination"])
    read(docs.collect(), [x[:2] for x in inputs["packing"]], Tokenizer.from_file(default_vocabulary()))


def test_run_gives_the_last_stage(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    want = sorted((x.doc_id, x.start, x.length, x.ids_crc32) for x in spark.read.parquet(f"{path}/packing").collect())
    assert sorted((x.doc_id, x.start, x.length, x.ids_crc32) for x in out.collect()) == want


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_rows_of_one_id_are_told_apart(spark):
    """Stage 3 keeps, of the rows of one id, the least by text and other columns, however they are dealt; rows without id stay."""
    r = random.Random(2)
    a, b = (" ".join(words(r, 30)) for _ in range(2))
    rows = [(1, b, "en", "s", 1), (1, a, "fr", "s", 1), (1, a, "en", "t", 1), (1, a, "en", "t", 1), (2, a, "en", "s", 1), (3, "x y", "en", "s", 1), (None, a, "en", "s", 1), (None, None, None, None, None)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        out = corpus_pipeline.without_near_copies(spark, docs, "")
        first = min(((1, a, "en", "t", 1), (1, b, "en", "s", 1)), key=lambda x: x[1])
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [first, (3, "x y", "en", "s", 1), (None, a, "en", "s", 1), (None, None, None, None, None)]))
