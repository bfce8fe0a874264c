import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm.language_id import fit, held_out, label_texts, predict, viterbi

SYLLABLES = {"aa": "ka ri mo te sul", "bb": "schu ngel öst pfa reit", "cc": "дом рек ван тыл ску"}


def text(r, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(s) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_viterbi_is_best():
    r = np.random.default_rng(1)
    for _ in range(40):
        lengths = r.integers(0, 6, 5)
        where = np.repeat(np.arange(5), lengths)
        scores = r.normal(0, 2, (len(where), 3)).astype(np.float32)
        label = viterbi(scores, where, 5, 1.5)
        value = lambda rows, path: sum(scores[i, p] for i, p in zip(rows, path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
        for d in range(5):
            rows = np.flatnonzero(where == d)
            if len(rows):
                best = max(value(rows, p) for p in itertools.product(range(3), repeat=len(rows)))
                assert abs(value(rows, label[rows]) - best) < 1e-4


def test_held_out_accuracy_and_spans(spark, documents):
    r = random.Random(2)
    rows = [(i, text(r, lang, r.randint(5, 60)), lang) for i, lang in enumerate(r.choice(list(SYLLABLES)) for _ in range(200))]
    docs = documents(rows)
    model = fit(docs.where(~held_out()))
    out = predict(docs, model).withColumn("out", held_out()).collect()
    assert {x.doc_id for x in out if x.out} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(x.lang_pred == x.lang and x.score == 1.0 for x in out if x.out)
    mixed = text(r, "aa", 30) + " " + text(r, "bb", 20) + " " + text(r, "cc", 10)
    ((lang, score, spans),) = label_texts(model, [mixed], 12.0)
    assert lang == "aa" and 0.3 < score < 0.8 and spans == [("aa", 30), ("bb", 20), ("cc", 10)]
    # Script alone rules a language out, however odd the word.
    assert label_texts(model, ["жжщщ"], 12.0)[0][0] == "cc"


def test_edges(spark, documents, edges):
    docs = documents(edges + [(200 + i, "ka ri mo", "zz") for i in range(3)])
    out = predict(docs, fit(docs)).collect()
    assert len(out) == len(edges) + 3
    for x in out:
        has_letter = any(c.isalpha() for c in x.text or "")
        assert (x.lang_pred == "und") == (not has_letter) and 0 <= x.score <= 1 and (x.score > 0) == has_letter
        assert sum(s.words for s in x.lang_spans) == 0 or has_letter


def test_nothing_learnt(documents):
    docs = documents([(1, "a b", None), (2, None, "en")])
    assert {x.lang_pred for x in predict(docs, fit(docs)).collect()} == {"und"}
    assert predict(documents([]), fit(documents([]))).count() == 0


def test_fold(spark):
    got = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(x.h == (zlib.crc32(str(x.id).encode()) % 4 == 2) for x in got)
    assert spark.createDataFrame([(None,)], "id long").select(F.when(held_out("id"), 1).otherwise(0)).first()[0] == 0
