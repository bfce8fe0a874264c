import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int, alphabet: str = "abcdefg") -> list[str]:
    return ["".join(r.choice(alphabet) for _ in range(r.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def documents(spark):
    """documents(rows of (doc_id, text) or (doc_id, text, lang, source)) as a DataFrame with columns that clash with what operators add or use inside."""

    def make(rows, clash=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            for name in ("id", "th", "n_lines", "n_words", "kept", "score", "key", "grp", "rep", "x", "seed", "a.b", "ld_id", "wm_words", "host", "conv"):
                df = df.withColumn(name, F.lit("mine"))
        return df

    return make


#: Texts at the edges: null, empty, white, one word, one very long line, many lines, other scripts, control strings.
EDGES = [None, "", " \t\n\x0b\x0c\r ", "word", "x" * 30_000, "same line of twenty characters\n" * 700, "é ü 日本 \U0001f600   a", "<|endoftext|> <|im_end|>", "\n\n\n"]


@pytest.fixture(scope="session")
def edges():
    """Rows with every edge text, twice, and with null ids, languages and sources."""
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(i, t) for i, t in enumerate(EDGES)]
    return rows + [(None, "no id at all, but some words in it", None, None), (None, None, None, None), (100, "only a source is missing here", "fr", None)]
