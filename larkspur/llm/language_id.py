"""Language ID: script ranges narrow the candidates, Viterbi labels the words.

A word is a run of letters.  Its script leaves as candidates the languages that
were seen in that script; its score in a language is the sum of log likelihoods
of its character trigrams (with word boundaries), which a naive Bayes model
gives.  A Viterbi pass over the words of a text, with a penalty for each change
of language, labels spans; so a single odd word does not break a span, and text
that really is mixed comes apart into its languages.  The text's language is the
one with the most letters; its score is that language's share of the letters.

Scale: the model is counts, so it is a plain aggregation over all training
rows: each task adds up its rows in one array of fixed size, and the arrays are
summed by (language, bucket).  The driver gets languages x buckets numbers,
never documents.  Labelling is one pass without a shuffle.  Within a batch the
Viterbi steps of all texts are taken at once, longest text first.

Defined cases: a text that is null or has no letter is `und` with score 0; a
null language is not learnt from; with nothing to learn from, every text is
`und`; letters of a script that no language was seen in leave all languages as
candidates; a tie goes to the language that is first by name; repeated rows
count each; other columns pass through, whatever they are called.
"""

from __future__ import annotations

import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, quoted, small_batches, with_mapped, worker_cache

#: Code point ranges of scripts, from the Unicode block charts.  Letters outside are script 0.
SCRIPT_RANGES = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("latin", 0x2C60, 0x2C7F), ("latin", 0xA720, 0xA7FF), ("latin", 0xFF21, 0xFF5A),
    ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("cyrillic", 0x1C80, 0x1C8F), ("cyrillic", 0x2DE0, 0x2DFF),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("arabic", 0x8A0, 0x8FF),
    ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F),
    ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7A3), ("han", 0x20000, 0x3134F),
]
SCRIPTS = ["other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]

#: Buckets of hashed trigrams; memory of the model is languages x this x 4 bytes.
BUCKETS = 1 << 15
#: Code points worked on at once; bounds the memory of a task beside the longest single text.
CHUNK = 1 << 21


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-cased letter (0 for what is no letter), and its script."""
    lower, script = np.zeros(sys.maxunicode + 1, np.uint32), np.zeros(sys.maxunicode + 1, np.uint8)
    for name, first, last in SCRIPT_RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    return lower, script


class Words:
    """The words of a run of texts, as arrays: for each letter its trigram's
    bucket, for each word its first letter, length, script and text."""

    def __init__(self, texts: list[str]):
        lower, script = worker_cache("letters", _letters)
        # A space before and behind each text keeps words and trigrams apart.
        points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        low = lower[points]
        is_letter = low > 0
        at = np.flatnonzero(is_letter)
        first = at[~is_letter[at - 1]]
        last = at[~is_letter[at + 1]]
        mixed = low * np.uint32(0x9E3779B1)
        bucket = (mixed[at - 1] * np.uint32(31) ^ mixed[at] * np.uint32(1000003) ^ np.roll(mixed, -1)[at] * np.uint32(0x85EBCA6B)) >> np.uint32(7)
        self.bucket = (bucket ^ (bucket >> np.uint32(11))) % np.uint32(BUCKETS)
        self.length = last - first + 1
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64) if len(first) else np.empty(0, np.int64)
        self.script = script[points[first]]
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
        self.text = np.searchsorted(ends, first, "left").astype(np.int64)
        self.n_texts = len(texts)


def _chunks(texts: list[str | None]):
    """Runs (first, texts) of some CHUNK code points; nulls are empty."""
    held, first, size = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            held, first, size = [], i + 1, 0
    if held:
        yield first, held


def train_counts(training: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, kind, slot, n): trigram counts by bucket (kind 0) and letters by script (kind 1)."""

    def run(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in small_batches(batches):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, some in _chunks(texts):
                words = Words(some)
                if not len(words.begin):
                    continue
                names = langs[first : first + len(some)]
                of_letter = np.repeat(words.text, words.length)
                for lang in set(names):
                    own = np.array([x == lang for x in names])
                    a, b = total.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS), np.int64)))
                    a += np.bincount(words.bucket[own[of_letter]], minlength=BUCKETS)
                    mine = own[words.text]
                    b += np.bincount(words.script[mine], words.length[mine], minlength=len(SCRIPTS)).astype(np.int64)
        for lang, arrays in total.items():
            for kind, a in enumerate(arrays):
                slot = np.flatnonzero(a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(slot), pa.string()), pa.array([kind] * len(slot), pa.int32()), pa.array(slot, pa.int32()), pa.array(a[slot], pa.int64())],
                    names=["lang", "kind", "slot", "n"],
                )

    rows = training.select(quoted(text_col).cast("string").alias("text"), quoted(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return rows.mapInArrow(run, "lang string, kind int, slot int, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n"))


class Model:
    """Log likelihoods by (bucket, language), and which languages a script leaves.

    `least_share`: a language is a candidate for a script if at least this share of its letters are of it.
    """

    def __init__(self, rows: list, smoothing: float = 0.5, least_share: float = 1e-3):
        self.langs = sorted({r[0] for r in rows})
        index = {x: i for i, x in enumerate(self.langs)}
        counts, scripts = np.zeros((BUCKETS, len(self.langs))), np.zeros((len(SCRIPTS), len(self.langs)))
        for lang, kind, slot, n in rows:
            (scripts if kind else counts)[slot, index[lang]] = n
        self.score = np.log((counts + smoothing) / (counts.sum(0) + smoothing * BUCKETS)).astype(np.float32)
        allowed = scripts >= least_share * np.maximum(scripts.sum(0), 1)
        allowed[~allowed.any(1)] = True
        self.barred = np.where(allowed, 0, -1e6).astype(np.float32)


def word_scores(model: Model, words: Words) -> np.ndarray:
    """(word, language): log likelihood of the word.  Only the languages that the word's
    script leaves are scored; the others are barred."""
    n, n_langs = len(words.begin), len(model.langs)
    if not n:
        return np.empty((0, n_langs), np.float32)
    out = np.full((n, n_langs), -1e6, np.float32)
    for script in np.unique(words.script).tolist():
        mine, left = words.script == script, np.flatnonzero(model.barred[script] == 0)
        bucket, begin = words.bucket, words.begin
        if not mine.all():
            length = words.length[mine]
            bucket, begin = bucket[np.repeat(mine, words.length)], np.concatenate([[0], np.cumsum(length)[:-1]])
        score = model.score if len(left) == n_langs else model.score[:, left]
        out[np.ix_(mine, left)] = np.add.reduceat(score[bucket], begin, axis=0)
    return out


def viterbi(scores: np.ndarray, text: np.ndarray, n_texts: int, switch: float) -> np.ndarray:
    """The best language of each word: the path with the largest sum of scores
    less `switch` for each change.  Words of one text are neighbours."""
    count = np.bincount(text, minlength=n_texts)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    begin, count = begin[order], count[order]
    label = np.empty(len(scores), np.int16)
    if not len(order):
        return label
    back = np.empty(scores.shape, np.int16)  # where each word's state came from
    longest = int(count[0])
    live = np.searchsorted(-count, -np.arange(1, longest + 1), "right")  # texts that have a word t
    state = np.zeros((len(order), scores.shape[1]), np.float64)
    state[:] = scores[begin]
    stay = np.arange(scores.shape[1], dtype=np.int16)
    rows = np.arange(len(order))
    for t in range(1, longest):
        k = live[t]
        now = state[:k]
        top = now.argmax(1)
        other = now[rows[:k], top] - switch
        come = other[:, None] > now
        at = begin[:k] + t
        back[at] = np.where(come, top[:, None].astype(np.int16), stay)
        state[:k] = np.where(come, other[:, None], now) + scores[at]
    current = state.argmax(1)
    for t in range(longest - 1, -1, -1):
        k = live[t]
        at = begin[:k] + t
        label[at] = current[:k]
        if t:
            current[:k] = back[at, current[:k]]
    return label


def label_texts(model: Model, texts: list[str | None], switch: float) -> list[tuple[str, float, list[tuple[str, int]]]]:
    """(language, score, spans as (language, words)) of each text."""
    out: list = [("und", 0.0, [])] * len(texts)
    if not model.langs:
        return out
    n_langs = len(model.langs)
    for first, some in _chunks(texts):
        words = Words(some)
        if not len(words.begin):
            continue
        label = viterbi(word_scores(model, words), words.text, words.n_texts, switch).astype(np.int64)
        share = np.bincount(words.text * n_langs + label, words.length, minlength=words.n_texts * n_langs).reshape(-1, n_langs)
        letters = share.sum(1)
        best = share.argmax(1)
        new = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(words.text, prepend=-1) != 0))
        spans: list[list] = [[] for _ in some]
        for w, n in zip(new.tolist(), np.diff(np.append(new, len(label))).tolist()):
            spans[words.text[w]].append((model.langs[label[w]], n))
        for i in np.flatnonzero(letters).tolist():
            out[first + i] = (model.langs[best[i]], float(share[i, best[i]] / letters[i]), spans[i])
    return out


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all training rows; one aggregation, languages x buckets numbers to the driver."""
    return Model([tuple(r) for r in train_counts(training, text_col, lang_col).collect()])


def predict(docs: DataFrame, model: Model, text_col: str = "text", switch: float = 12.0) -> DataFrame:
    """`docs` with lang_pred (string), score (double) and lang_spans (array of
    struct<lang, words>) put in, or replaced where the names are taken."""
    added = [("lang_pred", "string"), ("score", "double"), ("lang_spans", "array<struct<lang:string,words:bigint>>")]
    base = docs.drop(*(n for n, _ in added))
    text = fresh(base, "li_text")
    base = base.withColumn(text, quoted(text_col).cast("string"))
    fields = [T.StructField(n, T._parse_datatype_string(k)) for n, k in added]
    # Broadcasts are pickled by reference: only types that every worker has.
    held = docs.sparkSession.sparkContext.broadcast(SimpleNamespace(langs=model.langs, score=model.score, barred=model.barred))
    span = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = label_texts(held.value, batch.column(batch.num_columns - 1).to_pylist(), switch)
            spans = [[{"lang": a, "words": n} for a, n in x[2]] for x in found]
            yield batch, [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(spans, span)]

    return with_mapped(base, run, fields).drop(text)


def held_out(id_col: str = "doc_id"):
    """The fold that is never learnt from: crc32 of the id's decimal text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(quoted(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
