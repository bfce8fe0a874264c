"""Quality classifier with hierarchical empirical Bayes.

A logistic regression over statistics of the text gives each document's evidence
as log odds.  Hosts and paths of hosts differ in their share of good documents;
these shares are estimated by shrinking: a host's towards the global share, a
path's towards its host's, the more the fewer documents there are.  How strongly
is estimated from the spread of the shares themselves (the empirical part).  A
document's posterior is its evidence with the path's share as prior odds; what the
document itself adds to that share is counted out first, so that nothing counts twice.

Scale: texts are read once; what goes on is a dozen numbers per document, in the
checkpoint folder.  The regression takes Newton steps, each an aggregation of
one small matrix over all labelled rows.  Host and path counts are grouped
aggregations, summed map-side, so a host that holds a third of all documents is
no hot spot; shares go back by a join that adaptive execution broadcasts where
they are few and splits where a key is hot.

Defined cases: null and empty texts have the statistics of no words; labels that
repeat for a document are averaged; null labels are not learnt from; with no
labels, or labels of one kind alone, the evidence is 0 and the prior decides; a
null host or path is one of its own; rows that repeat an id are each judged, and
count each; of a site's repeated rows the one of the least host and path counts; ties
of shares do not matter, as nothing is ranked; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, forget_partitioning, quoted

FEATURES = ["log_words", "word_length", "symbols", "bars", "upper", "digits", "exclaims", "top_word", "distinct", "repeats", "dup_lines", "line_length"]
_SYMBOL, _UPPER, _DIGIT = re.compile(rb"[#*$%&<>]"), re.compile(rb"[A-Z]"), re.compile(rb"[0-9]")


def features(text: str | None) -> list[float]:
    """Statistics of a text, of some unit size each."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(1, len(words))
    chars = max(1, sum(map(len, words)))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    root = lambda x: x**0.5
    pairs = len(words) - 1
    return [
        np.log1p(len(words)) / 5,
        chars / n / 6,
        root(len(_SYMBOL.findall(raw)) / chars),
        root(raw.count(b"|") / n),
        root(len(_UPPER.findall(raw)) / chars),
        root(len(_DIGIT.findall(raw)) / chars),
        root(raw.count(b"!") / n),
        max(counts.values(), default=0) / n,
        len(counts) / n,
        root(1 - len(set(zip(words, words[1:]))) / pairs) if pairs > 0 else 0.0,
        root(1 - len(set(lines)) / n_lines) if lines else 0.0,
        np.log1p(len(words) / n_lines) / 5,
    ]


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of `docs` but the text, and x: its features."""
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(*map(quoted, rest), quoted(text_col).cast("string").alias(text_col))
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            x = [features(t) for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), pa.array(x, pa.list_(pa.float64()))], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def fit_logistic(labelled: DataFrame, steps: int = 8, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression with squares, by Newton steps.

    labelled: x (array of features), y (0 to 1).  Each step sends one matrix per task to the driver, whatever the rows.
    """
    size = 1 + 2 * len(FEATURES)
    weights = np.zeros(size)
    for _ in range(steps):
        now = weights.copy()

        def run(batches, now=now):
            hessian, slope, n = np.zeros((size, size)), np.zeros(size), 0.0
            for batch in batches:
                x = np.array(batch.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
                y = batch.column(1).to_numpy(zero_copy_only=False)
                d = np.hstack([np.ones((len(x), 1)), x, x * x])
                p = 1 / (1 + np.exp(-np.clip(d @ now, -30, 30)))
                hessian += d.T @ (d * (p * (1 - p))[:, None])
                slope += d.T @ (y - p)
                n += len(x)
            both = np.concatenate([hessian.ravel(), slope, [n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both)), pa.int64()), pa.array(both)], names=["i", "v"])

        sums = dict(map(tuple, labelled.select("x", "y").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()))
        flat = np.array([sums.get(i, 0.0) for i in range(size * size + size + 1)])
        hessian, slope = flat[: size * size].reshape(size, size), flat[size * size : -1]
        if not flat[-1]:
            break
        penalty = np.full(size, ridge)
        penalty[0] = 1e-6
        step = np.linalg.solve(hessian + np.diag(penalty), slope - penalty * weights)
        weights = weights + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-4:
            break
    return np.round(weights, 9)


def _evidence(measured: DataFrame, weights: np.ndarray) -> DataFrame:
    """`measured` with evidence, the log odds of the regression, in place of x."""
    w = [float(v) for v in weights]
    n = len(FEATURES)
    x = [F.get("x", i) for i in range(n)]
    total = F.lit(w[0])
    for i in range(n):
        total = total + x[i] * w[1 + i] + x[i] * x[i] * w[1 + n + i]
    return measured.withColumn("evidence", F.round(F.greatest(F.least(total, F.lit(12.0)), F.lit(-12.0)), 9)).drop("x")


def _strength(groups: DataFrame, share: str, parent) -> float:
    """How many documents the prior is worth: from the spread of the groups'
    shares about their parents', beyond what their sizes explain."""
    m = F.least(F.greatest(parent, F.lit(1e-3)), F.lit(1 - 1e-3))
    row = groups.where("n >= 2").agg(
        F.sum(F.col("n") * (F.col(share) - m) ** 2).alias("spread"), F.sum(m * (1 - m)).alias("chance"), F.sum(F.col("n") * m * (1 - m)).alias("most"), F.count(F.lit(1)).alias("k")
    ).first()
    if not row.k or row.most is None:
        return 50.0
    between = max(0.0, row.spread - row.chance) / max(row.most - row.chance, 1e-9)
    return round(float(min(5000.0, max(2.0, 1 / max(between, 1e-6) - 1))), 6)


def _logit(p):
    return F.log(p / (1 - p))


def quality_classifier(
    docs: DataFrame, labels: DataFrame, sites: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    host_col: str = "source", path_col: str = "lang", label_id: str = "doc_id", label_col: str = "quality", least: float = 0.5,
) -> DataFrame:
    """One row per row of `docs`: doc_id, evidence (log odds), host_share,
    path_share (without the document itself), quality (posterior, 0 to 1), kept (quality >= least).

    `sites` has site_id, site_host and site_path for documents whose host and
    path are known otherwise than by their own columns; one row for each id."""
    base = docs.select(
        quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"),
        F.coalesce(quoted(host_col).cast("string"), F.lit("\x00")).alias("host"), F.coalesce(quoted(path_col).cast("string"), F.lit("\x00")).alias("path"),
    )
    known = labels.select(quoted(label_id).cast("long").alias("label_of"), quoted(label_col).cast("double").alias("y")).where("y is not null")
    known = known.groupBy("label_of").agg(F.avg("y").alias("y"))
    measured = _measured(base, "text")
    measured = measured.join(known, measured["doc_id"] == known["label_of"], "left").drop("label_of")
    if sites is not None:
        sites = sites.groupBy("site_id").agg(F.min(F.struct("site_host", "site_path")).alias("site")).select("site_id", "site.site_host", "site.site_path")
        measured = measured.join(sites, measured["doc_id"] == sites["site_id"], "left")
        measured = measured.withColumns({"host": F.coalesce("site_host", "host"), "path": F.coalesce("site_path", "path")})
        measured = measured.drop("site_id", "site_host", "site_path")
    measured = checkpointed(measured)

    kinds = measured.where("y is not null").agg(F.count(F.when(F.col("y") > 0.5, 1)), F.count(F.when(F.col("y") <= 0.5, 1))).first()
    weights = fit_logistic(measured.where("y is not null")) if min(kinds) else np.zeros(1 + 2 * len(FEATURES))
    base_share = (kinds[0] + 1) / (sum(kinds) + 2)
    scored = _evidence(measured, weights)
    # Labels count as they are, other documents by what the classifier gives.
    share = F.coalesce("y", 1 / (1 + F.exp(-F.col("evidence"))))
    paths = checkpointed(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(share), 9).alias("share")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("share")) / F.sum("n")).alias("share"))
    whole = hosts.agg(F.sum(F.col("n") * F.col("share")), F.sum("n")).first()
    overall = round(float(whole[0] / whole[1]), 9) if whole[1] else 0.5
    host_worth = _strength(hosts, "share", F.lit(overall))
    shrunk = F.round((F.col("n") * F.col("share") + host_worth * overall) / (F.col("n") + host_worth), 9)
    hosts = hosts.select("host", shrunk.alias("host_share"))
    paths = paths.join(hosts, "host")
    path_worth = _strength(paths, "share", F.col("host_share"))
    prior = checkpointed(paths.select(forget_partitioning(F.xxhash64("host", "path")).alias("k"), F.col("host").alias("ph"), F.col("path").alias("pp"), "host_share", "n", "share"))

    keyed = scored.withColumn("own", share).withColumn("k", forget_partitioning(F.xxhash64("host", "path")))
    out = keyed.join(prior, (keyed["k"] == prior["k"]) & (keyed["host"] == prior["ph"]) & (keyed["path"] == prior["pp"]))
    others = (F.col("n") * F.col("share") - F.col("own") + path_worth * F.col("host_share")) / (F.col("n") - 1 + path_worth)
    out = out.withColumn("path_share", F.round(F.least(F.greatest(others, F.lit(0.0)), F.lit(1.0)), 9))
    bounded = F.least(F.greatest(F.col("path_share"), F.lit(1e-4)), F.lit(1 - 1e-4))
    odds = F.col("evidence") - float(np.log(base_share / (1 - base_share))) * float(min(kinds) > 0) + _logit(bounded)
    out = out.withColumn("quality", F.round(1 / (1 + F.exp(-odds)), 9))
    return out.select("doc_id", "evidence", "host_share", "path_share", "quality", (F.col("quality") >= least).alias("kept"))


def sites_of(pages: DataFrame) -> DataFrame:
    """(site_id, site_host, site_path) of documents.  A page belongs to the document
    that the number in its URL names; of several the one with the least page_id counts."""
    url = F.col("url")
    site = pages.select(
        F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+/[^/?#]+/(\d{1,18})", 1).alias("id"),
        F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1).alias("site_host"),
        F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]+/([^/?#]+)", 1).alias("site_path"), F.col("page_id"),
    ).where("id <> ''")
    return site.groupBy(F.col("id").cast("long").alias("site_id")).agg(
        F.min_by("site_host", "page_id").alias("site_host"), F.min_by("site_path", "page_id").alias("site_path")
    )
