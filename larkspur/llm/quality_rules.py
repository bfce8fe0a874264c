"""Quality rules with robust multivariate outliers, in DataFrame operations alone.

Base rules look at one document: too few words, or too many repeated ones.  The
documents that pass are judged among their like: for each (language, source) a
minimum-covariance-determinant estimate gives a centre and covariance that
outliers cannot pull, and a document whose transformed statistics lie too far
from the centre, by Mahalanobis distance, is rejected.

The estimate is the subset of the `support` share of a group whose covariance has
the least determinant, as concentration steps find it: each step keeps the share
that is nearest to the present estimate and takes the mean and covariance of
these, which lowers the determinant or leaves it.  There are three starts (median
and median absolute deviation; mean and covariance of all; median and the
covariance of spatial signs).  Each goes on until its determinant falls no more,
and the least of the three is the group's estimate.  A factor makes the covariance
that of a normal sample, so that squared distances are chi-square with 4 degrees.

Scale: texts are read once; what goes on is five numbers per document, written
to the checkpoint folder.  A group's order statistics come from counts of
narrow bins (0.4 % of a distance; values of the same bin are ties), so a step of all
starts and groups is two aggregations that sum map-side, and no group is gathered or sorted in one task, however hot.
Estimates go back to their documents by a join that adaptive execution
broadcasts where it is small and splits where a group is hot.

Defined cases: a null text has no words; null languages and sources are groups
of their own; groups of fewer than `min_group` documents are judged together
per language, languages that are still too small together; where even all of
these are too few, base rules alone decide; equal vectors (a group of copies)
have the variance floors, so that ties with the centre are at distance 0; starts of
equal determinant give the one named first; a text of any length is measured whole, as one
row's array of words; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, forget_partitioning, fresh, quoted, removed, written

_WHITE = r"[\x20\x09-\x0D]+"
DIMS = 4
#: Standard deviations that an estimate has at least, so that a group of like documents rejects no small difference: log words, log word length, share of symbols, share of repeats.
FLOORS = (0.5, 0.2, 0.05, 0.1)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once for each row, also where lambdas inside use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in `words`."""

    def of(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
        )

        def twice(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            return F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1))

        # Starts of repeated windows in ascending order; each adds what the one before does not cover.
        starts = lambda s: F.sort_array(F.transform(twice(s), lambda x: x["p"]))
        covered = lambda p: F.aggregate(
            p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        )["n"]
        return _let(F.sort_array(windows), lambda s: _let(starts(s), covered))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(of(words))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) put in or replaced."""
    words, lines, text = fresh(docs, "qr_words"), fresh(docs, "qr_lines"), F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    out = docs.withColumns({
        words: F.array_remove(F.split(text, _WHITE, -1), ""),
        lines: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    chars = F.char_length(text)
    out = out.withColumns({
        "n_words": F.size(quoted(words)).cast("long"),
        "word_chars": F.char_length(F.regexp_replace(text, _WHITE, "")).cast("long"),
        "n_symbols": (chars - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size(quoted(lines)) - F.size(F.array_distinct(quoted(lines)))).cast("long"),
        "n_repeat_words": _repeat_words(quoted(words)).cast("long"),
    })
    return out.drop(words, lines)


def _vector() -> list[Column]:
    """Transformed statistics.  Shares are square roots, which spreads small values."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(n.cast("double")),
        F.log((F.col("word_chars") + 1) / n),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt((F.col("n_repeat_words") + F.col("n_dup_lines")) / n),
    ]


_X = [f"x{i}" for i in range(DIMS)]
_PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def consistency(support: float) -> float:
    """What the covariance of the nearest `support` share of a normal sample of 4
    dimensions is to be multiplied with: support / P(chi-square of 6 <= the quantile of chi-square of 4)."""
    low, high = 0.0, 400.0  # half the quantile, by bisection of the closed form
    for _ in range(200):
        y = (low + high) / 2
        low, high = (y, high) if 1 - math.exp(-y) * (1 + y) < support else (low, y)
    return support / (1 - math.exp(-y) * (1 + y + y * y / 2))


def _quantile_bins(rows: DataFrame, key: list[str], value: Column, share: float, per_unit: int) -> DataFrame:
    """(key, bin): by group the first bin of width 1 / per_unit up to which at least `share` of the values lie."""
    from pyspark.sql import Window

    counts = rows.groupBy(*key, F.floor(value * per_unit).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Bins are narrow but bounded in number; a group's documents are not.
    run = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*key)
    counts = counts.select(*key, "bin", F.sum("n").over(run).alias("upto"), F.sum("n").over(whole).alias("all"))
    return counts.where(F.col("upto") >= F.col("all") * share).groupBy(*key).agg(F.min("bin").alias("bin"))


def _with_model(rows: DataFrame, model: DataFrame, key: list[str]) -> DataFrame:
    """Rows with the columns of their group; the key is disguised so that a hot group can be split."""
    hidden = [F.col(c).alias(f"of_{c}") for c in key]
    model = model.select(forget_partitioning(F.xxhash64(*key)).alias("of"), *hidden, *[c for c in model.columns if c not in key])
    on = [forget_partitioning(F.xxhash64(*key)) == F.col("of"), *[F.col(c) == F.col(f"of_{c}") for c in key]]
    return rows.join(model, reduce(lambda a, b: a & b, on)).drop("of", *[f"of_{c}" for c in key])


def _with_distance(rows: DataFrame) -> DataFrame:
    """Rows, with their model, and d2, the squared Mahalanobis distance, by forward substitution with the Cholesky factor l_ij."""
    out = rows
    for i in range(DIMS):
        v = F.col(_X[i]) - F.col(f"m{i}")
        for j in range(i):
            v = v - F.col(f"l{i}{j}") * F.col(f"z{j}")
        out = out.withColumn(f"z{i}", v / F.col(f"l{i}{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIMS)])
    return out.withColumn("d2", d2).drop(*[f"z{i}" for i in range(DIMS)])


_MODEL = [*(f"m{i}" for i in range(DIMS)), *(f"l{i}{j}" for i, j in _PAIRS)]


def _factor(moments: DataFrame) -> DataFrame:
    """Model rows (grp, start, logdet, m_i, l_ij) from (grp, start, m_i, c_ij): the
    Cholesky factor of the covariance, its variances raised to the floors."""
    out = moments
    for i in range(DIMS):
        for j in range(i + 1):
            v = F.greatest(F.col(f"c{i}{j}"), F.lit(FLOORS[i] ** 2)) if i == j else F.col(f"c{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(1e-12))) if i == j else v / F.col(f"l{j}{j}"))
    # Rounding takes away what the order of summation adds, so that runs agree.
    keep = [F.round(F.col(c), 9).alias(c) for c in _MODEL]
    logdet = reduce(lambda a, b: a + b, [2 * F.log(f"l{i}{i}") for i in range(DIMS)])
    return out.select("grp", "start", F.round(logdet, 9).alias("logdet"), *keep)


def _starts(rows: DataFrame) -> DataFrame:
    """Models of starts 0 (median and scaled median absolute deviation), 1 (mean and
    covariance) and 2 (median and the covariance of spatial signs) by group."""
    each = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(x).alias("v")) for i, x in enumerate(_X)])).alias("x")).select("grp", "x.dim", "x.v")
    key, middle = ["grp", "dim"], (F.col("bin") + 0.5) / 200
    median = written(_quantile_bins(each, key, F.col("v"), 0.5, 200).select(*key, middle.alias("med")))
    off = _quantile_bins(_with_model(each, median, key), key, F.abs(F.col("v") - F.col("med")), 0.5, 200).select(*key, (1.4826 * middle).alias("mad"))
    of = lambda i, c: F.max(F.when(F.col("dim") == i, F.col(c)))
    both = median.join(off, key).groupBy("grp").agg(*[of(i, "med").alias(f"m{i}") for i in range(DIMS)], *[of(i, "mad").alias(f"s{i}") for i in range(DIMS)])
    spread = {f"c{i}{j}": F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0) for i, j in _PAIRS}
    first = written(_factor(both.withColumn("start", F.lit(0)).withColumns(spread)))

    near = _with_model(rows, first.drop("start"), ["grp"])
    u = [F.col(_X[i]) - F.col(f"m{i}") for i in range(DIMS)]
    z = [u[i] / F.col(f"l{i}{i}") for i in range(DIMS)]
    size = F.greatest(reduce(lambda a, b: a + b, [x * x for x in z]), F.lit(1e-12))
    sums = near.groupBy("grp").agg(
        *[F.avg(u[i]).alias(f"a{i}") for i in range(DIMS)], *[F.first(c).alias(c) for c in _MODEL],
        *[F.avg(u[i] * u[j]).alias(f"q{i}{j}") for i, j in _PAIRS], *[F.avg(z[i] * z[j] / size).alias(f"s{i}{j}") for i, j in _PAIRS],
    )
    mean = sums.select("grp", F.lit(1).alias("start"), *[(F.col(f"m{i}") + F.col(f"a{i}")).alias(f"m{i}") for i in range(DIMS)],
                       *[(F.col(f"q{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")).alias(f"c{i}{j}") for i, j in _PAIRS])
    signs = sums.select("grp", F.lit(2).alias("start"), *[f"m{i}" for i in range(DIMS)],
                        *[(DIMS * F.col(f"s{i}{j}") * F.col(f"l{i}{i}") * F.col(f"l{j}{j}")).alias(f"c{i}{j}") for i, j in _PAIRS])
    return first.unionByName(_factor(mean)).unionByName(_factor(signs))


def _step(rows: DataFrame, model: DataFrame, support: float, factor: float) -> DataFrame:
    """One concentration step of each start and group."""
    key = ["grp", "start"]
    near = _with_distance(_with_model(rows, model.drop("logdet"), ["grp"]))
    # Bins of log distance: 256 to a unit, so that a bin spans 0.4 % of the distance.
    log_d = F.log(F.col("d2") + 1e-6)
    edge = _quantile_bins(near, key, log_d, support, 256)
    kept = _with_model(near, edge, key).where(F.floor(log_d * 256).cast("long") <= F.col("bin"))
    # Moments about the present centre, which keeps the digits that a difference of large sums would lose.
    u = [F.col(_X[i]) - F.col(f"m{i}") for i in range(DIMS)]
    sums = kept.groupBy(*key).agg(
        *[F.avg(u[i]).alias(f"a{i}") for i in range(DIMS)], *[F.first(f"m{i}").alias(f"m{i}") for i in range(DIMS)],
        *[F.avg(u[i] * u[j]).alias(f"q{i}{j}") for i, j in _PAIRS],
    )
    cov = {f"c{i}{j}": factor * (F.col(f"q{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")) for i, j in _PAIRS}
    return _factor(sums.withColumns(cov | {f"m{i}": F.col(f"m{i}") + F.col(f"a{i}") for i in range(DIMS)}))


def estimate(rows: DataFrame, support: float = 0.75, tolerance: float = 1e-3, steps: int = 100) -> DataFrame:
    """The minimum-covariance-determinant estimate (grp, logdet, m_i, l_ij) of each
    group of `rows` (grp, x_i).  A start is done when a step does not lower its log
    determinant by `tolerance`; `steps` only guards against endless loops and is not reached."""
    factor = consistency(support)
    state = written(_step(rows, written(_starts(rows)), support, factor).withColumn("live", F.lit(True)))
    for _ in range(steps):
        now = _step(rows, state.where("live").drop("live"), support, factor)
        now = now.select(F.col("grp").alias("g"), F.col("start").alias("s"), *[F.col(c).alias(f"n_{c}") for c in ("logdet", *_MODEL)])
        better = F.coalesce(F.col("n_logdet") <= F.col("logdet") - tolerance, F.lit(False))
        columns = [F.when(better, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("logdet", *_MODEL)]
        before = state
        state = written(state.join(now, (F.col("grp") == F.col("g")) & (F.col("start") == F.col("s")), "left").select("grp", "start", *columns, better.alias("live")))
        removed(before)
        if state.where("live").isEmpty():
            break
    best = state.groupBy("grp").agg(F.min(F.struct("logdet", "start", *_MODEL)).alias("x"))
    return best.select("grp", "x.logdet", *[F.col(f"x.{c}").alias(c) for c in _MODEL])


def _groups(rows: DataFrame, min_group: int) -> DataFrame:
    """(lang, source, grp) for groups that can be judged: a group of its own, its language's rest, or the rest of all."""
    name = lambda *c: F.concat_ws("\x1f", *[F.coalesce(x, F.lit("\x00")) for x in c])
    own = rows.groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("n"))
    small = own.where(F.col("n") < min_group)
    by_lang = small.groupBy("g_lang").agg(F.sum("n").alias("n_lang"))
    rest = by_lang.where(F.col("n_lang") < min_group).agg(F.sum("n_lang")).first()[0] or 0
    out = own.join(by_lang.withColumnRenamed("g_lang", "bl"), F.col("g_lang").eqNullSafe(F.col("bl")), "left")
    grp = (
        F.when(F.col("n") >= min_group, name(F.lit("own"), F.col("g_lang"), F.col("g_source")))
        .when(F.col("n_lang") >= min_group, name(F.lit("lang"), F.col("g_lang")))
        .when(F.lit(rest) >= min_group, F.lit("rest"))
    )
    return out.select("g_lang", "g_source", grp.alias("grp"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_words: int = 50, max_repeat_percent: int = 50, support: float = 0.75, min_group: int = 40, cutoff: float = 36.0,
) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed (boolean), distance2 (double, null where
    no estimate applies) and kept (boolean).  A squared distance over `cutoff`
    rejects; 36 is the point of chi-square with 4 degrees beyond which 3 in ten million lie."""
    base = docs.select(
        quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"),
        quoted(lang_col).cast("string").alias("g_lang"), quoted(source_col).cast("string").alias("g_source"),
    )
    counted = statistics(base).drop("text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)
    counted = checkpointed(counted.withColumns(dict(zip(_X, [F.round(x, 6) for x in _vector()]))))

    passed = counted.where(~F.col("base_failed"))
    groups = checkpointed(_groups(passed, min_group))
    joined = _join_groups(passed, groups)
    rows = joined.where(F.col("grp").isNotNull()).select("grp", *_X)
    model = written(estimate(rows, support)).drop("logdet")

    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = _with_distance(_with_model(joined.where(F.col("grp").isNotNull()), model, ["grp"]))
    judged = judged.select("doc_id", *stats, "base_failed", F.col("d2").alias("distance2"), (F.col("d2") <= cutoff).alias("kept"))
    others = joined.where(F.col("grp").isNull()).select("doc_id", *stats, "base_failed", F.lit(None).cast("double").alias("distance2"), F.lit(True).alias("kept"))
    dropped = counted.where("base_failed").select("doc_id", *stats, "base_failed", F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept"))
    return judged.unionByName(others).unionByName(dropped)


def _join_groups(passed: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.select(F.col("g_lang").alias("gl"), F.col("g_source").alias("gs"), "grp")
    return passed.join(g, F.col("g_lang").eqNullSafe(F.col("gl")) & F.col("g_source").eqNullSafe(F.col("gs"))).drop("gl", "gs")
