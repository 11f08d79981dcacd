"""Robust multivariate quality rule: minimum covariance determinant per (lang, source).

Per-document statistics are transformed to a vector; for every (lang, source)
the mean and covariance of the most concentrated ``SUPPORT`` share of its
documents are found by concentration steps (distances -> the closest share ->
new mean and covariance) from a coordinate-wise median start.  Documents whose
squared Mahalanobis distance exceeds ``CUTOFF`` are rejected.  All of it is
DataFrame code; a step is one partial aggregation to a row per group, so a hot
source costs no more than its rows.

Edge cases: null or empty text has zero statistics and fails the base rule;
null lang or source is a group of its own; groups with fewer than ``LEAST``
documents that pass the base rule take the estimate of their language, and
languages with fewer that of the corpus, found by the same steps; constant
statistics are held apart by ``FLOOR``; repeated rows count once each; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import common as C

#: Share of a group's documents that the estimate rests on.
SUPPORT = 0.75
STEPS = 4
LEAST = 50
#: Groups whose estimates may be broadcast (about 300 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 100_000
#: Variance added to each statistic: about the spread of one stray mark per thousand characters.
FLOOR = 0.25
#: Chi-square with 6 degrees of freedom exceeds it with probability about 1e-9.
CUTOFF = 55.0
#: Median of that distribution, for the consistency factor.
MEDIAN = 5.348
SYMBOLS = "#*$%&|<>"
VECTOR = ["x_words", "x_length", "x_symbols", "x_lines", "x_repeat", "x_marks"]
P = len(VECTOR)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more in the text, first occurrence included."""
    n = F.size(w)
    none = F.array().cast("array<bigint>")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(
        F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))).otherwise(none)

    def places(s: Column) -> Column:
        """Positions of windows equal to a neighbour in (hash, position) order."""
        pairs = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, b: F.when(
            a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    def covered(q: Column) -> Column:
        gaps = F.zip_with(q, F.slice(q, 2, F.greatest(F.size(q) - 1, F.lit(0))),
                          lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def count(h: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            _let(keyed, lambda s: _let(places(s), covered)))

    return _let(windows, count)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the per-text counts; one projection, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, C.WORD_SEP), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        _repeat_words(w).cast("long").alias("n_repeat_words")))
    line_counts = _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"),
        counts.alias("w"), line_counts.alias("l"),
        (F.size(F.split(text, f"[{SYMBOLS}]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size(F.split(text, "!", -1)) - 1).cast("long").alias("n_marks"),
    ).select("doc_id", "lang", "source", "w.*", "l.*", "n_symbols", "n_marks")


def with_vector(stats: DataFrame) -> DataFrame:
    """Adds base_failed, the group key and the transformed statistics."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    share = lambda top, bottom: F.log1p(1000.0 * F.col(top) / bottom)
    return stats.select(
        "*",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.concat_ws("\u0001", F.coalesce("lang", F.lit("\u0000")), F.coalesce("source", F.lit("\u0000"))).alias("grp"),
        F.log1p(F.col("n_words").cast("double")).alias("x_words"),
        (4 * F.log1p(chars / n)).alias("x_length"),
        share("n_symbols", chars).alias("x_symbols"),
        # a repeated line or two in a short text is ordinary; half of the lines is not
        (4 * F.log1p(3.0 * F.col("n_dup_lines") / (F.col("n_lines") + 10))).alias("x_lines"),
        (F.lit(0.5) * share("n_repeat_words", n)).alias("x_repeat"), share("n_marks", chars).alias("x_marks"))


def _whitening(est: DataFrame) -> DataFrame:
    """From m_i and c_i_j: w_i_j, the inverse of the Cholesky factor, so that d2 = |w (x - m)|^2."""
    c = lambda a, i, j: F.col(f"{a}_{i}_{j}")
    total = lambda xs: sum(xs[1:], xs[0]) if xs else F.lit(0.0)
    for j in range(P):
        est = est.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(c("c", j, j) + FLOOR - total([c("l", j, k) ** 2 for k in range(j)]), F.lit(FLOOR / 4))))
        est = est.withColumns({f"l_{i}_{j}": (c("c", i, j) - total([c("l", i, k) * c("l", j, k) for k in range(j)])) / c("l", j, j)
                               for i in range(j + 1, P)})
    for gap in range(P):
        est = est.withColumns({f"w_{j + gap}_{j}": 1 / c("l", j, j) if not gap else
                               -total([c("l", j + gap, k) * c("w", k, j) for k in range(j, j + gap)]) / c("l", j + gap, j + gap)
                               for j in range(P - gap)})
    return est.select("grp", *[f"m_{i}" for i in range(P)], *[f"w_{i}_{j}" for i in range(P) for j in range(i + 1)])


def _distance() -> Column:
    z = [sum((F.col(f"w_{i}_{j}") * (F.col(VECTOR[j]) - F.col(f"m_{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((x * x for x in z), F.lit(0.0))


def _moments(rows: DataFrame) -> DataFrame:
    x = [F.col(v) for v in VECTOR]
    sums = [F.avg(x[i]).alias(f"m_{i}") for i in range(P)]
    sums += [F.covar_pop(x[i], x[j]).alias(f"c_{i}_{j}") for i in range(P) for j in range(i + 1)]
    return _whitening(rows.groupBy("grp").agg(*sums))


def levels(rows: DataFrame) -> DataFrame:
    """grp, used (whose estimate judges the group), member (the estimates that the group's rows belong to); stored."""
    every = C.write_table(rows.groupBy("grp", F.coalesce("lang", F.lit("\u0000")).alias("language")).agg(F.sum((~F.col("base_failed")).cast("long")).alias("n")))
    by_lang = every.groupBy("language").agg(F.sum("n").alias("n_lang"))
    wide = F.concat(F.lit("\u0002"), "language")  # a key that no group has
    used = every.join(by_lang, "language").select("grp", wide.alias("wide"), F.when(F.col("n") >= LEAST, F.col("grp")).when(
        F.col("n_lang") >= LEAST, wide).otherwise(F.lit("\u0003")).alias("used"))
    used = C.write_table(used)
    asked = C.write_table(used.select(F.col("used").alias("key")).distinct())
    member = used.select("grp", F.explode(F.array("grp", "wide", F.lit("\u0003"))).alias("key")).join(asked, "key").groupBy("grp").agg(F.collect_list("key").alias("member"))
    return C.write_table(used.join(member, "grp", "left").select("grp", "used", "member"))


def estimates(rows: DataFrame) -> DataFrame:
    """grp -> mean, whitening matrix and scale of the minimum-covariance-determinant fit that judges it (one small row per group)."""
    level = levels(rows)
    fits = _fits(rows.filter(~F.col("base_failed")).select("grp", *VECTOR).join(C.sized_broadcast(level.select("grp", "member"), BROADCAST_GROUPS), "grp")
                 .select(F.explode("member").alias("grp"), *VECTOR))
    return C.write_table(level.select(F.col("grp").alias("own"), F.col("used").alias("grp")).join(fits, "grp").drop("grp").withColumnRenamed("own", "grp"))


def _fits(fit: DataFrame) -> DataFrame:
    """The fit of each ``grp``; rows may be members of several."""
    middle = fit.groupBy("grp").agg(*[F.percentile_approx(v, 0.5, 10000).alias(f"m_{i}") for i, v in enumerate(VECTOR)])
    middle = C.write_table(middle)
    spread = fit.join(C.sized_broadcast(middle, BROADCAST_GROUPS), "grp").groupBy("grp", *[f"m_{i}" for i in range(P)]).agg(
        *[F.percentile_approx(F.abs(F.col(v) - F.col(f"m_{i}")), 0.5, 10000).alias(f"s_{i}") for i, v in enumerate(VECTOR)])
    start = spread.withColumns({f"c_{i}_{j}": (1.4826 * F.col(f"s_{i}")) ** 2 if i == j else F.lit(0.0) for i in range(P) for j in range(i + 1)})
    now = C.write_table(_whitening(start))
    for _ in range(STEPS):
        far = fit.join(C.sized_broadcast(now, BROADCAST_GROUPS), "grp").select("grp", *VECTOR, _distance().alias("d2"))
        edge = C.write_table(far.groupBy("grp").agg(F.percentile_approx("d2", SUPPORT, 10000).alias("edge")))
        now = C.write_table(_moments(far.join(C.sized_broadcast(edge, BROADCAST_GROUPS), "grp").filter(F.col("d2") <= F.col("edge"))))
    scale = fit.join(C.sized_broadcast(now, BROADCAST_GROUPS), "grp").select("grp", _distance().alias("d2")).groupBy("grp").agg(
        F.greatest(F.percentile_approx("d2", 0.5, 10000) / MEDIAN, F.lit(1.0)).alias("scale"))
    return C.write_table(now.join(scale, "grp"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, distance (null: no row of the corpus passes the base rule) and kept, for every row of ``docs``."""
    rows = with_vector(C.write_table(statistics(docs)))
    out = rows.join(C.sized_broadcast(estimates(rows), BROADCAST_GROUPS), "grp", "left").withColumn("distance", _distance() / F.col("scale"))
    fine = F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)) & ~F.isnan(F.coalesce("distance", F.lit(0.0)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & fine).alias("kept"), "distance")
