"""Theme aggregates: summary, rising, key signals, praise, requests, polarising.

Core idea (theme facts): one pass explodes each review's tag array *plus a
null marker* and aggregates by (group keys, theme).  The null-theme row of a
group carries the group's totals, so per-theme measures and their
denominators come out of a single partial+final HashAggregate — one shuffle
of about groups x themes rows per map task, whatever the skew of the input.
``explode_outer`` is used on purpose: the array is never empty, and unlike
``explode`` it does not make Catalyst copy the tag expression into an
inferred ``size(...) > 0`` filter (which would run keyword matching twice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens import taxonomy as tx
from reviewlens.functions.text import days_between, ntz_literal, pct, truncate
from reviewlens.operators.recent import ALL, keyed, unkeyed
from reviewlens.operators.tagging import KINDS, ordinal_expr, requests_of, tag_expr, tags_of
from reviewlens.session import write_table

LOW = (1, 2)
HIGH = (4, 5)


def _explode_with_total(tags: Column) -> Column:
    return F.explode_outer(F.concat(F.array(F.lit(None).cast("string")), tags))


def _fact_rows(df: DataFrame, by: Sequence[str], tag_col: str) -> DataFrame:
    """Per (keys, theme) measures, the null theme carrying the group's totals."""
    d, keys = keyed(df, by)
    recent = F.col("is_recent") if "is_recent" in df.columns else F.lit(False)
    rows = d.select(
        *keys,
        F.col("rating"),
        F.col("date"),
        recent.alias("_r"),
        _explode_with_total(F.col(tag_col)).alias("theme"),
    )
    return rows.groupBy(*keys, "theme").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.count_if("_r").alias("recent_mentions"),
        F.count_if(F.col("rating").isin(*LOW)).alias("low_count"),
        F.count_if(F.col("rating").isin(*HIGH)).alias("high_count"),
        F.sum("rating").alias("rating_sum"),
        F.sum(F.when(F.col("_r"), F.col("rating"))).alias("recent_rating_sum"),
        F.min(F.when(F.col("_r"), F.col("date"))).alias("recent_oldest"),
        F.max("date").alias("max_date"),
    )


def _with_totals(agg: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = list(by) or [ALL]
    w = Window.partitionBy(*keys)
    total = lambda c: F.max(F.when(F.col("theme").isNull(), F.col(c))).over(w)
    out = agg.select(
        *keys, "theme", "mentions", "recent_mentions", "low_count", "high_count",
        "rating_sum", "recent_rating_sum", "recent_oldest",
        total("mentions").alias("n"),
        total("recent_mentions").alias("n_recent"),
        total("low_count").alias("n_low"),
        total("high_count").alias("n_high"),
    )
    return unkeyed(out.where(F.col("theme").isNotNull()), by)


def theme_facts(df: DataFrame, by: Sequence[str] = ("app_id",), tag_col: str = "complaint_categories") -> DataFrame:
    """Per (keys, theme): mentions, recent/low/high counts, rating sums and the
    oldest recent date, with the group's totals on every row.

    ``df`` may carry ``is_recent`` (from ``recent.flag_recent``); without it
    the recent measures are zero.
    """
    return _with_totals(_fact_rows(df, by, tag_col), by)


def stored_facts(df: DataFrame, by: Sequence[str] = ("app_id",), tag_col: str = "complaint_categories"):
    """(facts, newest review date): one pass over the reviews; only the facts,
    groups x themes rows, are stored, and several reports may share them."""
    agg = write_table(_fact_rows(df, by, tag_col))
    return _with_totals(agg, by), agg.where(F.col("theme").isNull()).agg(F.max("max_date")).first()[0]


def _ranked(df: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """``rank`` inside each group of a per-theme table (a few dozen rows per group)."""
    d, keys = keyed(df, by)
    return unkeyed(d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")), by)


# ── F1 ──────────────────────────────────────────────────────────────────────
def theme_summary(df: DataFrame, by: Sequence[str] = ("app_id",), tag_col: str = "complaint_categories",
                  facts: DataFrame | None = None) -> DataFrame:
    """(keys, theme, mentions, pct_of_reviews, rank by mentions); denominator = all rows."""
    f = facts if facts is not None else theme_facts(df, by, tag_col)
    return _ranked(f, by, F.col("mentions").desc(), ordinal_expr("theme", tx.COMPLAINT_GROUPS)).select(
        *by, "theme", "mentions", pct("mentions", "n").alias("pct_of_reviews"), "rank")


# ── F2 ──────────────────────────────────────────────────────────────────────
def rising_themes(flagged: DataFrame, by: Sequence[str] = ("app_id",), facts: DataFrame | None = None) -> DataFrame:
    """Themes whose recent share (rounded) beats the overall share (rounded), ranked by the change."""
    f = facts if facts is not None else theme_facts(flagged, by)
    overall = pct("mentions", "n")
    recent = F.when(F.col("recent_mentions") > 0, pct("recent_mentions", "n_recent")).otherwise(F.lit(0.0))
    up = (
        f.select(*by, "theme", overall.alias("overall_pct"), recent.alias("recent_pct"))
        .withColumn("change", F.bround(F.col("recent_pct") - F.col("overall_pct"), 1))
        .where(F.col("change") > 0)
    )
    return _ranked(up, by, F.col("change").desc(), ordinal_expr("theme", tx.COMPLAINT_GROUPS))


# ── F3 ──────────────────────────────────────────────────────────────────────
def key_signals(flagged: DataFrame, by: Sequence[str] = ("app_id",), min_change_pp: float = 3.0,
                min_recent_mentions: int = 5, critical_rating: float = tx.CRITICAL_RATING,
                facts: DataFrame | None = None, as_of=None) -> DataFrame:
    """Spiking themes: change >= min_change_pp and recent mentions >= minimum,
    ranked by change, then by the worse rating.

    ``days_ago`` counts whole days from the oldest recent mention to ``as_of``
    (default: newest review date in the input).  ``facts`` and ``as_of`` may
    come from one ``stored_facts`` call that other reports share.
    """
    if facts is None:
        f, newest = stored_facts(flagged, by)
        as_of = newest if as_of is None else as_of
    else:
        f = facts
    f = f.withColumn("as_of", ntz_literal(as_of) if as_of is not None else F.lit(None).cast("timestamp_ntz"))
    change = F.bround(pct("recent_mentions", "n_recent") - pct("mentions", "n"), 1)
    avg = F.bround(F.col("recent_rating_sum") / F.col("recent_mentions"), 1)
    out = (
        f.where(F.col("recent_mentions") > 0)
        .select(
            *by,
            F.col("theme").alias("complaint"),
            F.col("recent_mentions").alias("recent_count"),
            change.alias("change"),
            avg.alias("avg_rating"),
            days_between("recent_oldest", "as_of").cast("bigint").alias("days_ago"),
            F.col("mentions"),
        )
        .where((F.col("change") >= min_change_pp) & (F.col("recent_count") >= min_recent_mentions))
        .withColumn("is_critical", F.col("avg_rating") <= critical_rating)
    )
    return _ranked(out, by, F.col("change").desc(), F.col("avg_rating"), ordinal_expr("complaint", tx.COMPLAINT_GROUPS))


# ── F4 ──────────────────────────────────────────────────────────────────────
def top_negative_phrases(reviews: DataFrame, by: Sequence[str] = ("app_id",), top_n: int = 12) -> DataFrame:
    """Count of 1-2 star reviews containing each curated phrase; top_n per group."""
    d, keys = keyed(reviews, by)
    phrases = {p: [p] for p in tx.NEGATIVE_PHRASES}
    low = d.where(F.col("rating").isin(*LOW)).select(
        *keys, F.explode_outer(tag_expr("review_text", phrases, prune=False)).alias("phrase")
    ).where(F.col("phrase").isNotNull())
    counts = low.groupBy(*keys, "phrase").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*keys).orderBy(F.col("count").desc(), ordinal_expr("phrase", phrases))
    ranked = counts.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top_n)
    return unkeyed(ranked, by)


# ── F5 / F6 shared ──────────────────────────────────────────────────────────
def _tagged_counts(rows: DataFrame, keys: list[str], kind: str, label: str, min_count: int, top_n: int) -> DataFrame:
    taxonomy, tags = KINDS[kind][0], tags_of(rows, kind)
    tagged = rows.select(*keys, _explode_with_total(tags).alias(label))
    agg = tagged.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(*keys)
    agg = agg.withColumn("_total", F.max(F.when(F.col(label).isNull(), F.col("count"))).over(w)).where(
        F.col(label).isNotNull() & (F.col("count") >= min_count)
    )
    rk = Window.partitionBy(*keys).orderBy(F.col("count").desc(), ordinal_expr(label, taxonomy))
    return agg.withColumn("rank", F.row_number().over(rk).cast("bigint")).where(F.col("rank") <= top_n)


def praised_strengths(reviews: DataFrame, by: Sequence[str] = ("app_id",), min_count: int = 3,
                      top_n: int = 5) -> DataFrame:
    """Praise themes in 4-5 star reviews: count, pct of positive reviews."""
    d, keys = keyed(reviews, by)
    high = d.where(F.col("rating").isin(*HIGH))
    out = _tagged_counts(high, keys, "praise", "theme", min_count, top_n)
    out = out.select(*keys, "theme", "count", F.bround(F.lit(100.0) * F.col("count") / F.greatest("_total", F.lit(1)), 1)
                     .alias("pct_of_positive"), "rank")
    return unkeyed(out, by)


def product_opportunities(reviews: DataFrame, by: Sequence[str] = ("app_id",), min_count: int = 2,
                          top_n: int = 6) -> DataFrame:
    """Feature themes among 4-5 star reviews that use request language."""
    d, keys = keyed(reviews, by)
    req = d.where(F.col("rating").isin(*HIGH) & requests_of(d))
    out = _tagged_counts(req, keys, "feature", "request", min_count, top_n)
    return unkeyed(out.select(*keys, "request", "count", "rank"), by)


# ── F7 ──────────────────────────────────────────────────────────────────────
def mixed_areas(enriched: DataFrame, by: Sequence[str] = ("app_id",), min_each: int = 3, top_n: int = 4,
                facts: DataFrame | None = None) -> DataFrame:
    """Complaint themes present in both 1-2 and 4-5 star reviews."""
    f = facts if facts is not None else theme_facts(enriched, by)
    low_share = F.bround(F.lit(100.0) * F.col("low_count") / F.greatest("n_low", F.lit(1)), 1)
    keep = f.where(
        (F.col("low_count") >= min_each) & (F.col("high_count") >= min_each) & (low_share >= 2)
    ).select(*by, F.col("theme").alias("area"), "low_count", "high_count")
    d, keys = keyed(keep, by)
    w = Window.partitionBy(*keys).orderBy(
        (F.col("low_count") + F.col("high_count")).desc(), ordinal_expr("area", tx.COMPLAINT_GROUPS)
    )
    return unkeyed(d.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top_n), by)


# ── one pass over several taxonomies ────────────────────────────────────────
def mark_facts(df: DataFrame, by: Sequence[str], kinds: Sequence[str], sample_cut: int | None = None) -> DataFrame:
    """Per (keys, kind, theme) measures of several taxonomies from one scan; the null kind
    carries the group's totals.

    mentions (any rating), recent_mentions, recent_rating_sum, high_count (4-5
    stars), request_count (4-5 stars that use request language).  With
    ``sample_cut`` also high_sample and request_sample: the most-liked review of
    those rows, cut (order: likes, newest, id).
    """
    d, keys = keyed(df, by)
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("theme"))
    marked = lambda k: F.transform(tags_of(d, k), lambda t: F.struct(F.lit(k).alias("kind"), t.alias("theme")))
    marks = F.concat(F.array(none), *map(marked, kinds))
    high = F.col("rating").isin(*HIGH)
    recent = F.col("is_recent") if "is_recent" in df.columns else F.lit(False)
    cols = [*keys, F.col("rating"), recent.alias("_r"), high.alias("_high"), (high & requests_of(d)).alias("_request")]
    if sample_cut is not None:
        cols += [truncate("review_text", sample_cut).alias("_text"),
                 F.struct(F.col("thumbs_up").isNull().alias("a"), (-F.col("thumbs_up")).alias("b"),
                          F.timestamp_diff("MICROSECOND", F.col("date"), F.lit("9999-12-31").cast("timestamp_ntz")).alias("c"),
                          F.col("review_id").alias("d")).alias("_order")]
    rows = d.select(*cols, F.explode_outer(marks).alias("_m")).select("*", "_m.kind", "_m.theme").drop("_m")
    aggs = [F.count(F.lit(1)).alias("mentions"), F.count_if("_r").alias("recent_mentions"), F.sum(F.when(F.col("_r"), F.col("rating"))).alias("recent_rating_sum"),
            F.count_if("_high").alias("high_count"), F.count_if("_request").alias("request_count")]
    if sample_cut is not None:
        aggs += [F.min_by("_text", F.when(F.col(c), F.col("_order"))).alias(name)
                 for c, name in (("_high", "high_sample"), ("_request", "request_sample"))]
    return rows.groupBy(*keys, "kind", "theme").agg(*aggs)


def library_facts(flagged: DataFrame, by: Sequence[str], in_scope: Column, tag_col: str = "complaint_categories") -> DataFrame:
    """Per (keys, theme) of the rows in scope: mentions, n, rating_sum, and is_rising judged on
    all rows; one conditional aggregate for both scopes."""
    d, keys = keyed(flagged, by)
    rows = d.select(*keys, "rating", F.col("is_recent").alias("_r"), in_scope.alias("_s"), _explode_with_total(F.col(tag_col)).alias("theme"))
    agg = rows.groupBy(*keys, "theme").agg(
        F.count(F.lit(1)).alias("_all"), F.count_if("_r").alias("_recent"), F.count_if("_s").alias("mentions"),
        F.sum(F.when(F.col("_s"), F.col("rating"))).alias("rating_sum"))
    w = Window.partitionBy(*keys)
    total = lambda c: F.max(F.when(F.col("theme").isNull(), F.col(c))).over(w)
    agg = agg.select("*", total("_all").alias("_n_all"), total("_recent").alias("_n_recent"), total("mentions").alias("n"))
    rising = F.when(F.col("_recent") > 0, pct("_recent", "_n_recent")).otherwise(F.lit(0.0)) - pct("_all", "_n_all")
    out = agg.where(F.col("theme").isNotNull() & (F.col("mentions") > 0))
    return unkeyed(out.select(*keys, "theme", "mentions", "n", "rating_sum", (F.bround(rising, 1) > 0).alias("is_rising")), by)
