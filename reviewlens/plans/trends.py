"""Specified-but-unbuilt views: distributions, trends, version and app comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens import taxonomy as tx
from reviewlens.functions.text import iso_date, pct
from reviewlens.operators import themes as TH
from reviewlens.operators.recent import keyed, unkeyed


def rating_distribution(reviews: DataFrame, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """K1: count per star 1..5 with zero fill (one aggregation, then unpivot)."""
    d, keys = keyed(reviews, by)
    wide = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col("rating") == r).alias(f"r{r}") for r in range(1, 6)],
    )
    long = wide.unpivot([*keys, "_n"], [f"r{r}" for r in range(1, 6)], "star", "count")
    out = long.select(
        *keys,
        F.substring("star", 2, 1).cast("int").alias("rating"),
        F.col("count").cast("bigint").alias("count"),
        pct("count", "_n").alias("pct"),
    )
    return unkeyed(out, by)


def sentiment_trend(enriched: DataFrame, by: Sequence[str] = ("app_id",), unit: str = "day", fill: bool = False) -> DataFrame:
    """K2: per calendar day, week or month: reviews, mean score (3 dp), label counts.

    ``fill``: periods without a review between a group's first and last one come
    too, with zero counts and null means.  The calendar is generated from the
    aggregated table (a row per group), never from the reviews.
    """
    if unit not in ("day", "week", "month"):
        raise ValueError(f"unit must be 'day', 'week' or 'month', not {unit!r}")
    d, keys = keyed(enriched, by)
    out = d.where(F.col("date").isNotNull()).groupBy(*keys, F.to_date(F.date_trunc(unit, "date")).alias("_b")).agg(
        F.count(F.lit(1)).alias("reviews"),
        # mean of 3-dp scores from an exact integer sum: identical on any engine
        (F.sum(F.bround(F.col("sentiment_score") * 1000, 0).cast("bigint")) / F.count(F.lit(1)) / 1000.0)
        .alias("avg_sentiment"),
        F.count_if(F.col("sentiment_label") == "Positive").alias("n_positive"),
        F.count_if(F.col("sentiment_label") == "Negative").alias("n_negative"),
        F.bround(F.avg("rating"), 2).alias("avg_rating"),
    )
    if fill:
        out = _filled(out, keys, unit)
    return unkeyed(out.withColumn("period", iso_date("_b")).drop("_b"), by)


def _filled(counts: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """The counts with a row for each period from a group's first to its last: every period but the last
    is repeated up to the one that follows it, which needs neither a second scan nor a join."""
    after = F.lead("_b").over(Window.partitionBy(*keys).orderBy("_b"))
    step = F.expr(f"INTERVAL 1 {unit}")
    spread = counts.withColumn("_next", after).withColumn(
        "_at", F.when(F.col("_next").isNull(), F.array("_b")).otherwise(F.sequence(F.col("_b"), F.date_sub("_next", 1), step)))
    rows = spread.select("*", F.posexplode("_at").alias("_i", "_day"))
    kept = lambda c, none: F.when(F.col("_i") == 0, F.col(c)).otherwise(F.lit(none)).alias(c)
    return rows.select(*keys, F.col("_day").alias("_b"), kept("reviews", 0), kept("avg_sentiment", None), kept("n_positive", 0),
                       kept("n_negative", 0), kept("avg_rating", None))


def review_table(enriched: DataFrame) -> DataFrame:
    """K5: review rows with sentiment label and score."""
    return enriched.select(
        "app_id", "review_id", iso_date("date").alias("date"), "rating",
        "sentiment_score", "sentiment_label", "review_text",
    )


def compare_apps(enriched: DataFrame, app_a: str, app_b: str) -> DataFrame:
    """K6: theme shares of two apps side by side: one aggregate, its two columns filled by app."""
    two = enriched.where(F.col("app_id").isin(app_a, app_b))
    s = TH.theme_facts(two, ("app_id",)).select("app_id", "theme", "mentions", pct("mentions", "n").alias("share"))
    of = lambda app, c, none: F.coalesce(F.max(F.when(F.col("app_id") == app, F.col(c))), F.lit(none))
    j = s.groupBy("theme").agg(
        of(app_a, "mentions", 0).cast("bigint").alias("mentions_a"), of(app_b, "mentions", 0).cast("bigint").alias("mentions_b"),
        of(app_a, "share", 0.0).alias("pct_a"), of(app_b, "share", 0.0).alias("pct_b"))
    return j.select(F.lit(app_a).alias("app_a"), F.lit(app_b).alias("app_b"), "*", F.bround(F.col("pct_a") - F.col("pct_b"), 1).alias("delta"))


def theme_by_version(enriched: DataFrame, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """K7: theme measures per app version."""
    f = TH.theme_facts(enriched.drop("is_recent") if "is_recent" in enriched.columns else enriched,
                       [*by, "app_version"])
    return f.select(
        *by, "app_version", "theme", "mentions",
        F.col("n").alias("version_reviews"),
        pct("mentions", "n").alias("pct_of_reviews"),
        F.bround(F.col("rating_sum") / F.col("mentions"), 1).alias("avg_rating"),
    )


def sample_adequacy(reviews: DataFrame, by: Sequence[str] = ("app_id",), minimum: int = tx.MIN_SAMPLE) -> DataFrame:
    """K8: whether each app has the minimum review sample."""
    return reviews.groupBy(*by).agg(F.count(F.lit(1)).alias("n_reviews")).withColumn(
        "adequate", F.col("n_reviews") >= minimum)


def scope_counts(enriched: DataFrame, by: Sequence[str] = ("app_id",), primary: str = "Negative",
                 chips: Sequence[str] = ("Crash",), query: str = "crash") -> DataFrame:
    """total / filtered / searched counts in one aggregation."""
    from reviewlens.operators import filters as FL
    d, keys = keyed(enriched, by)
    in_primary = {
        "All Reviews": F.lit(True),
        "Negative": F.col("rating").isin(1, 2),
        "Mixed": F.col("rating") == 3,
        "Positive": F.col("rating").isin(4, 5),
    }.get(primary)
    if in_primary is None:
        raise ValueError(primary)
    groups = F.array(*[F.lit(g) for g in FL.chip_groups(chips)])
    filt = in_primary & (F.arrays_overlap("complaint_categories", groups) if chips else F.lit(True))
    searched = filt & FL.matches(query)
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(filt).alias("filtered"),
        F.count_if(searched).alias("searched"),
        F.count_if(F.size("complaint_categories") > 0).alias("tagged"),
    )
    return unkeyed(out, by)
