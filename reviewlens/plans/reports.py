"""Composite reports (what a user of the dashboard reads).

Each report is a DataFrame with flat columns; lookups of fixed text (card
framing, hints) are literal maps, and every join is between small
aggregated tables (one row per group x theme).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens import taxonomy as tx
from reviewlens.functions.text import confidence_tier, day_month_year, iso_date, iso_ts, join_or, pct, star_bar, truncate
from reviewlens.operators import filters as FL
from reviewlens.operators import themes as TH
from reviewlens.operators import topk as TK
from reviewlens.operators.ordered import newest_rank
from reviewlens.operators.recent import ALL, keyed, unkeyed
from reviewlens.operators.tagging import KINDS, ordinal_expr

STRICT_CHANGE = 5.0
STRICT_MENTIONS = 8


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _wide(samples: DataFrame, keys: Sequence[str], label: str, value: str, n: int, prefix: str) -> DataFrame:
    """(keys, label, rank, value) -> (keys, label, prefix_1..prefix_n)."""
    return samples.groupBy(*keys, label).agg(
        *[F.max(F.when(F.col("rank") == i, F.col(value))).alias(f"{prefix}_{i}") for i in range(1, n + 1)]
    )


# ── J1 ──────────────────────────────────────────────────────────────────────
def signal_cards(flagged: DataFrame, by: Sequence[str] = ("app_id",), min_change_pp: float = STRICT_CHANGE,
                 min_recent_mentions: int = STRICT_MENTIONS) -> DataFrame:
    """Critical / emerging signal cards on the full (unfiltered) set."""
    facts, newest = TH.stored_facts(flagged, by)
    ks = TH.key_signals(flagged, by, min_change_pp, min_recent_mentions, facts=facts, as_of=newest)
    snips = TK.signal_snippets(flagged, by, k=2)
    d_ks, keys = keyed(ks, by)
    d_sn, _ = keyed(snips, by)
    wide = _wide(d_sn, keys, "theme", "snippet", 2, "snippet").withColumnRenamed("theme", "complaint")
    j = d_ks.join(wide, [*keys, "complaint"], "left")
    headline = F.coalesce(F.try_element_at(_map({k: v[0] for k, v in tx.SIGNAL_FRAMING.items()}), F.col("complaint")),
                          F.col("complaint"))
    context = F.coalesce(F.try_element_at(_map({k: v[1] for k, v in tx.SIGNAL_FRAMING.items()}), F.col("complaint")),
                         F.lit(""))
    hint = F.coalesce(F.try_element_at(_map(tx.INVESTIGATION_HINTS), F.col("complaint")), F.lit(tx.DEFAULT_HINT))
    out = j.select(
        *keys,
        "complaint",
        F.when(F.col("is_critical"), "critical").otherwise("emerging").alias("kind"),
        headline.alias("headline"),
        context.alias("context"),
        F.when(F.col("is_critical"), hint).alias("hint"),
        "recent_count",
        "change",
        "avg_rating",
        "days_ago",
        F.when(F.col("days_ago") > 0, F.concat(F.lit("Spiked "), F.col("days_ago").cast("string"), F.lit("d ago")))
        .otherwise(F.lit("Recently spiking")).alias("days_text"),
        F.when(F.col("avg_rating") <= 1.5, F.lit("Mostly 1-star"))
        .otherwise(F.concat(F.lit("Avg "), F.col("avg_rating").cast("string"), F.lit("★"))).alias("star_text"),
        F.concat(F.lit("+"), F.col("change").cast("string"), F.lit("pp vs baseline")).alias("change_text"),
        confidence_tier("recent_count").alias("confidence"),
        "snippet_1",
        "snippet_2",
        F.col("mentions").alias("related_count"),
    )
    return unkeyed(out, by)


# ── J2 ──────────────────────────────────────────────────────────────────────
def theme_library(flagged: DataFrame, by: Sequence[str] = ("app_id",), primary: str = "All Reviews",
                  chips: Sequence[str] = ()) -> DataFrame:
    """Theme cards on the chip-filtered scope; the rising badge uses the full set."""
    facts = TH.library_facts(flagged, by, FL.in_chips(primary, chips, flagged))
    samples = TK.theme_samples(FL.apply_chips(flagged, primary, chips), by, k=2).withColumn("s", truncate("review_text", 110))
    d_f, keys = keyed(facts, by)
    d_s, _ = keyed(samples, by)
    wide = _wide(d_s, keys, "theme", "s", 2, "sample")
    share = F.lit(100.0) * F.col("mentions") / F.greatest(F.col("n"), F.lit(1))
    avg = F.col("rating_sum") / F.col("mentions")
    m = F.col("mentions").cast("string")
    freq = (
        F.when(share >= 20, F.concat(F.lit("Very frequently mentioned · "), m, F.lit(" reviews")))
        .when(share >= 10, F.concat(F.lit("Frequently mentioned · "), m, F.lit(" reviews")))
        .when(share >= 5, F.concat(F.lit("Commonly mentioned · "), m, F.lit(" reviews")))
        .otherwise(F.concat(F.lit("Mentioned in "), m, F.lit(" reviews")))
    )
    rating_label = (
        F.when(avg <= 1.5, "Almost all 1-star reviews")
        .when(avg <= 2.0, "Mostly 1-2 star reviews")
        .when(avg <= 2.5, "Mostly low-rated reviews")
        .when(avg <= 3.5, "Mixed star ratings")
        .otherwise("Appears even in positive reviews")
    )
    out = (
        d_f.join(wide, [*keys, "theme"], "left")
        .select(
            *keys,
            "theme",
            "mentions",
            F.col("n").alias("scope_reviews"),
            F.bround(F.lit(100.0) * F.col("mentions") / F.col("n"), 1).alias("pct_of_reviews"),
            F.bround(avg, 1).alias("avg_rating"),
            freq.alias("frequency_label"),
            rating_label.alias("rating_label"),
            "is_rising",
            confidence_tier("mentions").alias("confidence"),
            "sample_1",
            "sample_2",
        )
    )
    return unkeyed(out, by)


# ── J3 ──────────────────────────────────────────────────────────────────────
def _cards(reviews: DataFrame, by: Sequence[str], kind: str, count: str, sample: str, min_count: int, top_n: int) -> tuple[DataFrame, list[str]]:
    """Ranked themes of a kind with their sample and how many reviews of any rating mention them: one scan."""
    facts = TH.mark_facts(reviews, by, [kind], sample_cut=110)
    d, keys = (facts, list(by)) if by else (facts, [ALL])
    total = F.max(F.when(F.col("kind").isNull(), F.col(count))).over(Window.partitionBy(*keys))
    d = d.withColumn("_total", total).where(F.col("kind").isNotNull() & (F.col(count) >= min_count))
    order = Window.partitionBy(*keys).orderBy(F.col(count).desc(), ordinal_expr("theme", KINDS[kind][0]))
    d = d.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top_n)
    return d.select(*keys, "theme", F.col(count).alias("count"), "rank", "_total", F.col(sample).alias("sample_1"),
                    F.col("mentions").alias("related_count")), keys


def opportunity_cards(reviews: DataFrame, by: Sequence[str] = ("app_id",), min_count: int = 4, top_n: int = 5) -> DataFrame:
    d, keys = _cards(reviews, by, "feature", "request_count", "request_sample", min_count, top_n)
    out = d.select(
        *keys, F.col("theme").alias("request"), "count", "rank",
        F.concat(F.lit("📝 "), F.col("count").cast("string"), F.lit(" users requesting")).alias("count_text"),
        confidence_tier("count").alias("confidence"),
        "sample_1",
        "related_count",
    )
    return unkeyed(out, by)


def strength_cards(reviews: DataFrame, by: Sequence[str] = ("app_id",), min_count: int = 5, top_n: int = 4) -> DataFrame:
    d, keys = _cards(reviews, by, "praise", "high_count", "high_sample", min_count, top_n)
    d = d.withColumn("pct_of_positive", F.bround(F.lit(100.0) * F.col("count") / F.greatest("_total", F.lit(1)), 1))
    out = d.select(
        *keys, "theme", "count", "pct_of_positive", "rank",
        F.concat(F.lit("Mentioned in "), F.col("pct_of_positive").cast("string"),
                 F.lit("% of positive reviews — protect this in every release.")).alias("subtitle"),
        confidence_tier("count").alias("confidence"),
        "sample_1",
        "related_count",
    )
    return unkeyed(out, by)


# ── J4 ──────────────────────────────────────────────────────────────────────
EXPLORER = ["Date", "Rating", "Theme", "Review"]


def explorer_rows(enriched: DataFrame, primary: str = "All Reviews", chips: Sequence[str] = (), query: str | None = None,
                  literal: bool = False) -> DataFrame:
    """The reviews of the explorer, with the displayed columns beside date and review_id."""
    rows = FL.search_reviews(FL.apply_chips(enriched, primary, chips), query, literal)
    return rows.select(
        "app_id", "review_id", "date",
        iso_date("date").alias("Day"),
        F.col("rating").alias("Rating"),
        join_or("complaint_categories", "—").alias("Theme"),
        F.col("review_text").alias("Review"),
    )


def explorer(enriched: DataFrame, primary: str = "All Reviews", chips: Sequence[str] = (), query: str | None = None,
             literal: bool = False) -> DataFrame:
    """Newest first: ``rank`` is a review's place in its app's list."""
    rows = newest_rank(explorer_rows(enriched, primary, chips, query, literal))
    return rows.select("app_id", "rank", "review_id", iso_ts("date").alias("time"), F.col("Day").alias("Date"), *EXPLORER[1:])


def export_columns() -> list[Column]:
    """A8: the columns of the full export, in their order."""
    return [iso_date("date").alias("date"), F.col("rating"), F.col("sentiment_label"),
            join_or("complaint_categories", "").alias("complaint_categories"), F.col("review_text")]


def export_rows(enriched: DataFrame) -> DataFrame:
    """A8: rows of the full export."""
    return enriched.select("app_id", *export_columns())


def export_list(enriched: DataFrame) -> DataFrame:
    """A8: rows of the full export with their ``rank`` in their app's file, newest first."""
    cols = ["app_id", "review_id", "date", "rating", "sentiment_label", "complaint_categories", "review_text"]
    return newest_rank(enriched.select(*cols)).select("app_id", "rank", "review_id", *export_columns())


# ── J5 ──────────────────────────────────────────────────────────────────────
def review_cards(enriched: DataFrame, by: Sequence[str] = ("app_id",), latest_first: bool = True) -> DataFrame:
    """Drill-through cards: first 100 reviews per complaint theme."""
    d, keys = keyed(enriched, by)
    hashed = TK.text_keys(d, keys)
    rows = FL.theme_reviews(hashed.select(*keys, "review_id", "date", "rating", "complaint_categories", *TK.TEXT_KEY))
    top = TK.top_k_with_text(rows, hashed, [*keys, "theme"], TK.by_date(latest_first), tx.DRILL_CAP)
    out = top.select(
        *keys, "theme", "rank", "review_id",
        star_bar("rating").alias("stars"),
        day_month_year("date").alias("date_text"),
        "review_text",
    )
    return unkeyed(out, by)


# ── J6 ──────────────────────────────────────────────────────────────────────
def signal_coverage(flagged: DataFrame, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """How many cards of each kind a group has: counts from one scan over all taxonomies."""
    facts = TH.mark_facts(flagged, by, list(KINDS))
    keys = list(by) or [ALL]
    total = lambda c: F.max(F.when(F.col("kind").isNull(), F.col(c))).over(Window.partitionBy(*keys))
    f = facts.select("*", total("mentions").alias("_n"), total("recent_mentions").alias("_n_recent"))
    change = F.bround(pct("recent_mentions", "_n_recent") - pct("mentions", "_n"), 1)
    signal = (F.col("kind") == "complaint") & (F.col("recent_mentions") >= STRICT_MENTIONS) & (change >= STRICT_CHANGE)
    critical = F.bround(F.col("recent_rating_sum") / F.col("recent_mentions"), 1) <= tx.CRITICAL_RATING
    j = f.groupBy(*keys).agg(
        F.max(F.when(F.col("kind").isNull(), F.col("mentions"))).alias("n_reviews"),
        F.count_if(signal & critical).alias("n_critical"),
        F.count_if(signal & ~critical).alias("n_emerging"),
        F.least(F.count_if((F.col("kind") == "feature") & (F.col("request_count") >= 4)), F.lit(5)).alias("n_opportunities"),
        F.least(F.count_if((F.col("kind") == "praise") & (F.col("high_count") >= 5)), F.lit(4)).alias("n_strengths"),
    )
    cols = ["n_critical", "n_emerging", "n_opportunities", "n_strengths"]
    j = j.select(*keys, "n_reviews", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in cols])
    enough = sum((F.col(c) for c in cols[1:]), F.col(cols[0])) > 0
    out = j.withColumn("enough_signal", enough).withColumn(
        "message", F.when(enough, F.lit(None).cast("string")).otherwise(
            F.lit("Not enough signal in this review sample. Try a wider time scope.")))
    return unkeyed(out, by)


# ── J7 ──────────────────────────────────────────────────────────────────────
EMPTY_NEGATIVE = "(no negative reviews in this selection)"
EMPTY_POSITIVE = "(no positive reviews in this selection)"


def sentiment_corpus(enriched: DataFrame, by: Sequence[str] = ("app_id",), k: int = tx.CORPUS_PER_BUCKET) -> DataFrame:
    """Bullet lists of the k most-liked Negative and Positive reviews per group.

    The collected list is bounded by k (the top-k filter runs first, with a
    per-task WindowGroupLimit), so no group is ever gathered whole.
    """
    d, keys = keyed(enriched, by)
    top = TK.sentiment_topk(d, keys, k)
    blocks = top.groupBy(*keys, "sentiment_label").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "review_text"))),
                        lambda x: F.concat(F.lit("- "), x["review_text"])),
            "\n",
        ).alias("block"),
        F.count(F.lit(1)).alias("n"),
    )
    spine = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_reviews"))
    wide = blocks.groupBy(*keys).agg(
        F.max(F.when(F.col("sentiment_label") == "Negative", F.col("block"))).alias("neg"),
        F.max(F.when(F.col("sentiment_label") == "Positive", F.col("block"))).alias("pos"),
        F.max(F.when(F.col("sentiment_label") == "Negative", F.col("n"))).alias("n_negative"),
        F.max(F.when(F.col("sentiment_label") == "Positive", F.col("n"))).alias("n_positive"),
    )
    out = spine.join(wide, keys, "left").select(
        *keys,
        F.coalesce("n_negative", F.lit(0)).cast("bigint").alias("n_negative"),
        F.coalesce("n_positive", F.lit(0)).cast("bigint").alias("n_positive"),
        F.coalesce("neg", F.lit(EMPTY_NEGATIVE)).alias("negative_block"),
        F.coalesce("pos", F.lit(EMPTY_POSITIVE)).alias("positive_block"),
    )
    return unkeyed(out, by)
