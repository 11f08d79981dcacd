"""Per-row enrichment: sentiment and tags as projections (``plans.store`` keeps them)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens import taxonomy as tx
from reviewlens.operators.recent import flag_recent
from reviewlens.operators.sentiment import score_sentiment
from reviewlens.operators.tagging import flag_expr, tag_complaints, tag_expr
from reviewlens.sources import fixture
from reviewlens.sources.ingest import normalise_reviews


def enrich(reviews: DataFrame, sentiment: bool = True) -> DataFrame:
    return tag_complaints(score_sentiment(reviews) if sentiment else reviews)


def enrich_all(reviews: DataFrame) -> DataFrame:
    """Every per-review column that a report reads: sentiment, complaint, praise
    and feature tags and the request flag (``plans.store.append`` stores it)."""
    return enrich(reviews).withColumns({
        "praise_categories": tag_expr("review_text", tx.PRAISE_GROUPS),
        "feature_categories": tag_expr("review_text", tx.FEATURE_THEMES),
        "is_request": flag_expr("review_text", tx.REQUEST_SIGNALS),
    })


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised reviews derived from the driver's ``events`` table."""
    return normalise_reviews(fixture.raw_reviews(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews + complaint tags (a cheap per-row projection, not stored)."""
    return enrich(reviews(spark, sf_dir), sentiment=False)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews + sentiment + tags (per-row projections, not stored).

    The label passes through a one-element generator, which no filter on it is
    pushed below: the lexicon scorer, the costliest step, runs once per row.
    """
    return scored_once(reviews(spark, sf_dir))


def scored_once(plain: DataFrame) -> DataFrame:
    return enrich(plain, sentiment=True).withColumn("sentiment_label", F.explode_outer(F.array("sentiment_label")))


def flagged(spark: SparkSession, sf_dir: str, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """Enriched reviews with the per-group ``is_recent`` flag.

    Only the thresholds, one row per group, are computed ahead; the reviews
    stay a lazy projection.  A caller with many reports stores the table once
    (``plans.store``).
    """
    return flag_recent(enrich(reviews(spark, sf_dir), sentiment=False), by)
