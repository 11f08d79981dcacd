"""Row filters: rating buckets, requests, theme chips, drill-through, search.

All are plain predicates on columns, so they push into the Parquet scan
where the column is stored (``rating IN (...)``) and otherwise run in the
first codegen stage; none shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens import taxonomy as tx
from reviewlens.operators.tagging import requests_of, tag_expr
from reviewlens.operators.topk import explode_tags

BUCKETS = {"Negative": (1, 2), "Mixed": (3,), "Positive": (4, 5)}


def filter_rating_bucket(df: DataFrame, chip: str = "All Reviews") -> DataFrame:
    if chip == "All Reviews":
        return df
    if chip == "Requests":
        return filter_requests(df)
    if chip not in BUCKETS:
        raise ValueError(f"unknown rating chip {chip!r}; expected one of {tx.PRIMARY_CHIPS}")
    return df.where(F.col("rating").isin(*BUCKETS[chip]))


def filter_requests(df: DataFrame) -> DataFrame:
    return df.where(F.col("rating").isin(4, 5) & requests_of(df))


def chip_groups(chips: Sequence[str]) -> list[str]:
    unknown = [c for c in chips if c not in tx.THEME_CHIPS]
    if unknown:
        raise ValueError(f"unknown theme chips {unknown}")
    return [g for c in chips for g in tx.THEME_CHIPS[c]]


def filter_theme_chips(df: DataFrame, chips: Sequence[str], tag_col: str = "complaint_categories") -> DataFrame:
    """Keep reviews tagged with any group of any selected chip (OR)."""
    if not chips:
        return df
    groups = F.array(*[F.lit(g) for g in chip_groups(chips)])
    return df.where(F.arrays_overlap(F.col(tag_col), groups))


def apply_chips(df: DataFrame, primary: str = "All Reviews", chips: Sequence[str] = ()) -> DataFrame:
    return filter_theme_chips(filter_rating_bucket(df, primary), chips)


def in_chips(primary: str, chips: Sequence[str], df: DataFrame, tag_col: str = "complaint_categories") -> Column:
    """The rows that ``apply_chips`` keeps, as a condition."""
    if primary == "Requests":
        kept = F.col("rating").isin(*BUCKETS["Positive"]) & requests_of(df)
    elif primary == "All Reviews":
        kept = F.lit(True)
    elif primary in BUCKETS:
        kept = F.col("rating").isin(*BUCKETS[primary])
    else:
        raise ValueError(f"unknown rating chip {primary!r}; expected one of {tx.PRIMARY_CHIPS}")
    if chips:
        kept = kept & F.arrays_overlap(F.col(tag_col), F.array(*[F.lit(g) for g in chip_groups(chips)]))
    return F.coalesce(kept, F.lit(False))


def filter_stars(df: DataFrame, stars: Sequence[int]) -> DataFrame:
    return df.where(F.col("rating").isin(*stars))


def filter_date_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive calendar-day range on ``date``; literal bounds push down."""
    lo = F.lit(start).cast("timestamp_ntz")
    hi = F.lit(end).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    return df.where((F.col("date") >= lo) & (F.col("date") < hi))


def theme_reviews(enriched: DataFrame, tag_col: str = "complaint_categories") -> DataFrame:
    """C4: one row per (review, complaint theme) for drill-through."""
    return explode_tags(enriched, F.col(tag_col)).drop(tag_col)


def keyword_reviews(reviews: DataFrame, taxonomy: Mapping[str, Sequence[str]], out: str = "theme") -> DataFrame:
    """C5: reviews of any rating matching each theme's keywords."""
    return explode_tags(reviews, tag_expr("review_text", taxonomy), out)


def matches(query: str, text_col: str = "review_text") -> Column:
    """Case-insensitive (Unicode) regex test, never null.

    The pattern is compiled by the engine that will run it, so a pattern that
    would fail in a task fails here, with its message.
    """
    pattern = "(?iu)" + query
    jvm = SparkSession.active().sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException) as exc:
        raise ValueError(f"invalid search pattern {query!r}: {str(exc).splitlines()[0]}") from exc
    return F.coalesce(F.col(text_col).rlike(pattern), F.lit(False))


def search_reviews(df: DataFrame, query: str | None, literal: bool = False, text_col: str = "review_text") -> DataFrame:
    """Case-insensitive search; regex by default (as the reference), or literal."""
    q = (query or "").strip()
    if not q:
        return df
    if literal:
        return df.where(F.lower(F.col(text_col)).contains(q.lower()))
    return df.where(matches(q, text_col))
