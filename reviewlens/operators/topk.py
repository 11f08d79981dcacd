"""Per-group top-k samples.

Every sampler is ``row_number() over (partition by keys, theme order by ...)
<= k`` with a literal k, which Spark plans as a WindowGroupLimit: each map
task keeps at most k rows per group *before* the shuffle, so even a theme
holding a third of all reviews ships only k rows per task.  Orders are total
(rating/thumbs, then date desc, then review_id) so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens import taxonomy as tx
from reviewlens.functions.text import truncate
from reviewlens.operators.recent import keyed, unkeyed
from reviewlens.operators.tagging import requests_of, tags_of
from reviewlens.session import write_table

def newest() -> list[Column]:
    return [F.col("date").desc(), F.col("review_id").asc()]


def explode_tags(df: DataFrame, tags: Column, out: str = "theme") -> DataFrame:
    """One row per (review, tag); untagged reviews vanish.  explode_outer +
    not-null keeps Catalyst from duplicating the tag expression."""
    return df.withColumn(out, F.explode_outer(tags)).where(F.col(out).isNotNull())


#: From this k on, a group is first ranked in parts, so that no task gets k rows of every other task.
SALT_FROM, SALTS = 20, 32


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first k rows of each group.  A large k takes two stages: k of each
    part of a group (by a hash of the id), then k of those; a hot group's first
    stage runs in ``SALTS`` tasks, its last one sees ``SALTS * k`` rows."""
    if k >= SALT_FROM:
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", F.pmod(F.xxhash64("review_id", "date"), F.lit(SALTS)))
        df = df.withColumn("_part", F.row_number().over(part)).where(F.col("_part") <= k).drop("_part", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k).withColumn(
        rank_col, F.col(rank_col).cast("bigint")
    )


#: Winners of a top-k whose texts are looked up with a broadcast (about 100 bytes each).
BROADCAST_WINNERS = 500_000
TEXT_KEY = ["_h1", "_h2"]


def text_keys(df: DataFrame, keys: Sequence[str], text_col: str = "review_text") -> DataFrame:
    """Two hashes (96 bits) of a row's group, id, date and text, by which its text is found again."""
    cols = [*keys, "review_id", "date", text_col]
    return df.withColumns({"_h1": F.xxhash64(*cols), "_h2": F.hash(*cols)})


def top_k_with_text(rows: DataFrame, texts: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    text_col: str = "review_text") -> DataFrame:
    """``top_k`` of narrow rows that carry ``text_keys``, then the texts of the winners from ``texts``.

    Only keys, order columns and hashes are sorted and shuffled.  The winners, at
    most k a group, are stored; their texts come from a second scan, which a
    broadcast of the winners' hashes filters while they are few enough.
    """
    top = write_table(top_k(rows, keys, order, k))
    wanted = top.select(*TEXT_KEY).distinct()
    if top.count() <= BROADCAST_WINNERS:
        wanted = F.broadcast(wanted)
    found = texts.select(*TEXT_KEY, text_col).join(wanted, TEXT_KEY, "left_semi").groupBy(*TEXT_KEY).agg(F.min(text_col).alias(text_col))
    return top.join(found, TEXT_KEY).drop(*TEXT_KEY)


def theme_samples(enriched: DataFrame, by: Sequence[str] = ("app_id",), k: int = 3,
                  tag_col: str = "complaint_categories") -> DataFrame:
    """G2: the k lowest-rated reviews per theme."""
    d, keys = keyed(enriched, by)
    rows = explode_tags(d.select(*keys, "review_id", "date", "rating", "review_text", tag_col), F.col(tag_col))
    out = top_k(rows, [*keys, "theme"], [F.col("rating").asc(), *newest()], k)
    return unkeyed(out.drop(tag_col), by)


def signal_snippets(flagged: DataFrame, by: Sequence[str] = ("app_id",), k: int = 2, cut: int = 130) -> DataFrame:
    """G3: k lowest-rated recent-slice reviews per theme, cut at ``cut``."""
    recent = flagged.where("is_recent")
    s = theme_samples(recent, by, k)
    return s.withColumn("snippet", truncate("review_text", cut))


def _by_thumbs() -> list[Column]:
    return [F.col("thumbs_up").desc_nulls_last(), *newest()]


def strength_samples(reviews: DataFrame, by: Sequence[str] = ("app_id",), k: int = 2, cut: int = 110) -> DataFrame:
    """G4: most-liked 4-5 star reviews per praise theme."""
    d, keys = keyed(reviews, by)
    high = d.where(F.col("rating").isin(4, 5))
    rows = explode_tags(high.select(*keys, "review_id", "date", "thumbs_up", "review_text", tags_of(high, "praise").alias("_tags")),
                        F.col("_tags")).drop("_tags")
    out = top_k(rows, [*keys, "theme"], _by_thumbs(), k).withColumn("sample", truncate("review_text", cut))
    return unkeyed(out, by)


def opportunity_samples(reviews: DataFrame, by: Sequence[str] = ("app_id",), k: int = 2, cut: int = 110) -> DataFrame:
    """G4: most-liked request reviews per feature theme."""
    d, keys = keyed(reviews, by)
    req = d.where(F.col("rating").isin(4, 5) & requests_of(d))
    rows = explode_tags(req.select(*keys, "review_id", "date", "thumbs_up", "review_text", tags_of(req, "feature").alias("_tags")),
                        F.col("_tags"), "request").drop("_tags")
    out = top_k(rows, [*keys, "request"], _by_thumbs(), k).withColumn("sample", truncate("review_text", cut))
    return unkeyed(out, by)


def mixed_samples(enriched: DataFrame, by: Sequence[str] = ("app_id",), cut: int = 100) -> DataFrame:
    """G5: lowest-rated 1-2 star and highest-rated 4-5 star review per theme."""
    d, keys = keyed(enriched, by)
    base = explode_tags(d.select(*keys, "review_id", "date", "rating", "review_text", "complaint_categories"),
                        F.col("complaint_categories"), "area").drop("complaint_categories")
    neg = top_k(base.where(F.col("rating").isin(1, 2)), [*keys, "area"], [F.col("rating").asc(), *newest()], 1)
    pos = top_k(base.where(F.col("rating").isin(4, 5)), [*keys, "area"], [F.col("rating").desc(), *newest()], 1)
    out = neg.withColumn("side", F.lit("negative")).unionByName(pos.withColumn("side", F.lit("positive")))
    return unkeyed(out.withColumn("sample", truncate("review_text", cut)).drop("rank"), by)


def sentiment_topk(enriched: DataFrame, by: Sequence[str] = ("app_id",), k: int = tx.CORPUS_PER_BUCKET) -> DataFrame:
    """G6: top-k most-liked reviews per sentiment label (Negative, Positive)."""
    d, keys = keyed(enriched, by)
    hashed = text_keys(d, keys)
    rows = hashed.where(F.col("sentiment_label").isin("Negative", "Positive")).select(
        *keys, "sentiment_label", "review_id", "date", "thumbs_up", *TEXT_KEY)
    return unkeyed(top_k_with_text(rows, hashed, [*keys, "sentiment_label"], _by_thumbs(), k), by)


def investigate(rows: DataFrame, keys: Sequence[str], latest_first: bool = True, cap: int = tx.DRILL_CAP) -> DataFrame:
    """G7: first ``cap`` reviews per drill-through group, by date (rows without texts)."""
    return top_k(rows, keys, by_date(latest_first), cap)


def by_date(latest_first: bool) -> list[Column]:
    return newest() if latest_first else [F.col("date").asc(), F.col("review_id").asc()]
