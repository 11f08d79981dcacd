"""Landed raw reviews -> normalised ``reviews`` (+ quarantine), scopes, metadata.

Raw landing columns use the store's field names (``reviewId, at, score,
content, thumbsUpCount, reviewCreatedVersion``) plus ``app_id``.  Reading is
``spark.read.schema(RAW_SCHEMA)`` so missing optional fields come back null
and Catalyst prunes unread columns at the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens import taxonomy as tx
from reviewlens.functions.text import days_between, ntz_literal, strip_ws
from reviewlens.operators.recent import newest_n

RAW_SCHEMA = T.StructType([
    T.StructField("app_id", T.StringType()),
    T.StructField("reviewId", T.StringType()),
    T.StructField("at", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("thumbsUpCount", T.LongType()),
    T.StructField("reviewCreatedVersion", T.StringType()),
])

RENAME = {
    "reviewId": "review_id",
    "at": "date",
    "score": "rating",
    "content": "review_text",
    "thumbsUpCount": "thumbs_up",
    "reviewCreatedVersion": "app_version",
}
#: app_id of a landing table that has no such column: the reviews of one app.
NO_APP = ""
COLUMNS = ["app_id", "review_id", "date", "rating", "review_text", "thumbs_up", "app_version"]


#: Column that keeps the text of a record no parser could read.
CORRUPT = "_corrupt_record"
_ZONE = r"(?i)[0-9](z|[ ]?(utc|gmt|ut)([+-][0-9:]+)?|[+-][0-9]{1,2}(:?[0-9]{2}){0,2}|[ ]?[a-z]+/[a-z_/]+)$"


def read_raw(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Batch read of landed raw reviews with an explicit schema; malformed JSON
    or CSV records stay, as text, in ``_corrupt_record``."""
    if fmt not in ("json", "csv"):
        return spark.read.schema(RAW_SCHEMA).format(fmt).load(path)
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).format(fmt).load(path)


def _utc_naive(c: Column, dtype: str) -> Column:
    """UTC-naive timestamp of an instant or a string, whatever the session's
    time zone: an offset is honoured, a naive time counts as UTC."""
    if dtype == "timestamp":
        instant = c
    else:
        s = F.trim(c.cast("string"))
        dated = F.when(s.rlike(":"), s).otherwise(F.concat(s, F.lit("T00:00:00")))
        instant = F.try_to_timestamp(F.when(dated.rlike(_ZONE) & s.rlike(":"), dated).otherwise(F.concat(dated, F.lit("Z"))))
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def _typed(raw: DataFrame) -> DataFrame:
    """The normalised columns with safe casts: what does not fit becomes null, nothing raises."""
    kinds = dict(raw.dtypes)
    cols = [F.col("app_id").cast("string") if "app_id" in kinds else F.lit(NO_APP).alias("app_id")]
    want = {"date": "timestamp_ntz", "rating": "int", "review_text": "string", "thumbs_up": "int"}
    for src, dst in RENAME.items():
        kind = kinds.get(src)
        if kind is None:
            c = F.lit(None).cast(want.get(dst, "string"))
        elif dst == "date":
            c = F.col(src) if kind == "timestamp_ntz" else _utc_naive(F.col(src), kind)
        elif dst == "rating":
            number = F.col(src).cast("string").try_cast("double")
            c = F.col(src) if kind == "int" else F.when(~F.isnan(number), number.try_cast("int"))
        elif dst == "thumbs_up":
            c = F.col(src) if kind == "int" else F.col(src).try_cast("int")
        else:
            c = F.col(src).cast("string")
        cols.append(c.alias(dst))
    if CORRUPT in kinds:
        cols.append(F.col(CORRUPT))
    return raw.select(*cols)


def quarantine_reviews(raw: DataFrame) -> DataFrame:
    """Rows the reference would crash on (or that name no app), with the reason."""
    df = _typed(raw)
    corrupt = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    reason = (
        F.when(corrupt, "record_malformed")
        .when(F.col("app_id").isNull(), "app_id_missing")
        .when(F.col("rating").isNull(), "rating_missing_or_not_numeric")
        .when(~F.col("rating").between(1, 5), "rating_out_of_range")
        .when(F.col("date").isNull(), "timestamp_unparsable")
    )
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


def usable(raw: DataFrame) -> DataFrame:
    """Typed rows that are not for the quarantine: each row lands on exactly one side."""
    df = _typed(raw).where(_valid_cols())
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT) if CORRUPT in df.columns else df


def normalise_reviews(
    raw: DataFrame,
    days_back: int | None = None,
    target: int | None = None,
    as_of: datetime | str | None = None,
    by: Sequence[str] = ("app_id",),
) -> DataFrame:
    """Rename, type, scope, strip and drop blank reviews.

    Scope order follows the source semantics: the recency cutoff and the
    newest-``target`` cap are applied *before* blank texts are dropped.
    """
    df = usable(raw)
    if days_back is not None:
        df = scope_recent(df, days_back, as_of)
    if target is not None:
        df = newest_n(df, target, by)
    df = df.withColumn("review_text", strip_ws(F.coalesce(F.col("review_text"), F.lit(""))))
    return df.where(F.col("review_text") != "").select(*COLUMNS)


def _valid_cols() -> Column:
    """True for usable rows; never null, so every row lands on exactly one side."""
    return F.coalesce(F.col("app_id").isNotNull() & F.col("date").isNotNull() & F.col("rating").between(1, 5), F.lit(False))


def scope_recent(df: DataFrame, days_back: int, as_of: datetime | str | None = None) -> DataFrame:
    """Keep reviews at or after ``as_of - days_back`` (inclusive, order-free).

    ``as_of`` is a parameter (never the wall clock); ``None`` means the newest
    review date in ``df``, computed as one scalar.  The comparison is against
    a literal, so it is pushed down to the Parquet scan.
    """
    if as_of is None:
        as_of = df.agg(F.max("date")).first()[0]
    if as_of is None:
        return df
    lit = ntz_literal(as_of)
    return df.where(F.col("date") >= lit - F.make_dt_interval(F.lit(days_back)))


def scope_preset(raw: DataFrame, label: str = tx.DEFAULT_SCOPE, as_of=None, by: Sequence[str] = ("app_id",)) -> DataFrame:
    days_back, target = tx.SCOPE_PRESETS[label]
    return normalise_reviews(raw, days_back=days_back, target=target, as_of=as_of, by=by)


def app_header(reviews: DataFrame, app_info: DataFrame, by: Sequence[str] = ("app_id",)) -> DataFrame:
    """Per app: display title/summary with fallbacks, counts and date label.

    The review aggregate is one row per app; ``app_info`` is a dimension of
    the same size, joined left so apps without metadata still show.
    """
    stats = reviews.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    span = days_between("first_date", "last_date")
    label = (
        F.when(span == 0, F.date_format("last_date", "dd MMM yyyy"))
        .when(span <= 60, F.concat(F.date_format("first_date", "dd MMM"), F.lit("–"), F.date_format("last_date", "dd MMM yyyy")))
        .otherwise(F.concat(F.date_format("first_date", "MMM yyyy"), F.lit("–"), F.date_format("last_date", "MMM yyyy")))
    )
    info = app_info.select("app_id", "title", "store_rating", "total_ratings", "genre", "summary")
    j = stats.join(info, "app_id", "left")
    return j.select(
        "app_id",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("app_id")).alias("title"),
        F.coalesce(F.col("genre"), F.lit("")).alias("genre"),
        F.left(F.coalesce(F.col("summary"), F.lit("")), F.lit(200)).alias("summary"),
        F.col("store_rating"),
        F.col("total_ratings"),
        F.col("n_reviews"),
        F.format_number(F.col("n_reviews"), 0).alias("n_reviews_text"),
        F.date_format("first_date", "yyyy-MM-dd").alias("first_date"),
        F.date_format("last_date", "yyyy-MM-dd").alias("last_date"),
        span.cast("bigint").alias("span_days"),
        label.alias("date_range"),
    )
