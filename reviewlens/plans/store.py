"""The stored review table (A10): enriched once, laid out for slices, appended in batches.

``path/rows/batch=<b>/bucket=<h>/part-*`` holds the normalised reviews with every
per-review column a report reads (sentiment, complaint, praise and feature
tags, the request flag).  ``bucket`` is a hash of the app, so a query about one
app reads one folder of each batch.  Inside, rows are range-partitioned and
sorted by (app, date, id): a hot app is spread over as many files as its size
asks for, and the row groups of a file cover narrow date ranges, so a date bound
skips the others by their min/max statistics.

``path/days/batch=<b>`` holds the day counts of that batch's rows per app.
Counts of batches add up (``recent.merge_day_counts``), so the threshold of the
recent slice comes from the counts alone, and only rows from the boundary day
on are read.

A batch is a folder of its own, replaced when the batch is written again; the
rows go first, the counts (and the number of buckets) last, and readers take the batches that have both.
Range partitioning comes before the enrichment, so its sampling pass reads the
plain reviews and texts are matched and scored once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators import recent as R
from reviewlens.plans import enrich as E

BUCKETS = 64
ROW_GROUP_BYTES = 32 << 20


def bucket_of(app: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(app), F.lit(buckets)).cast("int")


def append(reviews: DataFrame, path: str, batch: str, buckets: int = BUCKETS, files: int | None = None,
           row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Enrich normalised reviews and store them as one batch (replacing it).

    ``files``: range partitions to write (default: the session's shuffle partitions).
    """
    spark = reviews.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["bucket", "app_id", "date", "review_id"]
    rows = reviews.withColumn("bucket", bucket_of(F.col("app_id"), buckets)).repartitionByRange(n, *order).sortWithinPartitions(*order)
    where = f"{path.rstrip('/')}/rows/batch={batch}"
    (E.enrich_all(rows).write.mode("overwrite").option("parquet.block.size", row_group_bytes).partitionBy("bucket").parquet(where))
    counts = R.day_counts(spark.read.parquet(where).select("app_id", "date")).withColumn("buckets", F.lit(buckets))
    counts.write.mode("overwrite").parquet(f"{path.rstrip('/')}/days/batch={batch}")


class Reviews:
    """The reviews in the forms that reports take, derived from landed rows on each use."""

    def __init__(self, plain: DataFrame):
        self.plain = plain

    def enriched(self) -> DataFrame:
        """With complaint tags."""
        return E.enrich(self.plain, sentiment=False)

    def scored(self) -> DataFrame:
        """With sentiment and complaint tags."""
        return E.scored_once(self.plain)

    def flagged(self, by: Sequence[str] = ("app_id",)) -> DataFrame:
        """With complaint tags and ``is_recent``."""
        return R.flag_recent(self.enriched(), by)

    def recent(self, by: Sequence[str] = ("app_id",)) -> DataFrame:
        return R.recent_slice(self.plain, by)


class Stored(Reviews):
    """The same forms, read from a stored table: no text is matched or scored again."""

    def __init__(self, spark: SparkSession, path: str):
        days = spark.read.parquet(f"{path.rstrip('/')}/days")
        rows = spark.read.parquet(f"{path.rstrip('/')}/rows")
        #: batches that are complete, and the number of buckets each was written with
        self.batches = dict(days.select("batch", "buckets").distinct().collect())
        self.table = rows.where(F.col("batch").isin(list(self.batches)))
        self.days = days
        super().__init__(self.table.drop("batch", "bucket"))

    @cached_property
    def counts(self) -> DataFrame:
        """Day counts per app over all batches."""
        return R.merge_day_counts(self.days.drop("batch", "buckets"))

    def _counts(self, by: Sequence[str]) -> DataFrame | None:
        if set(by) - {"app_id"}:
            return None
        return self.counts if by else self.counts.groupBy("day").agg(F.sum("n").alias("n"))

    def enriched(self) -> DataFrame:
        return self.plain

    def scored(self) -> DataFrame:
        return self.plain

    def flagged(self, by: Sequence[str] = ("app_id",)) -> DataFrame:
        return R.flag_recent(self.plain, by, histogram=self._counts(by))

    def recent(self, by: Sequence[str] = ("app_id",)) -> DataFrame:
        return R.recent_slice(self.plain, by, histogram=self._counts(by))

    def of_app(self, app_id: str) -> DataFrame:
        """Reviews of one app: one bucket folder of each batch, row groups of that app."""
        here = F.lit(False)
        for n in sorted(set(self.batches.values())):
            here = here | (F.col("batch").isin([b for b, k in self.batches.items() if k == n]) & (F.col("bucket") == bucket_of(F.lit(app_id), n)))
        return self.table.where(here & (F.col("app_id") == app_id)).drop("batch", "bucket")
