"""Structured Streaming: incremental theme counts over landed review files.

``readStream`` of raw landing files -> typing/strip (the batch normaliser's
row-wise steps) -> de-duplication by (app_id, review_id) in keyed state ->
``foreachBatch``, which adds the rest up per (app, window, theme) and writes it
under the batch's number, replacing that partition when a batch is replayed.
Readers sum the partial counts, so windows that are still open are complete up
to the last batch.

The source never de-duplicates; re-landed files should not count twice.  The
keys seen are the state of Spark's ``dropDuplicates``, dealt by a hash of the
key and held in RocksDB, so a batch looks up its own keys only, whatever the
length of the history; a review counts once however late it lands or lands
again, since no watermark drops a key or a row.  Rows without a review_id cannot
be told to be repeated: they take a branch without state and all count.

Windows are calendar units of the UTC-naive review date, so no session setting
matters.

The recent-20% slice is not incrementally maintainable (it depends on the
final row count); signals are recomputed from the facts, or from the stored
table and its day counts (``plans.store``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reviewlens.functions.text import iso_ts, strip_ws
from reviewlens.operators.tagging import tag_complaints
from reviewlens.session import checkpoint_dir
from reviewlens.sources import fixture as FX
from reviewlens.sources.ingest import usable

WINDOW = "day"
KEY = ["app_id", "review_id"]
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_reviews(raw_stream: DataFrame) -> DataFrame:
    """Row-wise normalisation of a stream (or table) of landed reviews."""
    df = usable(raw_stream)
    return df.withColumn("review_text", strip_ws(F.coalesce(F.col("review_text"), F.lit("")))).where(F.col("review_text") != "")


def uncounted(reviews: DataFrame) -> DataFrame:
    """Each review once over the whole stream, and every row without a review_id."""
    known = F.col("review_id").isNotNull()
    return reviews.where(known).dropDuplicates(KEY).unionByName(reviews.where(~known))


def windowed_theme_counts(reviews: DataFrame, window: str = WINDOW) -> DataFrame:
    """(app_id, window_start, window_end, theme, mentions) of a batch of reviews."""
    rows = tag_complaints(reviews).select(
        "app_id", F.date_trunc(window, "date").cast("timestamp_ntz").alias("w"), F.explode_outer("complaint_categories").alias("theme"))
    counts = rows.where(F.col("theme").isNotNull()).groupBy("app_id", "w", "theme").agg(F.count(F.lit(1)).alias("mentions"))
    end = F.col("w") + F.expr(f"INTERVAL 1 {window}")
    return counts.select("app_id", iso_ts("w").alias("window_start"), iso_ts(end).alias("window_end"), "theme", "mentions")


def write_facts(out: str, window: str = WINDOW):
    """foreachBatch sink: the partial counts of a micro-batch under its number.  A replayed batch
    replaces its own partition, so nothing is counted twice."""
    def _write(batch: DataFrame, batch_id: int) -> None:
        (windowed_theme_counts(batch, window).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))
    return _write


def read_facts(spark: SparkSession, out: str) -> DataFrame:
    """The counts so far, open windows included."""
    return (spark.read.parquet(out).groupBy("app_id", "window_start", "window_end", "theme")
            .agg(F.sum("mentions").alias("mentions")))


def run_available_now(spark: SparkSession, landing: str, out: str, checkpoint: str, window: str = WINDOW) -> StreamingQuery:
    """Process everything landed so far, then stop (restartable from the checkpoint); the finished query."""
    raw = spark.readStream.schema(landing_schema(spark, landing)).parquet(landing)
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        q = (uncounted(stream_reviews(raw)).writeStream.foreachBatch(write_facts(out, window))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(STATE_STORE, before)
    q.awaitTermination()
    return q


def landing_schema(spark: SparkSession, landing: str):
    return spark.read.parquet(landing).schema


def stream_theme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract run: land the raw reviews derived from ``events`` as files,
    stream them through, return what the facts hold."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"
    landing, out, ckpt = f"{base}/landing", f"{base}/out", f"{base}/ckpt"
    FX.raw_reviews(spark, sf_dir).write.parquet(landing)
    run_available_now(spark, landing, out, ckpt)
    return read_facts(spark, out)
