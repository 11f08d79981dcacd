"""Review-shaped landing data derived from the driver's ``events`` table.

Raw driver text almost never contains review vocabulary, so reviews are
composed from ``events`` and a 26-row phrase bank (recipe in FIXTURES.md §3).
The derivation is a pure projection — phrase lookups are ``element_at`` on a
literal array, not a join — so it scales with ``events`` and adds no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ───────────────────────────── FIXED VALUES ─────────────────────────────
# Phrase bank of the derived review fixture: (slot, polarity, text).
PHRASES: list[tuple[int, str, str]] = [
    (0, "neg", "This keeps crashing on my phone"),
    (1, "neg", "Too many ads everywhere"),
    (2, "neg", "It will not open since yesterday"),
    (3, "neg", "Cannot login, verification failed"),
    (4, "neg", "Very slow and it hangs"),
    (5, "neg", "Payment failed and no refund"),
    (6, "neg", "Total scam, waste of money"),
    (7, "neg", "Full of bugs and errors"),
    (8, "neg", "Useless, waste of time"),
    (9, "neg", "No response from customer support"),
    (10, "neg", "My account hacked, privacy gone"),
    (11, "neg", "Broken after update"),
    (12, "mix", "It is okay I guess"),
    (13, "mix", "Sometimes I get an error message"),
    (14, "pos", "Fast and smooth, works perfectly"),
    (15, "pos", "Easy to use and intuitive"),
    (16, "pos", "Great price, worth it"),
    (17, "pos", "Reliable and accurate"),
    (18, "pos", "Good but please add dark mode"),
    (19, "pos", "Love it, wish it had better search"),
    (20, "pos", "Would love offline download"),
    (21, "pos", "Beautiful and clean layout"),
    (22, "pos", "Nice but one thing: the notification settings"),
    (23, "pos", "On time, great support, no bug at all"),
    (24, "pos", "Great app, never had a crash"),
    (25, "pos", "Good but a little slow, so slow at night"),
]
APP_PREFIX = "com.example.app"
N_APPS = 5
LATE_CUTOFF = "2024-01-25 00:00:00"
# ─────────────────────────── END FIXED VALUES ───────────────────────────


# unique row key of each driver table, used to spread under-split scans
ROW_KEYS = {"events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"],
            "labels": ["doc_id"], "conversations": ["conv_id", "turn"]}


#: Session setting that spreads small one-split test files over the cores (off unless a session sets it).
SPREAD = "spark.reviewlens.spreadScans"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  With ``SPREAD`` set to true (local benchmarks on files of
    one split), its rows are dealt over the cores by their unique key."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    keys = ROW_KEYS.get(name)
    if keys and spark.conf.get(SPREAD, "false") == "true":
        return df.repartition(spark.sparkContext.defaultParallelism, *keys)
    return df


def _lookup(values: list, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx + F.lit(1))


def raw_reviews_from_events(events: DataFrame) -> DataFrame:
    """Raw landing rows (store field names) for every event."""
    late = F.col("ts") >= F.lit(LATE_CUTOFF).cast("timestamp_ntz")
    slot = (
        F.when(late & (F.col("event_type") == "error"), F.lit(0))
        .when(late & (F.col("event_type") == "signup"), F.lit(13))
        .otherwise((F.col("event_id") * 7 + F.col("user_id")) % 26)
    ).cast("int")
    slot2 = ((F.col("event_id") * 11 + F.col("user_id")) % 26).cast("int")
    pol = _lookup([p[1] for p in PHRASES], slot)
    txt = _lookup([p[2] for p in PHRASES], slot)
    txt2 = _lookup([p[2] for p in PHRASES], slot2)
    rating = (
        F.when(pol == "neg", F.col("event_id") % 2 + 1)
        .when(pol == "mix", F.lit(3))
        .otherwise(F.col("event_id") % 2 + 4)
    ).cast("int")
    content = (
        F.when(F.col("event_id") % 97 == 0, F.lit("   "))
        .when(F.col("event_id") % 3 == 0, F.concat(txt, F.lit(". "), txt2))
        .otherwise(txt)
    )
    version = F.concat(F.lit("1."), F.floor((F.dayofmonth("ts") - 1) / 10).cast("int").cast("string"))
    return events.select(
        F.concat(F.lit(APP_PREFIX), (F.col("user_id") % N_APPS).cast("string")).alias("app_id"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("reviewId"),
        F.col("ts").alias("at"),
        rating.alias("score"),
        content.alias("content"),
        F.floor("value").cast("int").alias("thumbsUpCount"),
        version.alias("reviewCreatedVersion"),
    )


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_reviews_from_events(table(spark, sf_dir, "events"))


def tied_reviews(reviews: DataFrame) -> DataFrame:
    """The reviews with one app nulled, every tenth id nulled, the others cut
    to 50 repeating ids, and dates cut to the day: ties wherever a cap falls."""
    number = F.col("review_id").cast("bigint")
    return reviews.withColumns({
        "app_id": F.when(~F.col("app_id").endswith("4"), F.col("app_id")),
        "review_id": F.when(number % 10 != 0, F.lpad((number % 50).cast("string"), 3, "0")),
        "date": F.date_trunc("day", "date").cast("timestamp_ntz"),
    })


def dirty_raw(raw: DataFrame) -> DataFrame:
    """Raw reviews as landed text with bad scores, bad and offset times,
    missing apps and counts beyond the integer range."""
    n = F.col("reviewId").cast("bigint")
    score = F.col("score").cast("string")
    for k, bad in enumerate(("NaN", "1e10", None, "0", "6")):
        score = F.when(n % 11 == k, F.lit(bad)).otherwise(score)
    shifted = F.concat((F.col("at") + F.expr("INTERVAL 330 MINUTES")).cast("string"), F.lit("+05:30"))
    return raw.withColumns({
        "app_id": F.when(n % 17 != 0, F.col("app_id")),
        "score": score,
        "at": F.when(n % 13 == 0, F.lit("soon")).when(n % 13 == 1, shifted).when(n % 13 == 2, F.concat(F.col("at").cast("string"), F.lit("Z")))
        .otherwise(F.col("at").cast("string")),
        "thumbsUpCount": F.when(n % 19 == 0, F.lit(3_000_000_000)).otherwise(F.col("thumbsUpCount").cast("bigint")),
    })


def app_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, url): six store-URL shapes per FIXTURES.md §3."""
    ev = table(spark, sf_dir, "events")
    p = F.concat(F.lit(APP_PREFIX), (F.col("user_id") % N_APPS).cast("string"))
    case = F.col("event_id") % 6
    url = (
        F.when(case == 0, F.concat(F.lit("https://store.example.com/details?id="), p, F.lit("&hl=en_IN")))
        .when(case == 1, F.concat(F.lit("https://store.example.com/details?hl=en_GB&id="), p, F.lit("#top")))
        .when(case == 2, p)
        .when(case == 3, F.concat(F.lit("  https://store.example.com/details?id="), p, F.lit("&hl=xx_YY ")))
        .when(case == 4, F.lit("store.example.com/details?id=com%2Eexample%2Ex"))
        .otherwise(F.lit("https://store.example.com/details?x=1"))
    )
    return ev.select("event_id", url.alias("url"))


def app_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """App metadata dimension derived from events: one row per app except the
    last app (missing row); app1 carries a null title and app2 an empty one.

    store_rating = mean event value of the app's users (1 dp), total_ratings =
    event count; a long generated summary exercises the 200-char cut.
    """
    ev = table(spark, sf_dir, "events")
    app_n = (F.col("user_id") % N_APPS).cast("int")
    agg = (
        ev.where(app_n < N_APPS - 1)
        .groupBy(app_n.alias("n"))
        .agg(
            F.bround(F.avg("value"), 1).alias("store_rating"),
            F.count(F.lit(1)).alias("total_ratings"),
            F.count_distinct("user_id").alias("users"),
            F.min("event_type").alias("genre"),
        )
    )
    app_id = F.concat(F.lit(APP_PREFIX), F.col("n").cast("string"))
    title = (
        F.when(F.col("n") == 1, F.lit(None).cast("string"))
        .when(F.col("n") == 2, F.lit(""))
        .otherwise(F.concat(F.lit("Example App "), F.col("n").cast("string")))
    )
    summary = F.when(F.col("n") == 3, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("Used by "), F.col("users").cast("string"), F.lit(" people. "), F.repeat(F.lit("Fast, simple, reliable. "), 12))
    )
    return agg.select(
        app_id.alias("app_id"),
        title.alias("title"),
        F.col("store_rating").cast("double").alias("store_rating"),
        F.col("total_ratings").cast("bigint").alias("total_ratings"),
        F.concat(F.lit("https://img.example.com/"), app_id, F.lit(".png")).alias("icon"),
        F.col("genre"),
        summary.alias("summary"),
    )


def landed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, day, raw): replies as an LLM might have left them, one per app and day of ``events``, in
    nine shapes: plain, fenced, a key missing, prose, nested values, a list, cut off, inside prose, null.
    One app's id does not end in a digit."""
    n = F.col("user_id") % N_APPS
    app = F.when(n == 3, F.lit("com.example.shop")).otherwise(F.concat(F.lit(APP_PREFIX), n.cast("string")))
    day = table(spark, sf_dir, "events").groupBy(app.alias("app_id"), n.alias("n"), F.to_date("ts").alias("day")).agg(
        F.min("event_type").alias("a"), F.max("event_type").alias("b"), F.count(F.lit(1)).alias("c"))
    plain = F.format_string('{"loved_features":["%s"],"top_complaints":["%s","%s"]}', "b", "a", "b")
    nested = F.format_string('{"loved_features":"%s","top_complaints":[{"count":%d,"theme":"%s"},%d,["%s"],null,true]}', "b", "c", "a", "c", "b")
    shapes = [
        plain,
        F.concat(F.lit("```json\n"), plain, F.lit("\n```")),
        F.format_string('{"top_complaints":["%s"]}', "a"),
        F.lit("Sorry, I can't summarise these reviews right now."),
        nested,
        F.format_string('[{"top_complaints":["%s"]}]', "a"),
        F.left(plain, F.lit(40)),
        F.concat(F.lit("Here you are: "), nested, F.lit("\nAnything else?")),
        F.lit(None).cast("string"),
    ]
    raw = F.element_at(F.array(*shapes), ((F.dayofmonth("day") + F.col("n")) % len(shapes) + 1).cast("int"))
    return day.select("app_id", F.col("day").cast("string").alias("day"), raw.alias("raw"))


def lexicon_table(spark: SparkSession, words: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(words.items()), "token string, valence double")
