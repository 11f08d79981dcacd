"""Contract queries: one callable (spark, sf_dir) -> DataFrame per operator.

Outputs are flat (no arrays), dates are ISO strings, ranks and counts BIGINT,
percentages DOUBLE rounded half-even — the same shapes the SQL oracle
produces.  Every query reads the driver tables (``events``, ``documents``,
``pages``) or data Spark derives from them, in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens import taxonomy as tx
from reviewlens.functions import text as T
from reviewlens.operators import filters as FL
from reviewlens.operators import recent as R
from reviewlens.operators import themes as TH
from reviewlens.operators import topk as TK
from reviewlens.operators.sentiment import LEXICON, score_sentiment
from reviewlens.operators.tagging import KINDS, flag_expr, tag_by_table, tag_expr
from reviewlens.plans import enrich as E
from reviewlens.plans import reports as RP
from reviewlens.plans import store as ST
from reviewlens.plans import trends as TR
from reviewlens.session import checkpoint_dir
from reviewlens.sources import fixture as FX
from reviewlens.sources import ingest as IN

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# ───────────────────────────── FIXED VALUES ─────────────────────────────
# Parameters of the contract runs (ours).
SEARCH_QUERY = "slow|crash"
EXPLORER_CHIPS = ["Slow", "Ads"]
EXPLORER_QUERY = "ads"
LIBRARY_PRIMARY = "Negative"
LIBRARY_CHIPS = ["Crash", "Login"]
NEWEST_N = 500
RECENT_DAYS = 7
DATE_RANGE = ("2024-01-10", "2024-01-20")
STARS = [1, 5]
COMPARE = ("com.example.app0", "com.example.app1")
# Custom document taxonomy for table-driven tagging (ours).
DOC_TAXONOMY: dict[str, list[str]] = {
    "privacy": ["password", "email", "phone", "address", "secret", "token"],
    "licensing": ["license", "copyright", "rights reserved", "mit", "apache"],
    "quality": ["good", "great", "best", "excellent", "quality"],
    "problems": ["error", "fail", "bug", "broken", "problem", "crash"],
    "commerce": ["price", "buy", "order", "payment", "shop", "sale"],
    "time": ["today", "yesterday", "tomorrow", "week", "year", "month"],
}
# ─────────────────────────── END FIXED VALUES ───────────────────────────


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _ids(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("app_id", "review_id", *extra)


# ── sources ─────────────────────────────────────────────────────────────────
@query("ingest_reviews")
def q_ingest(spark, d):
    rv = E.reviews(spark, d)
    return rv.select("app_id", "review_id", T.iso_ts("date").alias("date"), "rating", "review_text",
                     "thumbs_up", "app_version")


@query("quarantine_reviews")
def q_quarantine(spark, d):
    return IN.quarantine_reviews(FX.raw_reviews(spark, d)).select("app_id", "review_id", "reason")


@query("scope_recent")
def q_scope_recent(spark, d):
    rv = E.reviews(spark, d)
    return _ids(IN.scope_recent(rv, RECENT_DAYS), "rating")


@query("scope_newest_n")
def q_scope_newest_n(spark, d):
    return _ids(R.newest_n(E.reviews(spark, d), NEWEST_N), "rating")


def _copies(df: DataFrame) -> DataFrame:
    """How many rows of each (app, day, id) are in: which of them is no matter."""
    return df.groupBy("app_id", T.iso_date("date").alias("day"), "review_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("scope_newest_n_ties")
def q_newest_ties(spark, d):
    return _copies(R.newest_n(FX.tied_reviews(E.reviews(spark, d)), NEWEST_N))


@query("recent_slice_ties")
def q_recent_ties(spark, d):
    return _copies(R.recent_slice(FX.tied_reviews(E.reviews(spark, d))))


@query("ingest_dirty")
def q_ingest_dirty(spark, d):
    rv = IN.normalise_reviews(FX.dirty_raw(FX.raw_reviews(spark, d)))
    return rv.select("app_id", "review_id", T.iso_ts("date").alias("date"), "rating", "thumbs_up")


@query("quarantine_dirty")
def q_quarantine_dirty(spark, d):
    return IN.quarantine_reviews(FX.dirty_raw(FX.raw_reviews(spark, d))).select("app_id", "review_id", "reason")


@query("scope_preset_dated")
def q_scope_preset_dated(spark, d):
    """Cutoff, then cap, then blank removal."""
    return _ids(IN.normalise_reviews(FX.raw_reviews(spark, d), days_back=RECENT_DAYS, target=NEWEST_N // 10), "rating")


@query("scope_preset")
def q_scope_preset(spark, d):
    return _ids(IN.scope_preset(FX.raw_reviews(spark, d), "All recent"), "rating")


@query("app_header")
def q_app_header(spark, d):
    return IN.app_header(E.reviews(spark, d), FX.app_info(spark, d))


# ── scalar expressions ──────────────────────────────────────────────────────
@query("package_id")
def q_package_id(spark, d):
    u = FX.app_urls(spark, d)
    return u.select("event_id", T.package_id("url").alias("package_id"))


@query("country_hint")
def q_country_hint(spark, d):
    u = FX.app_urls(spark, d)
    return u.select("event_id", T.country_hint("url", tx.HL_TO_COUNTRY).alias("country"))


@query("url_param")
def q_url_param(spark, d):
    p = FX.table(spark, d, "pages")
    return p.select("page_id", T.query_param("url", "page").alias("page"), T.query_param("url", "ref").alias("ref"))


@query("truncate_text")
def q_truncate(spark, d):
    doc = FX.table(spark, d, "documents")
    return doc.select("doc_id", T.truncate("text", 110).alias("preview"))


# ── tagging ─────────────────────────────────────────────────────────────────
def _exploded(df: DataFrame, tags, out="theme") -> DataFrame:
    return TK.explode_tags(df.select("app_id", "review_id", "review_text"), tags, out).select("app_id", "review_id", out)


@query("tag_complaints")
def q_tag_complaints(spark, d):
    en = E.enriched(spark, d)
    return TK.explode_tags(en.select("app_id", "review_id", "complaint_categories"),
                           F.col("complaint_categories")).select("app_id", "review_id", "theme")


@query("tag_complaints_words")
def q_tag_words(spark, d):
    """Whole-word matching: "fee" is not in "coffee"."""
    return _exploded(E.reviews(spark, d), tag_expr("review_text", tx.COMPLAINT_GROUPS, match="word"))


@query("tag_praise")
def q_tag_praise(spark, d):
    return _exploded(E.reviews(spark, d), tag_expr("review_text", tx.PRAISE_GROUPS))


@query("tag_features")
def q_tag_features(spark, d):
    return _exploded(E.reviews(spark, d), tag_expr("review_text", tx.FEATURE_THEMES))


@query("flag_requests")
def q_flag_requests(spark, d):
    rv = E.reviews(spark, d)
    return rv.select("app_id", "review_id", flag_expr("review_text", tx.REQUEST_SIGNALS).alias("is_request"))


@query("top_negative_phrases")
def q_top_negative(spark, d):
    return TH.top_negative_phrases(E.reviews(spark, d))


@query("sentiment")
def q_sentiment(spark, d):
    doc = FX.table(spark, d, "documents")
    return score_sentiment(doc.select("doc_id", "text"), "text").select("doc_id", "sentiment_score", "sentiment_label")


@query("sentiment_by_table")
def q_sentiment_by_table(spark, d):
    """Scores of the documents under a lexicon that is read as a table."""
    doc = FX.table(spark, d, "documents").select("doc_id", "text")
    return score_sentiment(doc, "text", FX.lexicon_table(spark, LEXICON)).select("doc_id", "sentiment_score", "sentiment_label")


@query("tag_by_table")
def q_tag_by_table(spark, d):
    doc = FX.table(spark, d, "documents")
    rows = [(g, i, k) for i, (g, kws) in enumerate(DOC_TAXONOMY.items()) for k in kws]
    kw = spark.createDataFrame(rows, "group string, ordinal int, keyword string")
    return tag_by_table(doc, kw, ["doc_id"], "text").select("doc_id", "group", F.col("ordinal").cast("int"))


# ── themes ──────────────────────────────────────────────────────────────────
#: Reports over the reviews in whatever form they are at hand (``store.Reviews`` or ``store.Stored``).
REPORTS: dict[str, Callable[[ST.Reviews], DataFrame]] = {
    "theme_summary": lambda s: TH.theme_summary(s.enriched()),
    "theme_samples": lambda s: TK.theme_samples(s.enriched()).select("app_id", "theme", "rank", "review_id", "rating"),
    "recent_slice": lambda s: _ids(s.recent(), "rating"),
    "rising_themes": lambda s: TH.rising_themes(s.flagged()),
    "key_signals": lambda s: TH.key_signals(s.flagged()),
    "key_signals_strict": lambda s: TH.key_signals(s.flagged(), min_change_pp=RP.STRICT_CHANGE, min_recent_mentions=RP.STRICT_MENTIONS),
    "signal_snippets": lambda s: TK.signal_snippets(s.flagged()).select("app_id", "theme", "rank", "review_id", "snippet"),
    "signal_cards": lambda s: RP.signal_cards(s.flagged()),
    "theme_library": lambda s: RP.theme_library(s.flagged()),
    "theme_library_filtered": lambda s: RP.theme_library(s.flagged(), primary=LIBRARY_PRIMARY, chips=LIBRARY_CHIPS),
    "opportunity_cards": lambda s: RP.opportunity_cards(s.plain),
    "strength_cards": lambda s: RP.strength_cards(s.plain),
    "review_cards": lambda s: RP.review_cards(s.enriched()),
    "signal_coverage": lambda s: RP.signal_coverage(s.flagged()),
    "sentiment_corpus": lambda s: RP.sentiment_corpus(s.scored()),
}
QUERIES |= {name: lambda spark, d, f=report: f(ST.Reviews(E.reviews(spark, d))) for name, report in REPORTS.items()}


def build_store(spark: SparkSession, d: str) -> str:
    """Store the reviews in two batches, the second landing after the first; the folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/store/{uuid.uuid4().hex}"
    rv = E.reviews(spark, d)
    late = F.col("date") >= F.lit(FX.LATE_CUTOFF).cast("timestamp_ntz")
    ST.append(rv.where(~late), path, "0")
    ST.append(rv.where(late), path, "1")
    return path


@query("enriched_store")
def q_store(spark, d):
    """Every stored column, read back from both batches."""
    rows = ST.Stored(spark, build_store(spark, d)).plain
    return rows.select("app_id", "review_id", T.iso_ts("date").alias("date"), "rating", "thumbs_up", "sentiment_score", "sentiment_label",
                       *[T.join_or(c, "").alias(c) for _, c in KINDS.values()], "is_request")


@query("recent_slice_stored")
def q_recent_stored(spark, d):
    """The recent slice from the stored day counts and the newest row groups."""
    return REPORTS["recent_slice"](ST.Stored(spark, build_store(spark, d)))


@query("praised_strengths")
def q_praised(spark, d):
    return TH.praised_strengths(E.reviews(spark, d))


@query("product_opportunities")
def q_opps(spark, d):
    return TH.product_opportunities(E.reviews(spark, d))


@query("mixed_areas")
def q_mixed(spark, d):
    return TH.mixed_areas(E.enriched(spark, d))


@query("strength_samples")
def q_strength_samples(spark, d):
    return TK.strength_samples(E.reviews(spark, d)).select("app_id", "theme", "rank", "review_id", "sample")


@query("opportunity_samples")
def q_opp_samples(spark, d):
    return TK.opportunity_samples(E.reviews(spark, d)).select("app_id", "request", "rank", "review_id", "sample")


@query("mixed_samples")
def q_mixed_samples(spark, d):
    return TK.mixed_samples(E.enriched(spark, d)).select("app_id", "area", "side", "review_id", "sample")


@query("sentiment_topk")
def q_sentiment_topk(spark, d):
    return TK.sentiment_topk(E.scored(spark, d)).select("app_id", "sentiment_label", "rank", "review_id")


@query("investigate")
def q_investigate(spark, d):
    rows = FL.theme_reviews(E.enriched(spark, d).select("app_id", "review_id", "date", "complaint_categories"))
    return TK.investigate(rows, ["app_id", "theme"], latest_first=False).select("app_id", "theme", "rank", "review_id")


# ── filters ─────────────────────────────────────────────────────────────────
@query("filter_rating_bucket")
def q_bucket(spark, d):
    return _ids(FL.filter_rating_bucket(E.reviews(spark, d), "Mixed"), "rating")


@query("filter_requests")
def q_requests(spark, d):
    return _ids(FL.filter_requests(E.reviews(spark, d)), "rating")


@query("filter_theme_chips")
def q_chips(spark, d):
    return _ids(FL.filter_theme_chips(E.enriched(spark, d), ["Crash", "Login"]), "rating")


@query("theme_reviews")
def q_theme_reviews(spark, d):
    return FL.theme_reviews(E.enriched(spark, d)).select("app_id", "review_id", "theme")


@query("keyword_reviews")
def q_keyword_reviews(spark, d):
    return FL.keyword_reviews(E.reviews(spark, d), tx.FEATURE_THEMES).select("app_id", "review_id", "theme")


@query("search_reviews")
def q_search(spark, d):
    return _ids(FL.search_reviews(E.reviews(spark, d), SEARCH_QUERY), "rating")


@query("filter_date_range")
def q_date_range(spark, d):
    return _ids(FL.filter_date_range(E.reviews(spark, d), *DATE_RANGE), "rating")


@query("filter_stars")
def q_stars(spark, d):
    return _ids(FL.filter_stars(E.reviews(spark, d), STARS), "rating")


# ── reports ─────────────────────────────────────────────────────────────────
@query("explorer")
def q_explorer(spark, d):
    return RP.explorer(E.enriched(spark, d), "All Reviews", EXPLORER_CHIPS, EXPLORER_QUERY)


@query("export_all")
def q_export_all(spark, d):
    """Rows of the full download, by their rank in it."""
    return RP.export_list(E.scored(spark, d))


@query("export_filtered")
def q_export_filtered(spark, d):
    """Rows of the filtered download, by their rank in it."""
    return RP.explorer(E.enriched(spark, d), "Requests")


@query("scope_counts")
def q_scope_counts(spark, d):
    return TR.scope_counts(E.enriched(spark, d))


# ── spec views ──────────────────────────────────────────────────────────────
@query("rating_distribution")
def q_rating_dist(spark, d):
    return TR.rating_distribution(E.reviews(spark, d))


@query("sentiment_trend")
def q_sent_trend(spark, d):
    return TR.sentiment_trend(E.scored(spark, d))


@query("sentiment_trend_week")
def q_sent_trend_week(spark, d):
    return TR.sentiment_trend(E.scored(spark, d), unit="week", fill=True)


@query("sentiment_trend_month")
def q_sent_trend_month(spark, d):
    return TR.sentiment_trend(E.scored(spark, d), unit="month", fill=True)


@query("sentiment_trend_filled")
def q_sent_trend_filled(spark, d):
    """Days of the drill-through reviews of one theme: most apps have days without one."""
    rows = FL.filter_theme_chips(E.scored(spark, d), ["Login"])
    return TR.sentiment_trend(rows.where(F.dayofmonth("date") % 3 != 0), unit="day", fill=True)


@query("review_table")
def q_review_table(spark, d):
    return TR.review_table(E.scored(spark, d))


@query("compare_apps")
def q_compare(spark, d):
    return TR.compare_apps(E.enriched(spark, d), *COMPARE)


@query("theme_by_version")
def q_by_version(spark, d):
    return TR.theme_by_version(E.enriched(spark, d))


@query("sample_adequacy")
def q_adequacy(spark, d):
    return TR.sample_adequacy(E.reviews(spark, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key signals over all apps as one group (the reference's single-app case)."""
    fl = R.flag_recent(E.enriched(spark, sf_dir), by=())
    return TH.key_signals(fl, by=(), min_change_pp=RP.STRICT_CHANGE, min_recent_mentions=RP.STRICT_MENTIONS)


# ── insights and streaming ──────────────────────────────────────────────────
@query("parse_insights")
def q_parse_insights(spark, d):
    from reviewlens.plans import insights as INS
    return INS.parse_insights(FX.landed_replies(spark, d))


@query("stream_theme_counts")
def q_stream(spark, d):
    from reviewlens.streaming import themes as ST
    return ST.stream_theme_counts(spark, d)
