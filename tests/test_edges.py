"""Hand-made edge cases (FIXTURES.md §5)."""

from __future__ import annotations

import datetime as dt
import glob

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reviewlens import taxonomy as tx
from reviewlens.functions import text as T
from reviewlens.operators import filters as FL
from reviewlens.operators import recent as R
from reviewlens.operators import sentiment as S
from reviewlens.operators import themes as TH
from reviewlens.operators.tagging import tag_expr
from reviewlens.plans import enrich as E
from reviewlens.plans import reports as RP
from reviewlens.sources import export as X
from reviewlens.sources import ingest as IN

SCHEMA = "app_id string, review_id string, date timestamp_ntz, rating int, review_text string, thumbs_up int, app_version string"
T0 = dt.datetime(2024, 1, 1)


def reviews(spark, rows):
    """rows: (review_id, minutes after T0, rating, text[, thumbs])."""
    data = [("a", r[0], T0 + dt.timedelta(minutes=r[1]), r[2], r[3], r[4] if len(r) > 4 else 0, "1.0") for r in rows]
    return spark.createDataFrame(data, SCHEMA)


def raw(spark, rows):
    schema = "app_id string, reviewId string, at string, score string, content string, thumbsUpCount bigint"
    return spark.createDataFrame(rows, schema)


def test_blank_and_strip(spark):
    rows = [("a", str(i), "2024-01-01 00:00:00", "5", t, 1) for i, t in
            enumerate(["   ", "\n", " ", "　", None, "  ok\n", "\x1c x  "])]
    out = IN.normalise_reviews(raw(spark, rows)).orderBy("review_id").collect()
    assert [r.review_text for r in out] == ["ok", "x"]


def test_quarantine_and_offset_time(spark):
    rows = [
        ("a", "1", "2024-01-01T05:30:00+05:30", "4", "fine", 0),
        ("a", "2", "2024-01-01 00:00:00", None, "x", 0),
        ("a", "3", "2024-01-01 00:00:00", "x", "x", 0),
        ("a", "4", "2024-01-01 00:00:00", "0", "x", 0),
        ("a", "5", "2024-01-01 00:00:00", "6", "x", 0),
        ("a", "6", "not a time", "3", "x", 0),
    ]
    good = IN.normalise_reviews(raw(spark, rows)).collect()
    assert [(r.review_id, r.date) for r in good] == [("1", dt.datetime(2024, 1, 1))]
    q = {r.review_id: r.reason for r in IN.quarantine_reviews(raw(spark, rows)).collect()}
    assert q == {"2": "rating_missing_or_not_numeric", "3": "rating_missing_or_not_numeric",
                 "4": "rating_out_of_range", "5": "rating_out_of_range", "6": "timestamp_unparsable"}


def tags(spark, text, taxonomy=tx.COMPLAINT_GROUPS):
    df = spark.createDataFrame([(text,)], "review_text string")
    return df.select(tag_expr("review_text", taxonomy).alias("t")).first().t


def test_substring_semantics(spark):
    assert tags(spark, "good coffee") == ["Subscription / Payment"]
    assert tags(spark, "won’t open") == []
    assert tags(spark, "no bug at all") == ["Bugs / Errors"]
    assert tags(spark, "Too many ads and it keeps crashing") == ["Too many ads", "App crashing"]
    assert tags(spark, "it keeps crashing, too many ads") == ["Too many ads", "App crashing"]
    assert tags(spark, "") == [] and tags(spark, None) == []


def test_pruned_taxonomy_equals_full(spark):
    texts = [("keeps crashing after update",), ("login error, not opening",), ("so slow",), ("support not responding",),
             ("fraud app, fake app",), ("otp not received",), ("nothing here",)]
    df = spark.createDataFrame(texts, "review_text string")
    for taxonomy in (tx.COMPLAINT_GROUPS, tx.PRAISE_GROUPS, tx.FEATURE_THEMES):
        a = df.select(tag_expr("review_text", taxonomy, prune=True).alias("t")).collect()
        b = df.select(tag_expr("review_text", taxonomy, prune=False).alias("t")).collect()
        assert a == b


def test_untagged_only_gives_empty_summary(spark):
    df = E.enrich(reviews(spark, [("1", 0, 5, "lovely"), ("2", 1, 4, "nice")]), sentiment=False)
    assert TH.theme_summary(df).count() == 0
    assert TH.key_signals(R.flag_recent(df)).count() == 0


def test_small_app_slice_is_everything(spark):
    rows = [(f"{i:03d}", i, 1, "crash") for i in range(49)]
    fl = R.flag_recent(E.enrich(reviews(spark, rows), sentiment=False))
    assert fl.where("is_recent").count() == 49
    assert TH.rising_themes(fl).count() == 0


def test_date_tie_at_slice_edge(spark):
    # 60 rows, all at the same minute: slice of 50, review_id decides
    rows = [(f"{i:03d}", 0, 3, "ok") for i in range(60)]
    got = sorted(r.review_id for r in R.recent_slice(reviews(spark, rows)).collect())
    assert got == [f"{i:03d}" for i in range(50)]


def test_threshold_refinement_matches_row_number(spark):
    # one hot app with bursts in a few minutes; force every refinement level
    rows = []
    for i in range(3000):
        rows.append(("hot", f"{i:05d}", T0 + dt.timedelta(seconds=(i * 7) % 900), 1 + i % 5, "crash", 0, "1"))
    for i in range(120):
        rows.append(("small", f"{i:05d}", T0 + dt.timedelta(hours=i), 3, "ok", 0, "1"))
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import Window
    w = Window.partitionBy("app_id").orderBy(F.col("date").desc(), "review_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("app_id"))
    expect = (df.withColumn("rn", F.row_number().over(w)).withColumn("n", n)
              .where(F.col("rn") <= F.greatest(F.lit(50), F.floor(F.col("n") * 0.2)))
              .select("app_id", "review_id").collect())
    for exact_rows in (1, 10, 1_000_000):
        got = R.recent_slice(df, exact_rows=exact_rows).select("app_id", "review_id").collect()
        assert sorted(got) == sorted(expect)


def test_null_thumbs_sort_last(spark):
    df = reviews(spark, [("1", 0, 5, "fast", None), ("2", 1, 5, "fast", 0), ("3", 2, 5, "fast", None)])
    got = TK_strength(spark, df)
    assert got == ["2", "3"]


def TK_strength(spark, df):
    from reviewlens.operators import topk as TK
    return [r.review_id for r in TK.strength_samples(df).orderBy("rank").collect()]


def test_sentiment_label_uses_unrounded_score(spark):
    df = spark.createDataFrame([(0.0496,), (0.05,), (-0.0501,), (-0.0496,)], "c double")
    got = df.select(F.bround("c", 3).alias("s"), S.label_expr(F.col("c")).alias("l")).collect()
    assert [(r.s, r.l) for r in got] == [(0.05, "Neutral"), (0.05, "Positive"), (-0.05, "Negative"), (-0.05, "Neutral")]


def test_sentiment_rules(spark):
    df = spark.createDataFrame([("good",), ("not good",), ("very good",), ("good but bad",), ("",)], "review_text string")
    s = {r.review_text: r._compound for r in S.with_compound(df).collect()}
    assert s["good"] > 0 and s["not good"] < 0 and s["very good"] > s["good"]
    assert s["good but bad"] < 0 and s[""] == 0.0
    assert abs(s["good"] - 1.9 / (1.9 ** 2 + 15) ** 0.5) < 1e-12


def test_pct_tie_rounds_half_even(spark):
    df = spark.createDataFrame([(49, 400), (1, 8), (3, 8)], "c long, t long")
    got = [r.p for r in df.select(T.pct("c", "t").alias("p")).collect()]
    assert got == [round(100 * 49 / 400, 1), round(100 * 1 / 8, 1), round(100 * 3 / 8, 1)]


def test_days_ago_and_spike_text(spark):
    # oldest recent mention 23h59m before the newest review -> 0 days
    rows = [(f"{i:03d}", 0, 1, "crash") for i in range(10)] + [("zzz", 23 * 60 + 59, 1, "crash")]
    fl = R.flag_recent(E.enrich(reviews(spark, rows), sentiment=False), by=())
    cards = RP.signal_cards(fl, by=(), min_change_pp=-100, min_recent_mentions=1).collect()
    assert len(cards) == 1 and cards[0].days_ago == 0 and cards[0].days_text == "Recently spiking"
    assert cards[0].star_text == "Mostly 1-star" and cards[0].kind == "critical"


def test_span_labels(spark):
    info = spark.createDataFrame([], "app_id string, title string, store_rating double, total_ratings bigint, genre string, summary string")
    for span, expect in [(0, "01 Jan 2024"), (60, "01 Jan–01 Mar 2024"), (61, "Jan 2024–Mar 2024")]:
        df = reviews(spark, [("1", 0, 3, "x"), ("2", span * 24 * 60, 3, "y")])
        h = IN.app_header(df, info).first()
        assert h.date_range == expect and h.title == "a" and h.summary == ""


def test_truncate(spark):
    df = spark.createDataFrame([("x" * 110,), ("x" * 111,), ("😀" * 111,)], "s string")
    got = [r.t for r in df.select(T.truncate("s", 110).alias("t")).collect()]
    assert got == ["x" * 110, "x" * 110 + "…", "😀" * 110 + "…"]


def test_search(spark):
    df = reviews(spark, [("1", 0, 3, "abc"), ("2", 1, 3, "aXc"), ("3", 2, 3, "ABD")])
    assert FL.search_reviews(df, "a.c").count() == 2
    assert FL.search_reviews(df, "   ").count() == 3
    assert FL.search_reviews(df, "a.c", literal=True).count() == 0
    with pytest.raises(ValueError):
        FL.search_reviews(df, "(")


def test_urls(spark):
    cases = [
        ("https://store.example.com/details?id=com.a.b&hl=en_IN", "com.a.b", "in"),
        ("com.a.b", "com.a.b", None),
        ("store.example.com/details?id=com%2Ea", "com.a", None),
        ("https://x.com/details?id=&id=z", "z", None),
        ("https://x.com/details?x=1", None, None),
        ("  https://x.com/d?hl=EN_GB&id=q  ", "q", "gb"),
        ("com.a.b?id=z", "com.a.b?id=z", None),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "url string")
    got = df.select(T.package_id("url").alias("p"), T.country_hint("url", tx.HL_TO_COUNTRY).alias("c")).collect()
    assert [(r.p, r.c) for r in got] == [(c[1], c[2]) for c in cases]


def test_csv_bytes_match_pandas(spark, tmp_path):
    rows = [("a", "1", T0, 5, 'say "hi"\nnext', 0, "1.0", 0.5, "Positive", ["Too many ads", "App crashing"]),
            ("a", "2", T0, 1, "", 0, "1.0", 0.0, "Neutral", [])]
    schema = SCHEMA + ", sentiment_score double, sentiment_label string, complaint_categories array<string>"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    X.write_csv(RP.export_rows(df).drop("app_id"), str(tmp_path / "out"))
    got = open(glob.glob(str(tmp_path / "out" / "*.csv"))[0], encoding="utf-8").read()
    pdf = pd.DataFrame({"date": ["2024-01-01"] * 2, "rating": [5, 1], "sentiment_label": ["Positive", "Neutral"],
                        "complaint_categories": ["Too many ads, App crashing", ""], "review_text": ['say "hi"\nnext', ""]})
    assert got == pdf.to_csv(index=False)


def test_empty_input_keeps_schema(spark):
    df = E.enrich(spark.createDataFrame([], SCHEMA))
    fl = R.flag_recent(df)
    for out in (TH.theme_summary(df), TH.key_signals(fl), RP.signal_cards(fl), RP.theme_library(fl),
                RP.sentiment_corpus(df), TH.praised_strengths(df), TH.mixed_areas(df)):
        assert out.count() == 0 and len(out.columns) > 0


def test_word_match_mode(spark):
    df = spark.createDataFrame([("good coffee",), ("the fee is high",), ("no lag",), ("a flag",), ("crash!",)],
                               "review_text string")
    got = [r.t for r in df.select(tag_expr("review_text", tx.COMPLAINT_GROUPS, match="word").alias("t")).collect()]
    assert got == [[], ["Subscription / Payment"], ["Slow / Loading issues"], [], ["App crashing"]]


def test_streamed_facts_hold_open_windows(spark, tmp_path):
    """Two runs over files that land one after the other; the facts equal the batch tags, newest day included."""
    from reviewlens.operators.tagging import tag_complaints
    from reviewlens.sources import fixture as FXm
    from reviewlens.streaming import themes as ST
    landing, out, ckpt = (str(tmp_path / x) for x in ("landing", "facts", "ckpt"))
    raw = FXm.raw_reviews(spark, "/root/testdata/sf0.001").orderBy("at")
    for part in (raw.limit(600), raw.exceptAll(raw.limit(600))):
        part.write.mode("append").parquet(landing)
        ST.run_available_now(spark, landing, out, ckpt)
    tagged = tag_complaints(IN.normalise_reviews(raw))
    want = tagged.select("app_id", F.explode("complaint_categories").alias("theme")).groupBy("app_id", "theme").count()
    got = ST.read_facts(spark, out).groupBy("app_id", "theme").agg(F.sum("mentions").alias("count"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streamed_facts_hold_late_reviews_once(spark, tmp_path):
    """A backfill that lands after newer days counts in full, and a file that lands again adds nothing."""
    from reviewlens.operators.tagging import tag_complaints
    from reviewlens.sources import fixture as FXm
    from reviewlens.streaming import themes as ST
    landing, out, ckpt = (str(tmp_path / x) for x in ("landing", "facts", "ckpt"))
    raw = FXm.raw_reviews(spark, "/root/testdata/sf0.001").orderBy("at")
    old = raw.limit(300)
    for part in (raw.exceptAll(old), old, raw):  # the newest first
        part.write.mode("append").parquet(landing)
        ST.run_available_now(spark, landing, out, ckpt)
    tagged = tag_complaints(IN.normalise_reviews(raw))
    want = tagged.select("app_id", F.explode("complaint_categories").alias("theme")).groupBy("app_id", "theme").count()
    got = ST.read_facts(spark, out).groupBy("app_id", "theme").agg(F.sum("mentions").alias("count"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("zone", ["America/New_York", "UTC"])
def test_dirty_ingest_never_raises(spark, zone):
    """Every bad value lands in the quarantine with a reason; good times are UTC in any session zone."""
    from pyspark.sql import functions as Fn
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [("a", "1", "2024-01-01T00:00:00Z", "5", "t", 3_000_000_000), ("a", "2", "2024-03-10 02:30:00", "4.0", "t", 1),
                ("a", "3", "2024-11-03T01:30:00-04:00", "3", "t", None), ("a", "4", "2024-02-01", "2", "t", 0),
                ("a", "5", "2024-01-01 00:00:00", "NaN", "t", 0), ("a", "6", "2024-01-01 00:00:00", "1e10", "t", 0),
                ("a", "7", "2024-01-01 00:00:00", "Infinity", "t", 0), ("a", "8", "never", "5", "t", 0), (None, "9", "2024-01-01 00:00:00", "5", "t", 0)]
        df = spark.createDataFrame(rows, "app_id string, reviewId string, at string, score string, content string, thumbsUpCount long")
        good = IN.normalise_reviews(df).select("review_id", Fn.substring(Fn.col("date").cast("string"), 1, 16), "rating", "thumbs_up").orderBy("review_id").collect()
        assert [tuple(r) for r in good] == [("1", "2024-01-01 00:00", 5, None), ("2", "2024-03-10 02:30", 4, 1),
                                            ("3", "2024-11-03 05:30", 3, None), ("4", "2024-02-01 00:00", 2, 0)]
        bad = {r.review_id: r.reason for r in IN.quarantine_reviews(df).collect()}
        assert bad == {"5": "rating_missing_or_not_numeric", "6": "rating_missing_or_not_numeric", "7": "rating_missing_or_not_numeric",
                       "8": "timestamp_unparsable", "9": "app_id_missing"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_malformed_records_are_kept(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.json").write_text('{"app_id": "a", "reviewId": "1", "at": "2024-01-01 00:00:00", "score": "5", "content": "x"}\n{broken\n')
    df = IN.read_raw(spark, str(tmp_path / "l"))
    assert IN.normalise_reviews(df).count() == 1
    assert [(r.reason, r._corrupt_record) for r in IN.quarantine_reviews(df).collect()] == [("record_malformed", "{broken")]


@pytest.mark.parametrize("exact", [1, 10**6])
def test_newest_n_is_exact_with_nulls_and_ties(spark, exact):
    import datetime as dtm
    day = dtm.datetime(2024, 1, 1)
    rows = [("a", None, day, i % 2) for i in range(5)] + [("b", "same", day, 1) for _ in range(5)] + [(None, str(i), day, 1) for i in range(3)]
    rows += [("c", f"r{i}", day + dtm.timedelta(seconds=i), 1) for i in range(7)] + [("d", "x", day, 1)]
    df = spark.createDataFrame(rows, "app_id string, review_id string, date timestamp_ntz, rating int")
    for n in (1, 2, 10):
        got = R.newest_n(df, n, exact_rows=exact).groupBy("app_id").count().collect()
        assert {r.app_id: r["count"] for r in got} == {"a": min(n, 5), "b": min(n, 5), None: min(n, 3), "c": min(n, 7), "d": 1}
    newest = R.newest_n(df.where("app_id = 'c'"), 2, exact_rows=exact).collect()
    assert {r.review_id for r in newest} == {"r6", "r5"}


def test_search_folds_all_letters_and_checks_with_the_engine(spark):
    df = spark.createDataFrame([("CAFÉ noir",), ("tea",), (None,)], "review_text string")
    assert FL.search_reviews(df, "café").count() == 1
    with pytest.raises(ValueError):
        FL.search_reviews(df, "(?P<n>x)")


def test_url_values_survive(spark):
    long = "v" * 1_100_000
    df = spark.createDataFrame([("http://s/d?id=100%",), ("http://s/d?id=a%zz",), ("http://s/d?%69d=abc",), ("http://s/d?id=" + long,), ("http://s/d?id=&id=b%2Ec",)], "u string")
    from reviewlens.functions.text import query_param
    assert [r[0] for r in df.select(query_param("u", "id")).collect()] == ["100%", "a%zz", "abc", long, "b.c"]


def test_read_raw_json_landing(spark, tmp_path):
    from reviewlens.sources import fixture as FXm
    raw = FXm.raw_reviews(spark, "/root/testdata/sf0.001")
    landing = str(tmp_path / "landing")
    raw.withColumn("at", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).write.json(landing)
    via_json = IN.normalise_reviews(IN.read_raw(spark, landing, "json"))
    direct = IN.normalise_reviews(raw)
    cols = ["app_id", "review_id", "date", "rating", "review_text", "thumbs_up", "app_version"]
    assert sorted(tuple(r) for r in via_json.select(cols).collect()) == sorted(tuple(r) for r in direct.select(cols).collect())
