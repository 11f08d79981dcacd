"""The stored table, its day counts, ordered output, late texts, one-pass cards, calendars, lexicons and replies."""

from __future__ import annotations

import csv
import glob
import io
import re
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import ordered
from reviewlens.operators import recent as R
from reviewlens.operators import sentiment as S
from reviewlens.operators import tagging as TG
from reviewlens.plans import enrich as E
from reviewlens.plans import insights as INS
from reviewlens.plans import registry as REG
from reviewlens.plans import reports as RP
from reviewlens.plans import store as ST
from reviewlens.plans import trends as TR
from reviewlens.sources import export as X
from reviewlens.sources import fixture as FX
from reviewlens.streaming import themes as STREAM

from .conftest import SF_SMALL

ROW = "app_id string, review_id string, date timestamp_ntz, rating int, review_text string, thumbs_up int, app_version string"
T0 = dt.datetime(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    rv = E.reviews(spark, SF_SMALL)
    late = F.col("date") >= F.lit("2024-01-20").cast("timestamp_ntz")
    for _ in range(2):  # a batch that lands again replaces itself
        ST.append(rv.where(late), path, "b", buckets=4, files=3, row_group_bytes=4096)
    ST.append(rv.where(~late), path, "a", buckets=4, files=3, row_group_bytes=4096)
    return ST.Stored(spark, path), path


# ── stored table ────────────────────────────────────────────────────────────
@pytest.mark.parametrize("name", sorted(REG.REPORTS))
def test_reports_read_the_store_like_the_landed_rows(spark, stored, name):
    report = REG.REPORTS[name]
    rows = lambda df: sorted(map(repr, df.collect()))
    got = report(stored[0])
    assert rows(got) == rows(report(ST.Reviews(E.reviews(spark, SF_SMALL))))
    p = plan(got)
    assert "contains(" not in p and "RLIKE" not in p and "Python" not in p  # nothing is matched again


def test_layout_buckets_and_sorted_files(stored):
    table, path = stored
    assert len(glob.glob(f"{path}/rows/batch=*/bucket=*")) > 4
    for f in glob.glob(f"{path}/rows/batch=*/bucket=*/*.parquet"):
        import pyarrow.parquet as pq
        t = pq.ParquetFile(f).read(columns=["app_id", "date", "review_id"]).to_pylist()
        assert [tuple(r.values()) for r in t] == sorted(tuple(r.values()) for r in t)
    one = table.of_app("com.example.app1")
    assert one.count() == table.plain.where("app_id = 'com.example.app1'").count() > 0
    assert re.search(r"PartitionFilters: \[.*bucket", plan(one))


def test_recent_slice_reads_the_boundary_day_on(spark, stored):
    p = plan(stored[0].recent())
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(date", p)


def test_an_unfinished_batch_is_not_read(spark, stored, tmp_path):
    rv = E.reviews(spark, SF_SMALL)
    ST.append(rv, str(tmp_path), "0", files=2)
    E.enrich_all(rv.limit(5).withColumn("bucket", F.lit(1))).write.partitionBy("bucket").parquet(f"{tmp_path}/rows/batch=1")
    assert ST.Stored(spark, str(tmp_path)).plain.count() == rv.count()


def test_day_counts_add_up(spark):
    rv = E.reviews(spark, SF_SMALL)
    parts = [rv.where(F.col("rating") == k) for k in range(1, 6)]
    merged = R.merge_day_counts(*map(R.day_counts, parts))
    assert sorted(merged.collect()) == sorted(R.day_counts(rv).collect())


@pytest.mark.parametrize("exact", [0, 3, 10**6])
def test_newest_n_hashes_only_tied_rows(spark, exact):
    """Ties in date and id, rows equal in all columns, null ids, dates, groups; any refinement depth."""
    rng = random.Random(exact)
    rows = [(rng.choice(["a", "a", None, ""]), rng.choice([None, "", "x", "y"]), rng.choice([None, T0, T0 + dt.timedelta(hours=3), T0 + dt.timedelta(days=1)]),
             rng.randrange(1, 4), rng.choice(["p", "q"]), None, None) for _ in range(200)]
    df = spark.createDataFrame(rows, ROW).repartition(3)
    for n in (0, 1, 7, 40, 500):
        got = R.newest_n(df, n, exact_rows=exact).collect()
        for app in ("a", None, ""):
            mine = sorted((r for r in rows if r[0] == app and r[2]), key=lambda r: (-r[2].timestamp(), r[1] or ""))
            kept = [tuple(r) for r in got if r.app_id == app]
            assert len(kept) == min(n, len(mine))
            place = lambda rs: sorted((-r[2].timestamp(), r[1] or "") for r in rs)
            assert place(kept) == place(mine[:n])
    assert "to_json" not in plan(R.newest_n(E.reviews(spark, SF_SMALL), 10))


# ── ordered output ──────────────────────────────────────────────────────────
def test_newest_rank_equals_a_window(spark):
    rows = [(f"a{i % 3}" if i % 7 else None, f"{i % 40:03d}", T0 + dt.timedelta(minutes=37 * (i % 90)) if i % 11 else None, 1, "t", None, None) for i in range(300)]
    df = spark.createDataFrame(rows, ROW).repartition(4)
    want = {}
    for app in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == app), key=lambda r: (r[2] is None, -(r[2] or T0).timestamp(), r[1]))
        want[app] = [(i + 1, r[2], r[1]) for i, r in enumerate(mine)]
    got = {}
    for r in ordered.newest_rank(df).orderBy("rank").collect():
        got.setdefault(r.app_id, []).append((r["rank"], r.date, r.review_id))
    assert got == want


def test_csv_files_are_in_order(spark, stored, tmp_path):
    """Parts of an app, one after the other: the bytes of one newest-first file."""
    X.export_all(stored[0].scored(), str(tmp_path / "all"), files=5)
    want = {}
    for r in RP.export_list(stored[0].scored()).orderBy("app_id", "rank").collect():
        want.setdefault(r.app_id, []).append(r)
    assert len(glob.glob(f"{tmp_path}/all/*/part-*")) > len(want)
    for app, rows in want.items():
        text = io.StringIO()
        out = csv.writer(text, lineterminator="\n")
        out.writerows([r.date, r.rating, r.sentiment_label, r.complaint_categories, r.review_text] for r in rows)
        parts = [open(f, encoding="utf-8", newline="").read().split("\n", 1)[1] for f in sorted(glob.glob(f"{tmp_path}/all/app_id={app}/part-*"))]
        assert "".join(parts) == text.getvalue()


# ── plans ───────────────────────────────────────────────────────────────────
@pytest.mark.parametrize("name", ["opportunity_cards", "strength_cards"])
def test_cards_take_one_scan(spark, stored, name):
    assert len(re.findall("FileScan|Scan parquet", plan(REG.REPORTS[name](stored[0])))) == 1


def test_coverage_and_comparison_take_one_scan(spark, stored):
    flagged = stored[0].plain.withColumn("is_recent", F.col("rating") < 3)
    for df in (RP.signal_coverage(flagged), TR.compare_apps(stored[0].enriched(), *REG.COMPARE)):
        assert len(re.findall("FileScan|Scan parquet", plan(df))) == 1


@pytest.mark.parametrize("name", ["review_cards", "sentiment_corpus"])
def test_texts_join_after_the_ranking(spark, stored, name, monkeypatch):
    from reviewlens.operators import topk
    ranked = []
    real = topk.write_table
    monkeypatch.setattr(topk, "write_table", lambda df: ranked.append(df) or real(df))
    REG.REPORTS[name](stored[0]).collect()
    (narrow,) = ranked
    assert "review_text" not in narrow.columns
    for node in re.findall(r"(?:Exchange|Sort|Window)[^\n]*", plan(narrow)):
        assert "review_text" not in node


# ── table-driven tags ───────────────────────────────────────────────────────
@pytest.mark.parametrize("in_row, heavy", [(2_000, 10**6), (0, 10**6), (0, 7)])
def test_tag_by_table_with_a_trigram_in_every_text(spark, in_row, heavy):
    rng = random.Random(2)
    texts = [(i % 90 if i % 13 else None, " ".join(["the"] + [rng.choice(["theme", "Other", "ab", "x", "crashes", "é", ""]) for _ in range(rng.randrange(6))]))
             for i in range(200)] + [(500, None), (501, "")]
    kws = [("g", 0, "the"), ("g", 0, "theme"), ("h", 1, "ab"), ("h", 1, "CRASH"), ("i", 2, "é"), ("i", 2, ""), ("j", 3, None), ("k", 4, "nowhere")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    kw = spark.createDataFrame(kws, "group string, ordinal int, keyword string")
    got = {tuple(r) for r in TG.tag_by_table(df, kw, ["doc_id"], "text", in_row, heavy).collect()}
    assert got == {(i, g, o) for i, t in texts for g, o, k in kws if k and t and k.lower() in t.lower()}


def test_heavy_trigrams_are_split(spark, monkeypatch):
    """A trigram of all texts: no salt holds over three times the median."""
    seen = []
    real = TG._by_salted_grams
    monkeypatch.setattr(TG, "_by_salted_grams", lambda t, o, c, h: seen.append((t, c, h)) or real(t, o, c, h))
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the number "), F.col("id")).alias("text"))
    kw = spark.createDataFrame([("g", 0, "the")], "group string, ordinal int, keyword string")
    assert TG.tag_by_table(df, kw, ["doc_id"], "text", in_row=0, heavy_texts=100).count() == 2000
    texts, chosen, heavy = seen[0]
    salts = -(-chosen.first()["_n"] // heavy)
    assert salts == 20
    sizes = sorted(r["count"] for r in texts.groupBy(F.pmod(F.xxhash64("_row"), F.lit(salts))).count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]


# ── sentiment ───────────────────────────────────────────────────────────────
def compound(text, lexicon):
    raw = [t for t in re.split(r"[^A-Za-z']+", text or "") if t]
    words, up = [t.lower() for t in raw], [t == t.upper() and t != t.lower() for t in raw]
    stress = any(up) and not all(up)
    but = words.index("but") if "but" in words else None
    total = 0.0
    for i, w in enumerate(words):
        v = lexicon.get(w, 0.0)
        if v:
            sign = 1 if v > 0 else -1
            v += sign * 0.733 * (stress and up[i])
            prev = words[i - 1] if i else ""
            v += sign * 0.293 * ((prev in S.BOOSTERS_UP) - (prev in S.BOOSTERS_DOWN))
            if any(p in S.NEGATORS for p in words[max(0, i - 3):i]):
                v *= -0.74
            if but is not None and i != but:
                v *= 0.5 if i < but else 1.5
        total += v
    asked = (text or "").count("?")
    extra = min((text or "").count("!"), 4) * 0.292 + (0 if asked <= 1 else 0.18 * asked if asked <= 3 else 0.96)
    total += (total > 0) * extra - (total < 0) * extra
    return total / (total * total + 15) ** 0.5


@pytest.mark.parametrize("literal", [10**6, 0])
@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_scores_by_a_lexicon_table(spark, monkeypatch, literal, broadcast):
    monkeypatch.setattr(S, "LITERAL_WORDS", literal)
    monkeypatch.setattr(S, "BROADCAST_WORDS", broadcast)
    rng = random.Random(4)
    words = ["good", "GOOD", "Bad", "BAD", "not", "very", "slightly", "but", "x", "I", "don't", "hate", "fine!", "why?", "??", "!!!"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(150)] + [None, "", "GOOD", "GOOD BAD", "good " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)) * 2, "id long, text string").repartition(3)
    table = spark.createDataFrame([*S.LEXICON.items(), ("GOOD", 1.0), (None, 1.0), ("x", None)], "token string, valence double")
    for lexicon in (table, None):
        got = S.with_compound(df, "text", lexicon)
        assert got.columns == ["id", "text", "_compound"]
        for r in got.collect():
            assert r["_compound"] == pytest.approx(compound(r.text, S.LEXICON), abs=1e-9)
    assert got.count() == 2 * len(texts)


# ── calendar ────────────────────────────────────────────────────────────────
@pytest.mark.parametrize("unit", ["day", "week", "month"])
def test_calendar_has_every_period(spark, unit):
    days = [0, 1, 40, 41, 200]
    df = spark.createDataFrame([("a", T0 + dt.timedelta(days=d), 3, 0.5, "Positive") for d in days] + [("b", T0, 1, -0.5, "Negative"), ("c", None, 1, 0.0, "Neutral")],
                               "app_id string, date timestamp_ntz, rating int, sentiment_score double, sentiment_label string")
    got = {(r.app_id, r.period): r for r in TR.sentiment_trend(df, unit=unit, fill=True).collect()}
    at = lambda d: {"day": d, "week": d - dt.timedelta(days=d.weekday()), "month": d.replace(day=1)}[unit].date().isoformat()
    assert set(got) == {("a", at(T0 + dt.timedelta(days=d))) for d in range(201)} | {("b", at(T0))}
    counts = {}
    for d in days:
        counts[at(T0 + dt.timedelta(days=d))] = counts.get(at(T0 + dt.timedelta(days=d)), 0) + 1
    for (app, period), r in got.items():
        n = counts.get(period, 0) if app == "a" else 1
        assert r.reviews == n and (r.avg_sentiment is None) == (n == 0) and (r.n_positive, r.n_negative) == ((n, 0) if app == "a" else (0, 1))


# ── replies ─────────────────────────────────────────────────────────────────
def test_replies_of_any_shape(spark):
    cases = [
        ('{"top_complaints":["a"],"loved_features":["b","c"]}', "json", "a", "b; c"),
        ('```json\n{"top_complaints":["a"]}\n```', "salvaged", "a", ""),
        ('{}', "json", "", ""),
        ('{"top_complaints":null,"loved_features":"x"}', "json", "", "x"),
        ('{"top_complaints":[1,null,{"b":1,"a":"q"},["z"],true],"loved_features":{"k":2}}', "json", '1; {"a":"q","b":1}; ["z"]; true', '{"k":2}'),
        ('[{"top_complaints":["a"]}]', "error", None, None),
        ('"text"', "error", None, None), ("3", "error", None, None), ("null", "error", None, None),
        ('{"top_complaints":["a"', "error", None, None), ("{nope}", "error", None, None), ("", "error", None, None), (None, "error", None, None),
        ('first {"top_complaints":[]} then {"x":1}', "error", None, None),
    ]
    df = spark.createDataFrame([(f"app.{'xyz'[i % 3]}", r, i) for i, (r, *_) in enumerate(cases)], "app_id string, raw string, k int")
    got = {r.k: r for r in INS.parse_insights(df).collect()}
    for i, (_, status, top, loved) in enumerate(cases):
        assert (got[i].status, got[i].top_complaints, got[i].loved_features) == (status, top, loved), cases[i]
    assert {r.status for r in INS.parse_insights(FX.landed_replies(spark, SF_SMALL)).collect()} == {"json", "salvaged", "error"}


# ── streaming state ─────────────────────────────────────────────────────────
def test_a_batch_looks_up_its_own_keys_only(spark, tmp_path):
    """Two batches: the second one reads its rows and updates its new keys, not the history."""
    landing, out, ckpt = (str(tmp_path / x) for x in ("landing", "out", "ckpt"))
    raw = FX.raw_reviews(spark, SF_SMALL).withColumn("reviewId", F.when(F.col("reviewId") != "000000000001", F.col("reviewId"))).cache()
    first = raw.where(F.col("at") < F.lit("2024-01-28").cast("timestamp_ntz"))
    first.write.parquet(landing)
    STREAM.run_available_now(spark, landing, out, ckpt)
    again = first.limit(20).unionByName(raw.where(F.col("at") >= F.lit("2024-01-28").cast("timestamp_ntz"))).cache()
    again.write.mode("append").parquet(landing)
    q = STREAM.run_available_now(spark, landing, out, ckpt)
    done = [p for p in q.recentProgress if p["numInputRows"]]
    assert sum(p["numInputRows"] for p in done) <= 2 * again.count()  # the branches with and without an id each read the new files
    state = [s for p in done for s in p["stateOperators"]]
    new = STREAM.stream_reviews(raw).where("review_id is not null").select(*STREAM.KEY).distinct().count()
    old = STREAM.stream_reviews(first).where("review_id is not null").select(*STREAM.KEY).distinct().count()
    assert sum(s["numRowsUpdated"] for s in state) == new - old and state[-1]["numRowsTotal"] == new
    want = STREAM.windowed_theme_counts(STREAM.stream_reviews(raw))
    assert sorted(STREAM.read_facts(spark, out).collect()) == sorted(want.collect())
    assert not glob.glob(out + "_seen")
