"""Properties that must hold whatever the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlens.operators import recent as R
from reviewlens.operators import themes as TH
from reviewlens.operators.tagging import tag_by_table
from reviewlens.plans import enrich as E
from reviewlens.plans import registry as REG
from reviewlens.sources import fixture as FX

from .conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_per_app_union_equals_multi_app(spark):
    en = E.enriched(spark, SF_SMALL)
    multi = TH.key_signals(R.flag_recent(en), min_change_pp=-100, min_recent_mentions=1)
    apps = [r.app_id for r in en.select("app_id").distinct().collect()]
    per = None
    for a in apps:
        one = en.where(F.col("app_id") == a)
        ks = TH.key_signals(R.flag_recent(one, by=()), by=(), min_change_pp=-100, min_recent_mentions=1,
                            as_of=en.agg(F.max("date")).first()[0]).withColumn("app_id", F.lit(a))
        per = ks if per is None else per.unionByName(ks)
    assert _rows(multi.select(*sorted(multi.columns))) == _rows(per.select(*sorted(multi.columns)))


def test_recent_is_subset_and_sized(spark):
    rv = E.reviews(spark, SF_SMALL)
    fl = R.flag_recent(rv)
    got = {r.app_id: (r.n, r.k) for r in fl.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_recent").alias("k")).collect()}
    for n, k in got.values():
        assert k == min(n, max(50, int(n * 0.2)))


def test_rising_single_pass_equals_outer_join(spark):
    fl = R.flag_recent(E.enriched(spark, SF_SMALL))
    single = TH.rising_themes(fl)
    overall = TH.theme_summary(fl).select("app_id", "theme", F.col("pct_of_reviews").alias("overall_pct"))
    recent = TH.theme_summary(fl.where("is_recent")).select("app_id", "theme", F.col("pct_of_reviews").alias("recent_pct"))
    j = overall.join(recent, ["app_id", "theme"], "full").fillna(0.0, ["overall_pct", "recent_pct"])
    outer = j.withColumn("change", F.bround(F.col("recent_pct") - F.col("overall_pct"), 1)).where("change > 0")
    cols = ["app_id", "theme", "overall_pct", "recent_pct", "change"]
    assert _rows(single.select(cols)) == _rows(outer.select(cols))


def test_theme_mentions_equal_exploded_count(spark):
    en = E.enriched(spark, SF_SMALL)
    s = {(r.app_id, r.theme): r.mentions for r in TH.theme_summary(en).collect()}
    e = {(r.app_id, r.theme): r["count"] for r in en.select("app_id", F.explode("complaint_categories").alias("theme"))
         .groupBy("app_id", "theme").count().collect()}
    assert s == e


def test_tag_by_table_equals_substring_search(spark):
    """Every keyword length, null ids, repeated rows, a long text; no nested loop in the plan."""
    rows = [(1, "The cat sat on the mat."), (None, "a CAT, null id"), (None, None), (2, ""), (3, "x"), (4, "xy " * 60_000 + "needle"),
            (1, "The cat sat on the mat."), (5, "ÄÖ straße 🙂🙂")]
    words = [("pets", 0, "cat"), ("pets", 0, "dog"), ("short", 1, "x"), ("short", 1, "at"), ("long", 2, "needle"), ("long", 2, "on the mat"),
             ("odd", 3, "🙂🙂"), ("odd", 3, "Straße"), ("none", 4, "zzz"), ("none", 4, "")]
    doc = spark.createDataFrame(rows, "doc_id long, text string")
    kw = spark.createDataFrame(words, "group string, ordinal int, keyword string")
    out = tag_by_table(doc, kw, ["doc_id"], "text")
    want = {(i, g, o) for i, t in rows for g, o, k in words if t and k and k.lower() in t.lower()}
    got = out.collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert tag_by_table(doc, kw.limit(0), ["doc_id"], "text").count() == 0
