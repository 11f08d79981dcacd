"""Physical-plan properties: no Python in the hot path, no cartesian
products, pushed filters, per-task top-k limits."""

from __future__ import annotations

import pytest

from reviewlens.operators import filters as FL
from reviewlens.operators import topk as TK
from reviewlens.plans import enrich as E
from reviewlens.plans import registry as REG

from .conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["theme_summary", "key_signals", "signal_cards", "theme_library", "sentiment",
                                  "sentiment_corpus", "product_opportunities", "explorer", "package_id", "tag_by_table",
                                  "investigate", "review_cards", "recent_slice_ties", "ingest_dirty", "quarantine_dirty"])
def test_no_python_or_cartesian(spark, name):
    p = plan(REG.QUERIES[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in p, (name, bad)


def test_rating_filter_reaches_scan(spark, tmp_path):
    en = E.enriched(spark, SF_SMALL)
    path = str(tmp_path / "enriched")
    en.write.parquet(path)
    df = FL.filter_rating_bucket(spark.read.parquet(path), "Negative").select("review_id")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(rating" in p or "PushedFilters: [IsNotNull(rating), In(rating" in p
    assert "ReadSchema: struct<review_id:string,rating:int>" in p


def test_topk_uses_window_group_limit(spark):
    p = plan(TK.theme_samples(E.enriched(spark, SF_SMALL)))
    assert "WindowGroupLimit" in p


@pytest.mark.parametrize("name", ["investigate", "sentiment_topk"])
def test_large_topk_is_salted(spark, name, monkeypatch):
    """In the query's plan, or in that of the winners it stores."""
    plans = []
    real = TK.write_table
    monkeypatch.setattr(TK, "write_table", lambda df: plans.append(plan(df)) or real(df))
    plans.append(plan(REG.QUERIES[name](spark, SF_SMALL)))
    assert "_salt" in "".join(plans)


def test_building_a_query_writes_no_reviews(spark, monkeypatch):
    """What a query stores while it is built is per group or theme, never the reviews."""
    from reviewlens.operators import recent, themes
    seen = []
    for module in (recent, themes):
        real = module.write_table
        monkeypatch.setattr(module, "write_table", lambda df, *a, real=real: seen.append(df.columns) or real(df, *a))
    for name in ("rising_themes", "key_signals", "signal_cards", "theme_library", "signal_coverage", "sentiment_topk", "export_all", "review_table"):
        REG.QUERIES[name](spark, SF_SMALL)
    assert seen and not any("review_text" in c or "review_id" in c for c in seen)


def test_tag_expression_not_duplicated_by_explode(spark):
    df = TK.explode_tags(E.enriched(spark, SF_SMALL).select("complaint_categories"),
                         __import__("pyspark.sql.functions", fromlist=["col"]).col("complaint_categories"))
    opt = df._jdf.queryExecution().optimizedPlan().toString()
    # one tag expression: 'keeps crashing' is pruned, 'crash' appears once per evaluation
    assert opt.count("crash)") == 1


def test_a_derived_text_is_computed_once_per_tagging(spark):
    """Filters on tags are pushed into the scan's projection: keywords must not each bring a copy of the text's expression."""
    from pyspark.sql import functions as F

    from reviewlens.functions.text import strip_ws
    from reviewlens.operators import filters as FL
    from reviewlens.operators.tagging import tag_complaints

    raw = spark.createDataFrame([(1, " It CRASHES "), (2, None), (3, "fine"), (4, " cannot login ")], "id int, t string")
    texts = raw.select("id", strip_ws(F.initcap(F.concat(F.coalesce("t", F.lit("")), F.lit(" ")))).alias("review_text"))
    out = FL.filter_theme_chips(tag_complaints(texts.where("review_text != ''")), ["Crash", "Login"])
    assert sorted((r["id"], r["review_text"].lower()) for r in out.collect()) == [(1, "it crashes"), (4, "cannot login")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("initcap(") <= 3
