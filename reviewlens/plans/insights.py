"""Narrative-insight data on both sides of the (external) LLM call.

Before the call: ``sentiment_corpus`` (reports.py) builds the bounded prompt
material.  After it: ``parse_insights`` turns a table of landed raw replies into
the two lists, with the same salvage rule as the reference: parse as JSON;
failing that, take the greedy ``{...}`` span (dot matches newline) and parse that;
missing keys give empty lists.  Replies are parsed once into VARIANT, so keys may
hold anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("top_complaints", "loved_features")


def _items(reply: Column, key: str) -> Column:
    """What a key holds as an array of texts: strings as they are, other elements as JSON, nulls left
    out; a value that is no array is the only element; a missing key or null is the empty list."""
    value = F.try_variant_get(reply, f"$.{key}", "variant")
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    elements = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).when(kind != "VOID", F.array(value))
    text = lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")).otherwise(F.to_json(e))
    present = F.filter(elements, lambda e: F.coalesce(F.schema_of_variant(e) != "VOID", F.lit(False)))
    return F.coalesce(F.transform(present, text), F.array().cast("array<string>"))


def _json(text: Column) -> Column:
    """The one JSON value that a text is, else null.  Spark's parser stops after the first value, so the text is
    parsed as the only element of a list and as a member of an object: nothing but that value fits both."""
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    alone = (F.size(F.try_variant_get(boxed, "$", "array<variant>")) == 1) & F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    return F.when(alone, F.try_variant_get(boxed, "$[0]", "variant"))


def parse_insights(replies: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Every reply with its status (json, salvaged, error), the two lists and their sizes.

    A reply is an error (lists null) if it is null, no JSON and without a span
    that is, or JSON other than an object; so is one that repeats a key.  Nothing raises.
    """
    d = replies.withColumn("_whole", _json(F.col(raw_col)))
    span = F.nullif(F.regexp_extract(F.col(raw_col), r"(?s)\{.*\}", 0), F.lit(""))
    d = d.withColumn("_reply", F.coalesce("_whole", _json(span)))
    ok = F.coalesce(F.schema_of_variant("_reply").startswith("OBJECT"), F.lit(False))
    status = F.when(~ok, "error").when(F.col("_whole").isNotNull(), "json").otherwise("salvaged")
    d = d.select(*[c for c in replies.columns if c != raw_col], status.alias("status"),
                 *[F.when(ok, _items(F.col("_reply"), k)).alias(f"_{k}") for k in KEYS])
    top, loved = (F.col(f"_{k}") for k in KEYS)
    return d.select(
        *[c for c in replies.columns if c != raw_col], "status",
        F.size(top).cast("bigint").alias("n_top"),
        F.size(loved).cast("bigint").alias("n_loved"),
        F.array_join(top, "; ").alias("top_complaints"),
        F.array_join(loved, "; ").alias("loved_features"),
    )
