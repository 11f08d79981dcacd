"""Quotation linking: reply-ordered conversations without quotes.

Lines carry a quote level (leading > signs).  Level-0 lines are a message's
own text; quoted lines, and quoted blocks as a whole, are normalised and
hashed, and joined to the newest earlier message of the conversation whose own
lines (or whole text) have the hash.  The parent of a message is the one that
answers most characters of its quotes at the lowest level; without any, the
message before it.  Threads, levels and positions follow from the parents.

"Newest earlier message with this passage" and all positions are running
aggregates in two levels (buckets of ``BUCKET`` turns, then buckets), so a
line or a conversation that holds a third of all rows is neither joined with
itself nor ranked in one task.

Edge cases: null or empty texts have no own text and no quotes; a null conv_id
is a conversation of its own; rows that are equal in every column are one
message, all others are messages of their own, in the order of turn, role and a
hash of the text; rows without a turn have no place in a conversation and stand
alone (``unplaced``); an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm import common as C

BUCKET = 1024
#: Lines such as "On 3 May, Ann wrote:" above a quote.
ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|.*\bschrieb|.*\ba écrit|.*\bescribió)\s*:\s*$"
#: Pointer doubling ends when all threads are resolved; this many rounds cover 2**40 levels.
ROUNDS = 40


def _normal(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}]+", " "))


def _key() -> Column:
    """A message's place in its conversation, never null, so that it can be joined on."""
    return F.struct("turn", F.coalesce(F.concat(F.lit(" "), "role"), F.lit("")).alias("role"),
                    F.xxhash64(F.coalesce(F.concat(F.lit(" "), "text"), F.lit(""))).alias("hash"))


def _bucket() -> Column:
    """Rises with the key.  Rows without a conv_id may be many at one turn; they are told apart further."""
    none = F.col("conv") == F.lit(-1) - F.lit(2**62)
    return F.struct(F.when(none, F.col("key.turn")).otherwise(F.floor(F.col("key.turn") / BUCKET)).alias("turn"),
                    F.when(none, F.col("key.role")).otherwise("").alias("role"),
                    F.when(none, F.shiftright("key.hash", 56)).otherwise(F.lit(0).cast("long")).alias("hash"))


def _distinct(table: DataFrame) -> DataFrame:
    return table.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).distinct()


def messages(table: DataFrame) -> DataFrame:
    """conv (null-safe key), key (order in it), conv_id, turn, role, own (text without quotes), lines: one row per message."""
    return _parsed(_distinct(table).filter("turn IS NOT NULL"))


def _parsed(rows: DataFrame) -> DataFrame:
    marks = r"^((?:[ \t]*>)+)[ \t]?"
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, marks, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, marks, "").alias("body")))
    rows = rows.withColumn("lines", lines)
    own = F.filter("lines", lambda x: (x["level"] == 0) & ~x["body"].rlike(ATTRIBUTION))
    return rows.select(F.coalesce("conv_id", F.lit(-1) - F.lit(2**62)).alias("conv"), _key().alias("key"), "conv_id", "turn", "role", "lines",
                       F.trim(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), F.lit(" \t\n")).alias("own"))


def _passages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, h, key) of own passages and (conv, h, key, level, chars) of quoted ones, however short."""
    each = rows.select("conv", "key", F.explode("lines").alias("x")).select("conv", "key", "x.level", _normal(F.col("x.body")).alias("p"))
    whole = rows.select("conv", "key", F.lit(0).alias("level"), _normal(F.col("own")).alias("p"))
    levels = F.array_distinct(F.transform("lines", lambda x: x["level"]))
    blocks = (rows.select("conv", "key", "lines", F.explode(levels).alias("level")).filter("level > 0")
              .select("conv", "key", "level", _normal(F.array_join(F.transform(F.expr("filter(lines, x -> x.level = level)"), lambda x: x["body"]), " ")).alias("p")))
    every = each.unionByName(whole).unionByName(blocks).filter("p <> ''").select(
        "conv", F.xxhash64("p").alias("h"), "key", "level", F.length("p").cast("long").alias("chars"))
    return every.filter("level = 0").drop("level", "chars").distinct(), every.filter("level > 0").distinct()


def newest_before(given: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """``asked`` (keys, key, ...) with ``found``: the greatest smaller key in ``given`` (keys, key), or null."""
    extra = [c for c in asked.columns if c not in keys and c != "key"]
    kind = asked.schema["key"].dataType
    rows = (asked.withColumn("at", F.lit(None).cast(kind)).unionByName(
        given.select(*keys, "key", *[F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in extra], F.col("key").alias("at")))
        .withColumn("bucket", _bucket()))
    # of equal keys the asked ones come first, so the rows before hold smaller keys only
    inside = Window.partitionBy(*keys, "bucket").orderBy("key", F.col("at").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "bucket").agg(F.max("at").alias("m")).select(*keys, "bucket", F.max("m").over(across).alias("carried"))
    near = rows.withColumn("near", F.max("at").over(inside)).filter("at IS NULL")
    return near.join(carried, [*keys, "bucket"]).select(*asked.columns, F.coalesce("near", "carried").alias("found"))


def parents(rows: DataFrame) -> DataFrame:
    """conv, key, parent (key), n_linked: quotes first, else the message before."""
    own, quoted = _passages(rows)
    linked = newest_before(own, quoted, ["conv", "h"]).filter("found IS NOT NULL")
    votes = linked.groupBy("conv", "key", "found").agg(F.min("level").alias("level"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("conv", "key").agg(F.max(F.struct((-F.col("level")).alias("level"), "chars", "found")).alias("b"),
                                           F.sum("n").alias("n_linked")).select("conv", "key", F.col("b.found").alias("quoted"), "n_linked")
    places = rows.select("conv", "key")
    return (newest_before(places, places, ["conv"]).join(best, ["conv", "key"], "left")
            .select("conv", "key", F.coalesce("quoted", "found").alias("parent"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked")))


def threads(tree: DataFrame) -> DataFrame:
    """conv, key, root, level by pointer doubling."""
    now = C.write_table(tree.select("conv", "key", F.coalesce("parent", "key").alias("up"), F.col("parent").isNotNull().cast("long").alias("level")))
    for _ in range(ROUNDS):
        top = now.select("conv", F.col("key").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        new = C.write_table(now.join(top, ["conv", "up"]).select("conv", "key", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level")))
        left = new.join(now.select("conv", "key", F.col("up").alias("old")), ["conv", "key"]).filter("up <> old").limit(1).count()
        now = new
        if not left:
            break
    return now.withColumnRenamed("up", "root")


def _positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds position: how many messages of the thread come before, in two levels."""
    rows = rows.withColumn("bucket", _bucket())
    across = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n")).select(*keys, "bucket", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("head"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("key")
    return rows.join(heads, [*keys, "bucket"]).withColumn("position", (F.col("head") + F.row_number().over(inside) - 1).cast("long")).drop("bucket", "head")


def unplaced(table: DataFrame) -> DataFrame:
    """The messages without a turn, as ``link`` has them: each is a thread of its own."""
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    return _parsed(_distinct(table.filter("turn IS NULL"))).select(
        "conv_id", "turn", "role", none.alias("parent_turn"), none.alias("root_turn"), zero.alias("level"), zero.alias("position"),
        zero.alias("n_linked"), F.col("own").alias("text"))


def link(table: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent_turn, root_turn, level, position, n_linked, text (own words), one row per message with a turn.

    A conversation in reply order is its rows with one root_turn by position; a parent always comes before its replies."""
    rows = C.write_table(messages(table))
    tree = C.write_table(parents(rows))
    out = _positions(threads(tree), ["conv", "root"]).join(tree, ["conv", "key"]).join(rows, ["conv", "key"])
    return out.select("conv_id", "turn", "role", F.col("parent.turn").alias("parent_turn"), F.col("root.turn").alias("root_turn"), "level", "position",
                      "n_linked", F.col("own").alias("text"))
