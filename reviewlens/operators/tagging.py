"""Keyword tagging (multi-label, substring semantics).

Default form: the taxonomy is compiled into one SQL expression —
``array_compact(array(CASE WHEN contains(t, k1) OR ... THEN group END, ...))``
— so tagging is a per-row projection with no join and no shuffle.  Keywords
that contain another keyword of the same group are pruned first (identical
results, fewer ``contains``).  Single flags (request language) compile to one
literal-quoted regex alternation, which keeps filters small enough for
whole-stage codegen.

Stored form (``tags_of``, ``requests_of``): a table that already carries the
tag columns (``plans.store``) is read as it is, and nothing is matched again.

Table form (``tag_by_table``): for large, data-driven taxonomies, an exact
equi-join on each keyword's rarest trigram at every size; frequent trigrams
are split over salts, so no task gets all texts that share one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import taxonomy as tx
from reviewlens.functions.text import text_key
from reviewlens.session import write_table


def sql_str(s: str) -> str:
    """A Spark SQL string literal (backslash-escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _text_sql(text: str) -> str:
    return f"lower(coalesce(`{text}`, ''))"


def _any_sql(t: str, keywords: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {sql_str(k)})" for k in keywords) + ")"


_WORD = r"[\p{L}\p{N}_]"


def _word_sql(t: str, keywords: Sequence[str]) -> str:
    """One regex per group: any keyword as a whole word (quoted literally)."""
    alts = "|".join(_quoted(k) for k in keywords)
    return f"({t} RLIKE {sql_str(f'(?<!{_WORD})(?:{alts})(?!{_WORD})')})"


def tag_expr(text: str, taxonomy: Mapping[str, Sequence[str]], prune: bool = True, match: str = "substring") -> Column:
    """ARRAY<STRING> of matching groups, in taxonomy order, [] when none.

    ``match="substring"`` (default) reproduces the reference's ``kw in text``;
    ``match="word"`` requires whole-word hits ("fee" no longer hits "coffee").
    Compiled to one SQL expression string, so building it is a single call
    however many keywords the taxonomy has.  Subsumption pruning is only
    valid for substring matching, so word mode keeps every keyword.
    """
    if match == "substring":
        groups = tx.compiled(taxonomy, prune=prune)
        test = _any_sql
    elif match == "word":
        groups = tx.compiled(taxonomy, prune=False)
        test = _word_sql
    else:
        raise ValueError(f"match must be 'substring' or 'word', not {match!r}")
    whens = ", ".join(f"CASE WHEN {test('t', kws)} THEN {sql_str(g)} END" for g, kws in groups)
    return F.expr(f"transform(array({_text_sql(text)}), t -> array_compact(array({whens})))[0]")


def _quoted(k: str) -> str:
    return "\\Q" + k.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def flag_expr(text: str, phrases: Sequence[str]) -> Column:
    """True when any phrase occurs as a substring.

    One regex alternation of literal-quoted phrases: a single ``lower`` and a
    single cached pattern, so the predicate stays small inside whole-stage
    codegen (an OR of many ``contains`` pushed into a filter overflowed it).
    """
    alts = "|".join(_quoted(k) for k in tx.prune_subsumed(phrases))
    return F.expr(f"{_text_sql(text)} RLIKE {sql_str(alts)}")


def ordinal_expr(group: str, taxonomy: Mapping[str, Sequence[str]]) -> Column:
    """Position of a group in its taxonomy (tie-break for stable orders)."""
    whens = " ".join(f"WHEN {sql_str(g)} THEN {i}" for g, i in tx.group_ordinals(taxonomy).items())
    return F.expr(f"CASE `{group}` {whens} END")


#: Taxonomy and stored column of each kind of tag.
KINDS = {
    "complaint": (tx.COMPLAINT_GROUPS, "complaint_categories"),
    "praise": (tx.PRAISE_GROUPS, "praise_categories"),
    "feature": (tx.FEATURE_THEMES, "feature_categories"),
}
REQUEST_COL = "is_request"


def tags_of(df: DataFrame, kind: str, text_col: str = "review_text") -> Column:
    """Tags of a kind: the stored column where the table has it, else matched."""
    taxonomy, stored = KINDS[kind]
    return F.col(stored) if stored in df.columns else tag_expr(text_col, taxonomy)


def requests_of(df: DataFrame, text_col: str = "review_text") -> Column:
    """Request language: the stored flag where the table has it, else matched."""
    return F.col(REQUEST_COL) if REQUEST_COL in df.columns else flag_expr(text_col, tx.REQUEST_SIGNALS)


def tag_complaints(df: DataFrame, text_col: str = "review_text", out: str = "complaint_categories") -> DataFrame:
    return df.withColumn(out, tag_expr(text_col, tx.COMPLAINT_GROUPS))


def tag_praise(df: DataFrame, text_col: str = "review_text", out: str = "praise_themes") -> DataFrame:
    return df.withColumn(out, tag_expr(text_col, tx.PRAISE_GROUPS))


def tag_features(df: DataFrame, text_col: str = "review_text", out: str = "feature_themes") -> DataFrame:
    return df.withColumn(out, tag_expr(text_col, tx.FEATURE_THEMES))


def flag_requests(df: DataFrame, text_col: str = "review_text", out: str = "is_request") -> DataFrame:
    return df.withColumn(out, flag_expr(text_col, tx.REQUEST_SIGNALS))


# ── table-driven taxonomies ─────────────────────────────────────────────────
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """Distinct n-grams of a string in one linear pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


#: Chosen trigrams that are looked for inside each row; more meet the texts by a shuffle.
IN_ROW = 2_000
#: Keyword trigrams that may be broadcast to filter the texts' trigrams (about 40 bytes each).
BROADCAST_GRAMS = 1_000_000
#: Texts that share a trigram and meet its keywords in one task.
HEAVY_TEXTS = 500_000


def tag_by_table(df: DataFrame, keywords: DataFrame, id_cols: Sequence[str], text_col: str = "text", in_row: int = IN_ROW,
                 heavy_texts: int = HEAVY_TEXTS) -> DataFrame:
    """Distinct (id..., group, ordinal) for every keyword found in the text.

    ``keywords`` has columns (group, ordinal, keyword) and may be of any size.
    A keyword can only occur in a text that has all its trigrams, so it is looked
    for where its rarest trigram is (shorter keywords are their own gram), and
    the hits are verified with ``contains``.  Counted are only trigrams that some
    keyword has.

    Up to ``in_row`` chosen trigrams are intersected with each row's own, and the
    few that are left meet the keywords, a broadcast of counted size: the texts
    are never shuffled.  Beyond, texts and keywords meet by an equi-join on the
    trigram: only chosen trigrams leave the scan, and one that is in more than
    ``heavy_texts`` texts is split over salts, its keywords repeated for each.
    Rows are matched by a hash of id and text, so null ids stay; two rows of one
    hash could only add verified hits.
    """
    kw = keywords.select("group", "ordinal", F.lower("keyword").alias("keyword")).where(F.length("keyword") > 0).distinct()
    texts = df.select(*id_cols, text_key(text_col).alias("_t"))
    sizes = sorted({min(r[0], GRAM) for r in kw.select(F.length("keyword")).distinct().collect()})
    if not sizes:
        return df.limit(0).select(*id_cols).join(kw.select("group", "ordinal").limit(0), F.lit(False))
    of_text = F.concat(*[_grams(F.col("_t"), n) for n in sizes])
    own = F.when(F.length("keyword") < GRAM, F.array("keyword")).otherwise(_grams(F.col("keyword"), GRAM))
    possible = write_table(kw.withColumn("_g", F.explode(own)))
    chosen = write_table(_rarest(texts.select(F.explode(of_text).alias("_g")), possible))
    n_grams, n_chosen = chosen.agg(F.count_distinct("_g"), F.count(F.lit(1))).first()
    if n_grams <= in_row and n_chosen <= BROADCAST_GRAMS:
        wanted = F.array(*[F.lit(r[0]) for r in chosen.select("_g").distinct().collect()])
        rows = texts.withColumn("_g", F.explode_outer(F.array_intersect(of_text, wanted))).where(F.col("_g").isNotNull())
        found = rows.join(F.broadcast(chosen), "_g").where(F.col("_t").contains(F.col("keyword")))
    else:
        found = _by_salted_grams(texts.withColumn("_row", F.xxhash64(*id_cols, "_t")), of_text, chosen, heavy_texts)
    return found.select(*id_cols, "group", "ordinal").distinct()


def _few(grams: DataFrame) -> DataFrame:
    return F.broadcast(grams) if grams.count() <= BROADCAST_GRAMS else grams


def _rarest(grams: DataFrame, possible: DataFrame) -> DataFrame:
    """group, ordinal, keyword, its rarest trigram _g and the number _n of texts that hold it."""
    wanted = write_table(possible.select("_g").distinct())
    freq = grams.join(_few(wanted), "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    every = possible.join(freq, "_g", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    best = F.min(F.struct("_n", "_g")).alias("_best")
    return every.groupBy("group", "ordinal", "keyword").agg(best).select("group", "ordinal", "keyword", "_best._g", "_best._n")


def _by_salted_grams(texts: DataFrame, of_text: Column, chosen: DataFrame, heavy_texts: int) -> DataFrame:
    salts = F.ceil(F.greatest(F.col("_n"), F.lit(1)) / F.lit(heavy_texts)).cast("int")
    grams = write_table(chosen.groupBy("_g").agg(F.max(salts).alias("_salts")))
    rows = texts.select("_row", F.explode(of_text).alias("_g")).join(_few(grams), "_g")
    rows = rows.select("_row", "_g", F.pmod(F.xxhash64("_row"), F.col("_salts")).cast("int").alias("_s"))
    kw = chosen.select("group", "ordinal", "keyword", "_g", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_s"))
    hits = rows.join(kw, ["_g", "_s"]).select("_row", "group", "ordinal", "keyword")
    return texts.join(hits, "_row").where(F.col("_t").contains(F.col("keyword")))
