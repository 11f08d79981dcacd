"""Lexicon sentiment (the valence-aware rule scorer of Hutto & Gilbert 2014).

The reference calls a third-party scorer; its lexicon is not part of the
reference, so scores are ours (labels use the same thresholds).  The rules and
their constants are the published ones of that paper: per token a valence from a
lexicon, raised by 0.733 when the token is in capitals and the text is not;
+-0.293 when the preceding token is a booster; x -0.74 when one of the three
preceding tokens is a negator; x0.5 before / x1.5 after the first "but"; to the
sum 0.292 for each "!" (four at most), 0.18 for each of two or three "?", 0.96 for
more, in the direction of the sum; normalised with s / sqrt(s^2 + 15).

Scale: the whole score is one per-row expression over ``split`` and
higher-order functions (``transform``/``aggregate``), so a 20,000-word document
costs one row's work in the task that reads it.  The lexicon is a mapping or a
table (token, valence).  A table of at most ``LITERAL_WORDS`` rows becomes a
literal map: no explode, no join and no shuffle.  Of a larger one each distinct
text gets the entries of its own tokens by an equi-join on the token, the
lexicon broadcast while it is counted small; the texts' hashes, not the texts,
are shuffled with the tokens.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens import taxonomy as tx
from reviewlens.functions.text import col_
from reviewlens.session import write_table

# ───────────────────────────── FIXED VALUES ─────────────────────────────
# A small lexicon of our own choice of words: token -> valence on the -4..+4 scale of Hutto & Gilbert 2014.
LEXICON: dict[str, float] = {
    "good": 1.9, "great": 3.1, "excellent": 3.2, "amazing": 2.8, "awesome": 3.1,
    "best": 3.2, "love": 3.2, "loved": 2.9, "like": 1.5, "nice": 1.8,
    "beautiful": 2.9, "clean": 1.7, "easy": 1.9, "intuitive": 1.8, "fast": 1.4,
    "smooth": 1.5, "perfectly": 2.7, "perfect": 2.7, "reliable": 1.9, "accurate": 1.7,
    "worth": 1.0, "helpful": 1.9, "happy": 2.7, "fantastic": 2.6, "wonderful": 2.7,
    "useful": 1.9, "fine": 0.8, "okay": 0.9, "ok": 0.9, "enjoy": 2.2,
    "favorite": 2.0, "recommend": 1.5, "thanks": 1.9, "thank": 1.5, "win": 2.8,
    "works": 0.8, "stable": 1.2, "simple": 1.1, "quick": 1.1, "fun": 2.3,
    "friendly": 2.2, "brilliant": 2.8, "superb": 3.1, "pleasant": 2.3, "satisfied": 1.8,
    "glad": 2.0, "cool": 1.3, "better": 1.9, "improved": 1.5, "free": 1.1,
    "secure": 1.4, "safe": 1.9, "support": 1.7, "solid": 1.4, "trust": 2.3,
    "bad": -2.5, "worst": -3.1, "terrible": -2.9, "horrible": -2.6, "awful": -2.9,
    "poor": -2.1, "useless": -1.9, "waste": -1.8, "scam": -2.6, "fraud": -2.7,
    "fake": -2.1, "broken": -2.0, "bug": -1.4, "bugs": -1.5, "error": -1.7,
    "errors": -1.6, "crash": -1.7, "crashes": -1.8, "crashing": -1.9, "crashed": -1.8,
    "slow": -1.5, "hangs": -1.0, "freezes": -1.4, "lag": -1.2, "failed": -2.3,
    "fail": -2.5, "fails": -2.2, "failure": -2.3, "problem": -1.7, "problems": -1.7,
    "issue": -1.2, "issues": -1.3, "annoying": -1.9, "hate": -2.7, "angry": -2.3,
    "disappointed": -1.9, "disappointing": -2.2, "sad": -2.1, "pathetic": -2.4, "trash": -2.0,
    "garbage": -2.3, "hacked": -2.0, "stolen": -2.2, "cannot": -0.8, "refund": -0.6,
    "ads": -0.9, "spam": -1.5, "stupid": -2.4, "ugly": -2.3, "wrong": -2.1,
    "frustrating": -2.2, "ridiculous": -1.9, "lost": -1.3, "unfortunately": -1.6, "sucks": -2.5,
    "rubbish": -2.3, "worse": -2.1, "confusing": -1.3, "expensive": -0.8, "difficult": -1.5,
    "pain": -2.3, "damn": -1.7, "gone": -0.7, "never": -0.4, "boring": -1.3,
    "dead": -3.3, "kill": -3.7, "cheating": -2.6, "misleading": -1.8, "worthless": -2.4,
}
NEGATORS = [
    "not", "no", "never", "none", "nothing", "nobody", "neither", "nor", "without",
    "cannot", "can't", "don't", "doesn't", "didn't", "won't", "isn't", "wasn't",
    "aren't", "couldn't", "shouldn't", "wouldn't", "hardly", "rarely", "seldom",
]
BOOSTERS_UP = ["very", "really", "extremely", "so", "too", "totally", "absolutely", "highly", "incredibly", "super"]
BOOSTERS_DOWN = ["slightly", "somewhat", "barely", "little", "kinda", "partly"]
NEGATION_SCALAR = -0.74
BOOST = 0.293
BUT_BEFORE = 0.5
BUT_AFTER = 1.5
ALPHA = 15.0
CAPITALS = 0.733
EXCLAMATION = 0.292
EXCLAMATIONS_MOST = 4
QUESTION = 0.18
QUESTIONS_MOST = 3
QUESTIONS_MANY = 0.96
TOKEN_SPLIT = "[^A-Za-z']+"
# ─────────────────────────── END FIXED VALUES ───────────────────────────


#: Entries of a lexicon table that become a literal map (looked up token by token).
LITERAL_WORDS = 2_000
#: Entries of a lexicon table that may be broadcast to the tokens (about 60 bytes each).
BROADCAST_WORDS = 500_000
Lexicon = Mapping[str, float] | DataFrame


def tokens(text: Column | str) -> Column:
    """The words of a text, as written."""
    return F.filter(F.split(F.coalesce(col_(text), F.lit("")), TOKEN_SPLIT), lambda t: t != "")


def _shift_sql(k: int) -> str:
    """SQL: the token k places earlier at every position ('' before the start)."""
    return f"concat(array_repeat('', least({k}, size(_toks))), slice(_toks, 1, greatest(size(_toks) - {k}, 0)))"


def _with_lexicon(df: DataFrame, text_col: str, lexicon: Lexicon) -> tuple[DataFrame, str]:
    """The frame, and the SQL of a map from token to valence for each of its rows."""
    from reviewlens.operators.tagging import sql_str

    if isinstance(lexicon, DataFrame):
        table = lexicon.select(F.lower(F.col("token").cast("string")).alias("token"), F.col("valence").cast("double").alias("valence"))
        table = write_table(table.where(F.col("token").isNotNull() & F.col("valence").isNotNull()).groupBy("token").agg(F.max("valence").alias("valence")))
        n = table.count()
        if n > LITERAL_WORDS:
            return _own_entries(df, text_col, F.broadcast(table) if n <= BROADCAST_WORDS else table), "coalesce(_lex, map())"
        lexicon = dict(table.collect())
    entries = ", ".join(f"{sql_str(k)}, CAST({v!r} AS DOUBLE)" for k, v in lexicon.items())
    return df, f"map({entries})"


def _own_entries(df: DataFrame, text_col: str, table: DataFrame) -> DataFrame:
    """Rows with ``_lex``: the lexicon entries of their own tokens (at most as many as the text has words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = df.withColumns({"_x1": F.xxhash64(text), "_x2": F.hash(text)})
    words = d.select("_x1", "_x2", F.explode(F.array_distinct(F.transform(tokens(text_col), F.lower))).alias("token"))
    found = words.join(table, "token").groupBy("_x1", "_x2").agg(
        F.map_from_entries(F.collect_set(F.struct("token", "valence"))).alias("_lex"))
    return d.join(found, ["_x1", "_x2"], "left").drop("_x1", "_x2")


def with_compound(df: DataFrame, text_col: str = "review_text", lexicon: Lexicon | None = None,
                  out: str = "_compound") -> DataFrame:
    """Add the unrounded compound score in [-1, 1] as column ``out``.

    Tokens, their valences, their three predecessors, the position of the first
    "but" and whether capitals stress them are materialised once per row as
    arrays and zipped, so the per-token lambda reads only its own element (an
    inline token expression inside a lambda would re-split the whole text for
    every token).  The steps are SQL expression strings: one parse each, cheap
    to analyse.
    """
    from reviewlens.operators.tagging import sql_str

    cols = df.columns
    df, lex = _with_lexicon(df, text_col, LEXICON if lexicon is None else lexicon)
    arr = lambda ws: "array(" + ", ".join(sql_str(w) for w in ws) + ")"
    neg, up, down = arr(NEGATORS), arr(BOOSTERS_UP), arr(BOOSTERS_DOWN)
    d = df.select("*", tokens(text_col).alias("_raw"))
    d = d.select("*", F.expr("transform(_raw, t -> lower(t))").alias("_toks"), F.expr("transform(_raw, t -> t = upper(t) AND t <> lower(t))").alias("_up"))
    stress = "CASE WHEN exists(_up, u -> u) AND exists(_up, u -> NOT u) THEN _up ELSE array_repeat(false, size(_up)) END"
    d = d.select("*", F.expr(
        f"arrays_zip(transform(_toks, t -> coalesce(try_element_at({lex}, t), CAST(0 AS DOUBLE))), "
        f"{_shift_sql(1)}, {_shift_sql(2)}, {_shift_sql(3)}, "
        f"array_repeat(array_position(_toks, 'but'), size(_toks)), {stress})").alias("_ctx"))
    # zipped fields are named 0..5: valence, prev1, prev2, prev3, but-position, in capitals
    valence = f"(e['0'] + CASE WHEN e['5'] THEN signum(e['0']) * {CAPITALS}D ELSE 0D END)"
    boosted = (f"CASE WHEN e['0'] = 0 THEN e['0'] "
               f"WHEN array_contains({up}, e['1']) THEN {valence} + signum(e['0']) * {BOOST}D "
               f"WHEN array_contains({down}, e['1']) THEN {valence} - signum(e['0']) * {BOOST}D ELSE {valence} END")
    negated = f"(array_contains({neg}, e['1']) OR array_contains({neg}, e['2']) OR array_contains({neg}, e['3']))"
    signed = f"(CASE WHEN {negated} THEN ({boosted}) * {NEGATION_SCALAR}D ELSE ({boosted}) END)"
    val = (f"CASE WHEN e['4'] > 0 AND i + 1 < e['4'] THEN {signed} * {BUT_BEFORE}D "
           f"WHEN e['4'] > 0 AND i + 1 > e['4'] THEN {signed} * {BUT_AFTER}D ELSE {signed} END")
    d = d.select("*", F.expr(f"aggregate(transform(_ctx, (e, i) -> {val}), CAST(0 AS DOUBLE), (a, x) -> a + x)").alias("_s0"))
    d = d.select("*", (F.col("_s0") + F.signum("_s0") * _punctuation(text_col)).alias("_s"))
    return d.select(*[c for c in cols if c != out], (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + F.lit(ALPHA))).alias(out))


def _punctuation(text_col: str) -> Column:
    """How much exclamation and question marks add to a score's size."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    asked = count("?")
    return (F.least(count("!"), F.lit(EXCLAMATIONS_MOST)) * F.lit(EXCLAMATION)
            + F.when(asked <= 1, 0.0).when(asked <= QUESTIONS_MOST, asked * F.lit(QUESTION)).otherwise(QUESTIONS_MANY))


def label_expr(score: Column) -> Column:
    return (
        F.when(score >= tx.SENTIMENT_POSITIVE, "Positive")
        .when(score <= tx.SENTIMENT_NEGATIVE, "Negative")
        .otherwise("Neutral")
    )


def score_sentiment(df: DataFrame, text_col: str = "review_text", lexicon: Lexicon | None = None) -> DataFrame:
    """Add sentiment_score (3 dp, half-even) and sentiment_label (on the raw score)."""
    d = with_compound(df, text_col, lexicon)
    return d.select(
        *[c for c in d.columns if c != "_compound"],
        F.bround("_compound", 3).alias("sentiment_score"),
        label_expr(F.col("_compound")).alias("sentiment_label"),
    )
