"""Personal data by bootstrapped contextual extraction, in DataFrame code only.

Seeds are e-mail addresses, IP addresses, payment cards and phone numbers found
by fixed patterns.  Every identifier-like token (it holds a digit or @) has a
lexical pattern: the word before it (its shape, if that is identifier-like
too) and its own shape.  Patterns and tokens form a
bipartite graph; rounds score a pattern by the mean score of its tokens and a
token by its best pattern, from seeds at 1.  Patterns with a high score and
several distinct seeds are accepted and give their kind to tokens that no seed
rule has seen.  A token that a seed rule saw and refused (Luhn, range) stays
refused.

All edges and scores stay distributed; a pattern or token that holds a third of
all edges meets partial sums only.  Spans come from piece lengths between
matches (one running sum per document).

Edge cases: null or empty text has no spans; null doc_ids are kept apart by
their text; repeated rows have equal results; an empty table gives an empty
table; extra columns are ignored; patterns are possessive, so a text without
white space is scanned once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm import common as C

ROUNDS = 3
#: A pattern is accepted from this score and this many distinct seed tokens.
ACCEPT, SEEDS = 0.8, 4

# ───────────────────────────── FIXED VALUES ─────────────────────────────
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# ─────────────────────────── END FIXED VALUES ───────────────────────────
#: The text up to and with the next identifier-like token, from where the last one ended (possessive: one scan, no recursion).
TO_TOKEN = r"\G(?:[^\x20\x09-\x0D0-9@]*+[\x20\x09-\x0D])*+[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
KEY = ["doc_id", "th"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    at = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0),
                       lambda s, i: s + F.when(i % 2 == 0, twice(at(i))).otherwise(at(i))) % 10 == 0


def _valid() -> Column:
    m, n = F.col("m"), F.length(_digits(F.col("m")))
    return (F.when(F.col("kind") == "email", True)
            .when(F.col("kind") == "ip", m.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"))
            .when(F.col("kind") == "card", F.when(n.between(12, 19), _luhn(_digits(m))).otherwise(False))
            .otherwise(n.between(9, 15)))


def _shape(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(token, "0123456789", "9999999999"), r"\p{Ll}+", "a"), r"\p{Lu}+", "A")


def _ends(rows: DataFrame, parts: Column, length: Column) -> DataFrame:
    """KEY, p and the running sum ``end`` of the parts' lengths: one row per part of each row's text."""
    each = rows.select(*KEY, "row", parts.alias("z")).filter(F.size("z") > 0).select(*KEY, "row", F.posexplode("z").alias("i", "p"))
    running = Window.partitionBy(*KEY, "row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return each.select(*KEY, "p", F.sum(length).over(running).alias("end"))


def _places(rows: DataFrame, pattern: str) -> DataFrame:
    """doc_id, th, m, start, end of the leftmost non-overlapping matches of a pattern."""
    gaps, found = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    cut = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), found.alias("m"))
    return (_ends(rows, cut, F.col("p.gap") + F.coalesce(F.length("p.m"), F.lit(0))).filter(F.col("p.m").isNotNull())
            .select(*KEY, F.col("p.m").alias("m"), (F.col("end") - F.length("p.m")).alias("start"), "end").distinct())


def _token_places(rows: DataFrame) -> DataFrame:
    """doc_id, th, raw, left (the word before: its shape, if it is such a token too), end of all identifier-like tokens.

    Each text is scanned once; both words are read from the end of a part, whatever its length."""
    last = F.split(F.reverse("p"), C.WORD_SEP, 3)
    word = lambda i: F.reverse(F.coalesce(F.get(last, F.lit(i)), F.lit("")))
    parts = F.regexp_extract_all("text", F.lit(TO_TOKEN), F.lit(0))
    # a part without a word before its token follows the token of the part before
    at = _ends(rows, F.arrays_zip(parts.alias("p"), F.concat(F.array(F.lit("")), parts).alias("q")), F.coalesce(F.length("p.p"), F.lit(0)))
    at = at.filter(F.col("p.p").isNotNull()).select(*KEY, "end", "p.p", "p.q")
    before = F.reverse(F.coalesce(F.get(F.split(F.reverse("q"), C.WORD_SEP, 2), F.lit(0)), F.lit("")))
    return (at.select(*KEY, "end", word(0).alias("raw"), word(1).alias("word"), before.alias("before"))
            .select(*KEY, "raw", F.when(F.col("word") != "", F.lower("word")).otherwise(_shape(F.col("before"))).alias("left"), "end").distinct())


def matches(docs: DataFrame) -> DataFrame:
    """doc_id, th, kind, start, end, valid of all matches of the fixed patterns."""
    every = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("string"))
    # equal rows are told apart, so that one running sum never mixes two
    every = every.withColumn("row", F.monotonically_increasing_id())
    hints = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
    out = None
    for kind in KINDS:
        one = _places(every.filter(F.col("text").rlike(hints[kind])), PATTERNS[kind]).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("valid", _valid())


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, th, token, pattern, start, end of identifier-like tokens, outer punctuation taken off."""
    every = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("string"))
    every = every.withColumn("row", F.monotonically_increasing_id())
    at = _token_places(every.filter(F.col("text").rlike("[0-9@]")))
    core = F.regexp_replace(F.regexp_replace(F.col("raw"), r"^[\"'(\[{<]+", ""), r"[\"')\]}>.,;:!?]+\z", "")
    skipped = F.length("raw") - F.length(F.regexp_replace(F.col("raw"), r"^[\"'(\[{<]+", ""))
    return (at.withColumn("token", core).filter(F.length("token") > 3)
            .withColumn("start", F.col("end") - F.length("raw") + skipped).withColumn("end", F.col("start") + F.length("token"))
            .select(*KEY, F.lower("token").alias("token"), F.concat_ws(" ", "left", _shape(F.col("token"))).alias("pattern"), "start", "end"))


def _seeded(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Tokens with ``seed`` (kind of a valid match they touch) and ``refused`` (they touch an invalid one)."""
    mark = F.struct(F.col("end").alias("e"), F.col("start").alias("s"), "kind", "valid")
    rows = (found.select(*KEY, "start", "end", F.struct("token", "pattern").alias("t"), F.lit(None).cast("struct<e:int,s:int,kind:string,valid:boolean>").alias("span"))
            .unionByName(spans.select(*KEY, F.col("start").cast("int"), F.col("end").cast("int"), F.lit(None).cast("struct<token:string,pattern:string>").alias("t"),
                                      F.struct(F.col("end").cast("int").alias("e"), F.col("start").cast("int").alias("s"), "kind", "valid").alias("span")).withColumns(
                {"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})))
    order = Window.partitionBy(*KEY).orderBy("start", F.col("t").isNotNull())
    before = F.max("span").over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("span").isNotNull(), F.struct("span.s", "span.kind", "span.valid"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"b": before, "a": after}).filter(F.col("t").isNotNull())
    hit_b, hit_a = F.col("b.e") > F.col("start"), F.col("a.s") < F.col("end")
    seed = F.coalesce(F.when(hit_b & F.col("b.valid"), F.col("b.kind")), F.when(hit_a & F.col("a.valid"), F.col("a.kind")))
    refused = F.coalesce(hit_b & ~F.col("b.valid"), F.lit(False)) | F.coalesce(hit_a & ~F.col("a.valid"), F.lit(False))
    return rows.select(*KEY, "start", "end", "t.token", "t.pattern", seed.alias("seed"), refused.alias("refused"))


def accepted(seeded: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, kind of the high-confidence patterns (scores by iterating over the pattern-token graph)."""
    edges = C.write_table(seeded.groupBy("pattern", "token").agg(F.max("seed").alias("seed")))
    kinds = edges.filter(F.col("seed").isNotNull())
    seeds = kinds.select("token", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    score = seeds
    for k in range(rounds):
        weight = edges.join(score, "token").groupBy("pattern", "kind").agg(F.sum("score").alias("w"), F.sum((F.col("score") >= 1).cast("int")).alias("seeds"))
        of = C.write_table(weight.join(size, "pattern").select("pattern", "kind", (F.col("w") / F.col("n")).alias("p"), "seeds"))
        if k < rounds - 1:
            best = edges.join(of, "pattern").groupBy("token", "kind").agg((F.max("p") * 0.9).alias("score"))
            score = C.write_table(best.unionByName(seeds.select("token", "kind", "score")).groupBy("token", "kind").agg(F.max("score").alias("score")))
    return of.filter((F.col("p") >= ACCEPT) & (F.col("seeds") >= SEEDS)).groupBy("pattern").agg(F.max(F.struct("p", "kind")).alias("k")).select("pattern", "k.kind")


def find_identifiers(docs: DataFrame) -> DataFrame:
    """doc_id, th, base and added: sorted arrays of (start, rank of the kind, kind, end), for every row of ``docs``."""
    every = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"))
    all_spans = C.write_table(matches(docs))
    # what the rules refuse outright; short digit runs are no refusal
    judged = all_spans.filter(F.col("valid") | (F.col("kind") != "card") | (F.length(_digits(F.col("m"))) >= 12))
    seeded = C.write_table(_seeded(tokens(docs), judged))
    new = seeded.filter(F.col("seed").isNull() & ~F.col("refused")).join(accepted(seeded), "pattern").select(*KEY, "kind", "start", "end", F.lit(False).alias("base"))
    base = all_spans.filter("valid").select(*KEY, "kind", F.col("start").cast("long"), F.col("end").cast("long"), F.lit(True).alias("base"))
    rank = F.expr("array_position(array({}), kind) - 1".format(", ".join(f"'{k}'" for k in KINDS)))
    span = F.struct("start", rank.cast("int").alias("rank"), "kind", "end")
    both = base.unionByName(new).groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.when(F.col("base"), span))).alias("base"), F.sort_array(F.collect_set(F.when(~F.col("base"), span))).alias("added"))
    left, right = every.alias("l"), both.alias("r")
    joined = left.join(right, F.expr("l.th = r.th AND l.doc_id <=> r.doc_id"), "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return joined.select("l.doc_id", "l.th", F.coalesce("r.base", none).alias("base"), F.coalesce("r.added", none).alias("added"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by <KIND>; spans that overlap are covered once, by the first."""
    spans = find_identifiers(docs).select("doc_id", "th", F.sort_array(F.array_union("base", "added")).alias("spans")).filter(F.size("spans") > 0).dropDuplicates(KEY)
    spans = C.write_table(spans)
    start = F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("").alias("done"))

    def step(a, s):
        mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        skip = s["start"] + 1 < a["at"]
        part = F.substring(F.col("text"), a["at"].cast("int"), (s["start"] + 1 - a["at"]).cast("int"))
        return F.struct(F.when(skip, F.greatest(a["at"], s["end"] + 1)).otherwise(s["end"] + 1).alias("at"),
                        F.when(skip, a["done"]).otherwise(F.concat(a["done"], part, mark)).alias("done"))

    rows = docs.withColumn("__th", F.xxhash64("text")).alias("d")
    joined = rows.join(C.sized_broadcast(spans, 300_000).alias("s"), F.expr("d.__th = s.th AND CAST(d.doc_id AS BIGINT) <=> s.doc_id"), "left")
    joined = joined.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns], F.col("s.spans").alias("__spans"))
    clean = F.aggregate("__spans", start, step, lambda a: F.concat(a["done"], F.substring(F.col("text"), a["at"].cast("int"), F.lit(2**31 - 1))))
    return joined.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)
