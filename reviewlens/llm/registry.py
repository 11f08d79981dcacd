"""Contract queries of the training-data operators: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import common as C
from reviewlens.llm import alignment, fragment_join, identifiers, leaks, packing, phrases, quality, quotes, sequence_files, spelling
from reviewlens.llm import token_counts, toxicity, url_rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


@query("op1_mcd_quality")
def q_quality(spark, d):
    return quality.judge(C.documents(spark, d)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op2_sequence_files")
def q_sequence_files(spark, d):
    files = sequence_files.write(C.documents(spark, d), C.tokenizer_path(), end_id=2)
    return sequence_files.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op3_toxicity")
def q_toxicity(spark, d):
    return toxicity.toxicity(C.documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


@query("op4_identifiers")
def q_identifiers(spark, d):
    found = identifiers.find_identifiers(C.documents(spark, d))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.sort_array(F.array_union("base", "added"))
    return found.select("doc_id", *[n(k) for k in identifiers.KINDS], F.sha2(identifiers.as_text(F.col("base")), 256).alias("base_sha256"),
                        identifiers.as_text(every).alias("spans"))


@query("op5_fragment_join")
def q_fragment_join(spark, d):
    return fragment_join.similar_components(C.documents(spark, d)).select("doc_id", "n_shingles", "component_id")


@query("op6_latent_leaks")
def q_leaks(spark, d):
    return leaks.find_leaks(C.documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


@query("op7_packing")
def q_packing(spark, d):
    p = packing.pieces(C.documents(spark, d), C.tokenizer_path(), end_id=0)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op8_phrase_automata")
def q_phrases(spark, d):
    return phrases.remove_repeats(C.documents(spark, d)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_quotation_links")
def q_quotes(spark, d):
    table = spark.read.parquet(f"{d}/conversations.parquet")
    return quotes.link(table).unionByName(quotes.unplaced(table))


@query("op10_token_counts")
def q_token_counts(spark, d):
    return token_counts.count_tokens(C.documents(spark, d), C.tokenizer_path())


@query("op11_url_rules")
def q_url_rules(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(url_rules.FIXED_RULES, "host string, path string, verdict string")
    return url_rules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op12_run_alignment")
def q_run_alignment(spark, d):
    return alignment.align_documents(C.documents(spark, d), C.tokenizer_path(), C.tokenizer_path("piece_bpe_32k.model"))


@query("op13_spelling_variants")
def q_spelling(spark, d):
    return spelling.variants(C.documents(spark, d))


# ── SQL of the queries that have a SQL form ─────────────────────────────────
_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL["op5_fragment_join"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p+4], ' '))) END AS s FROM d),
one AS (SELECT doc_id, unnest(s) AS g FROM sets),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * i >= 80 * (len(x.s) + len(y.s) - i)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s"""

SQL["op8_phrase_automata"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 48), lambda p: {{'p': p, 'k': md5(array_to_string(w[p:p+49], ' '))}}), recursive := true)
        FROM d WHERE len(w) >= 50),
own AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM win JOIN own USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

SQL["op11_url_rules"] = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN hit USING (host, path)"""
