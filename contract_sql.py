"""DuckDB oracle SQL for the contract queries.

Written independently of the Spark operators: keyword matching is a join
against keyword tables (unpruned), the recent slice is a plain
``row_number``, sentiment is ``unnest`` + ``lag`` + a lexicon join.  Only the
fixed data (phrase bank, keyword lists, lexicon, display strings) is shared.
"""

from __future__ import annotations

from reviewlens import taxonomy as tx
from reviewlens.operators import sentiment as S
from reviewlens.plans import registry as REG
from reviewlens.sources import fixture as FX


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_lit(x) for x in r) + ")" for r in rows)


def _in_list(words) -> str:
    return "(" + ", ".join(_lit(w) for w in words) + ")"


def _kw_rows(taxonomy) -> list[tuple]:
    return [(g, i, k.lower()) for i, (g, kws) in enumerate(taxonomy.items()) for k in kws]


PHRASE = f"phrase(slot, pol, txt) AS (VALUES {_values(FX.PHRASES)})"

REVIEWS = f"""
{PHRASE},
ev AS (
  SELECT event_id, ts, user_id, value,
    CASE WHEN ts >= TIMESTAMP '{FX.LATE_CUTOFF}' AND event_type = 'error' THEN 0
         WHEN ts >= TIMESTAMP '{FX.LATE_CUTOFF}' AND event_type = 'signup' THEN 13
         ELSE (event_id * 7 + user_id) % 26 END AS s,
    (event_id * 11 + user_id) % 26 AS s2
  FROM events),
raw AS (
  SELECT '{FX.APP_PREFIX}' || CAST(ev.user_id % 5 AS VARCHAR) AS app_id,
         lpad(CAST(ev.event_id AS VARCHAR), 12, '0') AS review_id,
         ev.ts AS date,
         CAST(CASE p.pol WHEN 'neg' THEN 1 + ev.event_id % 2 WHEN 'mix' THEN 3 ELSE 4 + ev.event_id % 2 END AS INTEGER) AS rating,
         CASE WHEN ev.event_id % 97 = 0 THEN '   '
              WHEN ev.event_id % 3 = 0 THEN p.txt || '. ' || p2.txt
              ELSE p.txt END AS content,
         CAST(floor(ev.value) AS INTEGER) AS thumbs_up,
         '1.' || CAST(CAST(floor((day(ev.ts) - 1) / 10) AS INTEGER) AS VARCHAR) AS app_version
  FROM ev JOIN phrase p ON p.slot = ev.s JOIN phrase p2 ON p2.slot = ev.s2),
reviews AS (
  SELECT app_id, review_id, date, rating, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS review_text,
         thumbs_up, app_version
  FROM raw WHERE regexp_replace(content, '^\\s+|\\s+$', '', 'g') <> '')"""

CKW = f"ckw(grp, ord, kw) AS (VALUES {_values(_kw_rows(tx.COMPLAINT_GROUPS))})"
PKW = f"pkw(grp, ord, kw) AS (VALUES {_values(_kw_rows(tx.PRAISE_GROUPS))})"
FKW = f"fkw(grp, ord, kw) AS (VALUES {_values(_kw_rows(tx.FEATURE_THEMES))})"
REQ = f"req(kw) AS (VALUES {_values([(k,) for k in tx.REQUEST_SIGNALS])})"
NEG = f"negp(ord, kw) AS (VALUES {_values(list(enumerate(tx.NEGATIVE_PHRASES)))})"

CTAG = """
ctag AS (SELECT DISTINCT r.app_id, r.review_id, k.grp AS theme, k.ord
         FROM reviews r JOIN ckw k ON contains(lower(r.review_text), k.kw))"""

FLAG = """
rk AS (SELECT app_id, review_id, date, rating, review_text, thumbs_up,
              row_number() OVER (PARTITION BY app_id ORDER BY date DESC, review_id) AS rn,
              count(*) OVER (PARTITION BY app_id) AS n
       FROM reviews),
flag AS (SELECT *, rn <= greatest(50, floor(n * 0.2)) AS is_recent FROM rk)"""

REQ_ROWS = """
reqrows AS (SELECT r.* FROM reviews r
            WHERE r.rating IN (4, 5)
              AND EXISTS (SELECT 1 FROM req q WHERE contains(lower(r.review_text), q.kw)))"""


def _sentiment(src: str, ids: list[str], text: str, name: str) -> str:
    """CTEs computing ``name``(ids..., compound) for every row of ``src``."""
    idl = ", ".join(ids)
    lex = f"{name}_lex(w, v) AS (VALUES {_values(list(S.LEXICON.items()))})"
    neg, up, down = _in_list(S.NEGATORS), _in_list(S.BOOSTERS_UP), _in_list(S.BOOSTERS_DOWN)
    return f"""
{lex},
{name}_tok0 AS (
  SELECT {idl}, unnest(toks) AS raw, generate_subscripts(toks, 1) AS p
  FROM (SELECT {idl}, regexp_split_to_array(coalesce({text}, ''), '{S.TOKEN_SPLIT.replace("'", "''")}') AS toks
        FROM {src})),
{name}_tok AS (
  SELECT {idl}, t, p, up AND bool_or(up) OVER (PARTITION BY {idl}) AND bool_or(NOT up) OVER (PARTITION BY {idl}) AS stressed,
         lag(t, 1) OVER w AS p1, lag(t, 2) OVER w AS p2, lag(t, 3) OVER w AS p3,
         min(CASE WHEN t = 'but' THEN p END) OVER (PARTITION BY {idl}) AS bp
  FROM (SELECT *, lower(raw) AS t, raw = upper(raw) AND raw <> lower(raw) AS up FROM {name}_tok0 WHERE raw <> '')
  WINDOW w AS (PARTITION BY {idl} ORDER BY p)),
{name}_val AS (
  SELECT k.*, coalesce(l.v + CASE WHEN stressed THEN sign(l.v) * CAST({S.CAPITALS} AS DOUBLE) ELSE 0 END, CAST(0.0 AS DOUBLE)) AS v FROM {name}_tok k LEFT JOIN {name}_lex l ON l.w = k.t),
{name}_b AS (
  SELECT *,
    CASE WHEN v = 0 THEN v
         WHEN coalesce(p1, '') IN {up} THEN v + sign(v) * CAST({S.BOOST} AS DOUBLE)
         WHEN coalesce(p1, '') IN {down} THEN v - sign(v) * CAST({S.BOOST} AS DOUBLE)
         ELSE v END AS vb,
    (coalesce(p1, '') IN {neg} OR coalesce(p2, '') IN {neg} OR coalesce(p3, '') IN {neg}) AS negated
  FROM {name}_val),
{name}_s AS (
  SELECT {idl}, sum(
    CASE WHEN bp IS NOT NULL AND p < bp THEN (CASE WHEN negated THEN vb * CAST({S.NEGATION_SCALAR} AS DOUBLE) ELSE vb END) * CAST({S.BUT_BEFORE} AS DOUBLE)
         WHEN bp IS NOT NULL AND p > bp THEN (CASE WHEN negated THEN vb * CAST({S.NEGATION_SCALAR} AS DOUBLE) ELSE vb END) * CAST({S.BUT_AFTER} AS DOUBLE)
         ELSE (CASE WHEN negated THEN vb * CAST({S.NEGATION_SCALAR} AS DOUBLE) ELSE vb END) END) AS s
  FROM {name}_b GROUP BY {idl}),
{name}_p AS (
  SELECT {idl}, length(coalesce({text}, '')) - length(replace(coalesce({text}, ''), '!', '')) AS excl,
         length(coalesce({text}, '')) - length(replace(coalesce({text}, ''), '?', '')) AS ques FROM {src}),
{name}_a AS (
  SELECT {idl}, coalesce(s, CAST(0.0 AS DOUBLE)) + sign(coalesce(s, CAST(0.0 AS DOUBLE))) * (
           least(excl, {S.EXCLAMATIONS_MOST}) * CAST({S.EXCLAMATION} AS DOUBLE)
           + CASE WHEN ques <= 1 THEN 0 WHEN ques <= {S.QUESTIONS_MOST} THEN ques * CAST({S.QUESTION} AS DOUBLE) ELSE CAST({S.QUESTIONS_MANY} AS DOUBLE) END) AS s
  FROM {name}_p LEFT JOIN {name}_s USING ({idl})),
{name} AS (SELECT {idl}, s / sqrt(s * s + CAST({S.ALPHA} AS DOUBLE)) AS compound FROM {name}_a)"""


def _label(c: str) -> str:
    return (f"CASE WHEN {c} >= {tx.SENTIMENT_POSITIVE} THEN 'Positive' "
            f"WHEN {c} <= {tx.SENTIMENT_NEGATIVE} THEN 'Negative' ELSE 'Neutral' END")


ENR = _sentiment("reviews", ["app_id", "review_id"], "review_text", "rsent") + f""",
enr AS (SELECT r.*, round_even(c.compound, 3) AS sentiment_score, {_label('c.compound')} AS sentiment_label
        FROM reviews r JOIN rsent c USING (app_id, review_id))"""


def w(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") if i == 0 else c for i, c in enumerate([REVIEWS, *ctes]))


def _pct(c: str, t: str) -> str:
    return f"round_even(CAST(100.0 AS DOUBLE) * {c} / {t}, 1)"


def _cut(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) > {n} THEN left({c}, {n}) || '…' ELSE {c} END"


def _map_case(col: str, d: dict, default: str) -> str:
    whens = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in d.items())
    return f"CASE {col} {whens} ELSE {default} END"


def _tier(c: str) -> str:
    return f"CASE WHEN {c} >= 12 THEN 'high' WHEN {c} >= 6 THEN 'medium' ELSE 'low' END"


def _iso_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _iso_date(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


THEME_AGG = """
tot AS (SELECT app_id, count(*) AS n, count(*) FILTER (WHERE is_recent) AS n_recent FROM flag GROUP BY app_id),
th AS (SELECT f.app_id, t.theme, count(*) AS mentions,
              count(*) FILTER (WHERE f.is_recent) AS recent_mentions,
              avg(CASE WHEN f.is_recent THEN f.rating END) AS recent_avg,
              min(CASE WHEN f.is_recent THEN f.date END) AS recent_oldest
       FROM flag f JOIN ctag t USING (app_id, review_id) GROUP BY f.app_id, t.theme),
asof_t AS (SELECT max(date) AS as_of FROM reviews)"""


def _key_signals(min_change: float, min_recent: int) -> str:
    return w(CKW, CTAG, FLAG, THEME_AGG) + f"""
SELECT x.*, row_number() OVER (PARTITION BY app_id ORDER BY change DESC, avg_rating,
                              (SELECT min(t.ord) FROM ctag t WHERE t.theme = x.complaint)) AS rank FROM (
  SELECT th.app_id, th.theme AS complaint, th.recent_mentions AS recent_count,
         round_even({_pct('th.recent_mentions', 'tot.n_recent')} - {_pct('th.mentions', 'tot.n')}, 1) AS change,
         round_even(th.recent_avg, 1) AS avg_rating,
         greatest(date_sub('day', th.recent_oldest, asof_t.as_of), 0) AS days_ago,
         th.mentions,
         round_even(th.recent_avg, 1) <= {tx.CRITICAL_RATING} AS is_critical
  FROM th JOIN tot USING (app_id) CROSS JOIN asof_t
  WHERE th.recent_mentions > 0) x
WHERE change >= {min_change} AND recent_count >= {min_recent}"""


def _ids(where: str, src: str = "reviews") -> str:
    return f"SELECT app_id, review_id, rating FROM {src} WHERE {where}"


def _kw_tag(src: str, kw: str, label: str = "theme") -> str:
    return f"SELECT DISTINCT r.app_id, r.review_id, k.grp AS {label}, k.ord FROM {src} r JOIN {kw} k ON contains(lower(r.review_text), k.kw)"


def _tagged_counts(src: str, kw: str, label: str, min_count: int, top_n: int, with_pct: bool) -> str:
    pct_col = f", round_even(CAST(100.0 AS DOUBLE) * c.count / greatest(t.total, 1), 1) AS pct_of_positive" if with_pct else ""
    return f"""
tg AS ({_kw_tag(src, kw, label)}),
tt AS (SELECT app_id, count(*) AS total FROM {src} GROUP BY app_id),
c AS (SELECT app_id, {label}, min(ord) AS ord, count(*) AS count FROM tg GROUP BY app_id, {label}),
rk2 AS (SELECT c.app_id, c.{label}, c.count{pct_col},
               row_number() OVER (PARTITION BY c.app_id ORDER BY c.count DESC, c.ord) AS rank
        FROM c JOIN tt t USING (app_id) WHERE c.count >= {min_count})"""


SQL: dict[str, str] = {}

SQL["ingest_reviews"] = w() + f"""
SELECT app_id, review_id, {_iso_ts('date')} AS date, rating, review_text, thumbs_up, app_version FROM reviews"""

SQL["quarantine_reviews"] = w() + """
SELECT app_id, review_id, 'rating_out_of_range' AS reason FROM raw WHERE rating NOT BETWEEN 1 AND 5"""

SQL["scope_recent"] = w() + f"""
SELECT app_id, review_id, rating FROM reviews
WHERE date >= (SELECT max(date) FROM reviews) - INTERVAL {REG.RECENT_DAYS} DAY"""

SQL["scope_newest_n"] = w() + f"""
SELECT app_id, review_id, rating FROM (
  SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY date DESC, review_id) AS rn FROM reviews)
WHERE rn <= {REG.NEWEST_N}"""

_TIED = """,
tied AS (SELECT CASE WHEN right(app_id, 1) <> '4' THEN app_id END AS app_id,
                CASE WHEN CAST(review_id AS BIGINT) % 10 <> 0 THEN lpad(CAST(CAST(review_id AS BIGINT) % 50 AS VARCHAR), 3, '0') END AS review_id,
                date_trunc('day', date) AS date FROM reviews),
tr AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY date DESC, coalesce(review_id, '')) AS rn,
              count(*) OVER (PARTITION BY app_id) AS n FROM tied)
SELECT app_id, strftime(date, '%Y-%m-%d') AS day, review_id, count(*) AS n_rows FROM tr WHERE """
SQL["scope_newest_n_ties"] = w() + _TIED + f"rn <= {REG.NEWEST_N} GROUP BY ALL"
SQL["recent_slice_ties"] = w() + _TIED + "rn <= greatest(50, floor(n * 0.2)) GROUP BY ALL"

_DIRTY = """,
d0 AS (SELECT *, CAST(review_id AS BIGINT) AS k FROM raw),
dirty AS (SELECT CASE WHEN k % 17 <> 0 THEN app_id END AS app_id, review_id,
                 CASE k % 11 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 0 WHEN 4 THEN 6 ELSE rating END AS rating,
                 CASE WHEN k % 13 <> 0 THEN date END AS date, content,
                 CASE WHEN k % 19 <> 0 THEN thumbs_up END AS thumbs_up FROM d0)"""
SQL["ingest_dirty"] = w() + _DIRTY + f"""
SELECT app_id, review_id, {_iso_ts('date')} AS date, rating, thumbs_up FROM dirty
WHERE app_id IS NOT NULL AND rating BETWEEN 1 AND 5 AND date IS NOT NULL AND regexp_replace(content, '^\\s+|\\s+$', '', 'g') <> ''"""
SQL["quarantine_dirty"] = w() + _DIRTY + """
SELECT * FROM (SELECT app_id, review_id, CASE WHEN app_id IS NULL THEN 'app_id_missing' WHEN rating IS NULL THEN 'rating_missing_or_not_numeric'
       WHEN rating NOT BETWEEN 1 AND 5 THEN 'rating_out_of_range' WHEN date IS NULL THEN 'timestamp_unparsable' END AS reason FROM dirty)
WHERE reason IS NOT NULL"""
SQL["scope_preset_dated"] = w() + f"""
SELECT app_id, review_id, rating FROM (
  SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY date DESC, review_id) AS rn FROM raw
  WHERE date >= (SELECT max(date) FROM raw) - INTERVAL {REG.RECENT_DAYS} DAY)
WHERE rn <= {REG.NEWEST_N // 10} AND regexp_replace(content, '^\\s+|\\s+$', '', 'g') <> ''"""

_days, _cap = tx.SCOPE_PRESETS["All recent"]
SQL["scope_preset"] = w() + f"""
SELECT app_id, review_id, rating FROM (
  SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY date DESC, review_id) AS rn FROM raw)
WHERE rn <= {_cap} AND regexp_replace(content, '^\\s+|\\s+$', '', 'g') <> ''"""

_INFO = """
info AS (
  SELECT n, 'com.example.app' || CAST(n AS VARCHAR) AS app_id,
         CASE WHEN n = 1 THEN NULL WHEN n = 2 THEN '' ELSE 'Example App ' || CAST(n AS VARCHAR) END AS title,
         genre,
         CASE WHEN n = 3 THEN NULL ELSE 'Used by ' || CAST(users AS VARCHAR) || ' people. ' || repeat('Fast, simple, reliable. ', 12) END AS summary,
         store_rating, total_ratings
  FROM (SELECT CAST(user_id % 5 AS INTEGER) AS n, round_even(avg(value), 1) AS store_rating, count(*) AS total_ratings,
               count(DISTINCT user_id) AS users, min(event_type) AS genre
        FROM events WHERE user_id % 5 < 4 GROUP BY 1)),
st AS (SELECT app_id, count(*) AS n_reviews, min(date) AS first_date, max(date) AS last_date FROM reviews GROUP BY app_id)"""

SQL["app_header"] = w(_INFO) + f"""
SELECT st.app_id,
       coalesce(nullif(info.title, ''), st.app_id) AS title,
       coalesce(info.genre, '') AS genre,
       left(coalesce(info.summary, ''), 200) AS summary,
       info.store_rating, info.total_ratings, st.n_reviews,
       format('{{:,}}', st.n_reviews) AS n_reviews_text,
       {_iso_date('st.first_date')} AS first_date, {_iso_date('st.last_date')} AS last_date,
       date_sub('day', st.first_date, st.last_date) AS span_days,
       CASE WHEN date_sub('day', st.first_date, st.last_date) = 0 THEN strftime(st.last_date, '%d %b %Y')
            WHEN date_sub('day', st.first_date, st.last_date) <= 60 THEN strftime(st.first_date, '%d %b') || '–' || strftime(st.last_date, '%d %b %Y')
            ELSE strftime(st.first_date, '%b %Y') || '–' || strftime(st.last_date, '%b %Y') END AS date_range
FROM st LEFT JOIN info USING (app_id)"""

_URLS = """
urls AS (
  SELECT event_id, CASE event_id % 6
    WHEN 0 THEN 'https://store.example.com/details?id=' || p || '&hl=en_IN'
    WHEN 1 THEN 'https://store.example.com/details?hl=en_GB&id=' || p || '#top'
    WHEN 2 THEN p
    WHEN 3 THEN '  https://store.example.com/details?id=' || p || '&hl=xx_YY '
    WHEN 4 THEN 'store.example.com/details?id=com%2Eexample%2Ex'
    ELSE 'https://store.example.com/details?x=1' END AS url
  FROM (SELECT event_id, 'com.example.app' || CAST(user_id % 5 AS VARCHAR) AS p FROM events))"""


def _qparam(url: str, key: str) -> str:
    return f"url_decode(nullif(regexp_extract(split_part(trim({url}), '#', 1), '[?&]{key}=([^&#]+)', 1), ''))"


SQL["package_id"] = "WITH " + _URLS.strip() + f"""
SELECT event_id,
       CASE WHEN NOT regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT starts_with(trim(url), '//')
                 AND contains(trim(url), '.') AND NOT contains(trim(url), '/') THEN trim(url)
            ELSE {_qparam('url', 'id')} END AS package_id
FROM urls"""

SQL["country_hint"] = "WITH " + _URLS.strip() + f"""
SELECT event_id, {_map_case(f"lower({_qparam('url', 'hl')})", tx.HL_TO_COUNTRY, 'NULL')} AS country FROM urls"""

SQL["url_param"] = f"""
SELECT page_id, {_qparam('url', 'page')} AS page, {_qparam('url', 'ref')} AS ref FROM pages"""

SQL["truncate_text"] = f"SELECT doc_id, {_cut('text', 110)} AS preview FROM documents"

SQL["tag_complaints"] = w(CKW, CTAG) + "\nSELECT app_id, review_id, theme FROM ctag"
SQL["tag_complaints_words"] = w(CKW) + r"""
SELECT DISTINCT r.app_id, r.review_id, k.grp AS theme FROM reviews r JOIN ckw k
ON contains(lower(r.review_text), k.kw)
WHERE CASE WHEN contains(lower(r.review_text), k.kw) THEN regexp_matches(lower(r.review_text), '(^|[^\p{L}\p{N}_])' || regexp_escape(k.kw) || '($|[^\p{L}\p{N}_])') END"""
SQL["tag_praise"] = w(PKW) + f"\nSELECT app_id, review_id, theme FROM ({_kw_tag('reviews', 'pkw')})"
SQL["tag_features"] = w(FKW) + f"\nSELECT app_id, review_id, theme FROM ({_kw_tag('reviews', 'fkw')})"
SQL["flag_requests"] = w(REQ) + """
SELECT r.app_id, r.review_id, EXISTS (SELECT 1 FROM req q WHERE contains(lower(r.review_text), q.kw)) AS is_request
FROM reviews r"""

SQL["top_negative_phrases"] = w(NEG) + """
SELECT app_id, phrase, count, rank FROM (
  SELECT app_id, phrase, count, row_number() OVER (PARTITION BY app_id ORDER BY count DESC, ord) AS rank FROM (
    SELECT r.app_id, n.kw AS phrase, n.ord, count(*) AS count
    FROM reviews r JOIN negp n ON contains(lower(r.review_text), n.kw)
    WHERE r.rating IN (1, 2) GROUP BY r.app_id, n.kw, n.ord))
WHERE rank <= 12"""

SQL["sentiment"] = "WITH " + _sentiment("documents", ["doc_id"], "text", "dsent").strip("\n") + f"""
SELECT doc_id, round_even(compound, 3) AS sentiment_score, {_label('compound')} AS sentiment_label FROM dsent"""

_DOC_KW = [(g, i, k) for i, (g, kws) in enumerate(REG.DOC_TAXONOMY.items()) for k in kws]
SQL["tag_by_table"] = f"""
WITH dkw(grp, ord, kw) AS (VALUES {_values(_DOC_KW)})
SELECT DISTINCT d.doc_id, k.grp AS "group", CAST(k.ord AS INTEGER) AS ordinal
FROM documents d JOIN dkw k ON contains(lower(coalesce(d.text, '')), k.kw)"""

SQL["theme_summary"] = w(CKW, CTAG) + f"""
, tot AS (SELECT app_id, count(*) AS n FROM reviews GROUP BY app_id)
SELECT t.app_id, t.theme, count(*) AS mentions, {_pct('count(*)', 'max(tot.n)')} AS pct_of_reviews,
       row_number() OVER (PARTITION BY t.app_id ORDER BY count(*) DESC, min(t.ord)) AS rank
FROM ctag t JOIN tot USING (app_id) GROUP BY t.app_id, t.theme"""

SQL["theme_samples"] = w(CKW, CTAG) + """
SELECT app_id, theme, rank, review_id, rating FROM (
  SELECT t.app_id, t.theme, r.review_id, r.rating,
         row_number() OVER (PARTITION BY t.app_id, t.theme ORDER BY r.rating, r.date DESC, r.review_id) AS rank
  FROM ctag t JOIN reviews r USING (app_id, review_id))
WHERE rank <= 3"""

SQL["recent_slice"] = w(FLAG) + "\nSELECT app_id, review_id, rating FROM flag WHERE is_recent"

SQL["rising_themes"] = w(CKW, CTAG, FLAG, THEME_AGG) + f"""
SELECT x.*, row_number() OVER (PARTITION BY app_id ORDER BY change DESC, (SELECT min(t.ord) FROM ctag t WHERE t.theme = x.theme)) AS rank FROM (
  SELECT th.app_id, th.theme, {_pct('th.mentions', 'tot.n')} AS overall_pct,
         {_pct('th.recent_mentions', 'tot.n_recent')} AS recent_pct,
         round_even({_pct('th.recent_mentions', 'tot.n_recent')} - {_pct('th.mentions', 'tot.n')}, 1) AS change
  FROM th JOIN tot USING (app_id)) x
WHERE change > 0"""

SQL["key_signals"] = _key_signals(3.0, 5)
SQL["key_signals_strict"] = _key_signals(5.0, 8)

SQL["signal_snippets"] = w(CKW, CTAG, FLAG) + f"""
SELECT app_id, theme, rank, review_id, {_cut('review_text', 130)} AS snippet FROM (
  SELECT t.app_id, t.theme, f.review_id, f.review_text,
         row_number() OVER (PARTITION BY t.app_id, t.theme ORDER BY f.rating, f.date DESC, f.review_id) AS rank
  FROM ctag t JOIN flag f USING (app_id, review_id) WHERE f.is_recent)
WHERE rank <= 2"""

SQL["praised_strengths"] = w(PKW, "hi AS (SELECT * FROM reviews WHERE rating IN (4, 5))",
                             _tagged_counts("hi", "pkw", "theme", 3, 5, True)) + """
SELECT app_id, theme, count, pct_of_positive, rank FROM rk2 WHERE rank <= 5"""

SQL["product_opportunities"] = w(FKW, REQ, REQ_ROWS, _tagged_counts("reqrows", "fkw", "request", 2, 6, False)) + """
SELECT app_id, request, count, rank FROM rk2 WHERE rank <= 6"""

_MIXED = """
tl AS (SELECT app_id, count(*) FILTER (WHERE rating IN (1, 2)) AS n_low FROM reviews GROUP BY app_id),
mc AS (SELECT t.app_id, t.theme AS area, min(t.ord) AS ord,
              count(*) FILTER (WHERE r.rating IN (1, 2)) AS low_count,
              count(*) FILTER (WHERE r.rating IN (4, 5)) AS high_count
       FROM ctag t JOIN reviews r USING (app_id, review_id) GROUP BY t.app_id, t.theme)"""

SQL["mixed_areas"] = w(CKW, CTAG, _MIXED) + """
SELECT app_id, area, low_count, high_count, rank FROM (
  SELECT mc.app_id, area, low_count, high_count,
         row_number() OVER (PARTITION BY mc.app_id ORDER BY low_count + high_count DESC, ord) AS rank
  FROM mc JOIN tl USING (app_id)
  WHERE low_count >= 3 AND high_count >= 3
    AND round_even(CAST(100.0 AS DOUBLE) * low_count / greatest(n_low, 1), 1) >= 2)
WHERE rank <= 4"""

SQL["strength_samples"] = w(PKW, "hi AS (SELECT * FROM reviews WHERE rating IN (4, 5))",
                            f"tg AS ({_kw_tag('hi', 'pkw')})") + f"""
SELECT app_id, theme, rank, review_id, {_cut('review_text', 110)} AS sample FROM (
  SELECT t.app_id, t.theme, h.review_id, h.review_text,
         row_number() OVER (PARTITION BY t.app_id, t.theme ORDER BY h.thumbs_up DESC NULLS LAST, h.date DESC, h.review_id) AS rank
  FROM tg t JOIN hi h USING (app_id, review_id))
WHERE rank <= 2"""

SQL["opportunity_samples"] = w(FKW, REQ, REQ_ROWS, f"tg AS ({_kw_tag('reqrows', 'fkw', 'request')})") + f"""
SELECT app_id, request, rank, review_id, {_cut('review_text', 110)} AS sample FROM (
  SELECT t.app_id, t.request, h.review_id, h.review_text,
         row_number() OVER (PARTITION BY t.app_id, t.request ORDER BY h.thumbs_up DESC NULLS LAST, h.date DESC, h.review_id) AS rank
  FROM tg t JOIN reqrows h USING (app_id, review_id))
WHERE rank <= 2"""

SQL["mixed_samples"] = w(CKW, CTAG) + f"""
SELECT app_id, area, side, review_id, {_cut('review_text', 100)} AS sample FROM (
  SELECT t.app_id, t.theme AS area, 'negative' AS side, r.review_id, r.review_text,
         row_number() OVER (PARTITION BY t.app_id, t.theme ORDER BY r.rating, r.date DESC, r.review_id) AS rk
  FROM ctag t JOIN reviews r USING (app_id, review_id) WHERE r.rating IN (1, 2)
  UNION ALL
  SELECT t.app_id, t.theme AS area, 'positive' AS side, r.review_id, r.review_text,
         row_number() OVER (PARTITION BY t.app_id, t.theme ORDER BY r.rating DESC, r.date DESC, r.review_id) AS rk
  FROM ctag t JOIN reviews r USING (app_id, review_id) WHERE r.rating IN (4, 5))
WHERE rk = 1"""

SQL["sentiment_topk"] = w(ENR) + f"""
SELECT app_id, sentiment_label, rank, review_id FROM (
  SELECT app_id, sentiment_label, review_id,
         row_number() OVER (PARTITION BY app_id, sentiment_label ORDER BY thumbs_up DESC NULLS LAST, date DESC, review_id) AS rank
  FROM enr WHERE sentiment_label IN ('Negative', 'Positive'))
WHERE rank <= {tx.CORPUS_PER_BUCKET}"""

SQL["investigate"] = w(CKW, CTAG) + f"""
SELECT app_id, theme, rank, review_id FROM (
  SELECT t.app_id, t.theme, r.review_id,
         row_number() OVER (PARTITION BY t.app_id, t.theme ORDER BY r.date, r.review_id) AS rank
  FROM ctag t JOIN reviews r USING (app_id, review_id))
WHERE rank <= {tx.DRILL_CAP}"""

SQL["filter_rating_bucket"] = w() + "\n" + _ids("rating = 3")
SQL["filter_requests"] = w(REQ, REQ_ROWS) + "\nSELECT app_id, review_id, rating FROM reqrows"
_CHIP_GROUPS = [g for c in ("Crash", "Login") for g in tx.THEME_CHIPS[c]]
SQL["filter_theme_chips"] = w(CKW, CTAG) + f"""
SELECT app_id, review_id, rating FROM reviews r
WHERE EXISTS (SELECT 1 FROM ctag t WHERE t.app_id = r.app_id AND t.review_id = r.review_id AND t.theme IN {_in_list(_CHIP_GROUPS)})"""
SQL["theme_reviews"] = SQL["tag_complaints"]
SQL["keyword_reviews"] = SQL["tag_features"]
SQL["search_reviews"] = w() + "\n" + _ids(f"regexp_matches(review_text, {_lit(REG.SEARCH_QUERY)}, 'i')")
SQL["filter_date_range"] = w() + "\n" + _ids(
    f"date >= TIMESTAMP '{REG.DATE_RANGE[0]}' AND date < TIMESTAMP '{REG.DATE_RANGE[1]}' + INTERVAL 1 DAY")
SQL["filter_stars"] = w() + "\n" + _ids(f"rating IN {_in_list(REG.STARS)}")

_HEAD = {k: v[0] for k, v in tx.SIGNAL_FRAMING.items()}
_CTX = {k: v[1] for k, v in tx.SIGNAL_FRAMING.items()}


def _num_text(c: str) -> str:
    # Spark's double -> string keeps one decimal for whole numbers (3.0)
    return f"CAST({c} AS VARCHAR)"


SQL["signal_cards"] = w(CKW, CTAG, FLAG, THEME_AGG) + f""",
ks AS ({_key_signals(5.0, 8).split(THEME_AGG, 1)[1].strip()}),
sn AS (SELECT app_id, theme, rank, {_cut('review_text', 130)} AS snippet FROM (
  SELECT t.app_id, t.theme, f.review_text,
         row_number() OVER (PARTITION BY t.app_id, t.theme ORDER BY f.rating, f.date DESC, f.review_id) AS rank
  FROM ctag t JOIN flag f USING (app_id, review_id) WHERE f.is_recent) WHERE rank <= 2),
sw AS (SELECT app_id, theme, max(CASE WHEN rank = 1 THEN snippet END) AS snippet_1,
              max(CASE WHEN rank = 2 THEN snippet END) AS snippet_2 FROM sn GROUP BY app_id, theme)
SELECT ks.app_id, ks.complaint,
       CASE WHEN is_critical THEN 'critical' ELSE 'emerging' END AS kind,
       {_map_case('ks.complaint', _HEAD, 'ks.complaint')} AS headline,
       {_map_case('ks.complaint', _CTX, "''")} AS context,
       CASE WHEN is_critical THEN {_map_case('ks.complaint', tx.INVESTIGATION_HINTS, _lit(tx.DEFAULT_HINT))} END AS hint,
       recent_count, change, avg_rating, days_ago,
       CASE WHEN days_ago > 0 THEN 'Spiked ' || CAST(days_ago AS VARCHAR) || 'd ago' ELSE 'Recently spiking' END AS days_text,
       CASE WHEN avg_rating <= 1.5 THEN 'Mostly 1-star' ELSE 'Avg ' || {_num_text('avg_rating')} || '★' END AS star_text,
       '+' || {_num_text('change')} || 'pp vs baseline' AS change_text,
       {_tier('recent_count')} AS confidence,
       sw.snippet_1, sw.snippet_2, mentions AS related_count
FROM ks LEFT JOIN sw ON sw.app_id = ks.app_id AND sw.theme = ks.complaint"""


def _library(primary: str, chips: list[str]) -> str:
    pred = {"All Reviews": "TRUE", "Negative": "rating IN (1, 2)", "Mixed": "rating = 3",
            "Positive": "rating IN (4, 5)"}[primary]
    groups = [g for c in chips for g in tx.THEME_CHIPS[c]]
    chip_pred = (f"EXISTS (SELECT 1 FROM ctag t WHERE t.app_id = r.app_id AND t.review_id = r.review_id "
                 f"AND t.theme IN {_in_list(groups)})") if groups else "TRUE"
    return w(CKW, CTAG, FLAG, THEME_AGG) + f""",
fr AS (SELECT * FROM reviews r WHERE {pred} AND {chip_pred}),
fn AS (SELECT app_id, count(*) AS n FROM fr GROUP BY app_id),
fc AS (SELECT t.app_id, t.theme, count(*) AS mentions, avg(f.rating) AS avg_r
       FROM ctag t JOIN fr f USING (app_id, review_id) GROUP BY t.app_id, t.theme),
rise AS (SELECT th.app_id, th.theme FROM th JOIN tot USING (app_id)
         WHERE round_even({_pct('th.recent_mentions', 'tot.n_recent')} - {_pct('th.mentions', 'tot.n')}, 1) > 0),
smp AS (SELECT app_id, theme, max(CASE WHEN rank = 1 THEN s END) AS sample_1, max(CASE WHEN rank = 2 THEN s END) AS sample_2
        FROM (SELECT t.app_id, t.theme, {_cut('f.review_text', 110)} AS s,
                     row_number() OVER (PARTITION BY t.app_id, t.theme ORDER BY f.rating, f.date DESC, f.review_id) AS rank
              FROM ctag t JOIN fr f USING (app_id, review_id)) WHERE rank <= 2 GROUP BY app_id, theme)
SELECT fc.app_id, fc.theme, fc.mentions, fn.n AS scope_reviews,
       {_pct('fc.mentions', 'fn.n')} AS pct_of_reviews,
       round_even(fc.avg_r, 1) AS avg_rating,
       CASE WHEN 100.0 * fc.mentions / greatest(fn.n, 1) >= 20 THEN 'Very frequently mentioned · ' || CAST(fc.mentions AS VARCHAR) || ' reviews'
            WHEN 100.0 * fc.mentions / greatest(fn.n, 1) >= 10 THEN 'Frequently mentioned · ' || CAST(fc.mentions AS VARCHAR) || ' reviews'
            WHEN 100.0 * fc.mentions / greatest(fn.n, 1) >= 5 THEN 'Commonly mentioned · ' || CAST(fc.mentions AS VARCHAR) || ' reviews'
            ELSE 'Mentioned in ' || CAST(fc.mentions AS VARCHAR) || ' reviews' END AS frequency_label,
       CASE WHEN fc.avg_r <= 1.5 THEN 'Almost all 1-star reviews' WHEN fc.avg_r <= 2.0 THEN 'Mostly 1-2 star reviews'
            WHEN fc.avg_r <= 2.5 THEN 'Mostly low-rated reviews' WHEN fc.avg_r <= 3.5 THEN 'Mixed star ratings'
            ELSE 'Appears even in positive reviews' END AS rating_label,
       rise.theme IS NOT NULL AS is_rising,
       {_tier('fc.mentions')} AS confidence,
       smp.sample_1, smp.sample_2
FROM fc JOIN fn USING (app_id)
LEFT JOIN rise ON rise.app_id = fc.app_id AND rise.theme = fc.theme
LEFT JOIN smp ON smp.app_id = fc.app_id AND smp.theme = fc.theme"""


SQL["theme_library"] = _library("All Reviews", [])
SQL["theme_library_filtered"] = _library(REG.LIBRARY_PRIMARY, REG.LIBRARY_CHIPS)


def _cards(kind: str) -> str:
    if kind == "opp":
        head = w(FKW, REQ, REQ_ROWS, _tagged_counts("reqrows", "fkw", "request", 4, 5, False))
        label, src, kw = "request", "reqrows", "fkw"
        extra = (f"'📝 ' || CAST(c.count AS VARCHAR) || ' users requesting' AS count_text")
        cols = "c.app_id, c.request, c.count, c.rank"
    else:
        head = w(PKW, "hi AS (SELECT * FROM reviews WHERE rating IN (4, 5))",
                 _tagged_counts("hi", "pkw", "theme", 5, 4, True))
        label, src, kw = "theme", "hi", "pkw"
        extra = ("'Mentioned in ' || CAST(c.pct_of_positive AS VARCHAR) || "
                 "'% of positive reviews — protect this in every release.' AS subtitle")
        cols = "c.app_id, c.theme, c.count, c.pct_of_positive, c.rank"
    top_n = 5 if kind == "opp" else 4
    return head + f""",
sm AS (SELECT app_id, {label}, {_cut('review_text', 110)} AS sample_1 FROM (
  SELECT t.app_id, t.{label}, h.review_text,
         row_number() OVER (PARTITION BY t.app_id, t.{label} ORDER BY h.thumbs_up DESC NULLS LAST, h.date DESC, h.review_id) AS rn
  FROM tg t JOIN {src} h USING (app_id, review_id)) WHERE rn = 1),
rel AS (SELECT app_id, {label}, count(*) AS related_count FROM ({_kw_tag('reviews', kw, label)}) GROUP BY app_id, {label})
SELECT {cols}, {extra}, {_tier('c.count')} AS confidence, sm.sample_1,
       coalesce(rel.related_count, 0) AS related_count
FROM rk2 c LEFT JOIN sm ON sm.app_id = c.app_id AND sm.{label} = c.{label}
LEFT JOIN rel ON rel.app_id = c.app_id AND rel.{label} = c.{label}
WHERE c.rank <= {top_n}"""


SQL["opportunity_cards"] = _cards("opp")
SQL["strength_cards"] = _cards("str")


def _explorer(pred: str, chips: list[str], search: str | None, extra_ctes: tuple = ()) -> str:
    groups = [g for c in chips for g in tx.THEME_CHIPS[c]]
    chip_pred = (f"EXISTS (SELECT 1 FROM ctag t WHERE t.app_id = r.app_id AND t.review_id = r.review_id "
                 f"AND t.theme IN {_in_list(groups)})") if groups else "TRUE"
    search_pred = f"regexp_matches(r.review_text, {_lit(search)}, 'i')" if search else "TRUE"
    return w(CKW, CTAG, *extra_ctes) + f""",
th2 AS (SELECT app_id, review_id, string_agg(theme, ', ' ORDER BY ord) AS themes FROM ctag GROUP BY app_id, review_id)
SELECT r.app_id, row_number() OVER (PARTITION BY r.app_id ORDER BY r.date DESC, r.review_id) AS rank, r.review_id,
       {_iso_ts('r.date')} AS "time", {_iso_date('r.date')} AS "Date", r.rating AS "Rating", coalesce(th2.themes, '—') AS "Theme",
       r.review_text AS "Review"
FROM reviews r LEFT JOIN th2 USING (app_id, review_id)
WHERE {pred} AND {chip_pred} AND {search_pred}"""


SQL["explorer"] = _explorer("TRUE", REG.EXPLORER_CHIPS, REG.EXPLORER_QUERY)
SQL["export_filtered"] = _explorer(
    "r.rating IN (4, 5) AND EXISTS (SELECT 1 FROM req q WHERE contains(lower(r.review_text), q.kw))", [], None, (REQ,))

SQL["export_all"] = w(CKW, CTAG, ENR) + f""",
th2 AS (SELECT app_id, review_id, string_agg(theme, ', ' ORDER BY ord) AS themes FROM ctag GROUP BY app_id, review_id)
SELECT e.app_id, row_number() OVER (PARTITION BY e.app_id ORDER BY e.date DESC, e.review_id) AS rank, e.review_id,
       {_iso_date('e.date')} AS date, e.rating, e.sentiment_label,
       coalesce(th2.themes, '') AS complaint_categories, e.review_text
FROM enr e LEFT JOIN th2 USING (app_id, review_id)"""

SQL["review_cards"] = w(CKW, CTAG) + f"""
SELECT app_id, theme, rank, review_id, repeat('★', rating) || repeat('☆', 5 - rating) AS stars,
       coalesce(strftime(date, '%d %b %Y'), '') AS date_text, review_text FROM (
  SELECT t.app_id, t.theme, r.review_id, r.rating, r.date, r.review_text,
         row_number() OVER (PARTITION BY t.app_id, t.theme ORDER BY r.date DESC, r.review_id) AS rank
  FROM ctag t JOIN reviews r USING (app_id, review_id))
WHERE rank <= {tx.DRILL_CAP}"""

SQL["signal_coverage"] = w(CKW, CTAG, FLAG, THEME_AGG, PKW, FKW, REQ, REQ_ROWS,
                           "hi AS (SELECT * FROM reviews WHERE rating IN (4, 5))") + f""",
ks AS ({_key_signals(5.0, 8).split(THEME_AGG, 1)[1].strip()}),
op AS (SELECT app_id, count(*) AS n FROM (
         SELECT app_id, request, count(*) AS c FROM ({_kw_tag('reqrows', 'fkw', 'request')}) GROUP BY app_id, request)
       WHERE c >= 4 GROUP BY app_id),
sp AS (SELECT app_id, count(*) AS n FROM (
         SELECT app_id, theme, count(*) AS c FROM ({_kw_tag('hi', 'pkw')}) GROUP BY app_id, theme)
       WHERE c >= 5 GROUP BY app_id),
ksn AS (SELECT app_id, count(*) FILTER (WHERE is_critical) AS n_critical,
               count(*) FILTER (WHERE NOT is_critical) AS n_emerging FROM ks GROUP BY app_id),
sp2 AS (SELECT app_id, count(*) AS n_reviews FROM reviews GROUP BY app_id),
cv AS (SELECT sp2.app_id, sp2.n_reviews, coalesce(ksn.n_critical, 0) AS n_critical, coalesce(ksn.n_emerging, 0) AS n_emerging,
              least(coalesce(op.n, 0), 5) AS n_opportunities, least(coalesce(sp.n, 0), 4) AS n_strengths
       FROM sp2 LEFT JOIN ksn USING (app_id) LEFT JOIN op USING (app_id) LEFT JOIN sp USING (app_id))
SELECT *, (n_critical + n_emerging + n_opportunities + n_strengths) > 0 AS enough_signal,
       CASE WHEN (n_critical + n_emerging + n_opportunities + n_strengths) > 0 THEN NULL
            ELSE 'Not enough signal in this review sample. Try a wider time scope.' END AS message
FROM cv"""

SQL["sentiment_corpus"] = w(ENR) + f""",
tk AS (SELECT * FROM (
  SELECT app_id, sentiment_label, review_text,
         row_number() OVER (PARTITION BY app_id, sentiment_label ORDER BY thumbs_up DESC NULLS LAST, date DESC, review_id) AS rank
  FROM enr WHERE sentiment_label IN ('Negative', 'Positive')) WHERE rank <= {tx.CORPUS_PER_BUCKET}),
bl AS (SELECT app_id, sentiment_label, string_agg('- ' || review_text, chr(10) ORDER BY rank) AS block, count(*) AS n
       FROM tk GROUP BY app_id, sentiment_label),
sp AS (SELECT DISTINCT app_id FROM reviews)
SELECT sp.app_id, coalesce(ng.n, 0) AS n_negative, coalesce(ps.n, 0) AS n_positive,
       coalesce(ng.block, '(no negative reviews in this selection)') AS negative_block,
       coalesce(ps.block, '(no positive reviews in this selection)') AS positive_block
FROM sp LEFT JOIN bl ng ON ng.app_id = sp.app_id AND ng.sentiment_label = 'Negative'
LEFT JOIN bl ps ON ps.app_id = sp.app_id AND ps.sentiment_label = 'Positive'"""

SQL["scope_counts"] = w(CKW, CTAG) + f""",
tg2 AS (SELECT app_id, review_id, bool_or(theme IN {_in_list(tx.THEME_CHIPS['Crash'])}) AS crash, count(*) AS k
        FROM ctag GROUP BY app_id, review_id)
SELECT r.app_id, count(*) AS total,
       count(*) FILTER (WHERE r.rating IN (1, 2) AND coalesce(t.crash, FALSE)) AS filtered,
       count(*) FILTER (WHERE r.rating IN (1, 2) AND coalesce(t.crash, FALSE) AND regexp_matches(r.review_text, 'crash', 'i')) AS searched,
       count(*) FILTER (WHERE t.k IS NOT NULL) AS tagged
FROM reviews r LEFT JOIN tg2 t USING (app_id, review_id) GROUP BY r.app_id"""

SQL["rating_distribution"] = w() + f""",
st AS (SELECT app_id, count(*) AS n FROM reviews GROUP BY app_id),
stars(rating) AS (VALUES (1), (2), (3), (4), (5)),
c AS (SELECT app_id, rating, count(*) AS count FROM reviews GROUP BY app_id, rating)
SELECT st.app_id, CAST(stars.rating AS INTEGER) AS rating, coalesce(c.count, 0) AS count,
       {_pct('coalesce(c.count, 0)', 'st.n')} AS pct
FROM st CROSS JOIN stars LEFT JOIN c ON c.app_id = st.app_id AND c.rating = stars.rating"""

SQL["sentiment_trend"] = w(ENR) + f"""
SELECT app_id, count(*) AS reviews, CAST(sum(CAST(round_even(sentiment_score * 1000, 0) AS BIGINT)) AS BIGINT) / count(*) / 1000.0 AS avg_sentiment,
       count(*) FILTER (WHERE sentiment_label = 'Positive') AS n_positive,
       count(*) FILTER (WHERE sentiment_label = 'Negative') AS n_negative,
       round_even(avg(rating), 2) AS avg_rating,
       {_iso_date("date_trunc('day', date)")} AS period
FROM enr GROUP BY app_id, date_trunc('day', date)"""



def _filled_trend(unit: str, where: str, *ctes: str) -> str:
    return w(*ctes, ENR) + f""",
agg AS (
  SELECT app_id, CAST(date_trunc('{unit}', date) AS DATE) AS b, count(*) AS reviews,
         CAST(sum(CAST(round_even(sentiment_score * 1000, 0) AS BIGINT)) AS BIGINT) / count(*) / 1000.0 AS avg_sentiment,
         count(*) FILTER (WHERE sentiment_label = 'Positive') AS n_positive,
         count(*) FILTER (WHERE sentiment_label = 'Negative') AS n_negative, round_even(avg(rating), 2) AS avg_rating
  FROM enr WHERE {where} GROUP BY ALL),
cal AS (SELECT app_id, CAST(unnest(generate_series(min(b), max(b), INTERVAL 1 {unit})) AS DATE) AS b FROM agg GROUP BY app_id)
SELECT cal.app_id, coalesce(reviews, 0) AS reviews, avg_sentiment, coalesce(n_positive, 0) AS n_positive,
       coalesce(n_negative, 0) AS n_negative, avg_rating, {_iso_date('cal.b')} AS period
FROM cal LEFT JOIN agg USING (app_id, b)"""


SQL["sentiment_trend_week"] = _filled_trend("week", "TRUE")
SQL["sentiment_trend_month"] = _filled_trend("month", "TRUE")
SQL["sentiment_trend_filled"] = _filled_trend(
    "day", f"day(date) % 3 <> 0 AND EXISTS (SELECT 1 FROM ctag t WHERE t.app_id = enr.app_id AND t.review_id = enr.review_id "
    f"AND t.theme IN {_in_list(tx.THEME_CHIPS['Login'])})", CKW, CTAG)

SQL["review_table"] = w(ENR) + f"""
SELECT app_id, review_id, {_iso_date('date')} AS date, rating, sentiment_score, sentiment_label, review_text FROM enr"""

_A, _B = REG.COMPARE
SQL["compare_apps"] = w(CKW, CTAG) + f""",
tot AS (SELECT app_id, count(*) AS n FROM reviews GROUP BY app_id),
s AS (SELECT t.app_id, t.theme, count(*) AS mentions, {_pct('count(*)', 'max(tot.n)')} AS pct
      FROM ctag t JOIN tot USING (app_id) GROUP BY t.app_id, t.theme),
a AS (SELECT * FROM s WHERE app_id = {_lit(_A)}),
b AS (SELECT * FROM s WHERE app_id = {_lit(_B)})
SELECT {_lit(_A)} AS app_a, {_lit(_B)} AS app_b, coalesce(a.theme, b.theme) AS theme,
       coalesce(a.mentions, 0) AS mentions_a, coalesce(b.mentions, 0) AS mentions_b,
       coalesce(a.pct, CAST(0.0 AS DOUBLE)) AS pct_a, coalesce(b.pct, CAST(0.0 AS DOUBLE)) AS pct_b,
       round_even(coalesce(a.pct, CAST(0.0 AS DOUBLE)) - coalesce(b.pct, CAST(0.0 AS DOUBLE)), 1) AS delta
FROM a FULL OUTER JOIN b ON a.theme = b.theme"""

SQL["theme_by_version"] = w(CKW, CTAG) + f""",
vt AS (SELECT app_id, app_version, count(*) AS n FROM reviews GROUP BY app_id, app_version)
SELECT r.app_id, r.app_version, t.theme, count(*) AS mentions, max(vt.n) AS version_reviews,
       {_pct('count(*)', 'max(vt.n)')} AS pct_of_reviews, round_even(avg(r.rating), 1) AS avg_rating
FROM ctag t JOIN reviews r USING (app_id, review_id) JOIN vt ON vt.app_id = r.app_id AND vt.app_version = r.app_version
GROUP BY r.app_id, r.app_version, t.theme"""

SQL["sample_adequacy"] = w() + f"""
SELECT app_id, count(*) AS n_reviews, count(*) >= {tx.MIN_SAMPLE} AS adequate FROM reviews GROUP BY app_id"""

SQL["stream_theme_counts"] = w(CKW, CTAG) + f"""
SELECT t.app_id, strftime(date_trunc('day', r.date), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(date_trunc('day', r.date) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       t.theme, count(*) AS mentions
FROM ctag t JOIN reviews r USING (app_id, review_id)
GROUP BY ALL"""

def _reply_items(key: str) -> str:
    v = f"json_extract(v, '$.{key}')"
    text = "CASE json_type(e) WHEN 'VARCHAR' THEN json_extract_string(e, '$') ELSE CAST(e AS VARCHAR) END"
    return (f"CASE WHEN v IS NULL OR json_type(v) <> 'OBJECT' THEN NULL WHEN {v} IS NULL OR json_type({v}) = 'NULL' THEN []::VARCHAR[] "
            f"ELSE list_transform(list_filter(CASE json_type({v}) WHEN 'ARRAY' THEN CAST({v} AS JSON[]) ELSE [{v}] END, "
            f"lambda e: json_type(e) <> 'NULL'), lambda e: {text}) END")


SQL["parse_insights"] = f"""
WITH ev AS (
  SELECT CASE user_id % 5 WHEN 3 THEN 'com.example.shop' ELSE '{FX.APP_PREFIX}' || CAST(user_id % 5 AS VARCHAR) END AS app_id, user_id % 5 AS n,
         CAST(ts AS DATE) AS day, min(event_type) AS a, max(event_type) AS b, count(*) AS c FROM events GROUP BY ALL),
sh AS (
  SELECT *, '{{"loved_features":["' || b || '"],"top_complaints":["' || a || '","' || b || '"]}}' AS plain,
         '{{"loved_features":"' || b || '","top_complaints":[{{"count":' || c || ',"theme":"' || a || '"}},' || c || ',["' || b || '"],null,true]}}' AS nested
  FROM ev),
rep AS (
  SELECT app_id, CAST(day AS VARCHAR) AS day, CASE (day(day) + n) % 9
    WHEN 0 THEN plain WHEN 1 THEN '```json' || chr(10) || plain || chr(10) || '```' WHEN 2 THEN '{{"top_complaints":["' || a || '"]}}'
    WHEN 3 THEN 'Sorry, I can''t summarise these reviews right now.' WHEN 4 THEN nested WHEN 5 THEN '[{{"top_complaints":["' || a || '"]}}]'
    WHEN 6 THEN left(plain, 40) WHEN 7 THEN 'Here you are: ' || nested || chr(10) || 'Anything else?' END AS raw
  FROM sh),
js AS (
  SELECT *, coalesce(json_valid(raw), FALSE) AS whole, regexp_extract(coalesce(raw, ''), '(?s)\\{{.*\\}}') AS span FROM rep),
vs AS (SELECT app_id, day, whole, CASE WHEN whole THEN CAST(raw AS JSON) WHEN span <> '' AND json_valid(span) THEN CAST(span AS JSON) END AS v FROM js),
it AS (SELECT *, {_reply_items('top_complaints')} AS t, {_reply_items('loved_features')} AS l FROM vs)
SELECT app_id, day, CASE WHEN t IS NULL THEN 'error' WHEN whole THEN 'json' ELSE 'salvaged' END AS status,
       len(t) AS n_top, len(l) AS n_loved, array_to_string(t, '; ') AS top_complaints, array_to_string(l, '; ') AS loved_features
FROM it"""

SQL["sentiment_by_table"] = SQL["sentiment"]

SQL["enriched_store"] = w(CKW, CTAG, ENR, PKW, FKW, REQ) + f""",
cc AS (SELECT app_id, review_id, string_agg(theme, ', ' ORDER BY ord) AS c FROM ctag GROUP BY ALL),
pp AS (SELECT app_id, review_id, string_agg(theme, ', ' ORDER BY ord) AS p FROM ({_kw_tag('reviews', 'pkw')}) GROUP BY ALL),
ff AS (SELECT app_id, review_id, string_agg(theme, ', ' ORDER BY ord) AS f FROM ({_kw_tag('reviews', 'fkw')}) GROUP BY ALL)
SELECT e.app_id, e.review_id, {_iso_ts('e.date')} AS date, e.rating, e.thumbs_up, e.sentiment_score, e.sentiment_label,
       coalesce(c, '') AS complaint_categories, coalesce(p, '') AS praise_categories, coalesce(f, '') AS feature_categories,
       EXISTS (SELECT 1 FROM req q WHERE contains(lower(e.review_text), q.kw)) AS is_request
FROM enr e LEFT JOIN cc USING (app_id, review_id) LEFT JOIN pp USING (app_id, review_id) LEFT JOIN ff USING (app_id, review_id)"""

SQL["recent_slice_stored"] = SQL["recent_slice"]
