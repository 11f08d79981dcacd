"""Column-level helpers (scalar expressions, all JVM-side built-ins).

Each function takes and returns a ``Column`` so it composes inside
``select``/``withColumn`` and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() treats as whitespace.  Spark's trim()
# removes only U+0020, and Java's \s misses NBSP, U+001C-U+001F and friends.
WS_CLASS = (
    r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
ELLIPSIS = "…"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# the same characters, listed (fixed by the Unicode whitespace definition)
WS_CHARS = (
    [chr(c) for c in range(0x09, 0x0E)] + [chr(c) for c in range(0x1C, 0x21)]
    + ["\x85", "\xa0", "\u1680"] + [chr(c) for c in range(0x2000, 0x200B)]
    + ["\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
)


def strip_ws(c: Column | str) -> Column:
    """Strip leading/trailing whitespace the way Python's str.strip() does.

    The regex runs only for values whose first or last character is
    whitespace (a hash-set ``IN`` test); the rest pass through untouched.
    The value is the element of a one-element array, so the expression holds
    it once: wherever Catalyst inlines it, a derived text is computed once.
    """
    return F.transform(F.array(col_(c)), _stripped)[0]


def _stripped(c: Column) -> Column:
    edge = F.substring(c, 1, 1).isin(*WS_CHARS) | F.substring(c, -1, 1).isin(*WS_CHARS)
    return F.when(edge, F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")).otherwise(c)


def text_key(c: Column | str = "review_text") -> Column:
    """Lower-cased text, '' for null: the key every keyword test runs on."""
    return F.lower(F.coalesce(col_(c), F.lit("")))


def truncate(c: Column | str, n: int) -> Column:
    """First n code points plus an ellipsis when longer than n; else unchanged."""
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ELLIPSIS))).otherwise(c)


def pct(count: Column | str, total: Column | str, digits: int = 1) -> Column:
    """100*count/total rounded half-even (Python round semantics)."""
    return F.bround(F.lit(100.0) * col_(count) / col_(total), digits)


def confidence_tier(count: Column | str) -> Column:
    c = col_(count)
    return F.when(c >= 12, "high").when(c >= 6, "medium").otherwise("low")


def star_bar(rating: Column | str) -> Column:
    r = F.coalesce(col_(rating), F.lit(3))
    return F.concat(F.repeat(F.lit("★"), r), F.repeat(F.lit("☆"), F.lit(5) - r))


def day_month_year(ts: Column | str) -> Column:
    """'%d %b %Y' display date, '' for null."""
    return F.coalesce(F.date_format(col_(ts), "dd MMM yyyy"), F.lit(""))


def iso_date(ts: Column | str) -> Column:
    return F.substring(col_(ts).cast("string"), 1, 10)  # no detour over the session's time zone


def iso_ts(ts: Column | str) -> Column:
    return F.substring(col_(ts).cast("string"), 1, 19)


def join_or(arr: Column | str, empty: str) -> Column:
    """', '-joined array, or ``empty`` when the array is empty or null."""
    a = col_(arr)
    return F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.array_join(a, ", ")).otherwise(F.lit(empty))


def days_between(older: Column | str, newer: Column | str) -> Column:
    """Whole 24-hour periods from older to newer (timedelta.days), clamped at 0."""
    d = F.timestamp_diff("DAY", col_(older), col_(newer))
    return F.when(d < 0, F.lit(0)).otherwise(d)


def ntz_literal(value) -> Column:
    """A TIMESTAMP_NTZ literal from a datetime or string, independent of the
    Python and session time zones (goes through ISO text)."""
    text = value.isoformat(sep=" ") if hasattr(value, "isoformat") else str(value)
    return F.lit(text).cast("timestamp_ntz")


# ── URLs ────────────────────────────────────────────────────────────────────
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _decode(c: Column) -> Column:
    """Percent/'+' decoding that keeps a stray '%' as it is."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_param(url: Column | str, key: str) -> Column:
    """First non-blank value of ``key`` in the URL query, percent/'+' decoded.

    Splits the query on '&' and keeps pairs with a non-empty value whose
    decoded name is ``key``, like ``parse_qs``; a pair without a value is
    skipped so a later one wins.
    """
    query = F.regexp_extract(strip_ws(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=.") & (_decode(F.substring_index(p, "=", 1)) == key))
    return _decode(F.regexp_extract(F.try_element_at(pairs, F.lit(1)), "(?s)^[^=]*=(.*)$", 1))


def package_id(url: Column | str) -> Column:
    """Package id from a store URL, or the input itself when it is a bare id."""
    u = strip_ws(url)
    bare = (~u.rlike(_SCHEME)) & (~u.startswith("//")) & u.contains(".") & (~u.contains("/"))
    return F.when(bare, u).otherwise(query_param(u, "id"))


def country_hint(url: Column | str, hl_map: dict[str, str]) -> Column:
    hl = F.lower(query_param(url, "hl"))
    m = F.create_map(*[F.lit(x) for kv in hl_map.items() for x in kv])
    return F.try_element_at(m, hl)
