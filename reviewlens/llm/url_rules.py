"""URL allow and block lists: a trie over reversed host labels and path segments, longest match wins.

A rule is ``host/path`` (``example.net/en/``) with the verdict allow or block.  It fits its host and all
subdomains when the URL's path starts with the rule's path; its last segment may be cut anywhere
(``org/fr/ar`` fits ``/fr/article``).  Of all rules that fit, the one with most host labels wins, then the one
with the longest path; of two verdicts for one rule, block wins.  URLs that no rule fits get ``default``.

* **Trie** (the usual way): one dictionary per host label from the right, then one per complete path segment;
  each path node holds the rules that end in it by their cut last segment.  A URL is matched by one walk down,
  keeping the last rule that fitted, for each host depth from the deepest.  The rules are broadcast as the
  trie, after a check that they are at most ``TRIE_RULES`` rows and ``TRIE_BYTES`` bytes.
* **Join** (larger rule tables): distinct (host, path) pairs are expanded into the (host suffix, path prefix)
  keys that some rule could have, and meet the rules by an equi-join; the same order picks the winner.  Nothing
  is broadcast; no rule is left out.

Null URLs and URLs without ``://`` have an empty host and path, so only a rule with an empty host and path
could fit them.  A port or user name is part of the host text, as the definition of the host says.  Rows are
kept as they are, repeated ones too; input columns named like an output column are replaced.  Rules with a null
host, or a verdict other than allow or block, raise an error; a null path is the empty path.  Neither way
shuffles the pages' other columns except the join way, which joins on (host, path).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import common as C

#: Rules that may be broadcast as a trie: rows, and bytes of their text (a worker needs about 600 bytes a rule).
TRIE_RULES = 200_000
TRIE_BYTES = 16_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")
OUT = ["host", "path", "rule", "verdict"]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


class Trie:
    """Rules by reversed host labels, then by complete path segments, then by the cut last segment."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(_PATHS, {})
            *segments, last = path.split("/")
            for segment in segments:
                node = node.setdefault(segment, {})
            cuts = node.setdefault(_CUTS, {})
            if cuts.get(last, ("", ""))[1] != "block":
                cuts[last] = (host + path, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        node, found = self.root, [self.root.get(_PATHS)]
        if host:
            for label in reversed(host.split(".")):
                node = node.get(label)
                if node is None:
                    break
                found.append(node.get(_PATHS))
        segments = path.split("/")
        for paths in reversed(found):  # the deepest host first
            best, depth = None, 0
            while paths is not None:
                best = _longest_cut(paths.get(_CUTS), segments[depth]) or best
                if depth + 1 == len(segments):
                    break
                paths, depth = paths.get(segments[depth]), depth + 1
            if best:
                return best
        return None


#: Keys that no label or segment equals.
_PATHS, _CUTS = 0, 1


def _longest_cut(cuts: dict | None, segment: str) -> tuple[str, str] | None:
    if not cuts:
        return None
    if len(cuts) == 1:
        (cut, entry), = cuts.items()
        return entry if segment.startswith(cut) else None
    for n in range(len(segment), -1, -1):
        entry = cuts.get(segment[:n])
        if entry:
            return entry
    return None


def _checked(rules: DataFrame) -> DataFrame:
    return C.write_table(rules.select(
        F.translate(F.col("host").cast("string"), UPPER, LOWER).alias("host"),
        F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string")).distinct())


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
          trie_rules: int = TRIE_RULES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """All columns of ``pages`` and host, path, rule (null: none fits) and verdict of each URL.

    ``rules`` has columns host, path and verdict.
    """
    kept = [c for c in pages.columns if c not in OUT]
    link = F.col(url).cast("string")
    d = pages.select(*kept, *([] if url in kept else [link.alias("__url")]))
    link = link if url in kept else F.col("__url")
    d = d.select("*", host_of(link).alias("host"), path_of(link).alias("path")).select(*kept, "host", "path")
    rules = _checked(rules)
    n, size, wrong = rules.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0)),
        F.count_if(F.col("host").isNull() | ~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)))).first()
    if wrong:
        raise ValueError(f"{wrong} rules without a host or with a verdict other than {VERDICTS}")
    hit = _by_trie(d, rules) if n <= trie_rules and size <= trie_bytes else _by_join(d, rules)
    return hit.select(*kept, "host", "path", F.col("__hit.rule").alias("rule"),
                      F.coalesce("__hit.verdict", F.lit(default)).alias("verdict"))


def _by_trie(d: DataFrame, rules: DataFrame) -> DataFrame:
    spark = d.sparkSession
    C.ship(spark)
    trie = spark.sparkContext.broadcast(Trie([(r.host, r.path, r.verdict) for r in rules.collect()]))

    @F.pandas_udf("rule string, verdict string")
    def match(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        known: dict = {}
        out = []
        for key in zip(host, path):
            if key not in known:
                known[key] = trie.value.match(*key) or (None, None)
            out.append(known[key])
        return pd.DataFrame(out, columns=["rule", "verdict"], dtype="object")

    return d.withColumn("__hit", match("host", "path"))


def _by_join(d: DataFrame, rules: DataFrame) -> DataFrame:
    """A rule's key is (host, complete segments, cut last segment); a URL has a key for each host suffix,
    each number of complete segments and each length that a cut of some rule has."""
    folder = F.substring_index("path", "/", -1)
    r = (rules.withColumn("__cut", folder)
         .withColumn("__dir", F.left("path", F.length("path") - F.length("__cut")))
         .groupBy(F.col("host").alias("__host"), "__dir", "__cut").agg(F.max("verdict").alias("verdict"))  # "block" > "allow"
         .withColumn("rule", F.concat("__host", "__dir", "__cut"))
         .withColumn("__labels", F.when(F.col("__host") == "", 0).otherwise(F.size(F.split("__host", r"\.")))))
    lengths = sorted(x[0] for x in r.select(F.length("__cut")).distinct().collect())  # at most the longest segment
    urls = d.select("host", "path").distinct()
    labels, segments = F.split("host", r"\.", -1), F.split("path", "/", -1)
    suffixes = F.array_append(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k)), F.lit(""))
    keys = urls.withColumn("__host", F.explode(F.array_distinct(suffixes)))
    keys = keys.select("*", F.posexplode(segments).alias("__k", "__segment"))
    keys = keys.withColumn("__dir", F.when(F.col("__k") == 0, "").otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), F.col("__k")), F.lit("/"))))
    keys = keys.withColumn("__n", F.explode(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")))
    keys = keys.where(F.col("__n") <= F.length("__segment")).withColumn("__cut", F.left("__segment", F.col("__n")))
    fits = keys.join(r, ["__host", "__dir", "__cut"])
    best = fits.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), F.struct("__labels", F.length("rule") - F.length("__host"))).alias("__hit"))
    return d.join(best, ["host", "path"], "left")


#: The rules of the contract query (host, path, verdict).
FIXED_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
