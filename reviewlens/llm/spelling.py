"""Spelling variants by a variable-length gram index.

**Words.**  Maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of every whole text, A-Z lower-cased.  Where 31 divides the
unsigned crc32 of ``<doc_id>:<run>`` (null doc_id: nothing before the colon), the run's code point at that number
modulo its length goes.  Words are the distinct results of at least ``LEAST_LENGTH`` code points seen at least
twice.  Two words are near if one inserted, deleted or replaced code point makes one of the other.  A word's form
is its near word of largest count (ties: smallest in code-point order), if that count is at least ``FACTOR`` times
its own; its root is the end of the chain of forms.

**Gram dictionary.**  A gram of two code points is in the dictionary; a longer one is if all its shorter
beginnings are *frequent*, that is, occur more than ``bound`` times in the words (with a mark at both ends).  The
dictionary is therefore given by its frequent grams, which are counted length by length, each time only where the
beginning is frequent.  ``bound`` grows with the words so that at most ``MOST_GRAMS`` grams of a length are
frequent; they are broadcast.

**Decomposition.**  From each position goes the longest gram of the dictionary; one that lies inside an earlier
one is left out.  Words of length n and of lengths n, n + 1 meet in class n, in which grams have at most
(n + 2) // 4 code points (two at least); then any edit leaves ``SHARED`` grams of a word as they are.  Words under
ten code points therefore have grams of two; the longer a word, the longer its grams may be.

**Affected-gram bounds.**  One edit at a place can only change a gram that covers the place, or one behind it that
a new, longer gram could swallow (decided by the ends of frequent grams).  The greatest number of such grams over
all places is the word's bound a; near words share all but a of their grams, in the same order.  So of the
a + ``SHARED`` rarest grams of either word ``SHARED`` are shared: only these short lists are merged.

**Merging.**  A merged list is the intersection of ``SHARED`` gram lists: the words of a class that have these
grams, in order.  Merged lists meet by an equi-join on that key, long ones cut in blocks that meet pairwise in
separate tasks.  Of each candidate first the parities of its code points are compared (an edit changes two at
most), then the edit distance.  All steps are exact: bounds only choose which lists are read.

Null and empty texts give no words, an empty table an empty result; repeated rows count each time; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import common as C

LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
ONE_IN = 31
#: Frequent grams of one length, at most; and the least count that makes a gram frequent.
MOST_GRAMS = 100_000
LEAST_BOUND = 64
#: Longest gram of any class.
LONGEST = 12
#: Grams that near words must share; the classes' gram lengths are chosen so that they always do.
SHARED = 3
#: Entries of a list that meet in one task's group.
BLOCK = 4_000
#: Distinct words that a task counts before it hands them on.
PARTIAL = 300_000
HEAVY = 1_000_000
START, END = "\x02", "\x03"


# ── words ───────────────────────────────────────────────────────────────────
def changed(doc_id: int | None, run: str, salt: int | None = None) -> str:
    """The word that a lower-cased run of a document counts as."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()) if salt is None else salt)
    if h % ONE_IN:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def words(docs: DataFrame) -> DataFrame:
    """word, n (long): the words and their counts; stored, dealt by word."""
    C.ship(docs.sparkSession)
    run_re = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")  # a shorter run gives no word

    def count(batches):
        def emit(c):
            return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["word", "n"])

        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(run_re.findall(text.encode().lower().decode())).items():  # bytes.lower() changes A-Z only
                    word = changed(doc_id, run, salt)
                    if len(word) >= LEAST_LENGTH:
                        total[word] += n
                if len(total) > PARTIAL:
                    yield emit(total)
                    total.clear()
        yield emit(total)

    part = C.id_and_text(docs).mapInArrow(count, "word string, n long")
    every = part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return C.write_table(every.repartition(C.partitions_for(docs.sparkSession), "word"))


# ── gram dictionary ─────────────────────────────────────────────────────────
def frequent_grams(table: DataFrame, least: int = LEAST_BOUND, most: int = MOST_GRAMS) -> dict[str, int]:
    """The frequent grams and their counts.  More than ``instances / most`` occurrences each leave
    at most ``most`` of a length, whatever the size of the table."""
    spark = table.sparkSession
    found: dict[str, int] = {}
    bound = least
    for size in range(2, LONGEST):
        before = spark.sparkContext.broadcast(frozenset(g for g in found if len(g) == size - 1))

        def count(batches, size=size, before=before):
            total: Counter = Counter()
            for batch in batches:
                for word in batch.column("word").to_pylist():
                    s = START + word + END
                    total.update(s[p:p + size] for p in range(len(s) - size + 1) if size == 2 or s[p:p + size - 1] in before.value)
                if len(total) > PARTIAL:
                    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["g", "n"])
                    total.clear()
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["g", "n"])

        counts = table.select("word").mapInArrow(count, "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
        if size == 2:
            counts = C.write_table(counts)
            bound = max(least, (counts.agg(F.sum("n")).first()[0] or 0) // most)
        level = {r.g: r.n for r in counts.where(F.col("n") > bound).collect()}
        if not level:
            break
        found |= level
    return found


class Grams:
    """Decomposition of words and their affected-gram bounds under the frequent grams."""

    def __init__(self, frequent: dict[str, int]):
        self.frequent = frequent
        self.endings = {g[k:] for g in frequent for k in range(1, len(g))}

    def cut(self, word: str, most: int) -> list[tuple[int, int]]:
        """(start, end) of the grams of the marked word, at most ``most`` code points each."""
        s = START + word + END
        n, reach, out = len(s), 0, []
        for p in range(n - 1):
            e = p + 2
            while e - p < most and e < n and s[p:e] in self.frequent:
                e += 1
            if e > reach:  # else it lies inside an earlier gram
                out.append((p, e))
                reach = e
        return out

    def affected(self, word: str, grams: list[tuple[int, int]], most: int) -> int:
        """How many grams one edit can change, at most."""
        s = START + word + END
        step = [0] * (len(s) + 1)
        for p, e in grams:
            first = p
            while first > 0 and e - first < most and s[first:e - 1] in self.endings:
                first -= 1  # an edit at ``first`` could make a gram that covers this one
            step[first] += 1
            step[e] -= 1
        top = now = 0
        for x in step:
            now += x
            top = max(top, now)
        return top

    def rarest(self, word: str, most: int) -> list[tuple[int, int]]:
        """The grams of which two near words share at least ``SHARED``, by position."""
        s = START + word + END
        grams = self.cut(word, most)
        order = sorted(grams, key=lambda g: (self.frequent.get(s[g[0]:g[1]], 0), s[g[0]:g[1]], g[0]))
        return sorted(order[:self.affected(word, grams, most) + SHARED])

    def postings(self, word: str) -> tuple[set[int], set[int]]:
        """Keys of the merged lists that hold the word as the shorter and as the longer length of its class."""
        s = START + word + END
        out, before = [], None
        for size in (len(word), len(word) - 1):
            if longest(size) != before:  # else the decomposition is the same
                before = longest(size)
                sets = [":".join(g) for g in combinations([s[p:e] for p, e in self.rarest(word, before)], SHARED)]
            out.append({xxhash.xxh64_intdigest(f"{size}{g}") for g in sets} if size >= LEAST_LENGTH else set())
        return out[0], out[1]


def longest(size: int) -> int:
    """Longest gram of the class of words of ``size`` and ``size`` + 1 code points."""
    return max(2, min((size + 2) // (SHARED + 1), LONGEST))


def parities(word: str) -> int:
    """Which code points (modulo 64) a word has an odd number of."""
    x = 0
    for c in word:
        x ^= 1 << (ord(c) & 63)
    return x


# ── merging ─────────────────────────────────────────────────────────────────
def _lists(table: DataFrame, frequent: dict[str, int]) -> DataFrame:
    known = table.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        grams = Grams(known.value)
        as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        for batch in batches:
            keys, odd, longer, of = [], [], [], []
            for word in batch.column("word").to_pylist():
                sign = parities(word)
                for is_long, found in zip((False, True), grams.postings(word)):
                    keys.extend(found)
                    odd.extend([sign] * len(found))
                    longer.extend([is_long] * len(found))
                    of.extend([word] * len(found))
            yield pa.RecordBatch.from_arrays([as_long(keys), as_long(odd), pa.array(longer, pa.bool_()), pa.array(of, pa.string())],
                                             names=["key", "odd", "longer", "word"])

    return C.write_table(table.select("word").mapInArrow(run, "key long, odd long, longer boolean, word string"))


def near_pairs(table: DataFrame, frequent: dict[str, int], block: int = BLOCK) -> DataFrame:
    """a, b: each pair of near words once (stored)."""
    lists = _lists(table, frequent)
    size = lists.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > block)
    long_lists = C.sized_broadcast(C.write_table(size.select("key", F.ceil(F.col("c") / F.lit(block)).cast("int").alias("n_blocks"))), HEAVY)
    short = lists.join(long_lists, "key", "left_anti")
    cut = lists.join(long_lists, "key")
    mine = F.pmod(F.xxhash64("word"), F.col("n_blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    own, other = cut.withColumns({"i": mine}).withColumn("j", every), cut.withColumn("i", every).withColumn("j", mine)
    hits = _meet(short, short, ["key"]).unionByName(_meet(own, other, ["key", "i", "j"]))
    return C.write_table(hits.distinct())


def _meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Near words of the same list: the shorter (or the lesser of two of one length) is a."""
    a = left.where(~F.col("longer")).select(*on, F.col("word").alias("a"), F.col("odd").alias("odd_a"))
    b = right.select(*on, F.col("word").alias("b"), F.col("odd").alias("odd_b"), "longer")
    like = F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2
    one = F.levenshtein("a", "b", 1) == 1
    return a.join(b, on).where(like & (F.col("longer") | (F.col("a") < F.col("b"))) & one).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of a table word, form without circles, by pointer doubling: a chain of k forms
    takes about log2(k) joins, and k is at most log10 of the largest count."""
    now = C.write_table(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(on, "root", "left")
        now = C.write_table(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST_BOUND, most: int = MOST_GRAMS, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs``."""
    table = words(docs)
    pairs = near_pairs(table, frequent_grams(table, least, most), block)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = (both.join(table.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b").groupBy(F.col("a").alias("word"))
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("b").alias("form"))).alias("best")))
    near = table.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.minus") >= FACTOR * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))).alias("f"))
    near = C.write_table(near.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.form_n").alias("form_n")))
    root = roots(near.where(F.col("form").isNotNull()))
    return near.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
