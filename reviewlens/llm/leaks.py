"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all passages (windows of
   ``BLOCK`` words) of all documents give the TF-IDF weights.
2. A randomised SVD of TF-IDF passages, its products summed over Spark
   partitions, gives the latent space: all benchmark passages and all passages
   of all documents, over the terms that benchmark items hold (no other term
   can add to a cosine with an item).
3. Every passage of every document (two adjoining blocks) is projected and
   compared with all items at once; a cosine of ``COSINE`` or more makes it a
   candidate.  Its neighbourhood is then checked by longest common
   subsequence and by the item's closing words (the answer).
4. The latent space has RANK directions for up to ``ITEMS`` items, so a true
   copy may lie under the bound.  Therefore all places that hold enough of an
   item's rarest words for a positive check are candidates as well; this
   filter loses none, whatever the number of items.  Candidates of both kinds
   whose words, counted by id, cannot make a leak skip the word checks.

Items are broadcast in slices of at most ``ITEMS`` rows; more items mean more
passes, never fewer items.  Words are hashed once and stored; the scans of documents need no shuffle.

Edge cases: null or empty texts and items match nothing; items under
``SHORT`` words count only if all their words follow each other; repeated rows
give equal rows; empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import common as C

BLOCK = 20
BITS = 18
RANK, EXTRA = 128, 16
#: Documents that all documents together weigh in the fit, if there are more.
FIT_WEIGHT = 2_000
#: Weight of an item's passages beside those, so that the space keeps the items' own directions.
ITEM_SCALE = 10.0
COSINE = 0.15
#: Share of a passage's squared weight on item terms from which it is projected (a cosine c needs about c * c).
SHARE = 0.02
#: Characters handled at once, and where words are hashed (its arrays take some 30 bytes a character).
CHUNK, HASH_CHUNK = 1_000_000, 300_000
#: Share of an item's words in common order that makes a leak, alone or with the answer in place.
LCS, LCS_ANSWER = 0.7, 0.55
ANSWER_WORDS = 5
SHORT = 8
ITEMS = 5_000
#: Share of an item's words, the rarest first, that a place must hold beyond what a leak may lack (a filter only).
RARE = 0.3
#: Cells (items x places) that are counted at once (some 30 bytes each), and those of a search by term and place.
CELLS, FOUND = 1_000_000, 250_000
#: Lines whose rows are added at once, and words on item terms whose rows are summed at once (600 bytes each).
LINES, WORDS = 500, 8_000


#: White space outside ASCII, as str.split() knows it.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _spaced(text: str | None) -> str:
    """The text with plain spaces for white space outside ASCII: what hashes, positions and checks all split."""
    return (text or "") if not text or text.isascii() else _WIDE.sub(" ", text)


#: What is cut off the ends of a word.
_ENDS = ".,;:!?\"'()[]{}<>*#%&$|`~_-"


def _words(text: str | None) -> list[str]:
    """Words of a text as they are checked, one for each of ``_ids``."""
    return [w for w in [x.strip(_ENDS) for x in _spaced(text).lower().split()] if w]


def _reach(n: int) -> int:
    """Blocks before and after a passage in which an item of ``n`` words is looked for."""
    return -(-n // BLOCK) + 1


#: Byte classes: 0 white space, 1 dropped, 2 part of a word.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[list(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f")] = 0
_CLASS[list(b".,;:!?\"'()[]{}<>*#%&$|`~_-")] = 1
_VALUE = np.random.default_rng(11).integers(1, 2**63, 256).astype(np.uint64)
_POWER = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))
#: Letters whose powers are kept (16 bytes each).
ROOM = 400_000


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers 1, 2, ... of the odd number and 0, 1, ... of its inverse, modulo 2**64."""
    odd = int(_POWER[0])
    back = np.full(ROOM, pow(odd, -1, 1 << 64), np.uint64)
    back[0] = 1
    return np.cumprod(np.full(ROOM, odd, np.uint64)), np.cumprod(back)


def _ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all words of the texts (lower case, without punctuation) and the words of each text.

    Words are hashed byte by byte in arrays over the whole batch, so no Python object is made per word."""
    raw = [_spaced(t).lower().encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    keep = np.take(_CLASS, flat) != 1
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    ends -= np.searchsorted(np.flatnonzero(~keep), ends)
    flat = flat[keep]
    inside = np.take(_CLASS, flat) == 2
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    at = np.flatnonzero(start)
    n = np.diff(np.r_[0, np.searchsorted(at, ends)])
    if not len(at):
        return np.empty(0, np.int64), n
    size = np.flatnonzero(stop) + 1 - at
    first = np.cumsum(size) - size
    value = np.take(_VALUE, flat[inside])
    if len(value) <= ROOM and size.max() <= len(_POWER):
        # powers run on over all words; each word's sum is brought back to its own first letter
        power, back = C.kept("powers", _powers)
        h = np.add.reduceat(value * power[:len(value)], first) * back[first]
    else:
        h = np.add.reduceat(value * _POWER[(np.arange(len(value)) - np.repeat(first, size)) & 1023], first)
    return (C.mix(h) >> np.uint64(64 - BITS)).astype(np.int64), n


def _blocks(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block of each word and the number of blocks of each text."""
    blocks = -(-n // BLOCK)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.cumsum(blocks) - blocks, n) + inside // BLOCK, blocks


def _slots(n: np.ndarray) -> np.ndarray:
    """The place of each word in its block."""
    return (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) % BLOCK


def _by_column(c: np.ndarray) -> np.ndarray:
    """Positions of the words on item terms, by column and place."""
    at = np.flatnonzero(c >= 0)
    key = c[at]
    if len(key) and key.max() < 1 << 16:
        key = key.astype(np.uint16)  # numpy sorts 16 bits by radix
    return at[np.argsort(key, kind="stable")]


def _row_sums(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Sum of the table's rows that each line of ``cells`` names, some lines at a time so that they stay in the cache."""
    out = np.empty((len(cells), table.shape[1]), table.dtype)
    work = np.empty((min(LINES, len(cells)), table.shape[1]), table.dtype)
    for x in range(0, len(cells), LINES):
        part, acc = np.ascontiguousarray(cells[x:x + LINES].T), out[x:x + LINES]
        np.take(table, part[0], axis=0, out=acc, mode="clip")
        for y in part[1:]:
            acc += np.take(table, y, axis=0, out=work[:len(acc)], mode="clip")
    return out


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hash buckets of its words (stored), which idf, fit and search read."""

    def run(batches):
        for b in batches:
            texts, ids = b.column("text").to_pylist(), []
            for i, j in C.chunks(texts, HASH_CHUNK):
                flat, n = _ids(texts[i:j])
                raw, ends = flat.astype("<i4").tobytes(), (np.cumsum(n) * 4).tolist()
                ids += [raw[x:y] for x, y in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"])

    return C.write_table(docs.select("doc_id", "text").mapInArrow(C.tidy(run), "doc_id long, text string, ids binary"))


def _stored(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What ``_ids`` gave for the texts."""
    return np.frombuffer(b"".join(ids), "<i4").astype(np.int64), np.array([len(x) // 4 for x in ids], np.int64)


def idf(docs: DataFrame) -> np.ndarray:
    """ln((passages + 1) / (passages with the term + 1)) per bucket, over all ``hashed`` documents."""

    def run(batches):
        total, passages = np.zeros((1 << BITS) + 1, np.int64), 0
        for b in batches:
            stored = b.column("ids").to_pylist()
            for i, j in C.chunks(stored, CHUNK):
                ids, n = _stored(stored[i:j])
                block, blocks = _blocks(n)
                cells = np.full((int(blocks.sum()), BLOCK), -1, np.int32)
                cells[block, _slots(n)] = ids
                cells.sort(axis=1)
                cells[:, 1:][cells[:, 1:] == cells[:, :-1]] = -1  # a term counts once in a passage
                total += np.bincount(cells[cells >= 0], minlength=len(total))
                passages += len(cells)
        total[-1] = passages
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    got = docs.select("ids").mapInArrow(C.tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((1 << BITS) + 1)
    total[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return np.log((total[-1] + 1) / (total[:-1] + 1)).astype(np.float32) + np.float32(1e-3)


def latent(docs: DataFrame, items: list[np.ndarray], weight: np.ndarray, column, width: int) -> np.ndarray:
    """width x RANK basis of all passages of ``hashed`` documents and items: range of A'(A W) by partition sums,
    then the small Gram matrix by partition sums."""
    spark = docs.sparkSession
    rank = min(RANK + EXTRA, width)
    scale = float(np.sqrt(min(1.0, FIT_WEIGHT / max(C.count_rows(docs), 1))))
    own = spark.createDataFrame([(x.astype("<i4").tobytes(), ITEM_SCALE) for x in items], "ids binary, scale double")
    both = docs.select("ids", F.lit(scale).alias("scale")).unionByName(own)
    of_column = weight[np.flatnonzero(column >= 0)]
    data = spark.sparkContext.broadcast((weight, column))

    def summed(first: np.ndarray, gram: bool) -> np.ndarray:
        # words on no item are the zero row that ends the table
        given = spark.sparkContext.broadcast(np.vstack([first * of_column[:, None], np.zeros((1, rank))]).astype(np.float32))

        def run(batches):
            (w, c), table = data.value, given.value
            total, room = np.zeros((rank, rank) if gram else (width, rank)), np.empty((0, rank), np.float32)
            for b in batches:
                stored, scales = b.column("ids").to_pylist(), b.column("scale").to_numpy()
                for i, j in C.chunks(stored, 400_000):
                    flat, n_words = _stored(stored[i:j])
                    if not len(flat):
                        continue
                    block, n = _blocks(n_words)
                    cols = c[flat]
                    cells = np.full((int(n.sum()), BLOCK), width, np.int32)
                    cells[block, _slots(n_words)] = np.where(cols >= 0, cols, width)
                    # a passage is two adjoining blocks; the last block of a text stands alone as well
                    joined = np.ones(len(cells) - 1, bool)
                    joined[np.cumsum(n)[:-1][(np.cumsum(n)[:-1] > 0) & (np.cumsum(n)[:-1] < len(cells))] - 1] = False
                    size = np.bincount(block, w[flat].astype(np.float64) ** 2, len(cells))
                    size[:-1] += np.where(joined, size[1:], 0)
                    factor = (np.repeat(scales[i:j], n) / (np.sqrt(size) + 1e-9)).astype(np.float32)[:, None]
                    low = _row_sums(table, cells)
                    low[:-1] += low[1:] * joined[:, None]
                    low *= factor
                    if gram:
                        total += low.T @ low
                        continue
                    low *= factor
                    low[1:] += low[:-1] * joined[:, None]  # of both passages that hold a block
                    at = _by_column(cols)
                    if not len(at):
                        continue
                    col = cols[at]
                    edge = np.flatnonzero(np.r_[True, col[1:] != col[:-1], True])
                    x = 0
                    while x < len(edge) - 1:  # whole columns, some rows at a time so that they stay in the cache
                        y = max(x + 1, int(np.searchsorted(edge, edge[x] + WORDS, side="right")) - 1)
                        lo, hi, own = edge[x], edge[y], col[edge[x:y]]
                        if hi - lo > len(room):
                            room = np.empty((max(hi - lo, WORDS), rank), np.float32)
                        rows = np.take(low, block[at[lo:hi]], axis=0, out=room[:hi - lo], mode="clip")
                        total[own] += np.add.reduceat(rows, edge[x:y] - lo, axis=0) * of_column[own][:, None]
                        x = y
            step = 64  # lines of a record: those of all partitions meet in one group
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(0, len(total), step), pa.int64()), pa.array([total[k:k + step].tobytes() for k in range(0, len(total), step)], pa.binary())],
                names=["at", "cells"])

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, np.float64) for x in rows["cells"])
            return pd.DataFrame({"at": rows["at"][:1], "cells": [total.tobytes()]})

        got = (both.coalesce(C.partitions_for(spark, 64)).mapInArrow(C.tidy(run), "at long, cells binary")
               .groupBy("at").applyInPandas(add, "at long, cells binary").toPandas().sort_values("at"))
        return np.frombuffer(b"".join(got["cells"]), np.float64).reshape(-1, rank)

    omega = np.random.default_rng(7).standard_normal((width, rank))
    q, _ = np.linalg.qr(summed(omega, False))
    values, vectors = np.linalg.eigh(summed(q, True))
    return (q @ vectors[:, ::-1][:, :RANK]).astype(np.float32)


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence (bit-parallel over ``a``)."""
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = place.get(y)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def is_leak(item: list[str], region: list[str]) -> tuple[bool, int]:
    """Verdict and common words of an item and a neighbourhood."""
    n = common_subsequence(item, region)
    if len(item) < SHORT:
        return _holds(region, item), n
    return n >= LCS * len(item) or (n >= LCS_ANSWER * len(item) and _holds(region, item[-ANSWER_WORDS:])), n


def _holds(region: list[str], words: list[str]) -> bool:
    """Do the words follow each other in the region?"""
    return any(region[i:i + len(words)] == words for i in range(len(region) - len(words) + 1))


def _least(n: int) -> int:
    """Words in common order without which an item of ``n`` words is no leak."""
    return n if n < SHORT else int(np.ceil(min(LCS, LCS_ANSWER) * n))


class Holders:
    """Places that hold enough words of an item: every place with a leak is among them.

    A leak lacks at most n - least words of its item.  So of the rarest words, n - least + r in number, it holds r or
    more.  Places are cells of a neighbourhood's length, counted in pairs, so that each neighbourhood lies in one pair."""

    def __init__(self, ids: list[np.ndarray], column: np.ndarray, weight: np.ndarray):
        item, term, count, self.bound = [], [], [], np.zeros(len(ids), np.int64)
        for k, x in enumerate(ids):
            terms, times = np.unique(x, return_counts=True)
            order = np.lexsort((terms, -weight[terms]))
            terms, times = terms[order], times[order]
            lack = len(x) - _least(len(x))
            want = lack + min(_least(len(x)), max(2, int(np.ceil(RARE * len(x)))))
            m = min(int(np.searchsorted(np.cumsum(times), want)) + 1, len(terms))
            item.append(np.full(m, k))
            term.append(column[terms[:m]])
            count.append(times[:m])
            self.bound[k] = times[:m].sum() - lack
        self.item, self.term, self.count = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (item, term, count))
        self.first = np.searchsorted(self.item, np.arange(len(ids) + 1))
        self.cell = np.array([BLOCK * (2 + 2 * _reach(len(x))) for x in ids], np.int64)

    def find(self, c: np.ndarray, at: np.ndarray | None = None) -> list[tuple[int, int, int]]:
        """(item, first word, end) of the places among words with columns ``c`` (-1: on no item; ``at``: ``_by_column(c)``)."""
        at = _by_column(c) if at is None else at
        times = np.bincount(c[at], minlength=int(self.term.max()) + 1)
        start = np.cumsum(times) - times
        n = times[self.term]
        per_item = np.add.reduceat(n, self.first[:-1])
        cells = len(c) // self.cell + 2
        out, k = [], 0
        while k < len(per_item):
            most, sum_hits, j = 0, 0, k  # items k to j - 1 are counted together
            while j < len(per_item) and (j == k or (max(most, cells[j]) * (j + 1 - k) <= CELLS and sum_hits + per_item[j] <= CELLS)):
                most, sum_hits, j = max(most, cells[j]), sum_hits + per_item[j], j + 1
            e = np.arange(self.first[k], self.first[j])
            e = e[n[e] > 0]
            if len(e):
                entry = np.repeat(e, n[e])
                place = at[np.arange(len(entry)) + np.repeat(start[self.term[e]] - (np.cumsum(n[e]) - n[e]), n[e])]
                key = (self.item[entry] - k) * most + place // self.cell[self.item[entry]]
                new = np.r_[True, (entry[1:] != entry[:-1]) | (key[1:] != key[:-1])]  # a word counts once in a cell
                held = np.bincount(key[new], self.count[entry[new]], (j - k) * most).reshape(j - k, most)
                for i, x in zip(*np.nonzero(held[:, :-1] + held[:, 1:] >= self.bound[k:j, None])):
                    out.append((k + int(i), int(x * self.cell[k + i]), int((x + 2) * self.cell[k + i])))
            k = j
        return out


class Bounds:
    """Upper bounds of common words, counted on integer ids, so that hopeless places never reach the word checks.

    Equal words have equal ids, so a place never holds more words of an item, in any order, than ``held`` counts."""

    def __init__(self, ids: list[np.ndarray], column: np.ndarray):
        found = [np.unique(column[x], return_counts=True) for x in ids]
        self.term, self.times = (np.concatenate([np.empty(0, np.int64), *(f[i] for f in found)]).astype(np.int64) for i in (0, 1))
        self.size = np.array([len(f[0]) for f in found], np.int64)
        self.first = np.cumsum(self.size) - self.size
        n = [len(x) for x in ids]
        self.least = np.array([_least(x) for x in n], np.int64)
        #: Enough without the answer; short items always need all their words in a row.
        self.enough = np.array([np.ceil(LCS * x) if x >= SHORT else x + 1 for x in n], np.int64)
        self.answer = [column[x[-ANSWER_WORDS:] if len(x) >= SHORT else x].astype(np.int64) for x in ids]

    def places(self, c: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Of words with columns ``c``: sorted keys of (column, position) and of (item, start of its answer), and their base."""
        base, at = len(c) + 1, _by_column(c) if at is None else at
        keys = c[at].astype(np.int64) * base + at
        edge = np.searchsorted(keys, np.arange(int(self.term.max(initial=0)) + 2) * base)
        starts = []
        for k, words in enumerate(self.answer):
            rare = int(np.argmin(edge[words + 1] - edge[words]))
            p = at[edge[words[rare]]:edge[words[rare] + 1]] - rare
            p = p[(p >= 0) & (p + len(words) <= len(c))]
            for i, w in enumerate(words.tolist()):
                if not len(p):
                    break
                p = p[c[p + i] == w]
            if len(p):
                starts.append(k * base + p)
        return keys, np.concatenate([np.empty(0, np.int64), *starts]), base

    def held(self, keys: np.ndarray, base: int, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Words of each item that the words ``lo`` to ``hi`` hold, each as often as both have it."""
        out, order = np.zeros(len(item), np.int64), np.lexsort((lo, item))
        edge = np.flatnonzero(np.r_[True, np.diff(item[order]) != 0, True]) if len(item) else [0]
        for a, b in zip(edge, edge[1:]):
            k = int(item[order[a]])
            e = slice(self.first[k], self.first[k] + self.size[k])
            key, times = self.term[e, None] * base, self.times[e, None]
            step = max(1, FOUND // int(self.size[k]))
            for x in range(a, b, step):  # by term and place: neighbouring searches end near each other
                at = order[x:min(x + step, b)]
                found = np.searchsorted(keys, key + hi[at]) - np.searchsorted(keys, key + lo[at])
                out[at] = np.minimum(found, times).sum(axis=0)
        return out

    def may_leak(self, places: tuple, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """False: ``is_leak`` refuses the item in the words ``lo`` to ``hi``."""
        keys, starts, base = places
        n = self.held(keys, base, item, lo, hi)
        size = np.array([len(x) for x in self.answer], np.int64)[item]
        at = np.searchsorted(starts, item * base + lo)
        answered = np.r_[starts, np.iinfo(np.int64).max // 2][at] + size <= item * base + hi
        return (n >= self.enough[item]) | ((n >= self.least[item]) & answered)


SCHEMA = "doc_id long, item_id long, similarity double, n_common long, n_item long, start long"


def _search(docs: DataFrame, items: list[tuple[int, str]], weight: np.ndarray) -> DataFrame:
    """Candidates and checks for one slice of items (stored)."""
    spark = docs.sparkSession
    words = [_words(t) for _, t in items]
    ids = [_ids([t])[0] for _, t in items]
    used = np.unique(np.concatenate([np.empty(0, np.int64), *ids]))
    column = np.full(1 << BITS, -1, np.int32)
    column[used] = np.arange(len(used))
    basis = latent(docs, ids, weight, column, len(used))
    project = basis * weight[used][:, None]
    q = np.stack([project[column[x]].sum(0) / (np.sqrt((weight[x] ** 2).sum()) + 1e-9) for x in ids])
    q /= np.linalg.norm(q, axis=1, keepdims=True) + 1e-9
    data = spark.sparkContext.broadcast((np.vstack([project, np.zeros_like(project[:1])]).astype(np.float32), column, weight * weight, q.astype(np.float32), words, [i for i, _ in items],
                                         Holders(ids, column, weight), Bounds(ids, column)))

    def run(batches):
        table, col, square, query, item_words, item_ids, holders, bounds = data.value
        reaches = np.array([_reach(len(x)) for x in item_words], np.int64)
        for b in batches:
            doc, texts, stored, out = b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("ids").to_pylist(), []
            for i, j in C.chunks(texts, CHUNK):
                flat, n = _stored(stored[i:j])
                if not len(flat):
                    continue
                n_words, slot = n, _slots(n)
                block, n = _blocks(n)
                first, total = np.cumsum(n) - n, int(n.sum())
                c, size = col[flat], square[flat]
                at = _by_column(c)
                marks, head = bounds.places(c, at), np.cumsum(n_words) - n_words
                alone = np.zeros(total, bool)  # the last block of a text has none to join
                alone[(first + n - 1)[n > 0]] = True

                def passages(x):
                    x[:-1] += np.where(alone[:-1], 0, x[1:])
                    return x

                length = passages(np.bincount(block, size, total))
                share = passages(np.bincount(block, np.where(c >= 0, size, 0), total))
                # no projection is longer than the part of a passage that lies on item terms
                some = np.flatnonzero(share >= SHARE * length)
                split: dict[int, list[str]] = {}
                done: set[tuple[int, int]] = set()
                need = np.zeros(total + 1, bool)
                need[some] = need[some + 1] = True
                # each block as BLOCK columns, words on no item as the zero row that ends the table
                cols = np.full((total + 1, BLOCK), len(table) - 1, np.int32)
                cols[block, slot] = np.where(c >= 0, c, len(table) - 1)
                sums = np.zeros((total + 1, table.shape[1]), np.float32)
                rows = np.flatnonzero(need)
                sums[rows] = _row_sums(table, cols[rows])
                low = sums[some] + np.where(alone[some, None], 0, sums[some + 1])
                low /= np.sqrt(length[some])[:, None].astype(np.float32) + 1e-9
                for s in range(0, len(low), 20_000):
                    hit, item = np.nonzero(low[s:s + 20_000] @ query.T >= COSINE)
                    if not len(hit):
                        continue
                    value = np.einsum("ij,ij->i", low[s + hit], query[item])
                    place = some[s + hit]
                    row = np.searchsorted(first + n, place, side="right")
                    near = place - first[row]
                    ok = bounds.may_leak(marks, item, head[row] + np.maximum(near - reaches[item], 0) * BLOCK,
                                         head[row] + np.minimum((near + 2 + reaches[item]) * BLOCK, n_words[row]))
                    item, value, place, row = item[ok], value[ok], place[ok], row[ok]
                    best: dict[tuple[int, int], tuple[float, int]] = {}
                    for r, k, v, p in zip(row.tolist(), item.tolist(), value.tolist(), (place - first[row]).tolist()):
                        best.setdefault((r, k), []).append((v, p))
                    for (r, k), found in best.items():
                        if r not in split:
                            split[r] = _words(texts[i + r])
                        reach = _reach(len(item_words[k]))
                        for v, p in sorted(found, reverse=True):
                            lo = max(0, (p - reach) * BLOCK)
                            yes, m = is_leak(item_words[k], split[r][lo:(p + 2 + reach) * BLOCK])
                            if yes:
                                out.append((doc[i + r], item_ids[k], v, m, len(item_words[k]), lo))
                                done.add((r, k))
                                break
                ends = np.cumsum(n_words)
                cells = np.array(holders.find(c, at), np.int64).reshape(-1, 3)
                # a neighbourhood with a leak lies whole in one place
                ok = bounds.may_leak(marks, *cells.T)
                for k, lo, hi in cells[ok].tolist():
                    item, reach = item_words[k], _reach(len(item_words[k]))
                    for r in range(int(np.searchsorted(ends, lo, side="right")), len(ends)):
                        begin = int(ends[r] - n_words[r])
                        if begin >= hi:
                            break
                        if (r, k) in done or not n_words[r]:
                            continue
                        if r not in split:
                            split[r] = _words(texts[i + r])
                        a, b_ = max(lo - begin, 0), min(hi - begin, int(n_words[r]))
                        if common_subsequence(item, split[r][a:b_]) < _least(len(item)):
                            continue
                        best_p = None
                        for p in range(a // BLOCK, -(-b_ // BLOCK)):
                            w0 = max(0, (p - reach) * BLOCK)
                            yes, m = is_leak(item, split[r][w0:(p + 2 + reach) * BLOCK])
                            if yes:
                                x = slice(begin + p * BLOCK, begin + min((p + 2) * BLOCK, int(n_words[r])))
                                own = c[x][c[x] >= 0]
                                v = float(table[own].sum(0) @ query[k] / (np.sqrt(length[first[r] + p]) + 1e-9))
                                best_p = max(best_p or (v, m, w0), (v, m, w0))
                        if best_p:
                            out.append((doc[i + r], item_ids[k], best_p[0], best_p[1], len(item), best_p[2]))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[x] for o in out], t) for x, t in enumerate(kinds)],
                                             names=["doc_id", "item_id", "similarity", "n_common", "n_item", "start"])

    return C.write_table(docs.select("doc_id", "text", "ids").mapInArrow(C.tidy(run), SCHEMA))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, n_common, n_item, start (word): one row per document and leaked item."""
    spark = docs.sparkSession
    C.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id IS NOT NULL AND text RLIKE '[^ -/:-@]'")
    n = C.count_rows(items)
    out = spark.createDataFrame([], SCHEMA)
    if n:
        docs = hashed(docs)
        weight = idf(docs)
        slices = -(-n // ITEMS)
        for k in range(slices):
            part = sorted(map(tuple, items.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).distinct().collect()))
            part = [(i, t) for i, t in part if _words(t)]
            if part:
                out = out.unionByName(_search(docs, part, weight))
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "n_common", "n_item", "start")).alias("m")).select("doc_id", "item_id", "m.*")


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage (rows without a doc_id stay)."""
    leaked = C.write_table(find_leaks(docs, benchmark).select(F.col("doc_id").alias("__doc")).filter("__doc IS NOT NULL").distinct())
    return docs.join(C.sized_broadcast(leaked, 1_000_000), F.col("doc_id").cast("long") == F.col("__doc"), "left_anti").select(*docs.columns)
