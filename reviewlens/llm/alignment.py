"""Alignment of two tokenizers' tokens over one text by diagonal run skipping.

A byte-level BPE file (A) and a sentencepiece model (B, which adds a space before the text) cut the same
bytes: a space and the text.  The byte offsets at which a token of A and a token of B both end cut the text
into groups; the two tokens that end there are a link.

**Diagonal run skipping** (:func:`runs`): with ``ends_b[i + shift]`` facing ``ends_a[i]``, slices of doubling
length are compared at the present shift and a stretch of equal ends is jumped; a failing probe is halved back
to the end of the stretch.  Where the two differ, only the irregular group is walked token by token, and the
shift moves by the difference of its token counts.

**Counts.**  A stored row per document holds its distinct linked pairs and how often each occurs.  The corpus
counts are sums of those, added up inside each task before the shuffle.  The most frequent pairs, at most
``HEAD`` (17 bytes each), are broadcast, so frequent pairs are never a join key; documents meet the rest of the
pairs by an equi-join.  The head is chosen by a count bound taken from a histogram of a few hundred rows.

**Tokens.**  Pieces cut before spaces and line feeds are encoded once per worker and kept (``CACHE`` pieces);
texts in which a cut could matter are encoded whole.  Texts that are null or empty, or whose tokens' bytes of A
or B differ from the space and the text, have no tokens: zeros and an empty digest.  Each input row gives one
row, repeated rows too (each counts); columns other than doc_id and text are not read.  doc_id may be null.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import common as C

#: Pairs that are broadcast with their counts, at most.
HEAD = 1_000_000
#: Pieces whose ids one Python worker keeps before it starts afresh (about 300 bytes each).
CACHE = 600_000
#: Distinct pairs whose counts a task adds up before it hands them on.
PARTIAL = 2_000_000
TWO_SPACES = re.compile(r"\s\s")
STORED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "pairs array<long>, times array<int>")


# ── the alignment itself ────────────────────────────────────────────────────
def runs(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of A and of B that close each group, in order.

    Both arrays ascend and end at the same offset."""
    raw_a, raw_b = (np.ascontiguousarray(x, "<i8").tobytes() for x in (ends_a, ends_b))  # slices of bytes compare fastest
    at_a, at_b = memoryview(raw_a).cast("q"), memoryview(raw_b).cast("q")
    inner_a: list[int] = []
    inner_b: list[int] = []
    i, shift = 0, 0  # in bytes
    n, m = len(raw_a), len(raw_b)
    while i < n:
        step = 8
        while i + step <= n and i + step + shift <= m and raw_a[i:i + step] == raw_b[i + shift:i + step + shift]:
            i += step
            step *= 2
        while step > 8:  # under step more are equal: halve down to the first that differs
            step //= 2
            if i + step <= n and i + step + shift <= m and raw_a[i:i + step] == raw_b[i + shift:i + step + shift]:
                i += step
        if i == n:
            break
        p, q = i >> 3, (i + shift) >> 3  # an irregular group: go on with the token that ends first
        a, b = at_a[p], at_b[q]
        while a != b:
            if a < b:
                inner_a.append(p)
                p += 1
                a = at_a[p]
            else:
                inner_b.append(q)
                q += 1
                b = at_b[q]
        i = (p + 1) << 3
        shift = (q - p) << 3
    return _all_but(len(ends_a), inner_a), _all_but(len(ends_b), inner_b)


def _all_but(n: int, left_out: list[int]) -> np.ndarray:
    keep = np.ones(n, bool)
    keep[left_out] = False
    return np.flatnonzero(keep)


class PairText(dict):
    """``a|b`` of a pair of ids (a * size_b + b), made once."""

    def __init__(self, size_b: int):
        super().__init__()
        self.size_b = size_b

    def __missing__(self, pair: int) -> str:
        text = f"{pair // self.size_b}|{pair % self.size_b}"
        if len(self) < CACHE:
            self[pair] = text
        return text


class GroupText(dict):
    """Text of a group of several tokens, by its ids; made once."""

    def __missing__(self, ids: tuple[tuple[int, ...], tuple[int, ...]]) -> str:
        text = "|".join(",".join(map(str, x)) for x in ids)
        if len(self) < CACHE and len(ids[0]) + len(ids[1]) < 20:
            self[ids] = text
        return text


def groups_text(a: list[int], b: list[int], close_a: np.ndarray, close_b: np.ndarray, links: list[int],
                pairs: PairText, groups: GroupText) -> str:
    """``a1,a2|b1;a3|b2,b3`` of the groups; ``links`` are the pairs that close them."""
    out = list(map(pairs.__getitem__, links))
    first_a, first_b = np.r_[0, close_a[:-1] + 1], np.r_[0, close_b[:-1] + 1]
    odd = np.flatnonzero((first_a != close_a) | (first_b != close_b))
    for k, i, p, j, q in zip(*(x.tolist() for x in (odd, first_a[odd], close_a[odd], first_b[odd], close_b[odd]))):
        out[k] = groups[tuple(a[i:p + 1]), tuple(b[j:q + 1])]
    return ";".join(out)


# ── tokens ──────────────────────────────────────────────────────────────────
def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters
    stand for themselves, the other bytes for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class Pair:
    """Ids of both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.pieces = C.Pieces(path_a)  # learns many pieces by one library call
        self.whole_a = Tokenizer.from_file(path_a)
        self.whole_a.encode_special_tokens = True
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        chars = _byte_of_char()
        added = self.whole_a.get_added_tokens_decoder()
        self.size_a, self.size_b = self.whole_a.get_vocab_size(), self.sp.get_piece_size()
        self.bytes_a = [b""] * self.size_a
        for token, i in self.whole_a.get_vocab().items():
            self.bytes_a[i] = token.encode() if i in added else bytes(map(chars.__getitem__, token))
        self.bytes_b = []
        for i in range(self.size_b):
            p = self.sp.id_to_piece(i)
            self.bytes_b.append(bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode())
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.pair_text, self.group_text = PairText(self.size_b), GroupText()
        self.dtype_a, self.dtype_b = self.pieces.dtype, np.dtype("<u2" if self.size_b <= 1 << 16 else "<u4")
        self.space = self.sp.piece_to_id("▁")
        # no piece of B may run over the start of a word, else its texts are encoded whole
        self.words_apart = not any("▁" in self.sp.id_to_piece(i).lstrip("▁") for i in range(self.size_b))
        self.special = ["  ", "▁", "\0", *(t.content for t in added.values())]
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.wrong: set[str] = set()

    def _b(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)

    def _learn(self, new: list[str]) -> None:
        """Ids of pieces as they stand inside a text: after a space, or from a line feed on."""
        if not new:
            return
        self.pieces.known.clear()
        self.pieces._learn(new)
        ids_b = self._b(new)
        want = [p if p[:1] == "\n" else " " + p for p in new]
        for k, p in enumerate(new):
            if not p:
                ids_b[k] = [self.space]
            elif p[0] == "\n":  # without the space that B adds
                ids_b[k] = ids_b[k][1:]
        flat = np.array(list(chain.from_iterable(ids_b)), self.dtype_b)
        n = np.array([*map(len, ids_b)], np.int64)
        size_of = np.diff(np.r_[0, np.cumsum(self.len_b[flat])][np.r_[0, np.cumsum(n)]])
        text = [w.encode() for w in want]
        if b"".join(map(self.bytes_b.__getitem__, flat.tolist())) != b"".join(text) or (size_of != [*map(len, text)]).any():
            self.wrong.update(p for p, t, b in zip(new, text, ids_b) if b"".join(map(self.bytes_b.__getitem__, b)) != t)
        raw, size, at = flat.tobytes(), self.dtype_b.itemsize, 0
        for p, b in zip(new, ids_b):
            end = at + size * len(b)
            self.known[p] = (self.pieces.known[p], raw[at:end])
            at = end
        self.pieces.known.clear()

    def _whole_only(self, text: str) -> bool:
        """Could a cut change the text's ids?"""
        return (not self.words_apart or any(map(text.__contains__, self.special)) or text[0].isspace()
                or bool(TWO_SPACES.search(text) and self.pieces.unsafe.search(text)))

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        a = self.whole_a.encode(" " + text, add_special_tokens=False).ids
        b = self.sp.encode(text)
        want = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return None
        return np.array(a, self.dtype_a), np.array(b, self.dtype_b)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B of each text; None where it has no tokens."""
        if len(self.known) > CACHE:
            self.known.clear()
            self.wrong.clear()
        split = [None if not t else False if self._whole_only(t) else t.replace("\n", " \n").split(" ") for t in texts]
        self._learn(list(set().union(*(p for p in split if p)) - self.known.keys()))
        out = []
        for t, parts in zip(texts, split):
            if parts is None:
                out.append(None)
            elif parts is False or (self.wrong and not self.wrong.isdisjoint(parts)):
                out.append(self._whole(t))
            else:
                a, b = zip(*map(self.known.__getitem__, parts))
                out.append((np.frombuffer(b"".join(a), self.dtype_a), np.frombuffer(b"".join(b), self.dtype_b)))
        return out

    def align(self, ids: tuple[np.ndarray, np.ndarray] | None):
        """n_a, n_b, n_groups, digest, distinct pairs (a * size_b + b) and how often each is linked."""
        if ids is None:
            return 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int32)
        a, b = ids
        close_a, close_b = runs(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))
        links = a[close_a].astype(np.int64) * self.size_b + b[close_b]
        text = groups_text(a.tolist(), b.tolist(), close_a, close_b, links.tolist(), self.pair_text, self.group_text)
        pairs, times = np.unique(links, return_counts=True)
        return len(a), len(b), len(close_a), hashlib.sha256(text.encode()).hexdigest(), pairs, times.astype(np.int32)


# ── the corpus ──────────────────────────────────────────────────────────────
def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One stored row per document: token and group counts, digest, its pairs and their times."""
    C.ship(docs.sparkSession)

    def run(batches):
        pair = C.kept(("alignment", path_a, path_b), lambda: Pair(path_a, path_b))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for s, e in C.chunks(texts, 1_000_000):
                rows = [pair.align(x) for x in pair.encode(texts[s:e])]
                n_a, n_b, n_groups, digest, pairs, times = map(list, zip(*rows))
                long = lambda x: pa.array(x, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[s:e], batch.column("doc_id")[s:e], long(n_a), long(n_b), long(n_groups), long(n_groups),
                     pa.array(digest, pa.string()), _lists(pairs, pa.int64()), _lists(times, pa.int32())],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = C.id_and_text(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return C.write_table(rows.mapInArrow(run, STORED))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, times and list ends of a batch."""
    pairs, times = batch.column("pairs"), batch.column("times")
    ends = np.r_[0, np.cumsum(pairs.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    return pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64), ends


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.empty(0, np.int64)
    return pairs[first], np.add.reduceat(n, first) if len(first) else n


def pair_counts(stored: DataFrame, size_b: int) -> DataFrame:
    """pair, n and best (n is the highest of its id of B) over the corpus; stored."""

    def run(batches):
        def emit(p, n):
            return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

        p, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            pairs, times, _ = _flat(batch)
            p, n = _summed(np.r_[p, pairs], np.r_[n, times])
            if len(p) > PARTIAL:
                yield emit(p, n)
                p, n = p[:0], n[:0]
        if len(p):
            yield emit(p, n)

    part = stored.select("pairs", "times").mapInArrow(run, "pair long, n long")
    total = C.write_table(part.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("__b", F.col("pair") % F.lit(size_b)))
    highest = total.groupBy("__b").agg(F.max("n").alias("__n"))  # one row per id of B: its vocabulary bounds it
    return C.write_table(total.join(F.broadcast(highest), "__b").select("pair", "n", (F.col("n") == F.col("__n")).alias("best")))


def _step() -> Column:
    """Counts in 16 steps per power of two."""
    return F.floor(F.log2("n") * F.lit(16)).cast("int")


def head_bound(counts: DataFrame, most: int) -> int:
    """The least count step whose pairs, and all of higher steps, are at most ``most``."""
    hist = counts.groupBy(_step().alias("step")).agg(F.count(F.lit(1)).alias("c")).collect()  # some hundred rows
    bound, total = 1 << 20, 0
    for step, c in sorted(hist, reverse=True):
        total += c
        if total > most:
            break
        bound = step
    return bound


def align_documents(docs: DataFrame, path_a: str, path_b: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``."""
    import sentencepiece

    spark = docs.sparkSession
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    stored = aligned(docs, path_a, path_b)
    counts = pair_counts(stored, size_b)
    bound = head_bound(counts, head)
    top = counts.where(_step() >= bound).orderBy("pair").toArrow()
    known = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))
    tail = counts.where(_step() < bound)
    has_tail = not tail.isEmpty()

    def look_up(pairs):
        p, n, best = known.value
        at = np.searchsorted(p, pairs)
        at[at == len(p)] = 0
        hit = p[at] == pairs if len(p) else np.zeros(len(pairs), bool)
        return hit, np.where(hit, n[at], 0) if len(p) else np.zeros(len(pairs), np.int64), hit & best[at] if len(p) else hit

    def sums(batches):
        for batch in batches:
            pairs, times, ends = _flat(batch)
            _, n, best = look_up(pairs)
            total = lambda x: np.diff(np.r_[0, np.cumsum(x)][ends])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in KEPT), pa.array(total(times * best), pa.int64()), pa.array(total(times * n), pa.int64())],
                names=[*KEPT, "n_best", "count_sum"])

    def rest(batches):
        for batch in batches:
            pairs, times, ends = _flat(batch)
            hit, _, _ = look_up(pairs)
            row = np.repeat(batch.column("row").to_numpy(), np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(row[~hit], pa.int64()), pa.array(pairs[~hit], pa.int64()), pa.array(times[~hit], pa.int64())],
                                             names=["row", "pair", "times"])

    out = stored.mapInArrow(sums, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                  "groups_sha256 string, n_best long, count_sum long")
    if has_tail:
        far = stored.select("row", "pairs", "times").mapInArrow(rest, "row long, pair long, times long").join(tail, "pair")
        far = far.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best"),
                                     F.sum(F.col("times") * F.col("n")).alias("__sum"))
        out = out.join(far, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("__best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0))})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


KEPT = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
