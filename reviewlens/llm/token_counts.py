"""Token counts by rank-synchronous array merging.

Pre-tokens of many texts lie in ragged numpy arrays (symbols + row starts).
In each round every pre-token finds its own lowest-rank adjacent pair and all
rows apply theirs at once; rows without a mergeable pair leave the arrays
with their length as the count.  A merge only ever forms pairs of higher rank,
so applying all occurrences of the lowest pair together equals the library's
one-by-one order.

Edge cases: null or empty text counts 0 bytes and 0 tokens; extra columns are
ignored; repeated rows give repeated rows; an empty table gives an empty table;
a tokenizer file with another pre-tokeniser, a normaliser or another model than
plain byte-level BPE raises.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import common as C

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
NONE = np.int32(2**31 - 1)

# ───────────────────────────── FIXED VALUES ─────────────────────────────
# Pre-token pattern of the byte-level BPE family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ─────────────────────────── END FIXED VALUES ───────────────────────────


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


def _check(spec: dict, path: str) -> None:
    """Raise unless the file asks for exactly what this module does."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
             and not spec.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True))
    if not plain:
        raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")


class RankTable:
    """(left id, right id) -> rank and merged id, as an open-addressing table in numpy arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec, path)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.first = np.array([vocab[c] for c in _byte_letters()], np.int64)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        self.to = np.zeros(1 << self.bits, np.int32)
        mask = (1 << self.bits) - 1
        for rank, (key, slot, new) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), merged.tolist())):
            while self.key[slot] >= 0 and self.key[slot] != key:
                slot = (slot + 1) & mask
            if self.key[slot] < 0:
                self.key[slot], self.rank[slot], self.to[slot] = key, rank, new

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no such merge) and merged id of each pair."""
        key = (left << 32) | right
        slot = self._slot(key)
        rank, to = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int32)
        todo = np.arange(len(key))
        while len(todo):
            at = self.key[slot]
            hit = at == key[todo]
            rank[todo[hit]], to[todo[hit]] = self.rank[slot[hit]], self.to[slot[hit]]
            go = ~hit & (at >= 0)
            todo, slot = todo[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return rank, to

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token."""
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = size.copy()
        sym = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        row = np.repeat(np.arange(len(tokens)), size)
        rank, to = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        pair = np.flatnonzero(row[1:] == row[:-1])
        rank[pair], to[pair] = self.find(sym[pair], sym[pair + 1])
        while len(sym):
            new_row = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            size = np.diff(np.r_[new_row, len(sym)])
            least = np.minimum.reduceat(rank, new_row)
            out[row[new_row]] = size
            open_ = np.repeat(least != NONE, size)
            least = np.repeat(least, size)[open_]
            sym, row, rank, to = sym[open_], row[open_], rank[open_], to[open_]
            if not len(sym):
                break
            hit = rank == least
            at = np.flatnonzero(hit)
            start = np.r_[True, np.diff(at) > 1]  # "aaaa": only each second hit of a run merges
            first = np.maximum.accumulate(np.where(start, at, 0))
            at = at[((at - first) & 1) == 0]
            sym[at] = to[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            sym, row, rank, to = sym[stay], row[stay], rank[stay], to[stay]
            at = moved[at]
            near = np.unique(np.r_[at, at[at > 0] - 1])
            rank[near] = NONE
            near = near[near + 1 < len(sym)]
            near = near[row[near] == row[near + 1]]
            rank[near], to[near] = self.find(sym[near], sym[near + 1])
        return out


class Counter:
    """Token counts of texts; counts of pieces are kept per worker up to a bound."""

    def __init__(self, path: str):
        import regex

        self.table = RankTable(path)
        self.pattern = regex.compile(PATTERN)
        self.unsafe = re.compile(C.UNSAFE)
        self.added = re.compile("|".join(map(re.escape, self.table.added))) if self.table.added else None
        self.known: dict[str | tuple[str], int] = {}

    def _learn(self, pieces: list[str], at_once: int = 50_000) -> list[int]:
        out: list[int] = []
        for i in range(0, len(pieces), at_once):
            split = [self.pattern.findall(p) for p in pieces[i:i + at_once]]
            flat = [t.encode("utf-8", "surrogatepass") for s in split for t in s]
            ends = np.cumsum([0, *map(len, split)])
            total = np.r_[0, np.cumsum(self.table.counts(flat))] if flat else np.zeros(1, np.int64)
            out += (total[ends[1:]] - total[ends[:-1]]).tolist()
        return out

    def _plain(self, texts: list[str]) -> list[int]:
        whole = [bool(self.unsafe.search(t)) for t in texts]
        split = [[] if w or not t else t.replace("\n", " \n").split(" ") for t, w in zip(texts, whole)]
        # the first piece of a text has no space before it, so it is kept under a key of its own kind
        split = [[(s[0],), *s[1:]] if s else s for s in split]
        if len(self.known) > C.CACHE_PIECES:
            self.known.clear()
        new = list(set().union(*split) - self.known.keys())
        as_text = [p[0] if isinstance(p, tuple) else p if p[:1] == "\n" else " " + p for p in new]
        self.known.update(zip(new, self._learn(as_text)))
        long = iter(self._learn([t for t, w in zip(texts, whole) if w]))
        return [next(long) if w else sum(map(self.known.__getitem__, s)) for s, w in zip(split, whole)]

    def count(self, texts: list[str | None]) -> list[int]:
        parts: list[str] = []
        ends, marks = [], []
        for t in texts:
            cut = [t or ""] if not t or not self.added else self.added.split(t)
            parts += cut
            ends.append(len(parts))
            marks.append(len(cut) - 1)
        total = np.r_[0, np.cumsum(self._plain(parts))]
        return [int(total[e] - total[s]) + m for s, e, m in zip([0, *ends], ends, marks)]


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (a per-row map: no shuffle)."""
    C.ship(docs.sparkSession)

    def run(batches):
        counter = C.kept(("ranks", path), lambda: Counter(path))
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [x for i, j in C.chunks(texts) for x in counter.count(texts[i:j])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, SCHEMA)
