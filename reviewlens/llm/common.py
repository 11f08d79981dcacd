"""Helpers shared by the training-data operators (input shape, shared folder, words, tokens)."""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens import session

DOC_COLS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A word is a run of characters other than ASCII white space.
WORD_SEP = r"[\x20\x09-\x0D]+"
#: Token-piece cache entries kept by one Python worker before it starts afresh (about 250 MB).
CACHE_PIECES = 900_000
#: The same for restored words (about 100 MB), and for word hashes (about 20 MB; a larger table is slower).
CACHE_WORDS, CACHE_HASHES = 400_000, 100_000
#: Bytes of an Arrow batch where many stages share executors; the JVM and the Python worker hold a few batches for each task.
BATCH_BYTES = 4_000_000
#: Bits of a sieve: 16 for each key, rounded up to a power of two, between these (8 MB at most; beyond, it lets more rows through).
SIEVE_BITS = (16, 26)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not installed (same folder on each node, or --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def small_batches(spark: SparkSession) -> None:
    """Send rows to and from Python workers in batches of at most ``BATCH_BYTES`` (or what the session sets, if that is
    less).  With Spark's 64 MB a task's whole split is one batch, in the JVM and in the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(name).strip().lower())
    if not size or not 0 < int(size[1]) * 1024 ** " kmgtp".index(size[2] or " ") <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*DOC_COLS)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text (string); without a cast where the types are right, so that equal scans are seen as equal."""
    kinds = dict(docs.dtypes)
    want = {"doc_id": "bigint", "text": "string"}
    return docs.select(*[F.col(c) if kinds[c] == k else F.col(c).cast(k) for c, k in want.items()])


def fresh_dir(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder that the session names."""
    return f"{session.checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


def write_table(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    return session.write_table(df)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# ── words and hashes ────────────────────────────────────────────────────────
def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words; ``bytes.split()`` cuts exactly at \\x20 and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """word -> its 64-bit hash as 8 bytes; bounded, so a worker's memory does not follow the vocabulary."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        if len(self) >= CACHE_HASHES:
            self.clear()
        value = xxhash.xxh64_digest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=">u8").astype(np.uint64)


_ODD = np.array([0x9E3779B97F4A7C15], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hash(h: np.ndarray, k: int, odd: np.ndarray = _ODD) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values: doubling, so log2(k) vector steps."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size, block = odd, 1, h
    out, done = None, 0
    while True:
        if k & size:
            if out is None:
                out, done = block[:n], size
            else:
                out = out * power + block[done:done + n]
                done += size
        if done == k:
            return mix(out)
        block = block[:-size] * power + block[size:]
        power = power * power
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


# ── tokenizers ──────────────────────────────────────────────────────────────
def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Texts in which a cut before a space or line feed could change a pre-token: they are encoded whole.
UNSAFE = r"\s\s\s|\s\s\Z|\A\s"


class Pieces:
    """Token ids of whole texts by the tokenizers library, one library call per batch of unseen pieces.

    A byte-level BPE pre-token never spans a cut before a space or line feed
    that stands next to other text (``UNSAFE`` lists the exceptions), so the
    ids of such pieces can be kept and joined.  New pieces without white space
    are encoded as one text and cut where the bytes of the tokens reach the
    spaces; the others are kept apart by a special string.  The test compares
    with encoding each text whole.
    """

    def __init__(self, path: str, most: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut, self.cut_id = next(iter(added.items()))
        self.wide = self.tok.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.added = list(added)
        self.unsafe = re.compile("|".join([UNSAFE, *map(re.escape, added)]))
        self.two = re.compile(r"\s\s")
        #: Bytes of each id: a byte-level entry spells one byte by one character.
        vocabulary = self.tok.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.known: dict[str, bytes] = {}
        self.most = most
        self.lf = len(self._ids("\n")) * self.dtype.itemsize

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, pieces: list[str]) -> None:
        """Keep the ids of the pieces (each once, none holds a special string)."""
        if not pieces:
            return
        words = set(" ".join(pieces).split())  # a piece with white space is no such word
        plain = [p for p in pieces if p in words]
        if plain and self._learn_plain(plain):
            pieces = [p for p in pieces if p not in words]
        if pieces:
            self._learn_apart(pieces)

    def _learn_plain(self, pieces: list[str]) -> bool:
        """Pieces without white space; False: the tokens do not break at every space, nothing is kept."""
        text = " " + " ".join(pieces)
        a = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        flat = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        starts, ends = np.flatnonzero(flat == 32)[1:], np.cumsum(self.n_bytes[a])
        if not len(ends) or ends[-1] != len(flat):
            return False
        at = np.searchsorted(ends, starts) + 1
        if (ends[at - 1] != starts).any():
            return False
        raw, size = a.tobytes(), self.dtype.itemsize
        at = [0, *(at * size).tolist(), len(raw)]
        for p, i, j in zip(pieces, at, at[1:]):
            self.known[p] = raw[i:j]
        return True

    def _learn_apart(self, pieces: list[str]) -> None:
        text = self.cut.join(p if p[:1] == "\n" else " " + p for p in pieces)
        a = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        raw, size = a.tobytes(), self.dtype.itemsize
        ends = (np.flatnonzero(a == self.cut_id) * size).tolist()
        for p, i, j in zip(pieces, [0, *[e + size for e in ends]], [*ends, len(raw)]):
            self.known[p] = raw[i:j]

    def _whole(self, text: str) -> bool:
        """Must the text be encoded whole?  The full pattern is slow and looks only where a plain test finds something."""
        some = text[0].isspace() or self.two.search(text) or any(x in text for x in self.added)
        return bool(some and self.unsafe.search(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text (null: none)."""
        if len(self.known) > self.most:
            self.known.clear()
        split = [None if not t else False if self._whole(t) else ("\n" + t.replace("\n", " \n")).split(" ")
                 for t in texts]
        self._learn(list(set().union(*(p for p in split if p)) - self.known.keys()))
        get = self.known.__getitem__
        return [b"" if p is None else self._ids(t).tobytes() if p is False else b"".join(map(get, p))[self.lf:]
                for t, p in zip(texts, split)]


_KEPT: dict[object, object] = {}


def give_back(collect: bool = True) -> None:
    """Return freed memory to the machine: the JVM and the other workers of an executor share its limit."""
    import ctypes
    import gc

    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """``run`` (batches to batches), which returns a task's memory when the task ends: workers live on, and what one
    stage needed would otherwise count against the next."""

    def tidied(batches):
        yield from run(batches)
        give_back(collect=False)

    return tidied


def forget() -> None:
    """Drop what other operators' tasks have kept in this worker."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def kept(key, make):
    """One object per Python worker: the last one asked for.  A worker that goes on to another
    operator's tasks drops what the first one kept."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def pieces(path: str, most: int = CACHE_PIECES) -> Pieces:
    return kept(("pieces", path, most), lambda: Pieces(path, most))


def chunks(texts: list[str | None], most: int = 3_000_000):
    """Index ranges of at most about ``most`` characters, so that work arrays stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 100
        if size > most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def spans(texts, most: int = 3_000_000):
    """``chunks`` of an Arrow text column, before any text becomes a Python object."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 100)
    start = 0
    while start < len(ends):
        stop = min(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most)) + 1, len(ends))
        yield start, stop
        start = stop


def release(spark: SparkSession) -> None:
    """Let the driver notice that the broadcast tables and shuffle files of finished steps are out of use: until its next
    garbage collection they stay in the executors' memory and on their disks."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def count_rows(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def sized_broadcast(df: DataFrame, most: int) -> DataFrame:
    """``df`` (a stored table) marked for broadcast if it has at most ``most`` rows; else a plain shuffle join."""
    return F.broadcast(df) if count_rows(df) <= most else df


def bit_table(keys: DataFrame):
    """A broadcast table with a bit set for the top bits of each key (stored, one long column of hashes), and its size in bits."""
    bits = min(max(SIEVE_BITS[0], (16 * count_rows(keys)).bit_length()), SIEVE_BITS[1])
    block = min(bits, 18)
    place = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - bits)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << block, np.uint8)
        flags[rows["at"].to_numpy() & ((1 << block) - 1)] = 1
        return pd.DataFrame({"block": rows["block"][:1], "bits": [np.packbits(flags).tobytes()]})

    at = keys.select(place.alias("at")).withColumn("block", F.shiftright("at", block))
    table = np.zeros((1 << bits - block, 1 << block - 3), np.uint8)
    for b, x in at.groupBy("block").applyInPandas(run, "block long, bits binary").toPandas().itertuples(index=False):
        table[b] = np.frombuffer(x, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table.tobytes()), bits


def sieve(rows: DataFrame, column: str, table, inside: bool = True) -> DataFrame:
    """Rows whose ``column`` (a long of hash bits) may be a key of the bit table, or else those where it is none."""
    sent, bits = table

    def run(batches):
        flags = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            at = b.column(column).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            found = (flags[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1
            yield b.filter(pa.array(found == inside))

    return rows.mapInArrow(tidy(run), rows.schema)


def matching(rows: DataFrame, table: DataFrame, on: list[str], most: int) -> DataFrame:
    """``rows`` joined with ``table`` (stored) on whole keys.  A table of over ``most`` rows is not broadcast; then only
    rows that pass a sieve of its keys are shuffled, as the others (long texts, say) meet nothing."""
    if count_rows(table) <= most:
        return rows.join(F.broadcast(table), on)
    keys = bit_table(table.select(F.xxhash64(*on).alias("__key")))
    return sieve(rows.withColumn("__key", F.xxhash64(*on)), "__key", keys).drop("__key").join(table, on)


def without(rows: DataFrame, table: DataFrame, on: list[str], most: int) -> DataFrame:
    """``rows`` that ``table`` (stored) does not hold; beyond ``most`` rows of it, only rows that pass a sieve are shuffled."""
    if count_rows(table) <= most:
        return rows.join(F.broadcast(table), on, "left_anti").select(*rows.columns)
    keys = bit_table(table.select(F.xxhash64(*on).alias("__key")))
    every = rows.withColumn("__key", F.xxhash64(*on))
    some = sieve(every, "__key", keys).drop("__key").join(table, on, "left_anti").select(*rows.columns)
    return sieve(every, "__key", keys, False).drop("__key").unionByName(some)


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
