"""Concatenate-and-cut packing with two-pass prefix sums.

Pass 1 tokenises every document once and stores its ids with the partition
that made them and the offset inside that partition.  Partition totals get
their prefix sums in two levels (runs of partitions, then partitions inside a
run), which gives every document its global offset.  Pass 2 cuts at fixed
multiples of the window.  Windows that lie inside one task's rows are built
there; only the boundary records of windows that cross tasks are shuffled.

Edge cases: a null or empty text is the end id alone; repeated rows are packed
once each; an empty table gives no pieces; extra columns are ignored.  Only the
last window is short; it is padded in ``sequences``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm import common as C

WINDOW = 1024
#: Prefix sums: partitions in one run of the first level.
RUN = 4096
#: Rows of (partition, offset) that may be broadcast (24 bytes each); more are joined by shuffle.
BROADCAST_PARTS = 200_000


def tokenised(docs: DataFrame, path: str, end_id: int, most: int = C.CACHE_PIECES) -> DataFrame:
    """Stored rows: part, part_start (offset in the part), doc_id, n_tokens, ids (16- or 32-bit little-endian).
    A worker keeps the ids of at most ``most`` pieces."""
    C.ship(docs.sparkSession)

    def run(batches):
        enc = C.pieces(path, most)
        end = np.array([end_id], enc.dtype).tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j in C.spans(b.column("text"), min(3_000_000, 5 * most)):  # a chunk's pieces come on top of those kept
                ids = [x + end for x in enc.encode(b.column("text").slice(i, j - i).to_pylist())]
                n = np.array([len(x) // enc.dtype.itemsize for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(j - i, part, np.int64)), pa.array(at + np.cumsum(n) - n), b.column("doc_id").slice(i, j - i),
                     pa.array(n), pa.array(ids, pa.binary())],
                    names=["part", "part_start", "doc_id", "n_tokens", "ids"])
                at += int(n.sum())

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return C.write_table(rows.mapInArrow(C.tidy(run), "part long, part_start long, doc_id long, n_tokens long, ids binary"))


def prefix_sums(totals: DataFrame, key: str, value: str, run: int = RUN) -> DataFrame:
    """key -> sum of ``value`` over smaller keys; no window sees more than ``run`` keys or all runs."""
    rows = totals.withColumn("run", F.floor(F.col(key) / run))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("run").agg(F.sum(value).alias("v")).select("run", F.coalesce(F.sum("v").over(before), F.lit(0)).alias("head"))
    inside = Window.partitionBy("run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(heads, "run").select(
        key, (F.col("head") + F.coalesce(F.sum(value).over(inside), F.lit(0))).cast("long").alias("base"))


def placed(tokens: DataFrame) -> DataFrame:
    """``tokens`` with the global ``base`` of each row."""
    bases = C.write_table(prefix_sums(tokens.groupBy("part").agg(F.sum("n_tokens").alias("v")), "part", "v"))
    small = C.count_rows(bases) <= BROADCAST_PARTS
    return tokens.join(F.broadcast(bases) if small else bases, "part").select(
        "doc_id", "n_tokens", "ids", (F.col("base") + F.col("part_start")).alias("base"))


def pieces(docs: DataFrame, path: str, end_id: int = 0, window: int = WINDOW, most: int = C.CACHE_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (32-bit little-endian)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            base, n = b.column("base").to_numpy(), b.column("n_tokens").to_numpy()
            first, last = base // window, (base + n - 1) // window
            k = last - first + 1
            row = np.repeat(np.arange(len(n)), k)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            lo, hi = np.maximum(seq * window, base[row]), np.minimum((seq + 1) * window, base[row] + n[row])
            kept = b.column("ids").to_pylist()
            dtype = np.dtype(f"<u{len(kept[0]) // n[0]}")  # as wide as the encoder stored them; the end id is always there
            raw = [np.frombuffer(x, dtype).astype("<u4") for x in kept]
            cut = [raw[r][i:j].tobytes() for r, i, j in zip(row.tolist(), (lo - base[row]).tolist(), (hi - base[row]).tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), pa.array(lo - base[row]), pa.array(hi - lo), pa.array(n[row]),
                 pa.array(seq), pa.array(lo - seq * window), pa.array(cut, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    rows = placed(tokenised(docs, path, end_id, most))
    return rows.mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(parts: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (exactly ``window`` 32-bit ids), n_tokens.  Windows that a task holds whole are joined
    there; the boundary records of the others meet by sequence_id (a group never exceeds one window)."""

    def whole(batches):
        held: dict[int, list] = {}
        for b in batches:
            for s, o, n, x in zip(*(b.column(c).to_pylist() for c in ("sequence_id", "offset", "length", "ids"))):
                held.setdefault(s, []).append((o, n, x))
            done = [s for s, p in held.items() if sum(n for _, n, _ in p) == window]
            yield out([(s, 0, window, b"".join(x for _, _, x in sorted(held.pop(s)))) for s in done])
        yield out([(s, o, n, x) for s, p in held.items() for o, n, x in p])

    def out(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
            names=["sequence_id", "offset", "length", "ids"])

    pad = int(pad_id).to_bytes(4, "little")
    rows = parts.mapInArrow(whole, "sequence_id long, offset long, length long, ids binary")
    full = rows.filter(F.col("length") == window).select("sequence_id", "ids", F.col("length").alias("n_tokens"))
    joined = (rows.filter(F.col("length") < window).groupBy("sequence_id")
              .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
              .select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), "n_tokens")
              .withColumn("ids", F.when(F.col("n_tokens") == window, F.col("ids"))
                          .otherwise(F.concat("ids", F.unhex(F.repeat(F.lit(pad.hex()), (F.lit(window) - F.col("n_tokens")).cast("int")))))))
    return full.unionByName(joined)
