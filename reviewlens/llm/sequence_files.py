"""Token ids and masks as Arrow IPC files of fixed-size-list batches.

Documents go to shards by ranges of doc_id.  Each shard is one Arrow IPC file:
record batches of ``ids: fixed_size_list<uint16|uint32>[length]`` and
``mask: fixed_size_list<bool>[length]``, uncompressed, so that a memory-mapped
reader gets sequence i, or any run of ids, without a copy.  An index file per
shard holds doc_id, first id and number of ids.  File names carry a random
part and the manifest (written by Spark's own commit) lists the files of the
tasks that won, so a retried or doubled task leaves no wrong file in use.

Edge cases: null or empty text is the end id alone; null doc_ids come first;
repeated rows are written once each; an empty table gives an empty manifest.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import common as C
from reviewlens.llm.packing import prefix_sums

LENGTH = 1024
#: Sequences in one record batch.
BATCH = 512
MANIFEST = "shard long, path string, index_path string, n_docs long, n_tokens long, n_sequences long"


def _store(path: str):
    """(file system, path in it) of a folder or file in the shared folder."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


class ShardWriter:
    """Streams ids into fixed-length rows; holds at most one batch."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, length: int):
        fs, root = _store(folder)
        fs.create_dir(root, recursive=True)
        name = f"{shard:08d}-{uuid.uuid4().hex}"
        self.path, self.index_path = f"{folder}/{name}.arrow", f"{folder}/{name}.index.arrow"
        self.kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sinks = [fs.open_output_stream(f"{root}/{name}.arrow"), fs.open_output_stream(f"{root}/{name}.index.arrow")]
        self.data = pa.ipc.new_file(self.sinks[0], self.schema)
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.index = pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.dtype, self.length, self.left = dtype, length, [np.empty(0, dtype)]
        self.waiting = self.tokens = self.docs = self.rows = 0

    def add(self, doc_ids, ids: list[bytes]) -> None:
        n = np.array([len(x) // self.dtype.itemsize for x in ids], np.int64)
        start = self.tokens + np.cumsum(n) - n
        self.index.write_batch(pa.record_batch([doc_ids, pa.array(start), pa.array(n)], schema=self.index_schema))
        self.tokens += int(n.sum())
        self.docs += len(ids)
        self.left.append(np.frombuffer(b"".join(ids), self.dtype))
        self.waiting += int(n.sum())
        if self.waiting >= BATCH * self.length:
            self._flush()

    def _flush(self) -> None:
        """Write all full batches; every batch but the last of a file has BATCH rows."""
        flat, size = np.concatenate(self.left), self.length * BATCH
        full = len(flat) // size * size
        for i in range(0, full, size):
            self._write(flat[i:i + size], size)
        self.left, self.waiting = [flat[full:]], len(flat) - full

    def _write(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        self.data.write_batch(pa.record_batch(
            [pa.FixedSizeListArray.from_arrays(pa.array(flat, self.kind), self.length),
             pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.rows += len(flat) // self.length

    def close(self) -> None:
        self._flush()
        rest = self.left[0]
        if len(rest):
            self._write(np.r_[rest, np.zeros(-len(rest) % self.length, self.dtype)], len(rest))
        for x in (self.data, self.index, *self.sinks):
            x.close()


class ShardReader:
    """Random access to one shard; a local file is memory-mapped."""

    def __init__(self, path: str):
        fs, at = _store(path)
        source = pa.memory_map(at) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(at)
        self.file = pa.ipc.open_file(source)
        kind = self.file.schema.field("ids").type
        self.length, self.dtype = kind.list_size, np.dtype(kind.value_type.to_pandas_dtype())

    def batch(self, k: int) -> pa.RecordBatch:
        return self.file.get_batch(k)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """ids and mask of sequence i, both without a copy (all batches but the last have BATCH rows)."""
        b, r = self.batch(i // BATCH), i % BATCH
        at = slice(r * self.length, (r + 1) * self.length)
        return b.column("ids").values.to_numpy()[at], b.column("mask").values[at]

    def run(self, start: int, n: int) -> np.ndarray:
        """n ids from id ``start`` of the shard; a copy is made only where a run crosses batches."""
        size, out = BATCH * self.length, []
        while n:
            k, o = divmod(start, size)
            out.append(self.batch(k).column("ids").values.to_numpy()[o:o + n])
            start, n = start + len(out[-1]), n - len(out[-1])
        return out[0] if len(out) == 1 else np.concatenate([np.empty(0, self.dtype), *out])


def write(docs: DataFrame, path: str, end_id: int = 2, length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the stored manifest, one row per shard."""
    spark = docs.sparkSession
    C.ship(spark)
    folder = folder or C.fresh_dir(spark)

    def run(batches):
        enc, out = C.pieces(path), None
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            out = out or ShardWriter(folder, TaskContext.get().partitionId(), enc.dtype, length)
            texts = b.column("text").to_pylist()
            for i, j in C.chunks(texts):
                out.add(b.column("doc_id").slice(i, j - i), [x + end for x in enc.encode(texts[i:j])])
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{
                "shard": TaskContext.get().partitionId(), "path": out.path, "index_path": out.index_path,
                "n_docs": out.docs, "n_tokens": out.tokens, "n_sequences": out.rows}])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id"), F.xxhash64("text")]  # the hash splits one repeated doc_id over shards
    rows = rows.repartitionByRange(C.partitions_for(spark), *order).sortWithinPartitions(*order)
    return C.write_table(rows.mapInArrow(run, MANIFEST))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (32-bit little-endian), from the files."""
    spark = manifest.sparkSession
    C.ship(spark)

    def run(batches):
        for b in batches:
            for path, index_path, base in zip(*(b.column(c).to_pylist() for c in ("path", "index_path", "base"))):
                shard = ShardReader(path)
                fs, at = _store(index_path)
                index = pa.ipc.open_file(fs.open_input_file(at))
                for k in range(index.num_record_batches):
                    x = index.get_batch(k)
                    ids = [shard.run(s, n).astype("<u4").tobytes() for s, n in zip(x.column("start").to_pylist(), x.column("n_tokens").to_pylist())]
                    yield pa.RecordBatch.from_arrays(
                        [x.column("doc_id"), pa.array(x.column("start").to_numpy() + base), x.column("n_tokens"), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    bases = prefix_sums(manifest.select("shard", "n_tokens"), "shard", "n_tokens")
    shards = manifest.join(bases, "shard").select("path", "index_path", "base")
    return (shards.repartition(C.partitions_for(spark), "path")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary"))
