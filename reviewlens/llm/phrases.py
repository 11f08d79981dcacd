"""Repeated-phrase automata: find passages that recur across documents and remove later copies.

1. Every window of ``WINDOW`` words is labelled with the least hash among its
   ``ANCHOR``-word phrases, so equal windows carry equal labels.  Runs of
   windows with one label are segments; a label seen in one document only
   cannot hold a recurring window.  Counting labels is a partial aggregation,
   whatever a passage's frequency.
2. Confirm: segments that are equal everywhere belong to the smallest doc_id
   that has them; where segments under a label differ, their distinct windows
   are compared one by one.  Owned runs join to passages (owner, start, words).
3. Compile: documents with passages to remove are dealt to shards of bounded
   size; a shard's automaton (pyahocorasick, over word numbers) holds the
   passage texts its documents need, fetched from the owners once per shard,
   so a passage in a third of all documents loads no shard more than once.
4. Stream each shard's documents through its automaton; every occurrence of a
   passage owned by a smaller doc_id is removed.  The automaton compares words
   themselves, so a hash never removes anything by itself.

Texts are shuffled twice, whatever the size (for windows that need a closer
look, and for the automata); nothing is broadcast by hand.

Edge cases: null or empty texts keep nothing and remove nothing; fewer than
``WINDOW`` words: kept whole; a null doc_id neither owns nor loses words; equal
doc_ids do not remove from each other; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import common as C

WINDOW = 50
ANCHOR = 8
#: Words per shard, of its documents and of the passages they need; one document is never split.
SHARD_WORDS = 600_000
KEY = ["doc_id", "th"]


def _labels(words: list[bytes], window: int, anchor: int, hashes: C.WordHashes):
    """Per window: label and content hash."""
    h = hashes.array(words)
    return C.sliding_min(C.window_hash(h, anchor), window - anchor + 1), C.window_hash(h, window)


def segments(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, th, w (words of the document), s, n (windows), fp (label), seg (content hash) of every segment of every document."""

    def run(batches):
        hashes = C.kept("words", C.WordHashes)
        power = np.empty(0, np.uint64)
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("doc_id", "th", "text"))))
            for i, j in C.chunks([r[2] for r in rows]):
                doc, th, size, out = [], [], [], []
                for d, t, x in rows[i:j]:
                    w = C.words_of(x)
                    if len(w) < window:
                        continue
                    label, content = _labels(w, window, anchor, hashes)
                    s = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
                    n = np.diff(np.r_[s, len(label)])
                    if n.max() > len(power):
                        power = np.cumprod(np.full(2 * n.max(), 0x9E3779B97F4A7C15, np.uint64))
                    at = np.arange(len(label)) - np.repeat(s, n)
                    seg = C.mix(np.add.reduceat(content * power[at], s) + n.astype(np.uint64))
                    doc.append(np.full(len(s), d))
                    th.append(np.full(len(s), t))
                    size.append(np.full(len(s), len(w)))
                    out.append((s, n, label[s], seg))
                if out:
                    s, n, fp, seg = (np.concatenate([o[k] for o in out]) for k in range(4))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(doc), pa.int64()), pa.array(np.concatenate(th), pa.int64()), pa.array(np.concatenate(size), pa.int64()),
                         pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(C.as_long(fp)), pa.array(C.as_long(seg))],
                        names=["doc_id", "th", "w", "s", "n", "fp", "seg"])

    return rows.mapInArrow(run, "doc_id long, th long, w long, s int, n int, fp long, seg long")


def _windows(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """fp, seg, j, wh, doc_id, th, pos of each window of the segments listed in ``segs``."""

    def run(batches):
        hashes = C.kept("words", C.WordHashes)
        for b in batches:
            for d, t, x, segs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "th", "text", "segs"))):
                _, content = _labels(C.words_of(x), window, anchor, hashes)
                wh = C.as_long(content)
                s, n = (np.array([g[k] for g in segs], np.int64) for k in ("s", "n"))
                row = np.repeat(np.arange(len(s)), n)
                j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                pos = s[row] + j
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g["fp"] for g in segs], pa.int64()).take(pa.array(row)), pa.array([g["seg"] for g in segs], pa.int64()).take(pa.array(row)),
                     pa.array(j.astype(np.int32)), pa.array(wh[pos]), pa.array(np.full(len(row), d)), pa.array(np.full(len(row), t)),
                     pa.array(pos.astype(np.int32))], names=["fp", "seg", "j", "wh", "doc_id", "th", "pos"])

    return rows.select(*KEY, "text", "segs").mapInArrow(run, "fp long, seg long, j int, wh long, doc_id long, th long, pos int")


RUN = "array<struct<s:int,n:int,o_doc:bigint,o_th:bigint,o_s:int>>"


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Joins the runs listed in ``runs`` of each row: neighbours that continue each other become one."""

    def run(batches):
        for b in batches:
            lists = b.column("runs")
            row, v = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy()), lists.flatten()
            s, n, o, t, p = (v.field(k).to_numpy().astype(np.int64) for k in ("s", "n", "o_doc", "o_th", "o_s"))
            order = np.lexsort((p, t, o, n, s, row))
            row, s, n, o, t, p = (x[order] for x in (row, s, n, o, t, p))
            new = np.ones(len(row), bool)
            new[1:] = ((row[1:] != row[:-1]) | (o[1:] != o[:-1]) | (t[1:] != t[:-1])
                       | (s[1:] != s[:-1] + n[:-1]) | (p[1:] != p[:-1] + n[:-1]))
            at = np.flatnonzero(new)
            total = np.add.reduceat(n, at) if len(at) else n
            ends = np.r_[0, np.cumsum(np.bincount(row[at], minlength=b.num_rows))]
            joined = pa.StructArray.from_arrays(
                [pa.array(s[at].astype(np.int32)), pa.array(total.astype(np.int32)), pa.array(o[at]), pa.array(t[at]), pa.array(p[at].astype(np.int32))],
                names=["s", "n", "o_doc", "o_th", "o_s"])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.ListArray.from_arrays(ends.astype(np.int32), joined)], names=[*keys, "runs"])

    return rows.select(*keys, "runs").mapInArrow(run, ", ".join(f"{k} long" for k in keys) + f", runs {RUN}")


def owned_runs(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, th, w (words), runs: the maximal passages of each document that a smaller doc_id owns (stored)."""
    seg = C.write_table(segments(rows, window, anchor))
    labels = seg.groupBy("fp").agg(
        F.min(F.struct("doc_id", "th", "s")).alias("o"), F.max("doc_id").alias("last"), (F.min("seg") == F.max("seg")).alias("single"))
    labels = C.write_table(labels.filter(F.col("o.doc_id") < F.col("last")).select(
        "fp", "single", F.col("o.doc_id").alias("o_doc"), F.col("o.th").alias("o_th"), F.col("o.s").alias("o_s")))
    found = C.write_table(seg.join(labels, "fp"))
    own = F.struct("s", "n", "o_doc", "o_th", "o_s").alias("run")
    alike = found.filter(F.col("single") & (F.col("o_doc") < F.col("doc_id"))).select(*KEY, "w", own)

    mixed = found.filter(~F.col("single"))
    first = mixed.groupBy("fp", "seg").agg(F.min(F.struct("doc_id", "th", "s", "n")).alias("r")).select("fp", "seg", "r.*")
    lists = C.write_table(first.groupBy(*KEY).agg(F.collect_list(F.struct("fp", "seg", "s", "n")).alias("segs")))
    win = C.write_table(_windows(rows.join(lists.hint("shuffle_hash"), KEY), window, anchor))
    # stored, so that both sides of the next join are plain exchanges and a very common window's rows are split
    owner = C.write_table(win.groupBy("fp", "wh").agg(F.min(F.struct("doc_id", "th", "pos")).alias("o")))
    each = win.select("fp", "seg", "j", "wh").join(owner, ["fp", "wh"]).select("fp", "seg", F.struct(
        F.col("j").alias("s"), F.lit(1).alias("n"), F.col("o.doc_id").alias("o_doc"), F.col("o.th").alias("o_th"), F.col("o.pos").alias("o_s")).alias("run"))
    by_seg = _merged(each.groupBy("fp", "seg").agg(F.collect_list("run").alias("runs")), ["fp", "seg"])
    differ = (mixed.select(*KEY, "w", "s", "fp", "seg").join(by_seg, ["fp", "seg"]).withColumn("r", F.explode("runs"))
              .filter(F.col("r.o_doc") < F.col("doc_id"))
              .select(*KEY, "w", F.struct((F.col("s") + F.col("r.s")).alias("s"), F.col("r.n").alias("n"), F.col("r.o_doc").alias("o_doc"),
                                     F.col("r.o_th").alias("o_th"), F.col("r.o_s").alias("o_s")).alias("run")))
    return C.write_table(_merged(alike.unionByName(differ).groupBy(*KEY, "w").agg(F.collect_set("run").alias("runs")), [*KEY, "w"]))


def _passage_texts(rows: DataFrame, window: int) -> DataFrame:
    """shard, o_doc, words of the requested passages of each owner text."""

    def run(batches):
        for b in batches:
            shard, owner, text = [], [], []
            for sh, d, x, want in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "text", "want"))):
                w = C.words_of(x)
                for r in want:
                    shard.append(sh)
                    owner.append(d)
                    text.append(b" ".join(w[r["o_s"]:r["o_s"] + r["n"] + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(owner, pa.int64()), pa.array(text, pa.binary())],
                                             names=["shard", "o_doc", "words"])

    return rows.select("shard", "doc_id", "text", "want").mapInArrow(run, "shard long, o_doc long, words binary")


def _locate(docs: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
    """Stream the shard's documents through the automaton of its passages."""
    import ahocorasick

    number: dict[bytes, int] = {}
    owner: dict[tuple, int] = {}
    for o, words in zip(passages["o_doc"], passages["words"]):
        key = tuple(number.setdefault(w, len(number) + 1) for w in words.split())
        owner[key] = min(o, owner.get(key, o))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, o in owner.items():
        automaton.add_word(key, (int(o), len(key)))
    automaton.make_automaton()
    out = []
    for d, x in zip(docs["doc_id"], docs["text"]):
        w = C.words_of(x)
        cover = np.zeros(len(w) + 1, np.int32)
        if owner:
            for end, (o, n) in automaton.iter(tuple(map(lambda y: number.get(y, 0), w))):
                if o < d:
                    cover[end - n + 1] += 1
                    cover[end + 1] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        kept = b" ".join([y for y, g in zip(w, gone.tolist()) if not g])
        out.append((d, len(w), int(gone.sum()), kept.decode("utf-8", "surrogatepass")))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_text"])


RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of ``docs``."""
    C.ship(docs.sparkSession)
    # keys without nulls: the three joins below then share one exchange of the texts
    every = C.id_and_text(docs).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
                                       F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("key"))
    rows = every.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(*KEY, "text")
    runs = owned_runs(rows, window, anchor)
    total = runs.agg(F.sum(F.aggregate("runs", F.col("w"), lambda a, r: a + r["n"] + window))).first()[0] or 0
    shard = F.pmod(F.xxhash64("doc_id", "th"), F.lit(int(total // SHARD_WORDS + 1))).alias("shard")
    wanted = C.write_table(
        runs.select(shard, F.explode("runs").alias("r")).select("shard", "r.o_doc", "r.o_th", "r.o_s", "r.n").distinct()
        .groupBy(F.col("o_doc").alias("key"), F.col("o_th").alias("th"), "shard").agg(F.collect_list(F.struct("o_s", "n")).alias("want")))
    keys = runs.select(F.col("doc_id").alias("key"), "th", shard).hint("shuffle_hash")
    on = ["key", "th"]
    touched = every.join(keys, on).select("doc_id", "text", "shard")
    texts = every.join(wanted.hint("shuffle_hash"), on)
    changed = touched.groupBy("shard").cogroup(_passage_texts(texts, window).groupBy("shard")).applyInPandas(_locate, RESULT)

    words = F.filter(F.split(F.coalesce("text", F.lit("")), C.WORD_SEP), lambda x: x != "")
    same = (every.join(keys, on, "left").filter("shard IS NULL").select("doc_id", words.alias("w"))
            .select("doc_id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join("w", " ").alias("kept_text")))
    return same.unionByName(changed)
