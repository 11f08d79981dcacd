"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model of the corpus: counts over all documents.
2. Words that look tampered with (letters mixed with look-alike signs, letters
   stretched, letters spaced out) become lattices: each sign offers the
   letters it may stand for, a stretched run offers one or two letters,
   separators and spaces offer nothing or a word break.  In tokens of more than
   ``LONG`` characters (texts without spaces) each letter may begin a word.  Viterbi over the last two letters finds the path
   that channel costs and trigram model like best.
3. Restored words give features (the word and its first 4, 5 and 6 letters).
   Document counts of features by label select those that speak for toxicity;
   a logistic model over them gives the score.

Training sees only labelled rows whose crc32(doc_id) mod 5 is not 0; lang,
source and doc_id are no inputs.  The logistic weights are fitted on at most
``FIT_ROWS`` labelled rows; counts and the language model cover all rows.

Edge cases: null, empty or wordless text scores the intercept (no feature);
without any label of both kinds every score is 0; repeated rows score alike;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm import common as C

#: Labelled rows that the logistic weights are fitted on (a few numbers each).
FIT_ROWS = 30_000
#: Documents of the toxic class that must have a feature, and their least share of that class (it bounds the
#: features by the length of a text, whatever the number of rows).
LEAST, LEAST_SHARE = 4, 1 / 5000
#: Log-likelihood ratio from which a feature is of use.
RATIO = 1.5
PREFIXES = (4, 5, 6)
#: Label rows that may be broadcast (16 bytes each).
BROADCAST_LABELS = 2_000_000

# ───────────────────────────── FIXED VALUES ─────────────────────────────
# Letters that a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "&": "a", "#": "h", "%": "x", "*": "aeiou",
}
# Signs that only stand between letters.
BETWEEN = "._-*~'`^/\\,:;"
# Letters of the language model; index 0 is the word edge, the last one any other letter.
LETTERS = " abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøùúûüýÿßœ"
# ─────────────────────────── END FIXED VALUES ───────────────────────────
N = len(LETTERS) + 1
INDEX = {c: i for i, c in enumerate(LETTERS)}
#: Channel costs (natural log): a look-alike, a dropped separator, a shortened run, a sign left as it is.
COST_LOOK, COST_GAP, COST_SHORT, COST_KEEP = 1.0, 0.5, 0.5, 12.0
#: A separator or space that is a word break, and a word break without any sign in a token of over LONG characters.
COST_BREAK, COST_SPLIT = 1.5, 1.0
LONG = 40

_EDGE = re.compile(r"^[^\w@$€£¢|!+(]+|[^\w@$€£¢]+$|([#*$%&!.,])\1{2,}$")
_RUN = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)(?:\S ){2,}\S(?!\S)")


def _codes(text: str) -> np.ndarray:
    """Letter indices of a text; everything that is no letter is a word edge."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


_TABLE = np.zeros(0x250, np.int64)
for _c in range(0x250):
    _TABLE[_c] = INDEX.get(chr(_c), N - 1 if chr(_c).isalpha() else 0)
_TABLE[-1] = 0


def language_model(docs: DataFrame) -> np.ndarray:
    """Trigram costs (N x N x N) from all documents; the counts have a fixed number of cells."""

    def run(batches):
        C.forget()
        total = np.zeros(N ** 3, np.int64)
        for b in batches:
            for i, j in C.spans(b.column("text")):
                c = _codes("  ".join(["", *filter(None, b.column("text").slice(i, j - i).to_pylist()), ""]))
                total += np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(C.tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(N ** 3)
    counts[got["cell"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    counts = counts.reshape(N, N, N)
    two = counts.sum(2, keepdims=True)
    back = (counts.sum(0) + 0.1) / (counts.sum((0, 2))[:, None] + 0.1 * N)  # letter after one letter
    return (-np.log((counts + 2 * back[None]) / (two + 2))).astype(np.float32)


class Restorer:
    """Viterbi decoding of tampered words under the trigram model."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.known: dict[str, tuple[str, ...]] = {}

    def lattice(self, word: str, split: bool = False) -> list[list[tuple[str, float]]]:
        """Per observed run of one sign: the strings it may stand for and their channel costs."""
        out = []
        for m in re.finditer(r"(.)\1*", word, re.DOTALL):
            c, n = m[1], m.end() - m.start()
            gap = [(" ", COST_BREAK)] if not c.isalnum() else []
            if c in INDEX and c != " ":
                options = [(c * n, 0.0)] if n < 3 else [(c, COST_SHORT), (c + c, COST_SHORT)]
                out.append(options + [(" " + x, cost + COST_SPLIT) for x, cost in options] if split else options)
            elif c in LOOKS:
                options = [(x * k, COST_LOOK * n) for x in LOOKS[c] for k in ((1, 2) if n > 1 else (1,))]
                out.append(options + [("", COST_KEEP)] + (gap if c in BETWEEN else []))
            elif c in BETWEEN or c == " ":
                out.append([("", COST_GAP), *gap])
            else:
                out.append([("", COST_KEEP), *gap])
        return out

    def decode(self, word: str, split: bool = False) -> str:
        """The cheapest restored word or words; the time is linear in the length."""
        states = {(0, 0): (0.0, None)}
        for options in [*self.lattice(word, split), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for string, extra in options:
                    x, y, total = a, b, cost + extra
                    for c in string:
                        z = INDEX[c]
                        total += float(self.costs[x, y, z])
                        x, y = y, z
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = (total, (path, string) if string else path)
            states = new
        path, out = min(states.values(), key=lambda v: v[0])[1], []
        while path:
            path, string = path
            out.append(string)
        return "".join(reversed(out)).strip()

    def forms(self, word: str) -> tuple[str, ...]:
        """The lower-case core of a word and, if it looks tampered with or is very long, its restored words."""
        core = _EDGE.sub("", word.lower())
        plain = "".join(c for c in core if c.isalpha())
        if not plain:
            return ()
        if len(core) <= LONG:
            if (plain == core or not any(c in LOOKS or c in BETWEEN for c in core)) and not _RUN.search(core):
                return (core,)
            if sum(c.isdigit() for c in core) > len(plain) + 2:
                return (core,)
        return tuple(dict.fromkeys((core, *self.decode(core, len(core) > LONG).split())))

    def words(self, text: str | None) -> set[str]:
        """Distinct words of a text, restored forms included (spaced-out letters are read as words)."""
        if not text:
            return set()
        if len(self.known) > C.CACHE_WORDS // 2:
            self.known.clear()
        out: set[str] = set()
        for w in set(text.split()):
            got = self.known.get(w)
            if got is None:
                got = self.forms(w)
                if len(w) <= LONG:
                    self.known[w] = got
            out.update(got)
        for m in _SPACED.finditer(text):
            out.update(self.decode(m[0].lower()).split())
        return out


def features(word: str) -> list[str]:
    whole = word if len(word) <= LONG else hashlib.sha1(word.encode("utf-8", "surrogatepass")).hexdigest()
    return ["=" + whole, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def train_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and label of the training rows (one label per doc_id: the highest)."""
    y = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    y = y.groupBy("doc_id").agg(F.max("y").alias("y")).filter(~held_out("doc_id"))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(C.sized_broadcast(y, BROADCAST_LABELS), "doc_id")


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def _count(rows: DataFrame, costs) -> DataFrame:
    """feature, toxic, clean: documents with each feature."""

    def run(batches):
        C.forget()
        r = Restorer(costs.value)
        tox, clean = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                (tox if y else clean).update({f for w in r.words(t) for f in features(w)})
                if len(tox) + len(clean) > 300_000:
                    yield out(tox, clean)
                    tox, clean = Counter(), Counter()
        yield out(tox, clean)

    def out(tox, clean):
        keys = [*tox, *(k for k in clean if k not in tox)]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([tox[k] for k in keys], pa.int64()),
                                           pa.array([clean[k] for k in keys], pa.int64())], names=["feature", "toxic", "clean"])

    return (rows.select("text", "y").mapInArrow(C.tidy(run), "feature string, toxic long, clean long")
            .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _fit(y: np.ndarray, row: np.ndarray, col: np.ndarray, width: int, steps: int = 400, ridge: float = 3e-5) -> tuple[np.ndarray, float]:
    """Logistic weights (>= 0: a feature only speaks for toxicity) by accelerated gradient steps."""
    m = len(y)
    w, b = np.zeros(width), float(np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4)))
    v, vb = w.copy(), b
    # a step per weight: curvature is at most (documents with it) / 4m, times the weights that act together in a text
    together = np.quantile(np.bincount(row, minlength=m), 0.99) + 1 if m else 1
    rate = 1 / (together * np.bincount(col, minlength=width) / (4 * max(m, 1)) + ridge)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[col], m) + vb, -30, 30)))
        g = np.bincount(col, (p - y)[row], width) / m + ridge * v
        nw, nb = np.maximum(v - rate * g, 0), vb - 4 / together * float((p - y).mean())
        v, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Language model, feature weights and intercept."""
    spark = docs.sparkSession
    C.ship(spark)
    costs = spark.sparkContext.broadcast(language_model(docs))
    rows = train_rows(docs, labels)
    n = {r["y"] > 0: r["n"] for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return {"costs": costs, "weights": {}, "bias": -30.0}
    ratio = F.log(((F.col("toxic") + 0.5) / (n[True] + 1)) / ((F.col("clean") + 0.5) / (n[False] + 1)))
    use = (_count(rows, costs).filter((F.col("toxic") >= max(LEAST, LEAST_SHARE * n[True])) & (ratio >= RATIO))
           .orderBy((F.col("toxic") * ratio).desc(), "feature").select("feature").toPandas()["feature"].tolist())
    number = spark.sparkContext.broadcast({f: i for i, f in enumerate(use)})

    def run(batches):
        r = Restorer(costs.value)
        for b in batches:
            hit = [sorted({number.value[f] for w in r.words(t) for f in features(w) if f in number.value}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(hit, pa.list_(pa.int32()))], names=["y", "hit"])

    # which labelled rows the fit sees, if there are more than FIT_ROWS: those of the least hash
    few = rows if sum(n.values()) <= FIT_ROWS else rows.filter(
        F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * FIT_ROWS / sum(n.values())))
    got = few.select("text", "y").mapInArrow(C.tidy(run), "y int, hit array<int>").toPandas()
    y = (got["y"].to_numpy() > 0).astype(float)
    size = got["hit"].map(len).to_numpy()
    row = np.repeat(np.arange(len(y)), size)
    col = np.concatenate([np.empty(0, np.int64), *got["hit"]]).astype(np.int64)
    w, bias = _fit(y, row, col, len(use))
    return {"costs": costs, "weights": {f: float(x) for f, x in zip(use, w) if x > 0}, "bias": bias}


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and score (0 to 1) of every row; one map, no shuffle."""
    C.ship(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(model["weights"])
    costs, bias = model["costs"], model["bias"]

    def run(batches):
        C.forget()
        r, known = Restorer(costs.value), {}
        value = weights.value
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                hit = set()
                for w in r.words(t):
                    f = known.get(w)
                    if f is None:
                        if len(known) > C.CACHE_WORDS // 2:
                            known.clear()
                        f = tuple(x for x in features(w) if x in value)
                        if len(w) <= LONG:
                            known[w] = f
                    if f:
                        hit.update(f)
                out.append(bias + sum(value[f] for f in sorted(hit)))
            s = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s)], names=[*keep, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(C.tidy(run), f"{schema}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return score(rows, train(rows, labels), ["doc_id"]).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score 0.5 or more (all columns kept)."""
    return score(docs, train(docs, labels), docs.columns).filter("score < 0.5").select(*docs.columns)
