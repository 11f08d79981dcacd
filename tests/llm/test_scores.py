"""Quality, toxicity, identifiers, leaks and quotes against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from reviewlens.llm import identifiers, leaks, quality, quotes, toxicity
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ── quality ─────────────────────────────────────────────────────────────────
def counts(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    hit = {j for i, x in enumerate(windows) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_estimate(spark):
    rng = random.Random(2)
    rows = cases.documents()
    rows += [(1000 + i, " ".join(cases.words(rng, rng.randrange(80, 300))), "fr", "s9", 1) for i in range(120)]
    rows += [(2000 + i, " ".join(w + "***" for w in cases.words(rng, 150)), "fr", "s9", 1) for i in range(8)]
    got = {r.doc_id: r for r in quality.judge(cases.frame(spark, rows, True)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r, c = got[i], counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert not (r.base_failed and r.kept)
        if r.distance is None:
            assert r.kept != r.base_failed
    assert all(got[i].kept for i in range(1000, 1120)) and not any(got[i].kept for i in range(2000, 2008))
    assert quality.judge(cases.frame(spark, rows).limit(0)).count() == 0


def test_quality_judges_small_groups(spark):
    """Groups below LEAST take their language's estimate, small languages the corpus': the same outlier falls everywhere."""
    rng = random.Random(6)
    plain = lambda: " ".join(cases.words(rng, rng.randrange(80, 300)))
    odd = lambda: " ".join(w + "***" for w in cases.words(rng, 150))
    rows = [(i, plain(), "fr", "big", 1) for i in range(120)] + [(200 + i, plain(), "fr", f"tail{i}", 1) for i in range(6)]
    rows += [(300 + i, plain(), lang, src, 1) for i, (lang, src) in enumerate([("it", "big"), ("it", None), (None, None), (None, "x")])]
    bad = [("fr", "big"), ("fr", "tail0"), ("fr", "new"), ("it", "big"), ("it", "y"), (None, None), (None, "z")]
    rows += [(400 + i, odd(), lang, src, 1) for i, (lang, src) in enumerate(bad)] + [(500, "short", "xx", "only", 1), (501, None, None, None, 1)]
    got = {r.doc_id: r for r in quality.judge(cases.frame(spark, rows)).collect()}
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())
    assert all(r.kept == (i < 400) for i, r in got.items())
    own = {r.doc_id: r.distance for r in quality.judge(cases.frame(spark, rows[:120])).collect()}  # a large group keeps its own fit
    alone = {r.doc_id: r.distance for r in quality.judge(cases.frame(spark, [r for r in rows if r[2:4] == ("fr", "big") and r[0] < 400] + [r for r in rows if r[2] == "it"])).collect()}
    assert all(abs(own[i] - alone[i]) < 1e-9 for i in own)


def test_whitening_equals_the_inverse_covariance(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, quality.P)) @ rng.standard_normal((quality.P, quality.P))
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{v} double" for v in quality.VECTOR))
    est = quality._moments(rows)
    got = np.array([r[0] for r in rows.join(est, "grp").select(quality._distance(), *quality.VECTOR).orderBy(quality.VECTOR[0]).collect()])
    x = x[np.argsort(x[:, 0])]
    inv = np.linalg.inv(np.cov(x.T, bias=True) + quality.FLOOR * np.eye(quality.P))
    want = np.einsum("ij,jk,ik->i", x - x.mean(0), inv, x - x.mean(0))
    assert np.allclose(got, want)


# ── toxicity ────────────────────────────────────────────────────────────────
def test_toxicity_restores_and_learns(spark):
    rng = random.Random(4)
    bad = ["grobian", "stinker", "halunke", "schuft"]
    hidden = ["gr0bi4n", "st1nk3r", "h a l u n k e", "sch.u.f.t", "stiiiinker", "h@lunke"]
    rows, labels = [], []
    for i in range(400):
        w = cases.words(rng, 40)
        w = ["".join(rng.choice(["ba", "do", "ki", "lu", "ma", "ne"]) for _ in range(3)) for _ in w]
        y = i % 4 == 0
        if y:
            w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(w), "de", "s0", 1))
        labels.append((i, 1, int(y)))
    for k, h in enumerate(hidden):
        rows.append((900 + k, "badoki " + h + " lumane", "de", "s0", 1))
    rows += [(950, None, None, None, None), (951, "", None, None, 0), (952, "dokiba " * 3000, "de", "s0", 1)]
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(cases.frame(spark, rows, True), y).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i in range(400) if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    assert sum(got[900 + k].predicted for k in range(len(hidden))) >= 5
    assert got[950].score == got[951].score < 0.5 and got[952].predicted == 0
    none = toxicity.toxicity(cases.frame(spark, rows[:5]), y.limit(0)).collect()
    assert len(none) == 5 and all(r.score < 0.5 for r in none)
    assert toxicity.toxicity(cases.frame(spark, rows).limit(0), y).count() == 0


def test_toxicity_reads_whole_tokens_and_runs(spark):
    """Words late in long tokens and long spaced runs are seen; all features that pass the threshold are kept."""
    rng = random.Random(4)
    plain = lambda n: ["".join(rng.choice(["ba", "do", "ki", "lu", "ma", "ne"]) for _ in range(3)) for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        w = plain(40)
        if i % 4 == 0:
            w[rng.randrange(40)] = rng.choice(["grobian", "stinker", "halunke", "schuft"])
        rows.append((i, " ".join(w), "de", "s0", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    w = [*plain(12), "halunke", *plain(12)]
    late = [".".join(w), "_".join(w), "".join(w), "-".join(x.replace("u", "\u00fc") if x != "halunke" else "h@lunke" for x in w), " ".join(" ".join(w)[:500].replace(" ", "")),
            "m" * 60 + ".stinker", "ba" * 300 + "/st1nker"]
    rows += [(900 + k, "badoki " + t + " lumane", "de", "s0", 1) for k, t in enumerate(late)]
    rows += [(950 + k, "badoki " + sep.join(plain(25)) + " lumane", "de", "s0", 1) for k, sep in enumerate([".", "_", "", "-"])]
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(cases.frame(spark, rows), y).collect()}
    assert [got[900 + k] for k in range(len(late))] == [1] * len(late) and [got[950 + k] for k in range(4)] == [0] * 4
    costs = np.ones((toxicity.N,) * 3, np.float32)
    assert len(toxicity.Restorer(costs).decode("ab." * 20_000, True)) >= 40_000


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    costs = rng.random((toxicity.N,) * 3).astype(np.float32) * 5
    r = toxicity.Restorer(costs)

    def cost(text):
        x = y = 0
        total = 0.0
        for c in text + " ":
            z = toxicity.INDEX[c]
            total += float(costs[x, y, z])
            x, y = y, z
        return total

    for word in ("1d10t", "l0oo0ser", "s.c-u.m", "b@@d", "$7upid"):
        ways = product(*r.lattice(word))
        best = min((sum(e for _, e in w) + cost("".join(s for s, _ in w)), "".join(s for s, _ in w)) for w in ways)
        assert r.decode(word) == best[1]


# ── identifiers ─────────────────────────────────────────────────────────────
def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


RULES = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
]


def base(text):
    return sorted((m.start(), k, identifiers.KINDS[k], m.end()) for k, (p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m[0]))


HARD = ["a.b@c.d@e.f g%h@i.j.", "x@y.zz%foo@bar.com", "1.2.3.4.5.6.7.8.9", "0001.02.3.255 256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
        "+1 (988) 555-2485 +12", "+1.2.3.4.5.6.7.8.9.0", "é@é.com ü.mail+x@ho-st.co.uk🙂9", "9" * 5000, "1 " * 4000, "a" * 20000, "@" * 3000, "🙂 10.0.0.1 🙂", None, ""]


def test_identifiers(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(HARD)]
    rows += [(100 + i, f"call agent id a{i}.z9@host{i}.example.com now", "en", "s", 1) for i in range(8)]
    rows += [(200, "call agent id k9.z9§host9.example.com now", "en", "s", 1), (201, "nothing here", "en", "s", 1)]
    rows += [(None, "id 10.0.0.2", "en", "s", 1), (None, "id 10.0.0.3 and 10.0.0.4", "en", "s", 1), rows[0]]
    df = cases.frame(spark, rows, True)
    got = identifiers.find_identifiers(df).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        spans = [(s.start, s.rank, s.kind, s.end) for s in r.base]
        if r.doc_id is None:
            assert len(spans) in (1, 2)
        else:
            assert spans == base(texts[r.doc_id]), r.doc_id
    red = {r.doc_id: r.text for r in identifiers.redact(df).collect()}
    assert red[100] == "call agent id <EMAIL> now" and red[201] == "nothing here" and red[14] is None
    assert identifiers.find_identifiers(df.limit(0)).count() == 0


def test_patterns_discover_what_no_rule_sees(spark):
    """The shape of e-mail seeds after one cue word finds an address whose host the rule cannot see whole."""
    rows = [(i, f"reach cue u{chr(97 + i)}.4{i}@mail{i}.org today", "en", "s", 1) for i in range(9)]
    rows += [(50, "reach cue žů.47@mail3.org today", "en", "s", 1), (51, "reach other zu47 today", "en", "s", 1)]
    rows += [(60 + i, f"card cue2 pin{i}{i}{i}{i} x", "en", "s", 1) for i in range(9)]
    got = {r.doc_id: r for r in identifiers.find_identifiers(cases.frame(spark, rows)).collect()}
    assert not got[51].added and not any(got[60 + i].added for i in range(9))
    text = rows[9][1]
    spans = [*got[50].base, *got[50].added]
    assert any(s.kind == "email" and "47@mail3.org" in text[s.start:s.end] for s in spans)
    edges = [("cue S", f"t{i}", "email", False) for i in range(9)] + [("cue S", "new", None, False), ("odd S", "t1", "email", False), ("odd S", "n2", None, False)]
    seeded = spark.createDataFrame(edges, "pattern string, token string, seed string, refused boolean")
    assert [tuple(r) for r in identifiers.accepted(seeded).collect()] == [("cue S", "email")]


def test_tokens_that_follow_each_other(spark):
    """Each entry of a list is a token; its context is the word before, or the shape of the entry before."""
    texts = ["accounts AB-1234 AB-2345 \n AB-3456, AB-4567\tAB-5678", "9999 alone", "x " + "a" * 20000 + " id 77777 y 88888 99999", "call Me: a1@b.de"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    found = {}
    for r in identifiers.tokens(cases.frame(spark, rows)).orderBy("start").collect():
        assert texts[r.doc_id][r.start:r.end].lower() == r.token
        found.setdefault(r.doc_id, []).append((r.token, r.pattern))
    assert found == {0: [("ab-1234", "accounts A-9999"), *((f"ab-{n}", "A-9999 A-9999") for n in (2345, 3456)), ("ab-4567", "A-9999, A-9999"), ("ab-5678", "A-9999 A-9999")],
                     1: [("9999", " 9999")], 2: [("77777", "id 99999"), ("88888", "y 99999"), ("99999", "99999 99999")], 3: [("a1@b.de", "me: a9@a.a")]}
    rows = [(i, " ".join(["hosts", *(f"u{k}{i}@h{k}.example.org" for k in range(4)), "uß9@h1§example.org"]), "en", "s", 1) for i in range(6)]
    got = identifiers.find_identifiers(cases.frame(spark, rows)).collect()
    assert all(len(r.base) == 4 for r in got)


# ── leaks ───────────────────────────────────────────────────────────────────
def test_tokens_equal_a_plain_scan(spark):
    """Every word with a digit or @ is a token; its place and the word before it, over any white space and tails."""
    import re

    rng = random.Random(3)
    parts = ["a", "B1", "@x", "12", "\n", " ", "  ", "\t", "\u0085", "\U0001F600", "é9", ".", "(", "foo", "x@y.zz", "x" * 3000, " word" * 400]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))), None, None, 0) for i in range(600)]

    def shape(t):
        return re.sub("[A-Z]+", "A", re.sub("[a-zé]+", "a", re.sub("[0-9]", "9", t)))

    want = set()
    for i, text, *_ in rows:
        before = ""
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            word = m.group()
            if re.search("[0-9@]", word):
                skip = len(word) - len(re.sub(r"^[\"'(\[{<]+", "", word))
                core = re.sub(r"[\"')\]}>.,;:!?]+\Z", "", word[skip:])
                left = shape(before) if re.search("[0-9@]", before) else before.lower()
                if len(core) > 3:
                    want.add((i, core.lower(), f"{left} {shape(core)}", m.start() + skip, m.start() + skip + len(core)))
            before = word
    got = identifiers.tokens(cases.frame(spark, rows, True)).select("doc_id", "token", "pattern", "start", "end").collect()
    assert len(got) > 500 and sorted(map(tuple, got)) == sorted(want)


def test_leaks(spark):
    rng = random.Random(8)
    items = [(i, " ".join(cases.words(rng, rng.randrange(15, 50), 3000))) for i in range(12)] + [(50, None), (51, ""), (52, "tiny item here"), (52, "tiny item here")]
    rows, want = [], set()
    for d in range(60):
        body = cases.words(rng, rng.randrange(30, 200), 3000)
        if d % 3 == 0:
            k = rng.randrange(12)
            part = items[k][1].split()
            if d % 2:  # a paraphrase: some words changed
                for _ in range(len(part) // 8):
                    part[rng.randrange(len(part) - 6)] = "other"
            at = rng.randrange(len(body))
            body[at:at] = part
            want.add((d, k))
        rows.append((d, " ".join(body), "en", "s", 1))
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), (102, " ".join(cases.words(rng, 8000, 3000)), "en", "s", 1)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7)).withColumn("start", F.lit("x"))
    got = leaks.find_leaks(cases.frame(spark, rows, True), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    kept = leaks.drop_leaked(cases.frame(spark, rows + [(None, "no id", None, None, 1)]), bench)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in want} | {None}
    assert leaks.find_leaks(cases.frame(spark, rows).limit(0), bench).count() == 0
    assert leaks.find_leaks(cases.frame(spark, rows), bench.limit(0)).count() == 0


def test_leaks_of_many_items_equal_brute_force(spark):
    """1,200 items and 128 directions: copies and paraphrases are found as by checking every place."""
    rng = random.Random(12)
    items = [[w.strip(".,") for w in cases.words(rng, rng.randrange(15, 60), 3000)] for _ in range(1200)] + [["tiny", "item", "here"]]
    rows = []
    for d in range(60):
        body = [w.strip(".,") for w in cases.words(rng, rng.randrange(20, 150), 3000)]
        for _ in range(2):
            part = list(rng.choice(items))
            for _ in range(len(part) * rng.randrange(4) // 10):  # up to 30 % of the words changed or dropped
                k = rng.randrange(len(part))
                part[k:k + 1] = rng.choice([["other"], []])
            at = rng.randrange(len(body))
            body[at:at] = part
        rows.append((d, " ".join(body), "en", "s", 1))
    want = set()
    for d, t, *_ in rows:
        w, have = t.split(), Counter(t.split())
        for k, item in enumerate(items):
            if sum((have & Counter(item)).values()) >= leaks.LCS_ANSWER * len(item):
                r = leaks._reach(len(item))
                places = range(-(-len(w) // leaks.BLOCK))
                if any(leaks.is_leak(item, w[max(0, (p - r) * leaks.BLOCK):(p + 2 + r) * leaks.BLOCK])[0] for p in places):
                    want.add((d, k))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = leaks.find_leaks(cases.frame(spark, rows), bench).collect()
    assert len(want) > 80 and {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert sum(r.similarity < leaks.COSINE for r in got) > 0  # the latent space alone would lose these


def test_latent_space_comes_from_all_passages(spark):
    """Its directions are the eigenvectors of the products of all passages, of many documents as of few."""
    rng = random.Random(31)
    items = [" ".join(cases.words(rng, 12, 60)) for _ in range(3)]
    texts = [" ".join(cases.words(rng, rng.randrange(90), 60)) for _ in range(leaks.FIT_WEIGHT + 400)] + [None, ""]
    docs = leaks.hashed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    ids = [leaks._ids([t])[0] for t in items]
    used = np.unique(np.concatenate(ids))
    column = np.full(1 << leaks.BITS, -1, np.int32)
    column[used] = np.arange(len(used))
    weight = leaks.idf(docs)
    basis = leaks.latent(docs, ids, weight, column, len(used))
    gram = np.zeros((len(used), len(used)))
    for words, scale in [(leaks._ids([t])[0], (leaks.FIT_WEIGHT / len(texts)) ** 0.5) for t in texts] + [(x, leaks.ITEM_SCALE) for x in ids]:
        for p in range(0, len(words), leaks.BLOCK):
            x = words[p:p + 2 * leaks.BLOCK]
            row = np.bincount(column[x][column[x] >= 0], minlength=len(used)) * weight[used] * scale / np.sqrt((weight[x].astype(float) ** 2).sum())
            gram += np.outer(row, row)
    assert basis.shape == gram.shape
    turned = basis.T.astype(float) @ gram @ basis
    assert np.allclose(np.diag(turned), np.sort(np.linalg.eigvalsh(gram))[::-1], rtol=1e-3)
    assert np.abs(turned - np.diag(np.diag(turned))).max() < 1e-4 * turned.max()


def test_bounds_refuse_no_leak():
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [list(rng.choice(vocabulary, n)) for n in (1, 2, 5, 7, 8, 9, 12, 20, 33)]
    words = [*rng.choice(vocabulary, 400), *items[5], *rng.choice(vocabulary, 30), *items[7][:14], "x", *items[7][15:], *items[3], "x", *items[0]]
    column = np.full(1 << leaks.BITS, -1, np.int32)
    ids = [leaks._ids([" ".join(x)])[0] for x in items]
    used = np.unique(np.concatenate(ids))
    column[used] = np.arange(len(used))
    c = column[leaks._ids([" ".join(words)])[0]]
    bounds, found = leaks.Bounds(ids, column), 0
    item = rng.integers(0, len(items), 3000)
    lo = rng.integers(0, len(words), 3000)
    hi = np.minimum(lo + rng.integers(0, 60, 3000), len(words))
    places = bounds.places(c)
    held, may = bounds.held(places[0], places[2], item, lo, hi), bounds.may_leak(places, item, lo, hi)
    for k, a, b, n, yes in zip(item.tolist(), lo.tolist(), hi.tolist(), held.tolist(), may.tolist()):
        assert n == (Counter(items[k]) & Counter(words[a:b])).total()
        leak = leaks.is_leak(items[k], words[a:b])[0]
        found += leak
        assert yes or not leak
    assert found > 50 and (~may).sum() > 500


def test_leaks_with_wide_spaces_and_a_long_item(spark):
    """No-break and other wide spaces split words everywhere; a long item widens no other item's neighbourhood."""
    rng = random.Random(21)
    one, two = (cases.words(rng, 20, 3000) for _ in range(2))
    items = [(0, " ".join(one)), (1, " ".join(two)), (2, " ".join(cases.words(rng, 400, 3000)))]
    body = cases.words(rng, 900, 4000)
    far = list(body)
    for k, w in enumerate(two):  # in order, but over 600 words: no copy
        far.insert(30 * (k + 1), w)
    rows = [(0, "\u00a0".join(body) + " " + " ".join(one), "en", "s", 1), (1, " ".join(body[:30]) + " " + "\u3000".join(one), "en", "s", 1),
            (2, " ".join(far[:400]) + " " + " ".join(far[400:]), "en", "s", 1)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(cases.frame(spark, rows), bench).collect()} == {(0, 0), (1, 0)}
    for t in ("a\u00a0b -- c", "x\u2028y z\x85", "\u3000", "it's\x1ca-b İ"):
        assert len(leaks._words(t)) == len(leaks._ids([t])[0])


def test_word_hashes_by_running_powers_are_those_by_place(monkeypatch):
    rng = random.Random(9)
    texts = [r[1] for r in cases.documents()] + ["x" * 1024, "y" * 1025 + " z", "--", "don't (x)", "É ß é", "b"]
    texts += ["".join(rng.choice("ab .,'é\n-Z") for _ in range(40)) for _ in range(50)]
    got = [leaks._ids([t]) for t in texts]
    whole = leaks._ids(texts)
    monkeypatch.setattr(leaks, "ROOM", 0)
    for (a, n), (b, m) in zip([*got, whole], [*(leaks._ids([t]) for t in texts), leaks._ids(texts)]):
        assert a.tolist() == b.tolist() and n.tolist() == m.tolist()
    assert whole[0].tolist() == [x for a, _ in got for x in a.tolist()]


def test_row_sums(monkeypatch):
    rng = np.random.default_rng(4)
    table, cells = rng.integers(0, 99, (30, 6)).astype(np.float32), rng.integers(0, 30, (17, 20)).astype(np.int32)
    monkeypatch.setattr(leaks, "LINES", 4)
    assert leaks._row_sums(table, cells).tolist() == table[cells].sum(1).tolist()
    assert leaks._row_sums(table, cells[:0]).shape == (0, 6)
    c = np.array([3, -1, 70_000, 3, 0], np.int32)
    assert leaks._by_column(c).tolist() == [4, 0, 3, 2] and leaks._by_column(c[:2]).tolist() == [0]


def test_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        assert leaks.common_subsequence(a, b) == slow(a, b)


# ── quotes ──────────────────────────────────────────────────────────────────
def test_quotes(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BUCKET", 3)
    rows = [(1, 0, "user", "Hello there my good friend\nHow is the weather today?"),
            (1, 1, "assistant", "On Monday, X wrote:\n> How is the WEATHER today?\nIt is raining cats here."),
            (1, 2, "user", "> Hello there my\n> good friend How is the weather today\nSecond branch"),
            (1, 3, "user", ">> How is the weather today?\n> It is raining cats here.\nBring an umbrella then"),
            (1, 4, "user", "no quote at all"), (1, 9, "user", "> something nobody ever said\nx"), (1, 12, "user", "> It is raining cats here!\ny"),
            (None, 0, None, None), (None, 5, "b", ""), (2, None, "z", "y"), (1, 4, "user", "no quote at all")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("1") for c in ("lines", "level", "own", "conv", "found", "bucket", "parent")})
    got = {(r.conv_id, r.turn): r for r in quotes.link(df).collect()}
    tree = {k: (r.parent_turn, r.root_turn, r.level, r.position) for k, r in got.items()}
    assert tree == {(1, 0): (None, 0, 0, 0), (1, 1): (0, 0, 1, 1), (1, 2): (0, 0, 1, 2), (1, 3): (1, 0, 2, 3), (1, 4): (3, 0, 3, 4),
                    (1, 9): (4, 0, 4, 5), (1, 12): (1, 0, 2, 6), (None, 0): (None, 0, 0, 0), (None, 5): (0, 0, 1, 1)}
    assert got[1, 1].text == "It is raining cats here." and got[1, 3].text == "Bring an umbrella then" and got[None, 0].text == ""
    assert quotes.link(df.limit(0)).count() == 0


def test_short_quotes_link(spark):
    """A short quote finds its message; a longer quote weighs more than several short ones."""
    rows = [(1, 0, "user", "Shall we?"), (1, 1, "a", "Yes, ok."), (1, 2, "b", "Something else that is said"), (1, 3, "c", "> Yes, ok.\nFine"),
            (1, 4, "d", "No\nHm"), (1, 5, "e", "> No\n> ...\n> Something else that is said\nBoth"), (1, 6, "f", "> !?\nnothing quoted")]
    got = {r.turn: (r.parent_turn, r.n_linked) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0), 1: (0, 0), 2: (1, 0), 3: (1, 1), 4: (3, 0), 5: (2, 2), 6: (5, 0)}


def test_quotes_keep_every_message(spark, monkeypatch):
    """Messages that share a turn or have no conv_id or turn all come back; only equal rows are one."""
    monkeypatch.setattr(quotes, "BUCKET", 3)
    rows = [(1, 0, "user", "What is the weather today?"), (1, 0, "assistant", "It is raining cats here."), (1, 0, "assistant", "It is raining cats here."),
            (1, 1, "user", "> It is raining cats here.\nThank you"), (1, 1, None, "> What is the weather today?\nyes"), (1, 1, None, None), (1, 1, None, "")]
    rows += [(None, i % 2, "user", f"text {i}") for i in range(20)] + [(2, None, "z", "y"), (2, None, "z", "x\n> q"), (2, None, "z", "y"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.link(df).collect()
    one = {(r.turn, r.role, r.text): (r.parent_turn, r.root_turn, r.level, r.n_linked) for r in got if r.conv_id == 1 and r.text}
    assert one == {(0, "assistant", "It is raining cats here."): (None, 0, 0, 0), (0, "user", "What is the weather today?"): (0, 0, 1, 0),
                   (1, "user", "Thank you"): (0, 0, 1, 1), (1, None, "yes"): (0, 0, 2, 1)}
    assert sorted(r.position for r in got if r.conv_id == 1) == list(range(6))
    none = sorted((r.position, r.turn) for r in got if r.conv_id is None)
    assert none == [(i, i // 10) for i in range(20)] and sorted(r.text for r in got if r.conv_id is None) == sorted(f"text {i}" for i in range(20))
    alone = quotes.unplaced(df)
    assert alone.dtypes == quotes.link(df).dtypes
    assert sorted((r.conv_id or 0, r.role or "", r.text, r.parent_turn, r.level, r.position) for r in alone.collect()) == [
        (0, "", "", None, 0, 0), (2, "z", "x", None, 0, 0), (2, "z", "y", None, 0, 0)]


# ── pipeline ────────────────────────────────────────────────────────────────
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    item = " ".join(cases.words(rng, 30, 3000))
    rows = cases.documents()
    rows += [(700, "grobian " + " ".join(cases.words(rng, 60)), "de", "s0", 1), (701, " ".join(cases.words(rng, 40)) + " " + item, "en", "s0", 1),
             (702, "write to jo.1@mail.example.com or 10.1.2.3 soon " + " ".join(cases.words(rng, 40)), "en", "s0", 1)]
    rows += [(800 + i, " ".join(cases.words(rng, 25)) + (" grobian" if i % 3 == 0 else ""), "de", "s1", 1) for i in range(60)]
    spark.createDataFrame([(800 + i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cases.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        left.append({r.doc_id: r.text for r in docs.collect()} if k < 4 else docs.collect())
    tox, near, clean, private, packed = left
    assert not {700, *range(800, 860, 3)} & tox.keys() and len(tox) == len(rows) - 21
    from tests.llm.test_duplicates import components

    assert near.keys() == {i for i, (_, c) in components(tox).items() if c == i}
    assert near.keys() - clean.keys() == {701}
    assert private.keys() == clean.keys() and private[702].startswith("write to <EMAIL> or <IP> soon ")
    assert {i: t for i, t in private.items() if i != 702} == {i: t for i, t in clean.items() if i != 702}
    assert {r.doc_id for r in packed} == private.keys()
    assert hashlib  # digest columns are checked in the token tests


def test_pipeline_workers_get_small_batches(spark, tmp_path):
    import pyarrow as pa

    import corpus_pipeline
    from reviewlens.llm import common as C

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 120, 1, 1).selectExpr("id AS doc_id", "repeat('one two three ', 10000) AS text", "'en' AS lang", "'s' AS source", "140000L AS n_chars")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = spark.conf.get(name)
    try:
        for stage in ("toxicity", "near_duplicates", "decontamination", "packing"):
            spark.conf.set(name, "64m")
            dict(corpus_pipeline.STAGES)[stage](spark, rows.limit(2), str(tmp_path))
            got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
            assert max(got) < 2 * C.BATCH_BYTES and sum(got) > 15_000_000, stage
        spark.conf.set(name, "2k")  # a session's own smaller bound stays
        C.small_batches(spark)
        assert spark.conf.get(name) == "2k"
    finally:
        spark.conf.set(name, before)


def test_workers_give_back_what_they_kept(monkeypatch):
    from reviewlens.llm import common as C

    C.kept("one", lambda: [1])
    assert C._KEPT == {"one": [1]}
    C.forget()
    assert not C._KEPT
    done = []
    monkeypatch.setattr(C, "give_back", lambda collect=True: done.append(collect))
    assert list(C.tidy(lambda batches: (x + 1 for x in batches))([1, 2])) == [2, 3] and done == [False]
    hashes = C.WordHashes()
    words = [b"w%d" % i for i in range(C.CACHE_HASHES + 50)]
    assert len(hashes.array(words)) == len(words) and len(hashes) <= C.CACHE_HASHES <= 100_000
