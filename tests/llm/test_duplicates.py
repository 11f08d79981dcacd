"""Jaccard join and phrase removal against brute force."""

import random
from collections import defaultdict

import pytest

from reviewlens.llm import fragment_join, phrases
from tests.llm import cases


def shingle_set(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    top = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and top[i] != top[j]:
                    top[i] = top[j] = min(top[i], top[j])
                    changed = True
    return {i: (len(sets[i]), top[i]) for i in sets}


@pytest.mark.parametrize("few", [0, 2])
def test_components(spark, monkeypatch, few):
    """With 0 all hub rounds run; the components are the same."""
    monkeypatch.setattr(fragment_join, "PAIRS_PER_ROW", few)
    monkeypatch.setattr(fragment_join, "ROUNDS", 3)
    monkeypatch.setattr(fragment_join, "SHARD_SHINGLES", 2000)
    rows = cases.documents()
    rng = random.Random(1)
    body = cases.words(rng, 130)
    for k in range(12):  # a chain: neighbours are near, ends are not
        body = list(body)
        body[(k * 11) % 130] = f"chain{k}"
        rows.append((500 + k, " ".join(body), "en", "s0", 1))
    df = cases.frame(spark, rows + rows[:4] + [(None, "some text without an id", None, None, 1)], few == 0)
    want = components({i: t for i, t, *_ in rows})
    got = fragment_join.similar_components(df).collect()
    assert len(got) == len(rows) + 5
    for r in got:
        assert r.doc_id is None or (r.n_shingles, r.component_id) == want[r.doc_id]


def test_components_of_nothing(spark):
    assert fragment_join.similar_components(cases.frame(spark, cases.documents()).limit(0)).count() == 0


def test_one_doc_id_with_two_texts(spark):
    """Rows link by their own text; the pipeline keeps one of each group and both texts of a repeated doc_id."""
    import corpus_pipeline

    rng = random.Random(8)
    a, b = cases.words(rng, 120), cases.words(rng, 120)
    near = lambda w: " ".join([*w[:-1], "changed"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(b)), (3, near(a)), (4, " ".join(a[:60])), (1, " ".join(a)), (5, "short"), (5, "brief"), (5, None)]
    df = cases.frame(spark, [(i, t, "en", "s", 0) for i, t in rows], True)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in fragment_join.similar_components(df).collect())
    assert got == [(1, 116, 1)] * 3 + [(2, 116, 1), (3, 116, 1), (4, 56, 4), (5, 0, 5), (5, 1, 5), (5, 1, 5)]
    kept = sorted((r.doc_id, r.text or "") for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert kept == sorted([(1, " ".join(a)), (1, " ".join(b)), (4, " ".join(a[:60])), (5, "short"), (5, "brief"), (5, "")])


def test_partial_overlaps_add_up(spark):
    import numpy as np

    order = fragment_join.Order(np.arange(1 << 6)[::-1].copy(), 6, 4)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = np.r_[a[:300], rng.integers(0, 2**63, 100).astype(np.uint64)]
    whole = len(np.intersect1d(a, b))
    parts = [len(np.intersect1d(x, y)) for x, y in zip(order.pieces(order.keys(a)), order.pieces(order.keys(b)))]
    assert len(parts) == 4 and sum(parts) == whole and sum(p > 0 for p in parts) > 1


@pytest.mark.parametrize("rounds,size", [(0, 7), (4, 1000)])
def test_large_groups_make_no_pair_rows(spark, monkeypatch, rounds, size):
    """Many variants of one text, most of them too far to link: compared in blocks, not as rows."""
    rng = random.Random(6)
    base = cases.words(rng, 160, 4000)
    texts = {}
    for i in range(150):
        w = list(base)
        for k in range(rng.choice([2, 3, 3, 3])):  # two such variants link only where their changes are near
            w[rng.randrange(len(w))] = f"v{i}x{k}"
        texts[i] = " ".join(w)
    for i in range(150, 156):  # two shorter texts of other words in between
        texts[i] = " ".join(cases.words(random.Random(i % 2), 30)[:30 - i % 3])
    seen, possible = [], fragment_join._possible

    def spied(pairs, profiles):
        seen.append(pairs.count())
        return possible(pairs, profiles)

    monkeypatch.setattr(fragment_join, "ROUNDS", rounds)
    monkeypatch.setattr(fragment_join, "BLOCK_SETS", size, raising=False)
    monkeypatch.setattr(fragment_join, "_possible", spied)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in fragment_join.similar_components(cases.frame(spark, [(i, t, None, None, 0) for i, t in texts.items()])).collect()}
    want = components(texts)
    assert got == want and 5 < len({c for _, c in want.values()}) < 155
    assert sum(seen) < 3000  # of 150 * 149 / 2 = 11,175


@pytest.mark.parametrize("most", [0, 20])
def test_texts_are_not_dealt_out(spark, monkeypatch, most):
    """With more classes than may be broadcast, texts that meet nothing stay where they are read; the components are the same."""
    rng = random.Random(9)
    texts = {i: " ".join(cases.words(rng, 60, 5000)) for i in range(60)}
    texts |= {60 + i: texts[i] for i in range(6)}  # copies
    texts |= {70 + i: texts[i + 10] + " and more" for i in range(6)}  # near copies
    seen, plans, prefixes, fragments = [], [], fragment_join._prefixes, fragment_join._fragments

    def plan(rows):
        return rows._jdf.queryExecution().executedPlan().toString()

    def before_prefixes(rows, *rest):
        seen.append(plan(rows))
        return prefixes(rows, *rest)

    def before_fragments(rows, *rest):
        plans.append(plan(rows))
        return fragments(rows, *rest)

    monkeypatch.setattr(fragment_join, "BROADCAST_KEYS", most)
    monkeypatch.setattr(fragment_join, "_prefixes", before_prefixes)
    monkeypatch.setattr(fragment_join, "_fragments", before_fragments)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, t, None, None, 0) for i, t in texts.items()]
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in fragment_join.similar_components(cases.frame(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == components(texts)
    if most:  # six copies are fewer: their rows are left out by a broadcast
        assert all("hashpartitioning" not in p for p in seen)
    assert seen and plans and all("MapInArrow" in p for p in [*plans, *(seen if not most else [])] if "hashpartitioning" in p)


def test_numbers_of_classes_differ(spark, monkeypatch):
    from pyspark.sql import functions as F

    number = fragment_join._number
    monkeypatch.setattr(fragment_join, "_number", lambda salt: number(salt) if salt > 1 else F.abs(number(salt)) % 3)
    rows = cases.documents()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in fragment_join.similar_components(cases.frame(spark, rows)).collect()}
    assert got == components({i: t for i, t, *_ in rows})


@pytest.mark.parametrize("bits", [(16, 26), (4, 4), (20, 26)])
def test_sieved_joins_are_exact(spark, monkeypatch, bits):
    """Also where the sieve is so full that most rows pass it, where keys repeat or are null, and where it is empty."""
    from reviewlens.llm import common as C

    monkeypatch.setattr(C, "SIEVE_BITS", bits)
    rows = [(i % 300 if i % 7 else None, f"t{i % 5}", f"text {i}") for i in range(900)]
    keys = [(i, f"t{i % 2}", i) for i in range(0, 300, 3)] + [(None, "t1", -1)]
    left = spark.createDataFrame(rows, "a long, b string, text string").repartition(5)
    table = C.write_table(spark.createDataFrame(keys, "a long, b string, x long"))
    order = lambda d: sorted(map(tuple, d.collect()), key=str)
    for t in (table, table.limit(0)):
        for on in (["a", "b"], ["b"]):
            assert order(C.matching(left, t, on, -1)) == order(left.join(t, on))
            assert order(C.without(left, t, on, -1)) == order(left.join(t, on, "left_anti").select(*left.columns))
    kept = C.sieve(left.withColumn("h", F_hash("a")), "h", C.bit_table(table.select(F_hash("a").alias("h")))).count()
    assert 300 <= kept < (900 if bits[1] > 4 else 901)


def F_hash(*columns):
    from pyspark.sql import functions as F

    return F.xxhash64(*columns)


def test_many_dropped_documents(spark, monkeypatch):
    """The pipeline's stage where more rows are dropped than may be broadcast: rows that no key fits are not shuffled."""
    import corpus_pipeline
    from reviewlens.llm import common as C

    without, plans = C.without, []

    def sieved(rows, table, on, most):
        out = without(rows, table, on, -1 if "__doc" in on else most)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(C, "without", sieved, raising=False)
    rows = cases.documents()
    want = components({i: t for i, t, *_ in rows})
    df = cases.frame(spark, rows + [(None, rows[0][1], None, None, 1), (None, None, None, None, 0)], True)
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text or "") for r in out.collect()), key=str)
    assert got == sorted([(i, t or "") for i, t, *_ in rows if want[i][1] == i] + [(None, rows[0][1] or ""), (None, "")], key=str)
    assert plans and plans[-1].count("MapInArrow") >= 2


def test_single_shingles_are_not_dealt_out(spark, monkeypatch):
    """Of the prefix rows only those whose shingle is in two classes go through the exchange that joins them."""
    from reviewlens.llm import common as C

    rng = random.Random(11)
    texts = {i: " ".join(cases.words(rng, 100, 9000)) for i in range(80)}
    texts[80] = texts[3] + " more"
    counts, sieve = [], C.sieve

    def spied(rows, column, table, inside=True):
        out = sieve(rows, column, table, inside)
        counts.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(C, "sieve", spied, raising=False)
    got = {r.doc_id: r.component_id for r in fragment_join.similar_components(cases.frame(spark, [(i, t, None, None, 0) for i, t in texts.items()])).collect()}
    assert got == {i: 3 if i == 80 else i for i in texts}
    assert len(counts) == 1 and counts[0][0] > 1500 and counts[0][1] < 100


def test_overlaps_of_all_pairs(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64) << np.uint64(55)) for n in (0, 1, 40, 90, 200, 400, 90, 3)]
    for few, columns in ((4, 1024), (1, 7)):
        monkeypatch.setattr(fragment_join, "FEW_HOLDERS", few)
        monkeypatch.setattr(fragment_join, "COLUMNS", columns)
        got = fragment_join.overlaps(sets, np.array([50, 120, 120], np.uint64) << np.uint64(55))
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]


def removed(texts, window):
    first = defaultdict(lambda: 1 << 60)
    cut = {i: (t or "").encode().split() for i, t in texts.items()}
    for i, w in cut.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k:k + window])
            first[key] = min(first[key], i)
    out = {}
    for i, w in cut.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("window,anchor,small", [(50, 8, False), (12, 5, True)])
def test_phrases(spark, monkeypatch, window, anchor, small):
    if small:
        monkeypatch.setattr(phrases, "SHARD_WORDS", 300)
    rows = cases.documents()
    df = cases.frame(spark, rows + rows[:2] + [(None, rows[0][1], None, None, 0)], small)
    want = removed({i: t for i, t, *_ in rows}, window)
    got = phrases.remove_repeats(df, window, anchor).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        assert r.n_removed == 0 if r.doc_id is None else (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id]


def test_shards_are_sized_by_whole_documents(spark, monkeypatch):
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for d in range(30):
        w = [f"w{d}x{rng.randrange(10**6)}" for _ in range(1500)]
        rows.append((d, " ".join(w[:700] + shared + w[700:]), None, None, 0))
    most, locate = 6_000, phrases._locate

    def spied(docs, passages):
        assert sum(len(x.split()) for x in docs["text"]) <= 4 * most  # all documents together: 46,800
        return locate(docs, passages)

    monkeypatch.setattr(phrases, "SHARD_WORDS", most)
    monkeypatch.setattr(phrases, "_locate", spied)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in phrases.remove_repeats(cases.frame(spark, rows)).collect()}
    assert got == removed({i: t for i, t, *_ in rows}, 50)
    assert [got[d][1] for d in range(30)] == [0] + [60] * 29


def test_phrases_of_nothing(spark):
    assert phrases.remove_repeats(cases.frame(spark, cases.documents()).limit(0)).count() == 0
