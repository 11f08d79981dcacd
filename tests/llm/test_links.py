"""URL rules, token alignment and spelling variants against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reviewlens.llm import alignment, spelling, url_rules
from reviewlens.llm import common as C
from tests.llm import cases

# ── URL rules ───────────────────────────────────────────────────────────────
RULES = [*url_rules.FIXED_RULES, ("net", "/", "allow"), ("a.example.org", "/fr/x", "block"), ("EXAMPLE.org", "", "allow"), ("org", "/fr/xy", "allow"),
         ("org", "/fr/x", "block"), ("com", "/de", "allow"), ("example.com", "/de/", "block"), ("x.com", "/a/b/c/", "block"), ("net", None, "allow")]
URLS = [None, "", "net/", "http://", "http://net", "http://net/", "HTTP://A.Example.NET/en/x", "http://example.net/EN/x", "http://xexample.net/en/",
        "http://a.example.org/fr/xyz", "http://org/fr/xz", "http://example.com/de", "http://example.com/de/?/fr/", "http://b.example.com/de/a#x",
        "http://u:p@a.net:80/x", "http://a.net:80/x", "http://net?x", "http://net#/", "x://y.x.com/a/b/c/d", "http://x.com/a/b/c", "http://net./",
        "http://.net/", "http://a..net/", "see http://q.net/ and http://r.org/fr/", "http://ü.net/ä\n/é?", "//net/", "http://net//en/", "http://" + "a." * 200 + "net/" + "p/" * 300]


def judged(url, rules, default="allow"):
    host = path = ""
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    if m:
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    best = None
    for h, p, v in rules:
        h, p = h.lower(), p or ""
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h.split(".")) if h else 0, len(p), v == "block")
            best = max(best or (key, h + p, v), (key, h + p, v))
    return host, path, best[1] if best else None, best[2] if best else default


@pytest.mark.parametrize("trie", [True, False])
@pytest.mark.parametrize("rules", [RULES, url_rules.FIXED_RULES, RULES + [("", "", "block")], []])
def test_url_rules(spark, trie, rules):
    rng = random.Random(3)
    parts = ["net", "org", "com", "example", "a", "x", "fr", "de", "en"]
    urls = URLS + ["http://" + ".".join(rng.choices(parts, k=rng.randrange(1, 5))) + "".join("/" + rng.choice(parts) for _ in range(rng.randrange(4)))
                   + rng.choice(["", "/", "?q", "#f"]) for _ in range(300)]
    pages = spark.createDataFrame([(i % 200, u, "old", 1) for i, u in enumerate(urls)], "page_id long, url string, rule string, __k int").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    out = url_rules.judge(pages, table, trie_rules=10 if trie else -1) if len(rules) <= 10 or not trie else url_rules.judge(pages, table)
    assert out.columns == ["page_id", "url", "__k", "host", "path", "rule", "verdict"]
    got = Counter(tuple(r)[:2] + tuple(r)[3:] for r in out.collect())
    assert got == Counter((i % 200, u, *judged(u, rules)) for i, u in enumerate(urls))
    assert url_rules.judge(pages.limit(0), table).count() == 0


def test_url_rules_refuse_unusable_rules(spark):
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    for bad in ([(None, "/", "block")], [("a", "/", "maybe")], [("a", "/", None)]):
        with pytest.raises(ValueError):
            url_rules.judge(pages, spark.createDataFrame(bad, "host string, path string, verdict string"))


# ── token alignment ─────────────────────────────────────────────────────────
def common_ends(x, y):
    at = {e: j for j, e in enumerate(y)}
    return [i for i, e in enumerate(x) if e in at], [at[e] for e in x if e in at]


def test_runs_equal_common_ends():
    rng = random.Random(1)
    for _ in range(2000):
        n, p, q = rng.randrange(1, 80), rng.random(), rng.choice([0.1, 0.5, 0.95])
        x, y = (sorted({e for e in range(1, n) if rng.random() < k} | {n}) for k in (p, q))
        got = alignment.runs(np.array(x), np.array(y))
        assert tuple(a.tolist() for a in got) == common_ends(x, y)
    straight = np.arange(1, 1001)
    assert all((a == np.arange(1000)).all() for a in alignment.runs(straight, straight))


ODD_TEXTS = ["a  b", "  a", "a ", "a\n b", "a \n b", "\n", "\n\n", " ", "x\n\n\ny", "<|endoftext|> a <|endoftext|>", "a <s> b </s> <unk>", "a▁b", "▁",
             "é ü 日本語", "🙂 🙂🙂", "\t a\tb", "a\r\nb", "a\u00a0b", "ﬁ １２ ½", "<0x0A> y", "a\0b", "\ufeff a", "a \u3000 b", "q" * 3000, None, "", "unaffordability"]


@pytest.fixture(scope="module")
def libraries():
    tok = Tokenizer.from_file(C.tokenizer_path())
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=C.tokenizer_path("piece_bpe_32k.model"))


def expected(rows, libraries):
    """Alignment by the libraries' whole-text ids and plain sets of offsets."""
    tok, sp = libraries
    pair = alignment.Pair(C.tokenizer_path(), C.tokenizer_path("piece_bpe_32k.model"))
    linked, links = [], Counter()
    for doc_id, text in rows:
        ids = ([], [])
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            if b"".join(pair.bytes_a[i] for i in a) == b"".join(pair.bytes_b[i] for i in b) == (" " + text).encode():
                ids = (a, b)
        ends = [np.cumsum([len(t[i]) for i in x]).tolist() for t, x in zip((pair.bytes_a, pair.bytes_b), ids)]
        ca, cb = common_ends(*ends)
        groups, p, q = [], 0, 0
        for i, j in zip(ca, cb):
            groups.append(",".join(map(str, ids[0][p:i + 1])) + "|" + ",".join(map(str, ids[1][q:j + 1])))
            p, q = i + 1, j + 1
        mine = [(ids[0][i], ids[1][j]) for i, j in zip(ca, cb)]
        links.update(mine)
        linked.append((doc_id, len(ids[0]), len(ids[1]), len(groups), mine, hashlib.sha256(";".join(groups).encode()).hexdigest() if ids[0] else ""))
    best = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    return Counter((d, a, b, g, len(m), sum(links[x] == best[x[1]] for x in m), sum(links[x] for x in m), s) for d, a, b, g, m, s in linked)


@pytest.mark.parametrize("head", [1_000_000, 40, 0])
def test_alignment(spark, libraries, head):
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in cases.documents()]
    rows += [(1000 + i, t, None, None, 0) for i, t in enumerate(ODD_TEXTS)] + rows[:4] + [(None, "no id here", None, None, 1)]
    df = cases.frame(spark, rows, odd=head == 40)
    got = alignment.align_documents(df, C.tokenizer_path(), C.tokenizer_path("piece_bpe_32k.model"), head)
    assert Counter(map(tuple, got.collect())) == expected([r[:2] for r in rows], libraries)
    assert alignment.align_documents(df.limit(0), C.tokenizer_path(), C.tokenizer_path("piece_bpe_32k.model"), head).count() == 0


# ── spelling variants ───────────────────────────────────────────────────────
def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    close = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            close[a].append(b)
            close[b].append(a)
    form = {}
    for w, c in close.items():
        f = min(c, key=lambda x: (-n[x], x), default=None)
        form[w] = f if f and n[f] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n[w], len(close[w]), n.get(form[w])) for w in n}


def spelled(seed, vocab=120, syllables=("an", "ta", "on", "ti", "er", "é", "ß", "th")):
    rng = random.Random(seed)
    base = ["".join(rng.choice(syllables) for _ in range(rng.randrange(3, 12))) for _ in range(vocab)]
    out = []
    for d in range(60):
        ws = []
        for _ in range(150):
            w = base[int(len(base) * rng.random() ** 3)]
            if rng.random() < 0.15:
                i = rng.randrange(len(w) + 1)
                w = w[:i] + rng.choice(["", "x", "é", w[i:i + 1] * 2]) + w[i + rng.randrange(2):]
            ws.append(w if rng.random() < 0.7 else w.upper())
        out.append((d, rng.choice([" ", ", ", "-", "1"]).join(ws)))
    return out + [(None, out[0][1]), (3, out[3][1]), (70, None), (71, ""), (72, "÷×÷×÷×÷ " * 3), (73, "ab" * 4000 + " " + "ab" * 4000)]


@pytest.mark.parametrize("least, most, block", [(64, 100_000, 4_000), (0, 10**9, 3), (3, 50, 10)])
def test_variants(spark, least, most, block):
    rows = spelled(least)
    df = cases.frame(spark, [(d, t, None, None, 0) for d, t in rows], odd=True)
    got = spelling.variants(df, least, most, block).select("word", "form", "root", "n", "n_near", "form_n")
    want = expected_variants(rows)
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    assert spelling.variants(df.limit(0), least, most, block).count() == 0


@pytest.mark.parametrize("frequent", [{}, {"an": 9}, {x + y: 99 for x in "antoe\x02" for y in "antoe"} | {"ant": 70, "nta": 80, "tan": 70, "\x02an": 65, "on\x03": 66}])
def test_an_edit_leaves_as_many_grams_as_the_bound_says(frequent):
    """Words and all their neighbours share all but the affected grams, and the merged lists meet."""
    grams = spelling.Grams(frequent)
    rng = random.Random(7)
    for _ in range(150):
        w = "".join(rng.choice("anto") for _ in range(rng.randrange(7, 20)))
        i = rng.randrange(len(w) + 1)
        for v in {w[:i] + c + w[i + k:] for c in ("", "a", "n", "e") for k in (0, 1)} - {w}:
            a, b = sorted((w, v), key=len)
            if len(a) < 7:
                continue
            most = spelling.longest(len(a))
            cut = [Counter(f"\x02{x}\x03"[p:e] for p, e in grams.cut(x, most)) for x in (a, b)]
            shared = sum((cut[0] & cut[1]).values())
            for x, c in zip((a, b), cut):
                assert shared >= sum(c.values()) - grams.affected(x, grams.cut(x, most), most)
                assert sum(c.values()) - grams.affected(x, grams.cut(x, most), most) >= spelling.SHARED
            assert grams.postings(a)[0] & grams.postings(b)[len(a) != len(b)]


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w5")]
    got = dict(spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {w: "w13" for w, _ in chain}
