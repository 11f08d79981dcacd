"""Token files, packing and token counts against the tokenizers library."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewlens.llm import common as C
from reviewlens.llm import packing, sequence_files, token_counts
from tests.llm import cases


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(C.tokenizer_path())


def ids_of(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


WHITE = ["a  b", " a", "a ", "\n a\n", "a\n\n", "a \n\n b", "a\t\tb\t", "\t\n x", "x  y", "a  b", "\x1c\x1d a\x1c", "it's we'll I'm\n's",
         "１２ ½ x²", "<|endoftext|>", "a  <|endoftext|>  b", "日本語 テキスト", "🙂🙂  🙂", "aaaaaaaaaaaaaaaaaaaaaaaa", "....!!!??", "a" * 5000, " " * 50 + "x" + " " * 50]


def test_pieces_and_counts_equal_the_library(tok):
    path = C.tokenizer_path()
    enc, counter = C.Pieces(path), token_counts.Counter(path)
    texts = [t for _, t, *_ in cases.documents()] + WHITE + [None]
    for _ in range(2):  # the second time from the cache
        got = enc.encode(texts)
        assert [np.frombuffer(g, enc.dtype).tolist() for g in got] == [ids_of(tok, t) for t in texts]
        assert counter.count(texts) == [len(ids_of(tok, t)) for t in texts]


def test_few_kept_pieces_give_the_same_ids(tok):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 30)) for _ in range(60)]
    enc, most = C.Pieces(C.tokenizer_path(), 100), 0
    for i in range(0, len(texts), 5):
        assert [np.frombuffer(g, enc.dtype).tolist() for g in enc.encode(texts[i:i + 5])] == [ids_of(tok, t) for t in texts[i:i + 5]]
        most = max(most, len(enc.known))
    assert most < 300  # those of one call and at most 100 before


def test_pieces_learned_as_one_text_equal_the_library(tok):
    rng = np.random.default_rng(3)
    signs = [*"abcXYZ019'.,!-_#@<>|é你🙂\u0301\u180e\u200b", *" " * 9, *"\n" * 3, *"\t\r\x1c\x85\xa0\u2028\u3000", "'s", "<|endoftext|>", "  ", " \n"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 50))) for _ in range(3000)]
    enc = C.Pieces(C.tokenizer_path())
    for i in range(0, len(texts), 100):
        assert [np.frombuffer(g, enc.dtype).tolist() for g in enc.encode(texts[i:i + 100])] == [ids_of(tok, t) for t in texts[i:i + 100]]
    # where token bytes do not reach the spaces, the pieces are kept apart instead
    enc.known.clear()
    enc.n_bytes += 1
    words = ["one", "two words", "drei\nvier", "five six one"]
    assert not enc._learn_plain(["one", "two"]) and not enc.known
    assert [np.frombuffer(g, enc.dtype).tolist() for g in enc.encode(words)] == [ids_of(tok, t) for t in words]


def test_carriage_returns_count_like_the_library(tok):
    counter, enc = token_counts.Counter(C.tokenizer_path()), C.Pieces(C.tokenizer_path())
    texts = ["x \ry", "y", "y y", "x \r", "x\r y", "x\ry", "x \r\ny", "x\r\ny z", "\ry", "a \rb \rc\r d \n\re", "x \r<|endoftext|> \ry"]
    for t in (texts, texts[::-1]):
        assert counter.count(t) == [len(ids_of(tok, x)) for x in t]
        assert [np.frombuffer(g, enc.dtype).tolist() for g in enc.encode(t)] == [ids_of(tok, x) for x in t]


@pytest.mark.parametrize("odd", [False, True])
def test_count_tokens(spark, tok, odd):
    rows = cases.documents()
    df = cases.frame(spark, rows + rows[:3] + [(None, None, None, None, None)], odd)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, C.tokenizer_path()).collect())
    want = sorted((i, len((t or "").encode()), len(ids_of(tok, t)), len(ids_of(tok, t)) > 512) for i, t, *_ in rows + rows[:3] + [(-1, None)])
    assert got == want
    assert token_counts.count_tokens(df.limit(0), C.tokenizer_path()).count() == 0


def test_sequence_files_round_trip(spark, tok):
    rows = cases.documents()
    files = sequence_files.write(cases.frame(spark, rows, True), C.tokenizer_path(), end_id=2, length=64)
    got = sorted(sequence_files.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect())
    at = 0
    assert len(got) == len(rows)
    for r, (i, t, *_) in zip(got, sorted(rows, key=lambda r: r[0])):
        ids = ids_of(tok, t) + [2]
        assert tuple(r) == (i, at, len(ids), crc(ids))
        at += len(ids)
    for m in files.collect():  # masks mark the real ids; sequences come without a copy
        shard = sequence_files.ShardReader(m.path)
        marked = 0
        for k in range(m.n_sequences):
            ids, mask = shard.sequence(k)
            assert len(ids) == len(mask) == 64 and not ids.flags.owndata
            marked += sum(mask.to_pylist())
        assert marked == m.n_tokens
    assert sequence_files.read(sequence_files.write(cases.frame(spark, rows).limit(0), C.tokenizer_path())).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_packing(spark, tok, parts):
    rows = cases.documents()
    pieces = C.write_table(packing.pieces(cases.frame(spark, rows, True).repartition(parts), C.tokenizer_path(), end_id=0, window=100))
    ids = {i: ids_of(tok, t) + [0] for i, t, *_ in rows}
    stream, seen = {}, {i: 0 for i in ids}
    for r in pieces.collect():
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert np.frombuffer(r.ids, "<u4").tolist() == part and r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length > 0
        seen[r.doc_id] += r.length
        stream.setdefault(r.sequence_id, []).append((r.offset, part))
    assert seen == {i: len(x) for i, x in ids.items()}
    total = sum(seen.values())
    assert sorted(stream) == list(range(-(-total // 100)))
    flat = {}
    for s, p in stream.items():
        flat[s] = []
        for o, part in sorted(p):
            assert o == len(flat[s])
            flat[s] += part
        assert len(flat[s]) == 100 or s == max(stream)
    for r in packing.sequences(pieces, 100).collect():
        x = np.frombuffer(r.ids, "<u4").tolist()
        assert len(x) == 100 and x[:r.n_tokens] == flat.pop(r.sequence_id)
    assert not flat
    assert packing.pieces(cases.frame(spark, rows).limit(0), C.tokenizer_path()).count() == 0


def test_packing_takes_the_width_from_the_encoder(spark, monkeypatch):
    """A vocabulary over 65,536 is stored and read in 32 bits."""
    big = [70_000 + 3 * i for i in range(50)]
    stored = spark.createDataFrame([(0, 0, 7, 50, bytearray(np.array(big, "<u4").tobytes()))], "part long, part_start long, doc_id long, n_tokens long, ids binary")
    monkeypatch.setattr(packing, "tokenised", lambda *_: stored)
    got = packing.pieces(stored, "", window=32).orderBy("start").collect()
    assert [r.length for r in got] == [32, 18] and [x for r in got for x in np.frombuffer(r.ids, "<u4").tolist()] == big


def test_other_tokenizers_are_refused(tmp_path):
    import json

    with open(C.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", None)):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | {key: value}), encoding="utf-8")
        with pytest.raises(ValueError):
            token_counts.RankTable(str(path))


def test_prefix_sums_in_runs(spark):
    df = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 3 + 1).alias("v"))
    got = dict(packing.prefix_sums(df, "k", "v", run=7).collect())
    assert got == {k: sum(3 * j + 1 for j in range(k)) for k in range(50)}
