import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casewatch.llm.packing import Bins, pack, pack_documents, pack_pieces
from casewatch.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_places(rows, size):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_encoder_is_the_tokenizer():
    whole = Tokenizer.from_file(PATH)
    own = Encoder(PATH)
    rng = np.random.default_rng(0)
    letters = [*"aAbZéßñİΣς.,!?'<|>09 \n\t\x1c\x85\u0301中٣", "<|endoftext|>", "'ll", "<|ENDOFTEXT|>", "word", "Word,"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(800)] + ["", "İ.", "a" * 5_000]
    for start in range(0, len(texts), 50):
        part = texts[start : start + 50]
        for text, ids in zip(part, own.encode(part)):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
    assert own.encode([None])[0].tolist() == []


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr("casewatch.llm.tokens.KEPT", 5)
    own, whole = Encoder(PATH), Tokenizer.from_file(PATH)
    texts = [" ".join(f"w{chr(97 + (i * j) % 26)}x" for i in range(20)) for j in range(20)]
    for text in texts * 2:
        assert own.encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("low, high", [(1, 30), (20, 60), (40, 99), (25, 45)])
def test_search_keeps_items_and_only_lowers_bins(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 300)
    start = Bins(lengths, 100)
    start.best_fit()
    before = int((start.fill > 0).sum())
    start.improve()
    assert start.fewest() <= int((start.fill > 0).sum()) <= before
    at, offset, fill = pack(lengths, 100)
    assert (np.bincount(at, weights=lengths) <= 100).all()
    assert (fill == np.bincount(at, weights=lengths)[at]).all() and (offset + lengths <= fill).all()


@pytest.mark.parametrize("low, high, most", [(1300, 1500, 1_650), (900, 1400, 1_232), (1000, 2100, 1_655)])
def test_search_beats_best_fit_where_it_wastes_room(low, high, most):
    lengths = np.random.default_rng(0).integers(low, high, 4_096)
    bins = Bins(lengths, 4096)
    bins.best_fit()
    before = int((bins.fill > 0).sum())
    bins.improve()
    after = int((bins.fill > 0).sum())
    assert after <= most and after <= 0.985 * before and bins.fewest() <= after
    assert (np.bincount(bins.bin, weights=lengths, minlength=len(bins.fill)) == bins.fill).all() and bins.fill.max() <= 4096


def test_exchanges_empty_bins():
    """7+1, 6+2, 3+1: a move, exchanges of 3 for 2 and 2 for 1, and a last move leave two full bins."""
    bins = Bins(np.array([7, 1, 6, 2, 3, 1]), 10)
    bins.bin, bins.fill = np.array([0, 0, 1, 1, 2, 2]), np.array([8, 8, 4])
    bins.improve()
    assert sorted(bins.fill.tolist()) == [0, 10, 10]


def test_documents(spark):
    texts = [None, "", "one two three", "word " * 50, "a b c d e " * 9, "x"]
    docs = spark.createDataFrame([(i, t, 5, 0) for i, t in enumerate(texts)] + [(None, "x", 1, 1)], "doc_id long, text string, piece int, row int")
    rows = pack_documents(docs, PATH, size=16).collect()
    check_places(rows, 16)
    whole = Tokenizer.from_file(PATH)
    want = []
    for i, t in [*enumerate(texts), (None, "x")]:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        for n, a in enumerate(range(0, len(ids), 16)):
            want.append((i, n, a, len(ids[a : a + 16]), zlib.crc32(np.array(ids[a : a + 16], "<u4").tobytes())))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_rounds_over_many_shards(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 65, 600).tolist() + [64] * 5
    rows = spark.createDataFrame([(n, "x") for n in lengths], "length long, offset string")
    found = pack_pieces(rows, 64, shard=20).collect()
    assert sorted(r["length"] for r in found) == sorted(lengths)
    one = len(set(pack(np.array(lengths), 64)[0].tolist()))
    assert check_places(found, 64) <= one * 1.05
    assert pack_pieces(rows.limit(0), 64).count() == 0
