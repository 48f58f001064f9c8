import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from casewatch.llm import range_coder as rc
from casewatch.llm import token_files as tf
from casewatch.llm.tokens import Encoder
from casewatch.plans.lineage import new_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("count", [0, 1, 63, 64, 65, 1_000])
def test_round_trip(monkeypatch, count):
    monkeypatch.setattr(rc, "BLOCK", 64)
    monkeypatch.setattr(rc, "LANES", 4)
    rng = np.random.default_rng(count)
    for ids in (rng.integers(0, 65_536, count), np.zeros(count, int), np.full(count, 65_535), rng.zipf(1.4, count) % 500):
        assert rc.decode(rc.encode(ids.astype(np.uint32))).tolist() == ids.tolist()


def test_text_is_smaller_and_damage_is_seen():
    ids = np.tile(np.random.default_rng(1).zipf(1.5, 300) % 49_408, 20).astype(np.uint32)
    stream = rc.encode(ids)
    assert len(stream) < len(ids)  # of two bytes each
    for at in (0, 20, len(stream) - 1):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            rc.decode(bytes(bad))
    with pytest.raises(ValueError):
        rc.encode(np.array([1 << 16]))


def test_shared_model_needs_fewer_bits_than_single_ids():
    rng = np.random.default_rng(2)
    words = [rng.zipf(1.3, rng.integers(1, 4)) % 3_000 for _ in range(2_000)]
    ids = np.concatenate([words[w] for w in rng.zipf(1.2, 60_000) % 2_000]).astype(np.uint32)
    chance = np.bincount(ids) / len(ids)
    chance = chance[chance > 0]
    stream = rc.encode(ids)
    assert rc.decode(stream).tolist() == ids.tolist()
    assert 8 * len(stream) < -(chance * np.log2(chance)).sum() * len(ids)


def test_all_ids_are_equally_frequent():
    ids = np.random.default_rng(3).permutation(np.tile(np.arange(1 << 16), 3)).astype(np.uint32)
    stream = rc.encode(ids)
    assert (rc.decode(stream) == ids).all() and len(stream) < 2.5 * len(ids)


def test_lanes_and_blocks_that_are_not_full(monkeypatch):
    rng = np.random.default_rng(4)
    for block, lanes, short in ((5, 7, 3), (300, 2, 256), (1, 1, 1)):
        monkeypatch.setattr(rc, "BLOCK", block)
        monkeypatch.setattr(rc, "LANES", lanes)
        monkeypatch.setattr(rc, "SHORT", short)
        for count in (1, 2, block, block * lanes - 1, block * lanes, block * lanes + 1, 2 * block * lanes + 5):
            ids = rng.integers(0, 40, count).astype(np.uint32)
            assert rc.decode(rc.encode(ids)).tolist() == ids.tolist()


def test_learning_words_does_not_go_through_all_kept_ones():
    class Kept(dict):
        def __iter__(self):
            raise AssertionError("went through all kept words")

    ids_of, whole = Encoder(PATH), Tokenizer.from_file(PATH)
    ids_of.young = Kept(ids_of.young)
    ids_of._learn({"first", "words,", "more..."})
    for word in ("first", "words,", "more..."):
        assert np.frombuffer(ids_of.young[word], "<u2").tolist() == whole.encode(word, add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    rng, whole, ids_of = np.random.default_rng(5), Tokenizer.from_file(PATH), Encoder(PATH)
    signs = [*"abcßéàñşħABÉ.,;!?'|<> \n\t0", "'s", "'re", ",,", ".,", ", ", ". ", " ,", "é", "\u0301", "\u00a0", "日", "İ", "<|endoftext|>"]
    texts = [None, "", *("".join(rng.choice(signs, rng.integers(1, 50))) for _ in range(2_000))]
    for text, ids in zip(texts, ids_of.encode(texts)):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids


def test_documents(spark):
    texts = ["first words", None, "", "same", "same", "a longer text, " * 40, "ünï"]
    ids = [4, 9, None, 1, 1, 7, 3]
    docs = spark.createDataFrame([(i, t, 2) for i, t in zip(ids, texts)], "doc_id long, text string, part int").repartition(3)
    got = [tuple(r) for r in tf.token_file_digest(docs, PATH, segment=30).collect()]
    whole, at, want = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(zip(ids, texts), key=lambda x: -1 if x[0] is None else x[0]):
        found = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        at += len(found)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tf.token_file_digest(docs.limit(0), PATH).count() == 0


def test_files_hold_the_ids(spark):
    folder = new_dir(spark, "tokens")
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    tf.write_token_files(docs, folder, PATH)
    rows = tf.read_token_files(spark, folder).sort("doc_id").collect()
    whole = Tokenizer.from_file(PATH)
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in rows] == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in ("one two", "three")]
