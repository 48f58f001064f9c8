import random

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from casewatch.llm import pieces
from casewatch.llm.queries import op12_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [*"ab cdeTh  in\n\tß▁é漢字🙂<>x0A0123  \u0000ﬁ①", "the ", "  ", "▁▁", "<0x0A>", "</s>", "<unk>", "ing "]


def made(rng, longest=25):
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(longest)))


def test_ids_and_spans_are_those_of_the_library(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 50)
    monkeypatch.setattr(pieces, "LONGEST", 5)
    mine, library, rng = pieces.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(1)
    for _ in range(1_000):
        text = made(rng)
        ids, starts, ends = mine.encode([text.encode()])[0]
        assert ids.tolist() == library.encode(text, add_eos=True)
        want = library.encode(text, return_type="proto").pieces
        spans = []
        for n, piece in enumerate(want):
            if library.is_byte(piece.id):
                # The library gives a character's span to its last byte.
                last = next(p for p in want[n:] if p.end > p.begin)
                after = next(i for i in range(n, len(want)) if want[i].end > want[i].begin)
                spans.append((last.end - (after - n) - 1, last.end - (after - n)))
            else:
                spans.append((piece.begin, piece.end))
        assert list(zip(starts.tolist(), ends.tolist())) == [*spans, (len(text.encode()),) * 2]
        assert b"".join(text.encode()[a:b] for a, b in zip(starts, ends)) == text.encode()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_character_maps(rule, squeeze):
    library, spec = sentencepiece.SentencePieceNormalizer(rule_name=rule, remove_extra_whitespaces=squeeze), sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(library.serialized_model_proto())
    mine, rng = pieces.Normalizer(spec.normalizer_spec), random.Random(2)
    symbols = list("aAB ﬁ①㍿ é́ÅｱｶﾞΣ  \t\n​　ß漢🙂½")
    for _ in range(1_000):
        text = "".join(rng.choice(symbols) for _ in range(rng.randrange(14)))
        found, places = mine(text.encode())
        assert found.decode() == library.normalize(text), repr(text)
        assert len(places) == len(found) + 1 and (np.diff(places) >= 0).all() and 0 <= places[0] and places[-1] <= len(text.encode())
    found, places = mine("①ﬁx".encode())
    assert found.endswith(b"1fix") and places[-5:].tolist() == [0, 3, 3, 6, 7]


def test_documents_and_back(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    texts = [None, "", " ", "a", "a", "one two  three", "x" * 30_000, "ab " * 30_000, *[made(rng, 60) for _ in range(60)]]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, decoded string").repartition(3)
    found = pieces.decode_pieces(pieces.encode_pieces(docs, MODEL), MODEL, text="again")
    rows = found.orderBy("doc_id").collect()
    assert found.columns == ["doc_id", "text", "decoded", "piece_ids", "piece_starts", "piece_ends", "again"]
    for text, row in zip(texts, rows, strict=True):
        want = library.encode(text or "", add_eos=True)
        assert (row["text"], row["decoded"], row["piece_ids"], row["again"]) == (text, "kept", want, library.decode(want))
    with pytest.raises(ValueError, match="decoded"):
        pieces.decode_pieces(docs.withColumn("piece_ids", F.lit(None).cast("array<int>")), MODEL)
    empty = docs.withColumn("piece_ids", F.when(F.col("doc_id") == 0, F.array().cast("array<int>"))).drop("decoded").where("doc_id < 2")
    assert [r["decoded"] for r in pieces.decode_pieces(empty, MODEL).orderBy("doc_id").collect()] == ["", None]
    assert pieces.encode_pieces(docs.limit(0), MODEL).count() == 0


def test_registered_query(spark, data):
    import hashlib

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    found = {tuple(r) for r in op12_pieces(spark, data).collect()}
    want = set()
    for key, text in texts.items():
        ids = library.encode(text, add_eos=True)
        want.add((key, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    assert found == want
