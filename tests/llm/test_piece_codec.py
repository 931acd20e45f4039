"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from trafficlens.llm import piece_codec, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  ", "   a", "a ", "▁", "▁▁ x", " " * 17, "a" * 50, "\n\n\n", "a\tb\0c", "</s><s><unk><0x41>", "日本語 𝒳 😀é́", "e" * 33 + " " * 9,
    " " * 700 + "x", "ab" * 5000, "tie tie tie", "tie tie tie"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def both_ways(texts, library):
    vocabulary = piece_codec.load(PATH)
    ids, rows = piece_codec.encode_column(pa.array(texts, pa.string()), vocabulary)
    mine = [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])]
    assert mine == [library.encode(x or "") for x in texts]
    lists = pa.array(mine, pa.list_(pa.int32()))
    assert piece_codec.decode_column(lists, vocabulary).to_pylist() == [library.decode(x) for x in mine]


def test_odd_texts(library):
    both_ways(ODD, library)


def test_merges_that_wait_for_one_another(library):
    pick = random.Random(5)
    both_ways(["".join(pick.choice("aabbcn e  thinrsos\n▁é日=-_.") for _ in range(pick.randint(0, 70))) for _ in range(4000)], library)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_any_text(library, texts):
    both_ways(texts, library)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 260)), max_size=12), min_size=1, max_size=8))
def test_any_ids_decode(library, lists):
    mine = piece_codec.decode_column(pa.array(lists, pa.list_(pa.int32())), piece_codec.load(PATH)).to_pylist()
    assert mine == [library.decode(x) for x in lists]


def test_other_models_are_refused(tmp_path, monkeypatch):
    class Other(sentencepiece.SentencePieceProcessor):
        def normalize(self, text):
            return text.strip()

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError):
        piece_codec.load.__wrapped__(PATH)


def test_frames(spark, frame, library):
    docs = frame([(k, x) for k, x in enumerate(ODD)]).withColumn("ids", pa_null()).withColumn("decoded", pa_null())
    found = piece_codec.decode(piece_codec.encode(docs, PATH), PATH).collect()
    assert len(found) == len(ODD) and {"lang", "n_words", "start"} <= set(found[0].asDict())
    for row in found:
        assert row["ids"] == library.encode(row["text"] or "")
        assert row["decoded"] == library.decode(row["ids"])
    empty = piece_codec.decode(piece_codec.encode(frame([]), PATH), PATH)
    assert empty.count() == 0
    missing = spark.createDataFrame([(1, None), (2, [])], "doc_id int, ids array<int>")
    assert [r["decoded"] for r in piece_codec.decode(missing, PATH).collect()] == ["", ""]


def pa_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def test_query(spark, small, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_sentencepiece"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
