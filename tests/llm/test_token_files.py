import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trafficlens.llm import queries
from trafficlens.llm import token_files as T

ODD = ["", None, "  ", "a", "a  b", "\n\na", "x \ny", " a 　b \n c", "it's we'll\tgo \r\n end ", "<|endoftext|> x", "é\u0085 b", "\x1f a", "\U0001f642 \U0001f642\n\U0001f642", "\nx\ny", " 's", "\n's"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_pieces_encode_as_whole_texts(tokenizer):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["the", " of", " ", "\n", "Q", "é", "12", ".", "'s", "\t", " "]) for _ in range(rng.randrange(30))) for _ in range(300)]
    ids, rows = T.Encoder.at(queries.tokenizer_path()).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[rows[k] : rows[k + 1]].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, T.END_ID], text


def huffman_cost(counts):
    import heapq

    heap, total = sorted(counts), 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total


def test_code_lengths():
    rng = random.Random(4)
    for _ in range(40):
        counts = np.array([rng.randrange(1, 1000) for _ in range(rng.randrange(2, 60))])
        free = T.code_lengths(counts, 40)
        assert int((counts * free).sum()) == huffman_cost(counts.tolist())
        tight = T.code_lengths(counts, 6)
        assert tight.max() <= 6 and sum(2.0 ** -int(x) for x in tight) <= 1
    assert T.code_lengths(np.array([5])).tolist() == [1]
    assert T.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32, 64]), 4).max() == 4


def test_code_round_trip():
    rng = np.random.default_rng(1)
    ids = np.unique(rng.integers(0, 50_000, 3000))
    code = T.Code(ids, T.code_lengths(rng.geometric(0.01, len(ids)).astype(np.int64)))
    blocks = [rng.choice(ids, n).astype(np.uint32) for n in (1, 255, 256, 257, 5000)]
    made = [code.encode(b) for b in blocks]
    back = code.decode([p for p, _ in made], [m for _, m in made], np.array(list(map(len, blocks))))
    assert (back == np.concatenate(blocks)).all()
    # any checkpoint decodes by itself
    payload, marks = made[-1]
    assert (code.decode([payload], [marks[7:8]], np.array([256])) == blocks[-1][7 * 256 : 8 * 256]).all()


def test_files(spark, frame, tokenizer, monkeypatch):
    monkeypatch.setattr(T, "PART_BYTES", 2000)
    docs = frame([(3 * k % 101, t) for k, t in enumerate([*ODD, "word " * 9000, *(f"text {k} of many" for k in range(80))])] + [(None, "null id"), (7, "same"), (7, "same")])
    path = T.write_token_files(docs, queries.tokenizer_path(), T.fresh_path(spark))
    got = T.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    order = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in docs.collect())
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == order
    start, texts = 0, {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == start and r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"])
        texts[r["doc_id"]].remove(ids)
        start += len(ids)
    assert not any(texts.values())


def test_empty_table(spark, frame):
    path = T.write_token_files(frame([]), queries.tokenizer_path(), T.fresh_path(spark))
    assert T.read_token_files(spark, path).collect() == []


def test_special_tokens_encode_as_the_plain_call_does(spark, frame):
    """An unmodified tokenizer takes the string of a special token as that token."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    texts = [*ODD, "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y<|endoftext|>", "<|endoftext|> b", "<|endoftext", " a b c"]
    expected = [[*plain.encode(t or "", add_special_tokens=False).ids, T.END_ID] for t in texts]
    assert expected[len(ODD)] == [64, 220, 50256, 275, T.END_ID]
    for own in (texts, texts[::-1]):
        ids, rows = T.Encoder(queries.tokenizer_path()).encode(pa.array(own))
        assert [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:], strict=True)] == (expected if own is texts else expected[::-1])
    path = T.write_token_files(frame(list(enumerate(texts))), queries.tokenizer_path(), T.fresh_path(spark))
    got = T.read_token_files(spark, path).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in expected]


def test_marks_end_pieces_as_the_library_cuts(tokenizer):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["don't", "a", "B9", ".", ",", "'", "\"", ")", "...", "é", " ", "\n", "_", "'s.", "x.y", "3.14,"]) for _ in range(rng.randrange(25))) for _ in range(2000)]
    ids, rows = T.Encoder(queries.tokenizer_path()).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[rows[k] : rows[k + 1]].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, T.END_ID], text
