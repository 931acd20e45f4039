import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from trafficlens.llm import lm_score as S
from trafficlens.llm import queries


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows):
    one, two = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, text, held in rows:
        if not held:
            words = tokens(text)
            one.update(words)
            for h, w in zip(["<s>", *words], words, strict=False):
                two[h][w] += 1
    n, v = sum(one.values()), len(one)
    out = []
    for i, text, held in rows:
        words = tokens(text)
        low = [(one[w] + 1) / (n + v + 1) for w in words]
        score = 0.0
        for h, w, p in zip(["<s>", *words], words, low, strict=False):
            seen = two[h].total() if h in two else 0
            score += math.log10((max(two[h][w] - 0.75, 0) + 0.75 * len(two[h]) * p) / seen if seen else p)
        out.append((i, held, len(words), sum(one[w] > 0 for w in words), n, sum(map(math.log10, low)), score))
    return out


def same(got, expected):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-9)


CASES = [(1, "The cat the cat sat", False), (2, "the cat", False), (3, None, False), (4, "", True), (5, "the unknown cat", True), (None, "a a a", False), (2, "the cat", False), (7, "w " * 3000, True)]


@pytest.mark.parametrize("part_bytes", [S.PART_BYTES, 500])
def test_cases(spark, tmp_path, monkeypatch, part_bytes):
    monkeypatch.setattr(S, "PART_BYTES", part_bytes)
    spark.createDataFrame([(*r, "x") for r in CASES], "doc_id bigint, text string, held boolean, score string").repartition(3).write.parquet(str(tmp_path / "d"))
    same(S.lm_scores(spark.read.parquet(str(tmp_path / "d")), F.col("held")).collect(), brute(CASES))


def test_weights_of_a_state_sum_to_one(spark, tmp_path):
    """Over the vocabulary and one unknown word, after a word that has arcs."""
    train = [(k, "a b a c a b a d", False) for k in range(5)]
    ask = [(100 + k, f"a {w}", True) for k, w in enumerate(["a", "b", "c", "d", "zz"])]
    spark.createDataFrame(train + ask, "doc_id bigint, text string, held boolean").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r["score"] for r in S.lm_scores(spark.read.parquet(str(tmp_path / "d")), F.col("held")).collect()}
    rows = {r[0]: r for r in brute(train + ask)}
    for k in got:
        assert got[k] == pytest.approx(rows[k][6])


def test_empty_and_all_held_out(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", True)], "doc_id bigint, text string, held boolean").coalesce(1)
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    same(S.lm_scores(docs, F.col("held")).collect(), brute([(1, "a b", True)]))
    assert S.lm_scores(docs.limit(0), F.col("held")).collect() == []


def test_bigrams_seen_once_are_arcs(spark, tmp_path):
    """A held-out text that repeats a phrase seen once scores above one of the same words in an order never seen."""
    rows = [*CASES[:5], (10, "a rare phrase", False), (11, "a rare phrase", True), (12, "phrase rare a", True)]
    spark.createDataFrame(rows, "doc_id bigint, text string, held boolean").repartition(3).write.parquet(str(tmp_path / "d"))
    got = S.lm_scores(spark.read.parquet(str(tmp_path / "d")), F.col("held")).collect()
    same(got, brute(rows))
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[11] > score[12] + 1


def test_query(spark, small):
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    same(queries.op10_lm_score(spark, small).collect(), brute(rows))
