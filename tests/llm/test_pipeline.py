"""The pipeline, stage by stage, against what each stage must leave of what it was given."""

import zlib

import numpy as np
import pytest
from test_near_dup import exact

import corpus_pipeline
from trafficlens.llm import contamination, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "123 ...", "en", None, 7), (9003, "", None, "src1", 0)], docs.schema)
    path = tmp_path_factory.mktemp("pipeline")
    docs.unionByName(extra).write.parquet(str(path / "in"))
    out = [spark.read.parquet(str(path / "in"))]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], small).write.parquet(str(path / str(k)))
        out.append(spark.read.parquet(str(path / str(k))))
    return [(d.columns, {r["doc_id"]: r for r in d.collect()}, d.count()) for d in out]


def test_columns_and_uniqueness(stages):
    assert all(columns == COLUMNS for columns, _, _ in stages[:-1])
    assert all(len(rows) == n for _, rows, n in stages)


def test_language(stages):
    before, after = stages[0][1], stages[1][1]
    assert set(before) - set(after) == {i for i, r in before.items() if not any(c.isalpha() for c in r["text"] or "")}


def test_near_duplicates(stages):
    before, after = stages[1][1], stages[2][1]
    labels = exact([(i, r["text"]) for i, r in before.items()])
    assert set(after) == {i for i in before if labels[i][1] == i}


def test_decontamination(stages, spark):
    before, after = stages[2][1], stages[3][1]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    ids = sorted(before)
    found = contamination.brute_force([before[i]["text"] for i in ids], items)
    assert set(after) == {i for i, (_, n_hit, _) in zip(ids, found, strict=True) if not n_hit} and len(after) < len(before)


def test_mixing(stages):
    before, after = stages[3][1], stages[4][1]
    for i, r in after.items():
        assert set(r["text"].split()) <= set(before[i]["text"].split()) and r["n_chars"] == len(r["text"])
        assert len(r["text"].split()) <= 3 * len(before[i]["text"].split())
    total = sum(len(r["text"].split()) for r in before.values())
    assert abs(sum(len(r["text"].split()) for r in after.values()) - total) < 0.05 * total


def test_token_files(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    before, after, start = stages[4][1], stages[5][1], 0
    assert set(before) == set(after)
    for i in sorted(after):
        ids = [*tokenizer.encode(before[i]["text"], add_special_tokens=False).ids, 0]
        assert tuple(after[i][c] for c in ("start", "n_tokens", "ids_crc32")) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
