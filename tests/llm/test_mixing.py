from collections import Counter

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from trafficlens.llm import mixing, queries


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        rows = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(3).cast("bigint")).alias("p"))
        rows = rows.select("id", "p", mixing.permuted(F.col("p"), F.lit(n).cast("bigint"), F.lit(3).cast("bigint"), inverse=True).alias("back")).collect()
        assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["id"] == r["back"] for r in rows)


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), ("d", 0), (None, 50), ("b", 0)], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert sum(got.values()) == pytest.approx(1160)
    weights, cap = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 30, "b": 300, "c": 3000, "d": 0, None: 150}
    free = [s for s in got if got[s] < cap[s]]
    level = {got[s] / weights[s] for s in free}
    assert max(level) == pytest.approx(min(level)) and all(got[s] <= weights[s] * max(level) + 1e-9 for s in got)


def test_mix(spark, frame):
    rows = [(k, "w " * (k % 50), None, ["a", "b", None][k % 3]) for k in range(300)] + [(None, "w w"), (5, None), (5, ""), (7, "one two"), (7, "one two")]
    docs = frame(rows)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS
    assert mixing.mix(docs.limit(0)).collect() == []


def test_mixed_documents(spark, frame):
    rows = [(k, " ".join(f"d{k}w{i}" for i in range(k % 90)), None, "ab"[k % 2]) for k in range(200)] + [(7, "x y", None, "a"), (7, "x y", None, "a"), (8, None)]
    docs = frame(rows)
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"], r["size"]] += r["taken"]
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    words = Counter()
    for r in got.collect():
        own = r["text"].split(" ")
        size = 2 if own[0] in "xy" else r["doc_id"] % 90
        words[r["doc_id"], size] += len(own)
        assert set(own) <= set(next(t for i, t, *_ in rows if i == r["doc_id"] and t and own[0] in t.split()).split())
    assert words == +taken


def test_clashing_names_and_long_texts(spark, frame):
    """A user's own _hash comes back as it was; a text of 500,000 words takes seconds."""
    import time

    from pyspark.sql import functions as F

    docs = frame([(1, "a b c", None, "x"), (2, "d e", None, "x"), (3, "w " * 500_000, None, "x")]).withColumn("_hash", F.lit("mine"))
    began = time.time()
    got = mixing.mixed_documents(docs).collect()
    assert time.time() - began < 60
    assert {r["_hash"] for r in got} == {"mine"} and sum(len(r["text"].split(" ")) for r in got) > 400_000


def test_draws_are_made_by_many_tasks(spark):
    sources = spark.createDataFrame([(1, 1_000_000, 3_000_000, 0, 3_000_000)], "rank bigint, blocks bigint, draws bigint, first_slot bigint, slots bigint")
    draws = mixing.draw_slots(sources)
    assert draws.rdd.getNumPartitions() >= 3_000_000 // mixing.TASK_SLOTS
    assert draws.count() == 3_000_000


def test_query(spark, small):
    assert differences(queries.op8_mixing(spark, small), connect(small), queries.SQL["op8_mixing"]) == []
