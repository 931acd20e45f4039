"""Suffix-array search against word-list comparison."""

import random

import pyarrow as pa
import pytest
from compare import connect, differences

from trafficlens.llm import contamination as C
from trafficlens.llm import queries

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [("7", LONG), ("10", "Only Four Words Here"), ("11", None), ("12", ""), ("13", "x " * 15), ("7", "only four words here"), ("21", LONG)]
TEXTS = [
    LONG, "before " + LONG.upper() + " after", " ".join(LONG.split()[:9]), " ".join(LONG.split()[1:11]), "only, four; words-here!", "only four words",
    None, "", "...", "x " * 40, "x " * 14, LONG + " " + LONG, "only four words here only four words here", "é" + LONG,
]


def rows(result):
    return [(r["n_words"], r["n_hit"], r["item_ids"]) for r in result]


def test_cases(spark, frame):
    docs = frame([(k, t) for k, t in enumerate(TEXTS)])
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    found = C.contamination(docs, items).orderBy("doc_id").collect()
    assert rows(found) == C.brute_force(TEXTS, ITEMS)
    assert found[0]["matches"][0]["n_words"] == 12 and found[11]["n_hit"] == 24


def test_passes_agree(spark, frame):
    docs = frame([(k, t) for k, t in enumerate(TEXTS)])
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getCheckpointDir() or __import__("tempfile").mkdtemp())
    assert rows(C.contamination(docs, items, query_bytes=60).orderBy("doc_id").collect()) == C.brute_force(TEXTS, ITEMS)


def test_random_texts():
    rng = random.Random(5)
    word = lambda: rng.choice("a b c d".split())
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    items = [(str(k), " ".join(word() for _ in range(rng.randrange(0, 16)))) for k in range(20)]
    built = C.build_queries([i for i, _ in items], pa.array([t for _, t in items]))
    found = C.search_shard(pa.array(texts), built)
    expected = C.brute_force(texts, items)
    for k, (n_words, n_hit, ids) in enumerate(expected):
        assert found.n_words[k] == n_words
        assert found.hits[found.rows[k] : found.rows[k + 1]].sum() == n_hit
        assert sorted(built.ids[i] for d, i in found.doc_items if d == k) == ids


def test_suffix_array_orders_words():
    codes = C._codes(C.W.words(pa.array(["b a b a b a c a b a b " * 9]), C.W.ALPHANUMERIC).hashes)
    order = C.suffix_array(C._packed(codes), 12)
    padded = [*codes.tolist(), *[0] * 14]
    prefixes = [tuple(padded[p : p + 12]) for p in order]
    assert prefixes == sorted(prefixes) and sorted(order) == list(range(len(codes)))


def test_empty_tables_and_filter(spark, frame):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert C.contamination(frame([]), items).collect() == []
    docs = frame([(1, LONG), (2, None), (3, "clean text"), (None, "")])
    assert [r["n_hit"] for r in C.contamination(docs, items.limit(0)).collect()] == [0, 0, 0, 0]
    kept = C.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3]


def test_query(spark, small):
    assert differences(queries.op1_decontamination(spark, small), connect(small), queries.SQL["op1_decontamination"]) == []


@pytest.mark.parametrize("ids", [[], ["b", "a"]])
def test_digest(spark, ids):
    got = spark.range(1).select(C.item_digest(C.F.array(*map(C.F.lit, ids)).cast("array<string>")).alias("x")).first()["x"]
    assert got == C.sha256_of(ids)


def matches_of(row):
    return [tuple(m) for m in row["matches"] or []]


def test_matches_of_items_that_share_words(spark, frame):
    """Two items with one preamble, an item that repeats itself, an item given twice, single-word items."""
    preamble = " ".join(f"p{k}" for k in range(12))
    items = [("a", preamble + " one two three"), ("b", preamble + " four five six seven eight nine ten eleven"), ("b", preamble + " four five six seven eight nine ten eleven"),
             ("c", "x " * 15), ("d", "q"), ("e", "only four words here"), (None, preamble), ("f", None)]
    texts = [items[1][1], items[0][1] + " " + items[1][1], "x " * 40, "q", "q q", "only four words here", preamble + " three", None, "", "p0 " + preamble]
    found = C.contamination(frame(list(enumerate(texts))), spark.createDataFrame(items, "item_id string, text string")).orderBy("doc_id").collect()
    known = [(i or "", t) for i, t in items]
    assert [matches_of(r) for r in found] == [C.brute_matches(t, known) for t in texts]
    assert (0, 20, "b", 0) in matches_of(found[0]) and (0, 12, "a", 0) in matches_of(found[0])


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_matches_against_brute_force(window):
    rng = random.Random(window)
    word = lambda: rng.choice("a b c".split())
    texts = [" ".join(word() for _ in range(rng.randrange(0, 50))) for _ in range(40)]
    items = [(f"i{k:02d}", " ".join(word() for _ in range(rng.randrange(0, 25)))) for k in range(15)]
    items += [(f"j{k:02d}", " ".join(t.split()[3:30])) for k, t in enumerate(texts[:8])]
    built = C.build_queries([i for i, _ in items], pa.array([t for _, t in items]), window)
    found = C.search_shard(pa.array(texts), built)
    for k, text in enumerate(texts):
        got = sorted({(w, n, built.ids[item], at) for d, w, n, item, at in found.matches if d == k})
        assert got == C.brute_matches(text, items, window)


def test_periodic_texts_cost_what_their_matches_cost():
    """200,000 equal words against an item of 2,000: 398 million pairs of windows, 201,981 matches."""
    built = C.build_queries(["a"], pa.array(["x " * 2_000]))
    found = C.search_shard(pa.array(["x " * 200_000]), built)
    assert len(found.matches) == (200_000 - 9) + (2_000 - 9) - 1
    assert max(n for _, _, n, _, _ in found.matches) == 2_000
