import random

import pyarrow as pa
import pytest
from compare import connect, differences

from trafficlens.llm import near_dup as N
from trafficlens.llm import queries
from trafficlens.llm.components import components


def exact(rows):
    """component by id: all pairs on full sets."""
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def cluster(rng, first, n, words=120, edits=4):
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"e{rng.randrange(10_000)}"
        out.append((first + k, " ".join(own)))
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_groups(spark, frame, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rng = random.Random(block)
    rows = cluster(rng, 0, 90, edits=7) + cluster(rng, 100, 40, edits=9) + cluster(rng, 200, 3) + [(300 + k, " ".join(f"u{rng.randrange(9999)}" for _ in range(30))) for k in range(40)]
    rows += [(400, None), (401, ""), (402, " \n\t"), (403, "One two"), (404, "one\ttwo"), (405, "one two three"), (406, rows[5][1].upper()), (407, rows[5][1])]
    # a passage shared by documents that are otherwise unlike
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(500 + k, passage + " " + " ".join(f"q{rng.randrange(99_999)}" for _ in range(rng.randrange(10, 40)))) for k in range(60)]
    rng.shuffle(rows)
    got = N.near_duplicates(frame(rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == exact(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_null_ids_repeats_and_filter(spark, frame):
    text = " ".join(f"w{k}" for k in range(30))
    docs = frame([(1, text), (1, text), (2, text + " x"), (None, text), (3, None)])
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in N.near_duplicates(docs).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    kept = N.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 3]
    assert N.near_duplicates(docs.limit(0)).collect() == []


def test_estimate_follows_similarity(spark):
    rng = random.Random(1)
    base = [f"w{k}" for k in range(400)]
    other = base[:300] + [f"x{rng.randrange(9999)}" for _ in range(100)]
    found = N.W.words(pa.array([" ".join(base), " ".join(other)]))
    hashes, offsets = N.shingle_sets(found)
    bits, _ = N.sketch(hashes, offsets)
    a, b = ({*hashes[offsets[k] : offsets[k + 1]].tolist()} for k in (0, 1))
    row = spark.createDataFrame([(bits[0].view("int64").tolist(), bits[1].view("int64").tolist())], "a array<bigint>, b array<bigint>")
    assert row.select(N.estimate(row["a"], row["b"])).first()[0] == pytest.approx(len(a & b) / len(a | b), abs=0.15)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3), (200, 199)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100, 199: 199, 200: 199}


def test_query(spark, small):
    assert differences(queries.op5_near_dup(spark, small), connect(small), queries.SQL["op5_near_dup"]) == []
