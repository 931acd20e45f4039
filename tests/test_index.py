"""Indexes of several tables, eviction inside the store, dispatch by replayed breakers."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trafficlens.functions import vectors as V
from trafficlens.functions.clock import at
from trafficlens.operators import cache as C
from trafficlens.operators import routing as G
from trafficlens.sources import dims

DIM, PLANES, TABLES = 16, 6, 3


def frame(spark, vectors):
    return spark.createDataFrame([(i, f"t{i % 2}", "m", [float(x) for x in v]) for i, v in enumerate(vectors)],
                                 "id bigint, tenant string, model string, vec array<double>")


def buckets(vec, probes):
    """The same buckets, one plane after another."""
    out = []
    for t in range(TABLES):
        side = [sum(a * b for a, b in zip(p, vec)) for p in V.hyperplanes(DIM, PLANES, V.SEED + t)]
        size = [sum(x * x for x in p) ** 0.5 for p in V.hyperplanes(DIM, PLANES, V.SEED + t)]
        own = sum(1 << i for i, s in enumerate(side) if s >= 0)
        near = sorted(range(PLANES), key=lambda i: abs(side[i]) / size[i])[:probes]
        out += [(t, s) for s in [own, *(own ^ 1 << i for i in near)]]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, DIM))
    near = base[rng.integers(0, 40, 120)] + 0.4 * rng.normal(size=(120, DIM))
    return [*base, *near, base[0], base[0], np.zeros(DIM)]


@pytest.mark.parametrize("probes", [0, 2, PLANES])
def test_buckets_of_all_tables(spark, vectors, probes):
    got = frame(spark, vectors).select("id", V.lsh_buckets(F.col("vec"), DIM, PLANES, TABLES, probes).alias("b")).collect()
    for r in got:
        if any(vectors[r.id]):
            assert [(b >> PLANES, b % (1 << PLANES)) for b in r.b] == buckets(vectors[r.id], probes)


def test_first_table_is_the_single_index(spark, vectors):
    rows = frame(spark, vectors)
    one = {(r.id, r.signature) for r in C.build_index(rows, DIM, PLANES).collect()}
    many = C.build_index(rows, DIM, PLANES, TABLES).collect()
    assert {(r.id, r.signature) for r in many if r.table == 0} == one
    assert len(many) == TABLES * len(vectors)
    assert C.build_index(rows.limit(0), DIM, PLANES, TABLES).count() == 0


def test_candidates_meet_in_some_table_and_come_once(spark, vectors):
    groups = C.distinct_vectors(frame(spark, vectors))
    ids = {r.gid: (r.tenant, buckets(r.vec, 2), set(buckets(r.vec, 0)), np.array(r.vec)) for r in groups.collect() if any(r.vec)}
    want = {(a, b) for a, (ta, looked, _, _) in ids.items() for b, (tb, _, own, _) in ids.items() if ta == tb and own & set(looked)}
    got = C.bucket_candidates(groups.filter("norm > 0"), groups.filter("norm > 0"), DIM, PLANES, TABLES, 2).collect()
    assert len(got) == len(want) and {(r.qid, r.eid) for r in got} == want
    for r in got:
        a, b = ids[r.qid][3], ids[r.eid][3]
        assert r.similarity == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_more_tables_find_more(spark, vectors):
    rows = frame(spark, vectors)
    found = [C.lsh_recall(rows, 0.8, DIM, PLANES, t, 2).agg(F.sum("found")).first()[0] for t in (1, 3, 8)]
    pairs = C.lsh_recall(rows, 0.8, DIM, PLANES).agg(F.sum("true_pairs")).first()[0]
    assert found[0] < found[1] <= found[2] <= pairs and found[2] >= 0.9 * pairs


def test_planes_have_bounds(spark, vectors):
    with pytest.raises(ValueError, match="planes"):
        V.lsh_buckets(F.col("vec"), DIM, 31)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path)
            for f in names if f.endswith(".parquet")}


def test_eviction_keeps_the_files_of_other_days(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.sql("select id, cast('2024-01-01' as timestamp_ntz) + make_dt_interval(cast(id div 4 as int), cast(id % 4 * 6 as int))"
                     " as expires_at from range(20) union all select 99, cast(null as timestamp_ntz)")
    C.write_store(rows, path)
    before = files(path)
    assert C.evict_store(spark, path, at("2024-01-03 06:00:00"), rows.schema) == {"removed": 10, "dropped": 2, "rewritten": 1}
    after = files(path)
    untouched = {f: t for f, t in before.items() if not any(f"expires_on=2024-01-0{d}" in f for d in (1, 2, 3))}
    assert len(untouched) >= 3 and untouched.items() <= after.items()
    assert not os.path.exists(f"{path}/expires_on=2024-01-01") and not os.path.exists(f"{path}/expires_on=2024-01-02")
    assert sorted(r.id for r in C.read_store(spark, path, schema=rows.schema).collect()) == [*range(10, 20), 99]
    # a second run finds nothing to do
    assert C.evict_store(spark, path, at("2024-01-03 06:00:00"), rows.schema) == {"removed": 0, "dropped": 0, "rewritten": 0}
    assert files(path) == after
    # the rest of the day goes with its folder, and a store may become empty
    assert C.evict_store(spark, path, at("2024-01-09 00:00:00"), rows.schema) == {"removed": 10, "dropped": 3, "rewritten": 0}
    assert [r.id for r in C.read_store(spark, path, schema=rows.schema).collect()] == [99]


SECOND = 1_000_000


@pytest.mark.parametrize("cooldown", [3, 10])
def test_dispatch_by_open_breakers(spark, cooldown):
    rng = random.Random(cooldown)
    providers = sorted({p for _, p, _, _ in dims.PRICING})
    opened = {p: [] for p in providers}
    for p in providers:
        now = rng.randrange(5)
        while now < 300:
            opened[p].append(now)
            now += cooldown + rng.randrange(8)
    stamp = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    log = spark.createDataFrame([(p, stamp(s).to_pydatetime()) for p in providers for s in opened[p]], "provider string, opened_at timestamp_ntz")
    routes = [(p, c) for _, p, c in dims.ALIASES] + [(m, []) for m, *_ in dims.PRICING] + [(None, None)]
    asked = [(i, rng.randrange(-20, 330), *rng.choice(routes)) for i in range(600)] + [(600, None, *routes[0])]
    requests = spark.createDataFrame(
        [(i, None if s is None else stamp(s).to_pydatetime(), p, c, "kept") for i, s, p, c in asked],
        "request_id bigint, ts timestamp_ntz, primary_model string, chain array<string>, opened_at string")
    got = {r.request_id: r for r in G.route_around_breakers(
        requests, dims.load_aliases(spark), dims.load_pricing(spark), log, "ts", "request_id", cooldown * SECOND).collect()}
    assert len(got) == len(asked)
    provider = {m: p for m, p, *_ in dims.PRICING}
    for i, s, primary, chain in asked:
        full = [primary, *chain] if primary else []
        up = [m for m in full if s is None or not any(o <= s < o + cooldown for o in opened[provider[m]])]
        r = got[i]
        assert (r.served_model, r.served_provider) == ((up[0], provider[up[0]]) if up else (None, None))
        assert r.fallback_used == (full.index(up[0]) > 0 if up else None) and r.opened_at == "kept"
        assert r.dispatch_error == ("ALL_PROVIDERS_EXHAUSTED" if full and not up else None)
    quiet = G.route_around_breakers(requests, dims.load_aliases(spark), dims.load_pricing(spark), log.limit(0), "ts", "request_id")
    assert quiet.filter("primary_model is not null and served_model <> primary_model").count() == 0


def test_openings_of_a_replay(spark):
    rows = spark.createDataFrame([("a", 1, True, "CLOSED"), ("a", 2, True, "OPEN"), ("a", 3, False, "OPEN"), ("a", 9, True, "OPEN"), ("b", 1, True, "CLOSED")],
                                 "k string, ts int, allowed boolean, state_after string")
    assert {tuple(r) for r in G.breaker_openings(rows, "k", "ts").collect()} == {("a", 2), ("a", 9)}


def test_another_embedder(spark):
    rows = spark.createDataFrame([(1, "a bb BB " + "x" * 40), (2, ""), (3, None)], "id bigint, prompt string")
    got = {r.id: list(r.vec) for r in C.embed_prompts(rows, V.word_lengths).collect()}
    assert got == {1: [1.0, 2.0, *[0.0] * 13, 1.0], 2: [0.0] * 16, 3: [0.0] * 16}


def brute(vectors, looked, threshold, ordered=False):
    """(query, entry, similarity, whether a bucket is shared) of the pairs that reach the threshold, copies by smallest id."""
    first = {}
    for i, v in enumerate(vectors):
        first.setdefault((i % 2, tuple(v)), i)
    names = list(first.values())
    for a in names:
        for b in names:
            size = np.sqrt((vectors[a] @ vectors[a]) * (vectors[b] @ vectors[b]))
            sim = vectors[a] @ vectors[b] / size if size else 0.0
            if a % 2 == b % 2 and sim >= threshold and (a < b or not ordered):
                yield a, b, sim, bool(set(buckets(vectors[a], looked)) & set(buckets(vectors[b], 0)))


@pytest.fixture
def small_blocks(monkeypatch):
    """Scopes of many blocks and blocks of many tiles; buckets may not pair rows."""
    monkeypatch.setattr(C.split_blocks, "__defaults__", (7,))
    monkeypatch.setattr(C, "TILE", (3, 5))
    monkeypatch.setattr(C, "bucket_candidates", None)


@pytest.mark.parametrize("probes", [0, 2, None])
@pytest.mark.parametrize("mode", ["lsh", "lsh_then_exact", "exact"])
def test_best_of_each_query_leaves_a_block_without_pairs(spark, vectors, small_blocks, mode, probes):
    rows, best = frame(spark, vectors), {}
    for a, b, sim, near in brute(vectors, PLANES if probes is None else probes, 0.5):
        if mode == "exact" or near or mode == "lsh_then_exact":
            best[a] = max(best.get(a, (0,)), (mode == "exact" or near, round(sim, 9), -b))
    got = C.best_match(rows, rows, 0.5, DIM, mode, None, PLANES, TABLES, probes).collect()
    names = {i: min(j for j, w in enumerate(vectors) if j % 2 == i % 2 and (w == v).all()) for i, v in enumerate(vectors)}
    assert {r.id: (round(r.similarity, 9), r.match_id) for r in got} == {
        i: (best[n][1], -best[n][2]) for i, n in names.items() if n in best}


@pytest.mark.parametrize("probes", [0, 2, None])
def test_recall_is_counted_inside_blocks(spark, vectors, small_blocks, probes):
    want = list(brute(vectors, PLANES if probes is None else probes, 0.3, ordered=True))
    got = C.lsh_recall(frame(spark, vectors), 0.3, DIM, PLANES, TABLES, probes).collect()
    for r in got:
        near = [n for a, _, _, n in want if f"t{a % 2}" == r.tenant]
        assert (r.true_pairs, r.found, r.recall) == (len(near), sum(near), sum(near) / len(near))
    assert len(got) == 2
