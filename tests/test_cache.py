"""Semantic cache: golden rows, exact joins and replay against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlens.functions import vectors as V
from trafficlens.operators import cache as C
from trafficlens.operators import skew


def java_hash(token):
    h = 0
    for ch in token:
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    return h


def plain_embed(text):
    import re
    vec = [0.0] * 128
    for token in re.findall("[a-z0-9]+", text.lower()):
        h = java_hash(token)
        vec[h % 128] += 4
        vec[((h * 31 + len(token)) & 0xFFFFFFFF) % 128] += 1
    return vec


def plain_cosine(a, b):
    dot = sum(x * y for x, y in zip(a, b))
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return dot / size if size else 0.0


TEXTS = ["What is the capital city of France?", "", "!!!", "Ünïcode café 12ab", "a" * 300, "x y z " * 50,
         "Can you tell me the capital city of France"]


def test_embedding_equals_token_by_token(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, t string")
    got = {r.id: r.v for r in df.select("id", V.embed(F.col("t")).alias("v")).collect()}
    assert {i: list(v) for i, v in got.items()} == {i: plain_embed(t) for i, t in enumerate(TEXTS)}


def rows(spark, entries):
    df = spark.createDataFrame(entries, "id bigint, tenant string, model string, prompt string, exp string")
    return C.embed_prompts(df).withColumns({
        "expires_at": F.col("exp").cast("timestamp_ntz"), "content": F.lit("Paris"),
        "prompt_tokens": F.lit(9), "completion_tokens": F.lit(1)})


@pytest.mark.parametrize("query,tenant,threshold,now,hit,similarity", [
    ("Can you tell me the capital city of France", "team-alpha", 0.6, "2024-01-01 00:30:00", True, 0.700786),
    ("Write a Python function to reverse a linked list", "team-alpha", 0.92, "2024-01-01 00:30:00", False, 0.0),
    ("What is the capital city of France?", "team-beta", 0.5, "2024-01-01 00:30:00", False, 0.0),
    ("What is the capital city of France?", "team-alpha", 0.5, "2024-01-01 01:00:01", False, 0.0),
    ("What is the capital city of France?", "team-alpha", 0.5, "2024-01-01 01:00:00", True, 1.0),
])
def test_golden_lookups(spark, query, tenant, threshold, now, hit, similarity):
    entries = rows(spark, [(1, "team-alpha", "m", "What is the capital city of France?", "2024-01-01 01:00:00")])
    asked = rows(spark, [(7, tenant, "m", query, "2024-01-01 00:00:00")])
    for mode in ("exact", "lsh_then_exact"):
        got = C.cache_lookup(asked, entries, threshold, mode=mode, now=F.lit(now).cast("timestamp_ntz")).first()
        assert (got.hit, got.similarity) == (hit, similarity)
        assert (got.content == "Paris") == hit


def words(seed, n, copies=0.3):
    rnd = random.Random(seed)
    bag = "red blue green cat dog runs jumps over under the a lazy quick".split()
    out = []
    for i in range(n):
        text = "red cat runs" if rnd.random() < copies else " ".join(rnd.choices(bag, k=rnd.randrange(1, 7)))
        out.append((i, f"t{rnd.randrange(2)}", "m", text))
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.93])
def test_pairs_equal_brute_force(spark, threshold):
    data = words(3, 120)
    df = C.embed_prompts(spark.createDataFrame(data, "id bigint, tenant string, model string, prompt string"))
    got = C.similar_prompt_pairs(df, threshold, 128)
    total = got.agg(F.sum("row_pairs")).first()[0]
    vec = {i: plain_embed(p) for i, _, _, p in data}
    expected = sum(1 for a in data for b in data if a[0] < b[0] and a[1] == b[1]
                   and plain_cosine(vec[a[0]], vec[b[0]]) >= threshold)
    assert total == expected


def test_pairs_do_not_depend_on_block_size(spark, monkeypatch):
    df = C.embed_prompts(spark.createDataFrame(words(9, 90), "id bigint, tenant string, model string, prompt string"))
    whole = sorted(map(tuple, C.similar_prompt_pairs(df, 0.6, 128).collect()))
    monkeypatch.setattr(skew.split_blocks, "__defaults__", (7,))
    monkeypatch.setattr(skew.split_join, "__defaults__", (7,))
    monkeypatch.setattr(skew.lookup_join, "__defaults__", ("inner", 7))
    assert sorted(map(tuple, C.similar_prompt_pairs(df, 0.6, 128).collect())) == whole


def test_hit_flag_is_the_same_in_exact_and_two_step_mode(spark):
    make = lambda seed: C.embed_prompts(spark.createDataFrame(
        words(seed, 80, 0.1), "id bigint, tenant string, model string, prompt string"))
    q, e = make(1), make(2)
    hits = {m: {r.id for r in C.best_match(q, e, 0.9, 128, mode=m).collect()} for m in ("exact", "lsh", "lsh_then_exact")}
    assert hits["exact"] == hits["lsh_then_exact"] >= hits["lsh"]


def plain_replay(data, threshold, ttl_us):
    vec, stored, out = {r[0]: plain_embed(r[3]) for r in data}, [], {}
    for i, tenant, _, _, us in sorted(data, key=lambda r: (r[4], r[0])):
        live = [s for s in stored if s[1] == tenant and (ttl_us is None or s[2] + ttl_us >= us)]
        hit = any(plain_cosine(vec[i], vec[s[0]]) >= threshold for s in live)
        out[i] = hit
        if not hit:
            stored.append((i, tenant, us))
    return out


@pytest.mark.parametrize("ttl,copies", [(None, 0.3), (40, 0.3), (40, 1.0), (7, 0.9)])
def test_replay_equals_plain_replay(spark, ttl, copies):
    rnd, at, data = random.Random(4), 0, []
    for row in words(11, 160, copies):
        at += rnd.choice([0, 1, 2, 9]) * 1_000_000
        data.append((*row, at))
    df = spark.createDataFrame(data, "id bigint, tenant string, model string, prompt string, us bigint")
    df = C.embed_prompts(df.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")))
    expected = plain_replay(data, 0.75, None if ttl is None else ttl * 1_000_000)
    for parts in (1, 9):
        got = C.cache_replay(df, 0.75, 128, ttl, partitions=parts)
        assert {r.id: r.hit for r in got.collect()} == expected


def test_another_embedder_can_be_plugged_in(spark):
    flat = lambda text: F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))
    df = spark.createDataFrame([(1, "t", "m", "abc"), (2, "t", "m", "abcd")], "id bigint, tenant string, model string, prompt string")
    pairs = C.similar_prompt_pairs(C.embed_prompts(df, flat), 0.9, 2).collect()
    assert len(pairs) == 1 and pairs[0].similarity > 0.99


def test_import_vectors_strict_raises(spark):
    df = spark.createDataFrame([(1, "1.0,2.0"), (2, "1.0,x")], "id bigint, embedding string")
    good, bad = C.import_vectors(df, 2)
    assert [r.id for r in good.collect()] == [1] and [r.id for r in bad.collect()] == [2]
    with pytest.raises(Exception, match="bad vector in row 2"):
        C.import_vectors(df, 2, strict=True)[0].collect()


def test_hot_keys_are_split_without_changing_a_join(spark):
    left = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"))
    right = spark.range(100).select(F.col("id").alias("r"), (F.col("id") % 9).alias("k"))
    plain = sorted(map(tuple, left.join(right, "k").select("id", "r").collect()))
    assert sorted(map(tuple, skew.split_join(left, right, ["k"], "id", "r", 5).select("id", "r").collect())) == plain
    unique = right.filter("r < 5")
    for how in ("inner", "left"):
        plain = sorted(map(str, left.join(unique, "k", how).select("id", "r").collect()))
        got = skew.lookup_join(left, unique, ["k"], "id", how, 5).select("id", "r")
        assert sorted(map(str, got.collect())) == plain
        assert got.count() == len(plain)


def test_hot_null_keys_survive_a_left_lookup(spark):
    left = spark.range(50).select("id", F.lit(None).cast("bigint").alias("k"))
    right = spark.range(3).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert skew.lookup_join(left, right, ["k"], "id", "left", 5).count() == 50


def test_reading_live_entries_skips_expired_folders(spark, tmp_path):
    from trafficlens.functions.clock import at
    from trafficlens.operators import cache as C

    rows = spark.sql("select id, cast('2024-01-01' as timestamp_ntz) + make_dt_interval(cast(id as int)) as expires_at from range(6)")
    C.write_store(rows, str(tmp_path / "store"))
    now = at("2024-01-03 00:00:00")
    live = C.live_entries(C.read_store(spark, str(tmp_path / "store"), now), now)
    assert sorted(r.id for r in live.collect()) == [3, 4, 5]
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(expires_on" in plan


@pytest.mark.parametrize("ttl", [None, 40])
def test_replay_pairs_no_whole_scopes(spark, monkeypatch, ttl):
    """Small blocks, tiles and rounds; a replay may not list all similar pairs of a scope."""
    monkeypatch.setattr(skew.split_blocks, "__defaults__", (7,))
    monkeypatch.setattr(C, "TILE", (3, 5))
    monkeypatch.setattr(C, "SETTLE", 11)
    monkeypatch.setattr(C, "exact_pairs", None)
    rnd, at, data = random.Random(5), 0, []
    for row in words(12, 150, 0.4):
        at += rnd.choice([0, 1, 2, 9]) * 1_000_000
        data.append((*row, at))
    df = spark.createDataFrame(data, "id bigint, tenant string, model string, prompt string, us bigint")
    df = C.embed_prompts(df.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")))
    vec = {r[0]: plain_embed(r[3]) for r in data}
    expected = plain_replay(data, 0.75, ttl and ttl * 1_000_000)
    by_id = {r[0]: r for r in data}
    got = {r.id: r for r in C.cache_replay(df, 0.75, 128, ttl, partitions=4).collect()}
    assert {i: r.hit for i, r in got.items()} == expected
    for i, r in got.items():
        past = [s for s, hit in expected.items() if not hit and by_id[s][1] == by_id[i][1] and (by_id[s][4], s) < (by_id[i][4], i)
                and (ttl is None or by_id[s][4] + ttl * 1_000_000 >= by_id[i][4])]
        near = sorted((-round(plain_cosine(vec[i], vec[s]), 9), s) for s in past if plain_cosine(vec[i], vec[s]) >= 0.75)
        assert r.match_id == (near[0][1] if near else None)
        assert r.similarity == pytest.approx(-near[0][0] if near else 0.0, abs=1e-6)


@pytest.mark.parametrize("threshold", [0.5, 0.93, 0.99])
def test_self_pairs_meet_once_in_a_triangle_of_blocks(spark, monkeypatch, threshold):
    """Small blocks and tiles, many leading directions left out: the pairs are those of brute force, named by the smaller id."""
    monkeypatch.setattr(skew.triangle_blocks, "__defaults__", (7,))
    monkeypatch.setattr(C, "TILE", (3, 5))
    monkeypatch.setattr(C, "HEAD", 3)
    monkeypatch.setattr(C, "SETTLE", 4)
    rnd = random.Random(8)
    data = [(i, "t" if i % 3 else None, "m", [float(5 + rnd.randrange(3)) for _ in range(6)]) for i in range(150)] + [
        (150, "t", "m", [0.0] * 6)]
    df = spark.createDataFrame(data, "id bigint, tenant string, model string, vec array<double>")
    got = {(r.left_id, r.right_id): r for r in C.similar_prompt_pairs(df, threshold, 6).collect() if r.left_id != r.right_id}
    first, copies = {}, {}
    for i, tenant, _, v in data:
        gid = first.setdefault((tenant, tuple(v)), i)
        copies[gid] = copies.get(gid, 0) + 1
    unit = np.array([v for *_, v in data])
    unit /= np.maximum(np.linalg.norm(unit, axis=1), 1e-300)[:, None]
    sim = unit @ unit.T
    expected = {(a, b) for a in copies for b in copies if a < b and data[a][1] == data[b][1] and sim[a, b] >= threshold}
    assert set(got) == expected and len(expected) > 20
    assert all(r.row_pairs == copies[a] * copies[b] and r.tenant == data[a][1] for (a, b), r in got.items())


def test_pair_joins_shuffle_no_pair(spark):
    """Scope and copies come from the blocks, so a pair is never joined back; a vector goes once to each block of its scope."""
    df = C.embed_prompts(spark.createDataFrame(words(9, 90), "id bigint, tenant string, model string, prompt string"))
    for joined in (C.similar_prompt_pairs(df, 0.6, 128), C.scoped_cosine_join(df, df, 0.6, 128)):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "Join" not in plan
    placed, on = skew.triangle_blocks(spark.range(60).withColumn("k", F.lit(1)), ["k"], "id", 10)
    assert placed.count() == 60 * 6 and on == ["k", "_l", "_r"]
