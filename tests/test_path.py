"""The request path in one pass: a plain replay of the rules, any number of partitions, and what users of the gateway see."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlens.operators.path import gateway_pass

TTL = 600
START = datetime.datetime(2024, 1, 1)


def cosine(a, b):
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(np.dot(a, b)) / n if n else 0.0


def brute(rows, threshold):
    """Event after event over all requests; a row is (id, ms, tenant, key, primary, served, vec, looks_up, latency, estimate, settled, budget)."""
    events = sorted([(r[1], 0, r[0], r) for r in rows] + [(r[1] + r[8], 1, r[0], r) for r in rows], key=lambda e: e[:3])
    spend, open_, live, out = {}, set(), {}, {}
    for now, step, request, (_, _, tenant, key, primary, served, vec, looks_up, _, estimate, settled, budget) in events:
        if step:
            if request in open_:
                open_.remove(request)
                spend[key] += settled - estimate
                if served:
                    live[tenant, served, vec] = now, request
            continue
        hits = [(-cosine(vec, v), i) for (t, m, v), (at, i) in live.items()
                if looks_up and (t, m) == (tenant, primary) and at + TTL * 1000 >= now and cosine(vec, v) >= threshold]
        if hits:
            out[request] = min(hits)[1], None
        else:
            fits = spend.get(key, 0) + estimate <= budget
            out[request] = None, fits
            if fits:
                spend[key] = spend.get(key, 0) + estimate
                open_.add(request)
    return out


def traffic(seed, n=400):
    pick = random.Random(seed)
    vecs = [tuple(float(pick.choice([0, 0, 1, 2])) for _ in range(8)) for _ in range(9)]
    rows = []
    for k in range(n):
        tenant = pick.choice(["a", "a", "a", "b", "c"])
        key = {"a": 1, "b": 2, "c": 3}[tenant] if pick.random() < 0.9 else 4
        rows.append((k, pick.randrange(n * 4000), tenant, key, pick.choice("xy"), pick.choice(["x", "y", "y", None]), pick.choice(vecs),
                     pick.random() < 0.7, pick.choice([0, 500, 90_000]), pick.randrange(1, 50), 0, {1: 300, 2: 10**9, 3: 60, 4: 10**9}[key]))
    return [(*r[:10], pick.randrange(60) if r[5] else 0, r[11]) for r in rows]


def frame(spark, rows):
    flat = [(r[0], START + datetime.timedelta(milliseconds=r[1]), *r[2:6], list(r[6]), *r[7:], "kept") for r in rows]
    return spark.createDataFrame(flat, "request_id bigint, ts timestamp_ntz, tenant string, key_id bigint, primary_model string, served_model string, "
                                 "vec array<double>, looks_up boolean, latency_ms bigint, estimate bigint, settled bigint, budget bigint, note string")


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_pass_against_a_plain_replay(spark, partitions):
    rows = traffic(partitions)
    got = gateway_pass(frame(spark, rows), 0.8, 8, TTL, partitions).collect()
    assert {r["request_id"]: (r["match_id"], r["admitted"]) for r in got} == brute(rows, 0.8)
    assert len(got) == len(rows) and {r["note"] for r in got} == {"kept"}
    answers = list(brute(rows, 0.8).values())
    assert any(m is not None for m, _ in answers) and any(ok is False for _, ok in answers)


def test_spend_is_settled_and_taken_back(spark):
    """Estimates of 60 under a budget of 100: the second fits only after the first has cost 10, the fourth after a refund."""
    def row(k, second, served, settled):
        return k, second * 1000, "t", 1, "m", served, (float(k == i) for i in range(8)), True, 1500, 60, settled, 100

    rows = [(*r[:6], tuple(r[6]), *r[7:]) for r in [row(0, 0, "m", 10), row(1, 1, "m", 60), row(2, 2, None, 0), row(3, 3, "m", 5), row(4, 4, "m", 5), row(5, 5, "m", 5)]]
    got = {r["request_id"]: r["admitted"] for r in gateway_pass(frame(spark, rows), 0.8, 8, TTL).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 5: False} == {k: ok for k, (_, ok) in brute(rows, 0.8).items()}


def test_a_repeated_prompt_hits_once_it_is_stored(spark):
    vec = (1.0,) + (0.0,) * 7
    rows = [(k, at, "t", 1, "m", "m", vec, True, 1000, 1, 1, budget) for k, at, budget in [(0, 0, 5), (1, 500, 5), (2, 1500, 5), (3, 3000, 0)]]
    got = {r["request_id"]: (r["match_id"], r["admitted"]) for r in gateway_pass(frame(spark, rows), 0.8, 8, TTL).collect()}
    # not yet at half a second; then the latest store answers, also for a key that could pay for nothing
    assert got == {0: (None, True), 1: (None, True), 2: (1, None) if got[2][0] == 1 else (0, None), 3: (1, None)} and got == brute(rows, 0.8)


def test_refused_requests_store_nothing(spark):
    vec = (1.0,) + (0.0,) * 7
    rows = [(0, 0, "t", 1, "m", "m", vec, False, 10, 9, 9, 5), (1, 1000, "t", 1, "m", "m", vec, True, 10, 3, 3, 5), (2, 2000, "t", 1, "m", "m", vec, True, 10, 3, 3, 5)]
    got = {r["request_id"]: (r["match_id"], r["admitted"]) for r in gateway_pass(frame(spark, rows), 0.8, 8, TTL).collect()}
    assert got == {0: (None, False), 1: (None, True), 2: (1, None)}


def test_empty(spark):
    assert gateway_pass(frame(spark, traffic(1)).limit(0), 0.8, 8, TTL).collect() == []


def test_outcomes_follow_the_pass(spark):
    """At the given tables: hits name served requests of the tenant that ended before, refused ones are never named."""
    from trafficlens.plans.queries import _outcomes

    rows = {r["request_id"]: r for r in _outcomes(spark, "/root/testdata/sf0.001")[1].collect()}
    hits = [r for r in rows.values() if r["cache_hit"]]
    assert hits
    for r in hits:
        entry = rows[r["match_id"]]
        assert entry["served_model"] == r["primary_model"] and entry["tenant"] == r["tenant"]
        assert entry["ts"] + datetime.timedelta(milliseconds=entry["latency_ms"]) <= r["ts"]


def test_prompts_named_by_id_give_the_same_answers(spark):
    """Requests that carry only the id of their prompt, two ids with one vector among them."""
    rows = traffic(5)
    ids = {v: f"p{i}" for i, v in enumerate(sorted({r[6] for r in rows}))}
    named = frame(spark, rows).withColumn("prompt_id", F.concat_ws(",", F.transform("vec", lambda x: x.cast("string"))))
    named = named.withColumn("prompt_id", F.when(F.col("request_id") % 2 == 0, F.concat("prompt_id", F.lit("'"))).otherwise(F.col("prompt_id")))
    prompts = named.select("prompt_id", "vec").distinct()
    assert prompts.count() > len(ids)
    got = gateway_pass(named.drop("vec"), 0.8, 8, TTL, 3, prompts)
    assert {r["request_id"]: (r["match_id"], r["admitted"]) for r in got.collect()} == brute(rows, 0.8)


def test_each_text_is_embedded_once(spark):
    """No vector travels with a request: facts name their prompts, and only different texts that reach the cache are embedded."""
    from trafficlens.plans import outcome
    from trafficlens.sources import dims, fixtures

    requests = fixtures.requests(spark, "/root/testdata/sf0.001")
    facts, prompts = outcome.request_facts(requests, dims.load_keys(spark), dims.load_aliases(spark), dims.load_pricing(spark))
    assert not {"vec", "messages", "_text"} & set(facts.columns)
    named = facts.filter("prompt_id is not null").select("prompt_id")
    assert prompts.count() == named.distinct().count() <= len(fixtures.LABELLED_PROMPTS) < named.count()
    assert prompts.join(named.distinct(), "prompt_id").count() == prompts.count()
    reaches = F.coalesce("auth_error", "body_error", "allow_error", "route_error").isNull()
    assert facts.filter(reaches != F.col("prompt_id").isNotNull()).count() == 0


def _counted(spark, rows):
    """The rows, and how many of them have been read."""
    read = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch
    return rows.mapInArrow(pass_on, rows.schema), read


def test_requests_and_outcomes_are_read_a_fixed_number_of_times(spark):
    """Once for what reaches the pass and once for what was refused; metering reads the outcomes once."""
    from trafficlens.plans import outcome
    from trafficlens.sources import dims
    from trafficlens.sources import fixtures as X

    folder = "/root/testdata/sf0.001"
    keys, aliases, pricing = dims.load_keys(spark), dims.load_aliases(spark), dims.load_pricing(spark)
    facts, prompts = outcome.request_facts(
        X.requests(spark, folder), keys, aliases, pricing, ["completion_tokens", "latency_ms"])
    facts = outcome.with_rates(facts)
    health = pricing.select("provider", F.lit(True).alias("healthy")).distinct()
    n = facts.count()
    counted, read = _counted(spark, facts)
    done = outcome.request_outcome(counted, prompts, aliases, pricing, health, ttl_seconds=30 * 86_400).checkpoint()
    assert done.count() == n and read.value == 2 * n
    counted, read = _counted(spark, done)
    stored = facts.select(F.col("request_id").alias("match_id"), F.col("prompt_tokens").alias("stored_prompt_tokens"),
                          F.col("completion_tokens").alias("stored_completion_tokens"))
    rows = outcome.meter_requests(counted, stored, pricing).collect()
    assert read.value == n and any(r.cache_hit for r in rows)
    assert all(r.prompt_tokens and r.completion_tokens for r in rows if r.cache_hit)
