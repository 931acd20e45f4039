"""The stateful part of the request path in one pass over ordered events: cache, budget and open reservations together.

An admitted request is two events: it arrives, and later completes. An arrival looks in the cache (unless it streams); a hit
ends there. Otherwise its estimate is reserved if the key's spend leaves room, or it is refused. A completion of a reserved
request settles the spend to the actual cost, or takes the reservation back where no model served, and stores the prompt
under the model that served. So a refused request stores nothing, and a stored prompt is found only after its completion.

Which requests are refused depends on the cache and the other way round, so a tenant's events are one ordered fold, over as
many partitions as they fill (see scan.py; boundaries of a tenant are settled one partition after another). A tenant whose
keys could pay for every request, hits included, cannot refuse any: its events fall apart into independent parts, one for each
group of prompts that similarity connects, and those are folded side by side.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.clock import epoch_us
from trafficlens.operators.cache import SCOPE, components, distinct_vectors, exact_pairs, with_group
from trafficlens.operators.scan import Fold, Rows, ordered_scan
from trafficlens.operators.skew import lookup_join

NEAR = "array<struct<entry:bigint,similarity:double>>"


class PathFold(Fold):
    """State: spend of each key, reservations that are open, and the latest store of each vector that is still live.

    Of several live entries the most similar one answers, then the smallest id; of one vector's entries the latest."""

    columns = ["us", "step", "request_id", "key_id", "estimate", "settled", "budget", "looks_up", "near", "near_similarity", "entry"]
    output = {"match_id": ("bigint", pa.int64()), "admitted": ("boolean", pa.bool_()), "spend_micro": ("bigint", pa.int64())}

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def start(self):
        return {}, frozenset(), {}

    def run(self, state, rows: Rows):
        spend, open_, live = dict(state[0]), set(state[1]), dict(state[2])
        match, admitted, after = [], [], []
        now = None
        for now, step, request, key, estimate, settled, budget, looks_up, ids, sims, entry in zip(
                *(rows[c].tolist() for c in self.columns[:8]), rows["near"], rows["near_similarity"], rows["entry"].tolist()):
            found = fits = None
            if step:
                if request in open_:
                    open_.remove(request)
                    spend[key] += settled - estimate
                    if entry >= 0:
                        live[entry] = now, request
            else:
                if looks_up:
                    for other, sim in zip(ids.tolist(), sims.tolist()):
                        stored = live.get(other)
                        if stored and stored[0] + self.ttl >= now and (found is None or (-sim, stored[1]) < found):
                            found = -sim, stored[1]
                if found is None:
                    fits = spend.get(key, 0) + estimate <= budget
                    if fits:
                        spend[key] = spend.get(key, 0) + estimate
                        open_.add(request)
            match.append(found and found[1])
            admitted.append(fits)
            after.append(spend.get(key, 0))
        if now is not None:
            live = {g: v for g, v in live.items() if v[0] + self.ttl >= now}
        return {"match_id": match, "admitted": admitted, "spend_micro": after}, (spend, frozenset(open_), live)


def _groups(requests: DataFrame, prompts: DataFrame | None, threshold: float, dim: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What lookups of a prompt ask (tenant, primary_model, prompt, asked, near), where stores of it go (tenant,
    served_model, prompt, entry), and all links between groups of either kind.

    A prompt is its prompt_id, or its vector where there are no ``prompts``. Requests merge into different prompts of a scope
    before anything is shuffled; only these meet their vectors."""
    key = "vec" if prompts is None else "prompt_id"

    def grouped(rows: DataFrame, model: str):
        seen = rows.select(F.col("request_id").alias("id"), "tenant", F.col(model).alias("model"), key)
        seen = seen.groupBy(*SCOPE, key).agg(F.min("id").alias("id"))
        known = (seen if prompts is None else seen.join(prompts, key)).checkpoint()
        return distinct_vectors(known), known

    q_groups, lookups = grouped(requests.filter("looks_up"), "primary_model")
    s_groups, stores = grouped(requests.filter("served_model is not null"), "served_model")
    pairs = exact_pairs(q_groups, s_groups, threshold, dim).checkpoint()
    near = pairs.groupBy(F.col("qid").alias("gid")).agg(F.collect_list(F.struct(F.col("eid").alias("entry"), "similarity")).alias("near"))
    # a group without a store near it keeps an empty list; lists grow with distinct similar prompts, not with copies
    known = q_groups.join(near, "gid", "left").select("gid", *SCOPE, "vec", F.coalesce("near", F.array().cast(NEAR)).alias("near"))
    asked = with_group(lookups, known, "near").select(
        "tenant", F.col("model").alias("primary_model"), key, F.col("gid").alias("asked"), "near")
    entries = with_group(stores, s_groups).select(
        "tenant", F.col("model").alias("served_model"), key, F.col("gid").alias("entry"))
    return asked, entries, pairs


def _parts(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """events with `part`, the key of the fold. Groups of lookups are even nodes, groups of stores odd ones."""
    ask, keep = F.col("asked") * 2, F.col("entry") * 2 + 1
    # a request that asks in one scope and stores in another one ties the two
    own = events.filter("asked is not null and entry >= 0").select(ask.alias("qid"), keep.alias("eid")).distinct()
    links = pairs.select((F.col("qid") * 2).alias("qid"), (F.col("eid") * 2 + 1).alias("eid")).unionByName(own).distinct()
    node = F.coalesce(ask, F.when(F.col("entry") >= 0, keep), F.lit(-1).cast("bigint"))
    placed = lookup_join(events.withColumn("gid", node), components(links), ["gid"], "request_id", "left")
    most = F.sum(F.greatest("estimate", "settled"))
    tight = events.groupBy("tenant", "key_id").agg(most.alias("most"), F.min("budget").alias("budget")).filter("most > budget")
    marked = lookup_join(placed, tight.select("tenant", F.lit(True).alias("tight")).distinct(), ["tenant"], "request_id", "left")
    part = F.when(F.col("tight"), F.lit(None)).otherwise(F.coalesce("component", "gid"))
    # requests that neither ask nor store share no state in a tenant that refuses none
    return marked.withColumn("part", F.to_json(F.struct("tenant", part.alias("p")))).drop("gid", "component", "tight")


def gateway_pass(requests: DataFrame, threshold: float, dim: int, ttl_seconds: int, partitions: int | None = None,
                 prompts: DataFrame | None = None) -> DataFrame:
    """match_id (the entry that answered), admitted (null on hits) and spend_micro for each request.

    Needs request_id, ts, tenant, key_id, primary_model, served_model (null: no model served), vec (or prompt_id, with
    ``prompts`` as prompt_id and vec), looks_up, latency_ms, and micro amounts estimate, settled (what it really cost, 0 if nothing served) and budget. Other columns are kept. At one
    instant arrivals come before completions, then the smaller id."""
    asked, entries, pairs = _groups(requests, prompts, threshold, dim)
    key = "vec" if prompts is None else "prompt_id"
    placed = lookup_join(requests, asked, ["tenant", "primary_model", key], "request_id", "left")
    placed = lookup_join(placed, entries, ["tenant", "served_model", key], "request_id", "left")
    events = placed.drop(key).withColumns({
        "asked": F.when(F.col("looks_up"), F.col("asked")), "near": F.when(F.col("looks_up"), F.col("near")),
        "entry": F.coalesce("entry", F.lit(-1).cast("bigint")), "us": epoch_us(F.col("ts"))}).checkpoint()
    keyed = _parts(events, pairs).withColumns({
        "near_similarity": F.coalesce(F.col("near.similarity"), F.array().cast("array<double>")),
        "near": F.coalesce(F.col("near.entry"), F.array().cast("array<bigint>"))})
    nothing = {"near": F.slice("near", 1, 0), "near_similarity": F.slice("near_similarity", 1, 0), "looks_up": F.lit(False)}
    done = keyed.withColumns(nothing | {"us": F.col("us") + F.coalesce("latency_ms", F.lit(0)) * 1000, "step": F.lit(1)})
    both = keyed.withColumn("step", F.lit(0)).unionByName(done)
    scanned = ordered_scan(both, "part", ["us", "step", "request_id"], PathFold(ttl_seconds * 1_000_000), partitions)
    return scanned.filter("step = 0").drop("step", "us", "near", "near_similarity", "asked", "entry", "part")
