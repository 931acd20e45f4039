"""Every operator as a query over the supplied tables: name -> function of (session, folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions import vectors as V
from trafficlens.functions.clock import at, minus_days, plus_seconds
from trafficlens.functions.text import estimate_message_tokens
from trafficlens.operators import admission as A
from trafficlens.operators import cache as C
from trafficlens.operators import messages as M
from trafficlens.operators import metering as B
from trafficlens.operators import reports as R
from trafficlens.operators import routing as G
from trafficlens.plans import outcome as O
from trafficlens.session import scratch_path, spread
from trafficlens.sources import dims, usage_io
from trafficlens.sources import fixtures as X
from trafficlens.streaming import jobs as S

AS_OF = "2024-01-31 00:00:00"
DAY_US = 86_400 * A.MICRO
VEC_DIM = 64

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _since():
    return minus_days(at(AS_OF), 7)


def _health(spark: SparkSession, down: str) -> DataFrame:
    return dims.load_pricing(spark).select("provider", (F.col("provider") != down).alias("healthy")).distinct()


# -- sources and sinks -------------------------------------------------------------------------------------------------

@query
def load_pricing(spark, d):
    used = X.usage(spark, d).groupBy(F.col("resolved_model").alias("model")).agg(F.count("*").alias("requests"))
    return dims.load_pricing(spark).join(used, "model").select("model", "provider", "price_in", "price_out", "requests")


@query
def load_aliases(spark, d):
    asked = X.requests(spark, d).groupBy(F.lower("model").alias("alias")).agg(F.count("*").alias("requests"))
    steps = dims.load_aliases(spark).select("alias", "primary_model", F.explode("chain").alias("fallback_model"))
    return steps.join(asked, "alias")


@query
def load_keys(spark, d):
    asked = X.requests(spark, d).groupBy("key_value", F.col("model").alias("allowed_model")).agg(
        F.count("*").alias("requests"))
    names = dims.load_keys(spark).select(
        "key_id", "key_value", "tenant", F.explode("allowed").alias("allowed_model"), "rpm", "budget")
    return names.join(asked, ["key_value", "allowed_model"]).drop("key_value")


def _faulty_wire(spark, d):
    """Wire events with missing and unreadable fields."""
    n, wire = F.col("usage_id"), F.col("wire")
    rows = usage_io.to_wire(X.usage(spark, d)).select("usage_id", "wire")
    text = F.when(n % 10 == 3, F.regexp_replace(wire, r'"costUsd":"[^"]*",', "")).when(
        n % 10 == 7, F.regexp_replace(wire, r',"createdAt":"[^"]*"', "")).otherwise(wire)
    fault = F.when(n % 97 == 0, "cost").when(n % 89 == 1, "time").when(n % 83 == 2, "json")
    broken = F.when(fault == "cost", F.regexp_replace(wire, r'"costUsd":"[^"]*"', '"costUsd":"abc"')).when(
        fault == "time", F.regexp_replace(wire, r'"createdAt":"[^"]*"', '"createdAt":"soon"')).when(
        fault == "json", F.lit('{"virtualKeyId": ')).otherwise(text)
    return rows.select("usage_id", fault.alias("fault"), broken.alias("wire"))


@query
def ingest_usage(spark, d):
    return usage_io.ingest_usage(_faulty_wire(spark, d), at(AS_OF))[0].drop("fault")


@query
def ingest_usage_quarantine(spark, d):
    return usage_io.ingest_usage(_faulty_wire(spark, d), at(AS_OF))[1].select("usage_id", "fault")


@query
def ingest_usage_stream(spark, d):
    wire = usage_io.to_wire(X.usage_of(S.read_table_stream(spark, d, "events"))).select("wire")
    local, central = S.ingest_usage_stream(usage_io.ingest_usage(wire, at(AS_OF))[0])
    sides = local.withColumn("side", F.lit("local")).unionByName(central.withColumn("side", F.lit("central")))
    return sides.groupBy("side", "virtual_key_id", "provider").agg(
        F.count("*").alias("requests"), F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"),
        F.max("created_at").alias("newest"))


@query
def seed_missing(spark, d):
    u = F.col("user_id")
    known = X.table(spark, d, "events").select("user_id").distinct()
    name = F.concat(F.lit("vk-"), u.cast("string")).alias("key_value")
    tenant = F.concat(F.lit("tenant-"), (u % 10).cast("string")).alias("tenant")
    existing = known.filter(u % 3 != 0).select(
        name, tenant, (u % 5 != 0).alias("active"), (u * 0.5).cast("decimal(18,6)").alias("spend"))
    seed = known.select(name, tenant, F.lit(True).alias("active"), F.lit(0).cast("decimal(18,6)").alias("spend"))
    return dims.seed_missing(existing, seed)


@query
def store_entries(spark, d):
    path = scratch_path(spark, "entries")
    C.store_entries(X.prompts(spark, d), path, at(AS_OF))
    vec = F.col("vec")
    return C.read_store(spark, path).select(
        "id", "tenant", "model", "created_at", "expires_at", F.size(F.filter(vec, lambda x: x != 0)).alias("slots"),
        F.aggregate(V.as_double(vec), F.lit(0.0), lambda s, x: s + x).alias("weight"),
        V.dot(vec, vec).cast("bigint").alias("norm2"))


def _total(vec):
    return F.round(F.aggregate(V.as_double(vec), F.lit(0.0), lambda s, x: s + x), 6)


@query
def import_vectors(spark, d):
    text = X.vectors(spark, d).select("id", F.when(
        F.col("id") % 100 == 0, F.concat(V.export_vector(F.col("vec")), F.lit(",1.0"))).when(
        F.col("id") % 50 == 0, F.regexp_replace(V.export_vector(F.col("vec")), "^[^,]*", "x")).otherwise(
        V.export_vector(F.col("vec"))).alias("embedding"))
    good, bad = C.import_vectors(text, VEC_DIM)
    vec = F.col("vec")
    fine = good.select("id", F.lit(True).alias("accepted"), _total(vec).alias("total"),
                       F.round(vec[0], 6).alias("first"), F.round(F.element_at(vec, -1), 6).alias("last"))
    return fine.unionByName(bad.select("id", F.lit(False).alias("accepted")), allowMissingColumns=True)


@query
def export_vectors(spark, d):
    text = X.vectors(spark, d).select("id", V.export_vector(F.col("vec")).alias("embedding"))
    vec = V.import_vector(F.col("embedding"))
    return text.select("id", F.size(vec).alias("dims"), _total(vec).alias("total"))


def _stamped(spark, d):
    return X.prompts(spark, d).withColumns({
        "created_at": F.col("ts"), "expires_at": plus_seconds(F.col("ts"), 86_400)})


@query
def live_entries(spark, d):
    path, now = scratch_path(spark, "entries"), at("2024-01-04 00:00:00")
    C.write_store(_stamped(spark, d), path)
    return C.live_entries(C.read_store(spark, path, now), now).select("id", "tenant", "created_at", "expires_at")


@query
def evict_expired(spark, d):
    path, now = scratch_path(spark, "entries"), at("2024-01-04 00:00:00")
    C.write_store(_stamped(spark, d), path)
    store = C.read_store(spark, path)
    kept, _ = C.evict_expired(store, now)
    left = scratch_path(spark, "entries-kept")
    C.write_store(kept, left)
    both = store.select("id", F.lit(1).alias("before"), F.lit(0).alias("after")).unionByName(
        C.read_store(spark, left, schema=kept.schema).select("id", F.lit(0).alias("before"), F.lit(1).alias("after")))
    return both.agg((F.sum("before") - F.sum("after")).alias("removed"), F.sum("after").alias("kept"),
                    F.min(F.when(F.col("after") == 1, F.col("id"))).alias("first_kept"))


@query
def evict_folders(spark, d):
    """What is left in a store, by day, after eviction within it."""
    path, now = scratch_path(spark, "entries"), at("2024-01-04 12:00:00")
    entries = _stamped(spark, d)
    C.write_store(entries, path)
    C.evict_store(spark, path, now, entries.schema)
    return C.read_store(spark, path, schema=entries.schema).groupBy(F.to_date("expires_at").alias("expires_on")).agg(
        F.count("*").alias("entries"), F.min("id").alias("first_id"), F.min("expires_at").alias("first_expiry"))


@query
def parse_requests(spark, d):
    parsed = usage_io.parse_requests(X.request_bodies_json(spark, d))
    last = F.get(F.col("messages"), F.size("messages") - 1)
    return parsed.select(
        "request_id", "model", F.size("messages").alias("turns"), last["role"].alias("last_role"),
        last["content"].alias("last_content"), "stream", "temperature", "temperature_or_default", "max_tokens",
        "completion_limit")


@query
def write_usage(spark, d):
    path = scratch_path(spark, "usage")
    usage_io.write_usage(X.usage(spark, d), path)
    return usage_io.read_usage(spark, path).groupBy("created_on", "virtual_key_id").agg(
        F.count("*").alias("requests"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(18,6)").alias("cost_usd"))


@query
def usage_sink(spark, d):
    """The fact table as a stream leaves it, drained twice over one log."""
    path, log = scratch_path(spark, "usage-batches"), scratch_path(spark, "usage-log")
    records = X.usage_of(S.read_table_stream(spark, d, "events"))
    for _ in range(2):
        S.usage_sink(records, path, "central", log)
    return usage_io.read_batches(spark, path).groupBy("created_on", "virtual_key_id").agg(
        F.count("*").alias("requests"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(18,6)").alias("cost_usd"))


@query
def write_usage_clustered(spark, d):
    path = scratch_path(spark, "usage-clustered")
    usage_io.write_usage_clustered(X.usage(spark, d), path)
    return usage_io.read_usage(spark, path).groupBy("created_on", "virtual_key_id", "provider").agg(
        F.count("*").alias("requests"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("decimal(18,6)").alias("cost_usd"))


@query
def read_usage_window(spark, d):
    """Three days and a half of the fact table, read from their folders."""
    path = scratch_path(spark, "usage")
    usage_io.write_usage(X.usage(spark, d), path)
    return usage_io.read_usage(spark, path, at("2024-01-10 12:00:00"), at("2024-01-14 00:00:00")).groupBy("provider").agg(
        F.count("*").alias("requests"), F.sum("latency_ms").alias("latency_ms"), F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"))


# -- projections -------------------------------------------------------------------------------------------------------

@query
def validate_requests(spark, d):
    return G.validate_requests(X.raw_bodies(spark, d)).select("request_id", "violations")


@query
def estimate_tokens(spark, d):
    return B.prompt_tokens_of(X.messages(spark, d))


@query
def price_usage(spark, d):
    mixed = X.usage(spark, d).filter(F.col("status") == "SUCCESS").select(
        "usage_id", F.when(F.col("usage_id") % 5 == 4, "m-unknown").otherwise(F.col("resolved_model")).alias("model"),
        "prompt_tokens", "completion_tokens")
    return B.price_usage(mixed, dims.load_pricing(spark), "model").select(
        "usage_id", "model", "model_provider", "total_tokens", "cost_usd", "price_error")


def _routed(spark, d):
    checked = G.check_allowlist(G.authenticate(X.requests(spark, d), dims.load_keys(spark)))
    return G.resolve_route(checked, dims.load_aliases(spark), dims.load_pricing(spark))


@query
def estimate_cost(spark, d):
    sized = _routed(spark, d).filter(F.col("primary_model").isNotNull()).withColumn(
        "prompt_tokens", estimate_message_tokens(F.col("messages")))
    return B.estimate_cost(sized, dims.load_pricing(spark)).select("request_id", "primary_model", "estimate_usd")


@query
def true_up(spark, d):
    guess = B.estimate_cost(
        X.usage(spark, d).withColumns({
            "actual": F.col("cost_usd"), "prompt_tokens": F.lit(290), "max_tokens": F.lit(50)}).drop("cost_usd"),
        dims.load_pricing(spark), "resolved_model")
    charges = guess.withColumnRenamed("actual", "cost_usd").withColumn("failed", F.col("status") != "SUCCESS")
    return B.true_up(charges).select("usage_id", "virtual_key_id", "estimate_usd", "delta_usd", "over_estimate")


@query
def render_prompt(spark, d):
    return M.render_prompt(X.messages(spark, d))


@query
def user_text(spark, d):
    return M.user_text(X.messages(spark, d))


@query
def difficulty_features(spark, d):
    return M.score_prompts(spread(X.table(spark, d, "pages"), "page_id"), "html").select(
        "page_id", "keyword_signal", "code_signal", "step_signal", F.round("lexical_signal", 9).alias("lexical_signal"),
        "length_signal")


@query
def difficulty_score(spark, d):
    return M.score_prompts(spread(X.table(spark, d, "documents"), "doc_id"), "text").select(
        "doc_id", F.round("score", 9).alias("score"), "tier")


@query
def length_baseline(spark, d):
    return M.score_prompts(X.table(spark, d, "conversations"), "text").select("conv_id", "turn", "baseline_tier")


@query
def parse_status(spark, d):
    return B.parse_status(X.usage(spark, d), dims.error_codes(spark)).select(
        "usage_id", "outcome", "error_name", "error_code")


@query
def served_by(spark, d):
    return R.served_by(X.usage(spark, d))


@query
def export_usage_events(spark, d):
    path = scratch_path(spark, "events-json")
    usage_io.export_usage_events(X.usage(spark, d), path)
    records, _ = usage_io.ingest_usage(usage_io.read_usage_events(spark, path), at(AS_OF))
    return records.groupBy("virtual_key_id", "status", F.coalesce("provider", F.lit("none")).alias("provider")).agg(
        F.count("*").alias("events"), F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"),
        F.max("created_at").alias("newest"))


# -- request path ------------------------------------------------------------------------------------------------------

@query
def authenticate(spark, d):
    return G.authenticate(X.requests(spark, d), dims.load_keys(spark)).select(
        "request_id", "credential", "key_id", "tenant", "auth_error", "auth_message")


@query
def check_allowlist(spark, d):
    known = G.authenticate(X.requests(spark, d), dims.load_keys(spark)).filter(F.col("auth_error").isNull())
    return G.check_allowlist(known).select("request_id", "tenant", "model", "allow_error")


@query
def resolve_route(spark, d):
    return _routed(spark, d).select("request_id", "model", "auto_routed", "primary_model",
                                    F.array_join("chain", ",").alias("chain"), "route_error")


@query
def expand_chain(spark, d):
    return G.expand_chain(_routed(spark, d), ["request_id"])


@query
def route_around_outage(spark, d):
    return G.route_around_outage(
        _routed(spark, d), dims.load_aliases(spark), dims.load_pricing(spark), _health(spark, "north")).select(
        "request_id", "primary_model", "served_model", "served_provider", "fallback_used", "dispatch_error")


@query
def provider_of(spark, d):
    models = X.usage(spark, d).select("usage_id", F.col("resolved_model").alias("model"))
    return B.provider_of(models, dims.load_pricing(spark))


@query
def dispatch_outcome(spark, d):
    return G.dispatch_outcome(X.attempts(spark, d))


@query
def breaker_events(spark, d):
    told = G.breaker_events(X.attempts(spark, d)).withColumn("row_id", F.col("request_id") * 2 + F.col("position"))
    told = told.withColumnRenamed("failed", "broke")
    return A.breaker_replay(told, "position", "ts", "row_id", F.col("broke"), 3, 3600 * A.MICRO).select(
        "request_id", "position", F.col("broke").alias("failed"), "allowed", "state_after")


# -- reports -----------------------------------------------------------------------------------------------------------

@query
def key_cost_since(spark, d):
    return R.key_cost_since(X.usage(spark, d), _since())


@query
def key_requests_since(spark, d):
    return R.key_requests_since(X.usage(spark, d), _since())


@query
def key_cache_hits_since(spark, d):
    return R.key_cache_hits_since(X.usage(spark, d), _since())


@query
def usage_summary(spark, d):
    return R.usage_summary(X.usage(spark, d), dims.load_keys(spark), at(AS_OF))


@query
def provider_breakdown(spark, d):
    return R.provider_breakdown(X.usage(spark, d), _since())


@query
def top_providers(spark, d):
    return R.top_providers(X.usage(spark, d), _since(), 2)


@query
def total_spend_since(spark, d):
    return R.total_spend_since(X.usage(spark, d), _since())


@query
def fallback_count_since(spark, d):
    return R.fallback_count_since(X.usage(spark, d), _since())


@query
def usage_report(spark, d):
    report = R.usage_report(X.usage(spark, d), at(AS_OF))
    return report.select("window_days", "total_spend_usd", "fallback_count", F.posexplode("by_provider").alias(
        "position", "p")).select("window_days", "total_spend_usd", "fallback_count", "position", "p.*")


@query
def latency_percentiles(spark, d):
    return R.latency_percentiles(X.usage(spark, d), ["provider"])


@query
def latency_percentiles_overall(spark, d):
    return R.latency_percentiles(X.usage(spark, d), [])


@query
def sorted_latencies(spark, d):
    return R.sorted_latencies(X.usage(spark, d))


@query
def routing_accuracy(spark, d):
    return R.routing_accuracy(M.score_prompts(X.requests(spark, d)))


@query
def recent_requests(spark, d):
    return R.recent_requests(X.usage(spark, d), page=1, size=25)


@query
def over_admission_check(spark, d):
    # the bucket refills 20 a day over the 31 days the log can touch
    admitted = _rated(spark, d, "value").withColumns({
        "cost": F.col("value").cast("decimal(12,2)"), "allowance": F.lit(20 * 31), "budget": F.lit(1_000_000)})
    return R.over_admission_check(admitted, "event_type")


# -- folds -------------------------------------------------------------------------------------------------------------

def _rated(spark, d, *extra):
    log = X.table(spark, d, "events").select("event_type", "event_id", "ts", *extra)
    return A.rate_limit(log, "event_type", "ts", "event_id", F.lit(20), DAY_US)


@query
def rate_limit(spark, d):
    return _rated(spark, d).select("event_type", "event_id", "admitted")


@query
def retry_after(spark, d):
    return _rated(spark, d).filter(~F.col("admitted")).select("event_type", "event_id", "retry_after_ms")


def _charges(events):
    return events.select("user_id", "event_id", "ts", F.col("value").cast("decimal(12,2)").alias("cost"))


@query
def budget_admit(spark, d):
    return A.budget_admit(_charges(X.table(spark, d, "events")), "user_id", ["ts", "event_id"], F.col("cost"),
                          F.lit(500)).select("user_id", "event_id", "admitted", "spend")


def _step(size: int):
    """0, 1, 2, 0, ... over blocks of 500 events, times size."""
    return F.pmod(F.floor(F.col("event_id") / 500), F.lit(3)).cast("int") * size


@query
def rate_limit_changing(spark, d):
    log = X.table(spark, d, "events").select("event_type", "event_id", "ts")
    return A.rate_limit(log, "event_type", "ts", "event_id", F.lit(12) + _step(6), DAY_US).select(
        "event_type", "event_id", "admitted", "retry_after_ms")


@query
def budget_changing(spark, d):
    return A.budget_admit(_charges(X.table(spark, d, "events")), "user_id", ["ts", "event_id"], F.col("cost"),
                          F.lit(300) + _step(150)).select("user_id", "event_id", "admitted", "spend")


@query
def spend_ledger(spark, d):
    e, cost = X.table(spark, d, "events"), F.col("value").cast("decimal(12,2)")
    k = F.get_json_object("props", "$.k").cast("int")
    fix = F.when(F.col("event_type") == "error", -cost).otherwise((k - 50) * F.lit("0.05").cast("decimal(3,2)"))
    reserve = e.select("user_id", "ts", (F.col("event_id") * 2).alias("entry_id"),
                       cost.cast("decimal(18,6)").alias("amount"), F.lit(True).alias("is_guarded"))
    settle = e.filter(F.col("event_type").isin("error", "purchase")).select(
        "user_id", "ts", (F.col("event_id") * 2 + 1).alias("entry_id"), fix.cast("decimal(18,6)").alias("amount"),
        F.lit(False).alias("is_guarded"))
    return A.spend_ledger(reserve.unionByName(settle), "user_id", ["ts", "entry_id"], F.col("amount"),
                          F.col("is_guarded"), F.lit(500)).select("user_id", "entry_id", "admitted", "spend")


def _attempt_log(events):
    return events.select((F.col("user_id") % 2).alias("provider"), "event_id", "ts", "event_type")


@query
def breaker_replay(spark, d):
    return A.breaker_replay(
        _attempt_log(X.table(spark, d, "events")), "provider", "ts", "event_id", F.col("event_type") == "error", 3,
        3600 * A.MICRO).select("provider", "event_id", "allowed", "state_after")


@query
def breaker_dispatch(spark, d):
    """Requests dispatched by the state the breakers had at their time, as replayed from the attempt log."""
    log = _attempt_log(X.table(spark, d, "events")).withColumn(
        "provider", F.when(F.col("provider") == 0, "north").otherwise("harbor"))
    replayed = A.breaker_replay(log, "provider", "ts", "event_id", F.col("event_type") == "error", 3, 3600 * A.MICRO)
    return G.route_around_breakers(
        _routed(spark, d), dims.load_aliases(spark), dims.load_pricing(spark),
        G.breaker_openings(replayed, "provider", "ts"), "ts", "request_id", 3600 * A.MICRO).select(
        "request_id", "primary_model", "served_model", "served_provider", "fallback_used", "dispatch_error")


@query
def cache_savings(spark, d):
    hits = X.usage(spark, d).filter("cache_hit").drop("cost_usd")
    return B.cache_savings(hits, dims.load_pricing(spark))


# -- completions -------------------------------------------------------------------------------------------------------

def _completions(turns, *extra):
    return turns.select(*extra, F.col("id").alias("completion_id"), F.col("prompt").alias("content"),
                        F.length("prompt").alias("prompt_tokens"), F.size(F.split("prompt", " ")).alias("completion_tokens"))


@query
def chunk_completion(spark, d):
    return M.chunk_completion(_completions(X.replies(spark, d)))


@query
def assemble_chunks(spark, d):
    return M.assemble_chunks(M.chunk_completion(_completions(X.replies(spark, d)))).drop("complete")


# -- vectors and cache -------------------------------------------------------------------------------------------------

@query
def embed_corpus(spark, d):
    v = C.embed_prompts(X.doc_prompts(spark, d)).select("id", "vec")
    ramp = F.transform(F.sequence(F.lit(0), F.lit(V.DIM - 1)), lambda i: i.cast("double"))
    vec = F.col("vec")
    return v.select(
        "id", F.size(F.filter(vec, lambda x: x != 0)).alias("slots"),
        F.aggregate(V.as_double(vec), F.lit(0.0), lambda s, x: s + x).alias("weight"), V.dot(vec, ramp).alias("moment"),
        F.round(F.array_max(V.l2_normalize(vec)), 9).alias("largest"))


@query
def embed_other(spark, d):
    """Cache entries under another embedder."""
    v = C.new_entries(X.doc_prompts(spark, d), at(AS_OF), embedder=V.word_lengths)
    ramp = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: i.cast("double"))
    return v.select("id", F.aggregate(V.as_double(F.col("vec")), F.lit(0.0), lambda s, x: s + x).alias("weight"),
                    V.dot(F.col("vec"), ramp).alias("moment"), F.round(V.norm(F.col("vec")), 9).alias("norm"), "expires_at")


@query
def build_index(spark, d):
    return C.build_index(X.vectors(spark, d), VEC_DIM)


@query
def index_stats(spark, d):
    return C.index_stats(X.vectors(spark, d), VEC_DIM)


@query
def bucket_join(spark, d):
    v = X.vectors(spark, d)
    return C.bucket_join(v, v, VEC_DIM)


@query
def scoped_cosine_join(spark, d):
    v = X.vectors(spark, d)
    return C.scoped_cosine_join(v, v, 0.3, VEC_DIM)


@query
def similar_prompt_pairs(spark, d):
    return C.similar_prompt_pairs(C.embed_prompts(X.doc_prompts(spark, d)), 0.99, V.DIM)


@query
def lsh_recall(spark, d):
    return C.lsh_recall(X.vectors(spark, d), 0.3, VEC_DIM)


@query
def index_stats_tables(spark, d):
    return C.index_stats(X.vectors(spark, d), VEC_DIM, X.LSH_PLANES, X.LSH_TABLES)


@query
def lsh_recall_tables(spark, d):
    return C.lsh_recall(C.embed_prompts(X.prompts(spark, d)), C.THRESHOLD, V.DIM, X.LSH_PLANES, X.LSH_TABLES)


def _lookup_sides(spark, d):
    entries = C.embed_prompts(X.prompts(spark, d)).withColumns({
        "content": F.col("prompt"), "prompt_tokens": F.length("prompt"),
        "completion_tokens": F.size(F.split("prompt", " "))})
    return C.embed_prompts(X.replies(spark, d)), entries


@query
def best_match(spark, d):
    queries, entries = _lookup_sides(spark, d)
    return C.best_match(queries, entries, 0.5, V.DIM, mode="exact").withColumn("similarity", F.round("similarity", 6))


@query
def best_match_lsh(spark, d):
    queries, entries = _lookup_sides(spark, d)
    return C.best_match(queries, entries, 0.5, V.DIM, mode="lsh").withColumn("similarity", F.round("similarity", 6))


@query
def best_match_tables(spark, d):
    queries, entries = _lookup_sides(spark, d)
    return C.best_match(queries, entries, 0.5, V.DIM, mode="lsh", planes=X.LSH_PLANES, tables=X.LSH_TABLES).withColumn(
        "similarity", F.round("similarity", 6))


@query
def best_match_lsh_then_exact(spark, d):
    queries, entries = _lookup_sides(spark, d)
    return C.best_match(queries, entries, 0.5, V.DIM).withColumn("similarity", F.round("similarity", 6))


@query
def cache_lookup(spark, d):
    queries, entries = _lookup_sides(spark, d)
    return C.cache_lookup(queries, entries, 0.5, V.DIM, mode="exact")


def _replay(spark, d, ttl):
    log = C.embed_prompts(X.prompts(spark, d))
    return C.cache_replay(log, 0.60, V.DIM, ttl).select("id", "hit", "match_id", "similarity")


@query
def cache_replay(spark, d):
    return _replay(spark, d, None)


@query
def cache_replay_ttl(spark, d):
    return _replay(spark, d, 86_400)


# -- composites --------------------------------------------------------------------------------------------------------

def _outcomes(spark, d):
    keys, aliases, pricing = dims.load_keys(spark), dims.load_aliases(spark), dims.load_pricing(spark)
    requests = X.requests(spark, d)
    facts, prompts = O.request_facts(requests, keys, aliases, pricing, ["completion_tokens", "latency_ms"])
    facts, health = O.with_rates(facts, DAY_US), _health(spark, "harbor")
    done = O.request_outcome(facts, prompts, aliases, pricing, health, ttl_seconds=6 * 3600)
    return facts, done


@query
def request_outcome(spark, d):
    return _outcomes(spark, d)[1].select(
        "request_id", "tenant", "cache_hit", "match_id", "error_code", "http_status", "retry_after_ms", "served_model",
        "served_provider", "fallback_used")


@query
def status_histogram(spark, d):
    return R.status_histogram(_outcomes(spark, d)[1], ["tenant"])


@query
def rejection_report(spark, d):
    refused = _outcomes(spark, d)[1].filter(F.col("error_code").isNotNull())
    return R.rejection_report(refused, dims.error_codes(spark))


@query
def meter_requests(spark, d):
    facts, done = _outcomes(spark, d)
    stored = facts.select(
        F.col("request_id").alias("match_id"), F.col("prompt_tokens").alias("stored_prompt_tokens"),
        F.col("completion_tokens").alias("stored_completion_tokens"))
    return O.meter_requests(done, stored, dims.load_pricing(spark))


# -- streams -----------------------------------------------------------------------------------------------------------

@query
def rate_limit_stream(spark, d):
    log = S.read_table_stream(spark, d, "events").select("event_type", "event_id", "ts")
    done = S.run_to_table(S.rate_limit_stream(log, "event_type", "ts", "event_id", F.lit(20), DAY_US), "rate")
    return done.select("event_type", "event_id", "admitted", "retry_after_ms")


@query
def budget_stream(spark, d):
    log = _charges(S.read_table_stream(spark, d, "events"))
    done = S.run_to_table(
        S.budget_stream(log, "user_id", "ts", "event_id", F.col("cost"), F.lit(True), F.lit(500)), "budget")
    return done.select("user_id", "event_id", "admitted", (
        F.col("spend_micro") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)").alias("spend"))


@query
def breaker_stream(spark, d):
    log = _attempt_log(S.read_table_stream(spark, d, "events"))
    done = S.run_to_table(S.breaker_stream(
        log, "provider", "ts", "event_id", F.col("event_type") == "error", 3, 3600 * A.MICRO), "breaker")
    return done.select("provider", "event_id", "allowed", "state_after")


@query
def cache_stream(spark, d):
    log = C.embed_prompts(X.turns_of(S.read_table_stream(spark, d, "conversations"), "user"))
    done = S.run_to_table(S.cache_stream(log, 0.60, 86_400, lateness=None), "cache")
    return done.select("id", "hit", "match_id", "similarity")


@query
def usage_rollup_stream(spark, d):
    rows = X.usage_of(S.read_table_stream(spark, d, "events"))
    return S.run_to_latest(S.usage_rollup_stream(rows, lateness=None), "rollup", ["window_start", "provider"])


@query
def assemble_chunks_stream(spark, d):
    turns = X.turns_of(S.read_table_stream(spark, d, "conversations"), "assistant")
    chunks = M.chunk_completion(_completions(turns, "ts"), ["ts"])
    return S.run_to_table(S.assemble_chunks_stream(chunks, lateness=None), "chunks")
