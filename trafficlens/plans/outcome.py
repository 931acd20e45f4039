"""What the gateway would have answered to each request, and the log rows those answers leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.text import estimate_message_tokens, render_messages
from trafficlens.functions.vectors import DIM, embed
from trafficlens.operators.admission import MICRO, rate_limit
from trafficlens.operators.cache import THRESHOLD, TTL_SECONDS
from trafficlens.operators.metering import estimate_cost, price_usage
from trafficlens.operators.path import gateway_pass
from trafficlens.operators.routing import (
    authenticate, check_allowlist, resolve_route, route_around_outage, validate_requests)
from trafficlens.operators.skew import lookup_join
from trafficlens.session import shared_dir
from trafficlens.sources.dims import ERROR_CODES

_FACTS = ["request_id", "ts", "key_id", "tenant", "rpm", "budget", "model", "stream", "primary_model", "chain",
          "prompt_tokens", "estimate_usd", "auth_error", "body_error", "allow_error", "route_error"]


def request_facts(requests: DataFrame, keys: DataFrame, aliases: DataFrame, pricing: DataFrame,
                  extra: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(facts, prompts). Facts: everything about a request that needs no other request: errors, route, estimate, and the
    prompt_id of its text (a SHA-256) where it gets as far as the cache. Map-side joins only. Prompts: prompt_id, vec.

    The passes that follow all start from these narrow rows, so they are written out once and the message texts are read
    once. Each different text is embedded once, and no vector travels with a request."""
    shared_dir(requests.sparkSession)
    checked = check_allowlist(validate_requests(authenticate(requests, keys)))
    # the messages are read to the end before the joins, so that they are not copied from step to step
    fine = F.col("auth_error").isNull() & F.coalesce("body_error", "allow_error").isNull()
    sized = checked.withColumns({
        "prompt_tokens": estimate_message_tokens(F.col("messages")), "_body": F.when(fine, render_messages(F.col("messages")))})
    priced = estimate_cost(resolve_route(sized, aliases, pricing), pricing).withColumn(
        "_text", F.when(F.col("route_error").isNull(), F.col("_body")))
    read = priced.select(*_FACTS, "_text", F.unhex(F.sha2("_text", 256)).alias("prompt_id"), *extra).checkpoint()
    # the text is part of the key, so copies merge in a hash table
    texts = read.filter("_text is not null").select("prompt_id", "_text").distinct()
    return read.drop("_text"), texts.select("prompt_id", embed(F.col("_text")).alias("vec")).checkpoint()


def with_rates(facts: DataFrame, window_us: int = 60 * MICRO) -> DataFrame:
    """facts with rate_error and retry_after_ms. Only requests of a known key draw on its rate; the others go round the
    ordered scan by a union. Rates depend on nothing else, so they come first and are written out once."""
    known = rate_limit(facts.filter(F.col("auth_error").isNull()), "key_id", "ts", "request_id", F.col("rpm"), window_us)
    known = known.withColumn("rate_error", F.when(~F.col("admitted"), "RATE_LIMITED")).drop("admitted", "tokens_before")
    unknown = facts.filter(F.col("auth_error").isNotNull()).withColumns({
        "rate_error": F.lit(None).cast("string"), "retry_after_ms": F.lit(None).cast("bigint")})
    return known.unionByName(unknown).checkpoint()


def request_outcome(facts: DataFrame, prompts: DataFrame, aliases: DataFrame, pricing: DataFrame, health: DataFrame,
                    threshold: float = THRESHOLD, ttl_seconds: int = TTL_SECONDS, partitions: int | None = None) -> DataFrame:
    """The first rule each request fails: key, rate, body, allowlist, alias, (cache hit ends here), budget, dispatch.

    Needs facts with rates, completion_tokens and latency_ms. Requests that get as far as the cache are written out once, as the
    pass reads them several times, whatever the number of refused ones beside them. They go through one ordered
    pass (operators/path.py), in which misses store, spend is settled or taken back on completion, and refused requests leave
    nothing; the others go round it by a union, so no request is joined back to itself."""
    own = [*_FACTS, "rate_error", "retry_after_ms", "completion_tokens", "latency_ms"]
    extra = [c for c in facts.columns if c not in (*own[:-2], "prompt_id")]
    refused = F.coalesce("auth_error", "rate_error", "body_error", "allow_error", "route_error")
    routed = route_around_outage(facts.filter(refused.isNull()), aliases, pricing, health)
    priced = price_usage(routed.withColumn("resolved_model", F.col("served_model")), pricing)
    micro = lambda c: (c.cast("decimal(18,6)") * F.lit(MICRO)).cast("bigint")
    sized = priced.select(
        *routed.columns, micro(F.col("estimate_usd")).alias("estimate"), (~F.col("stream")).alias("looks_up"),
        F.coalesce(micro(F.col("cost_usd")), F.lit(0).cast("bigint")).alias("settled")).withColumn(
        "budget_usd", F.col("budget")).withColumn("budget", micro(F.col("budget"))).checkpoint()
    passed = gateway_pass(sized, threshold, DIM, ttl_seconds, partitions, prompts).withColumns({
        "cache_hit": F.col("match_id").isNotNull(), "budget_error": F.when(~F.col("admitted"), "BUDGET_EXHAUSTED")})
    kept = [*_FACTS, "rate_error", "retry_after_ms", *extra, "match_id", "cache_hit", "budget_error", "served_model",
            "served_provider", "fallback_used", "dispatch_error"]
    none = lambda kind: F.lit(None).cast(kind)
    rest = facts.filter(refused.isNotNull()).withColumns({
        "match_id": none("bigint"), "cache_hit": F.lit(False), "fallback_used": F.lit(False),
        **{c: none("string") for c in ("budget_error", "served_model", "served_provider", "dispatch_error")}})
    judged = passed.drop("budget").withColumnRenamed("budget_usd", "budget").select(*kept).unionByName(rest.select(*kept))

    code = F.coalesce(refused, F.when(~F.col("cache_hit"), F.coalesce("budget_error", "dispatch_error")))
    served = code.isNull() & ~F.col("cache_hit")
    by_code = F.create_map(*(F.lit(v) for code_, status, _ in ERROR_CODES for v in (code_, status)))
    return judged.select(
        "request_id", "ts", "key_id", "tenant", "model", "primary_model", "prompt_tokens", "estimate_usd", "match_id",
        "cache_hit", code.alias("error_code"),
        F.when(code.isNull(), 200).otherwise(by_code[code]).alias("http_status"),
        F.when(code == "RATE_LIMITED", F.col("retry_after_ms")).alias("retry_after_ms"),
        F.when(served, F.col("served_model")).alias("served_model"),
        F.when(served, F.col("served_provider")).alias("served_provider"),
        F.coalesce(served & F.col("fallback_used"), F.lit(False)).alias("fallback_used"), *extra)


def meter_requests(outcomes: DataFrame, stored_usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Request log rows: hits at cost 0 with the stored entry's tokens, served requests priced, exhausted ones as errors.

    Refusals (401, 429, 400, 403, 402) leave no row. Needs completion_tokens and latency_ms on the outcomes;
    ``stored_usage`` gives match_id, stored_prompt_tokens, stored_completion_tokens."""
    hit, failed = F.col("cache_hit"), F.col("error_code").isNotNull()
    shared_dir(outcomes.sparkSession)
    # written out, as the outcomes are read several times below
    logged = outcomes.filter(~failed | (F.col("error_code") == "ALL_PROVIDERS_EXHAUSTED")).checkpoint()
    # most requests answer no other one, so they need not be sent to the join
    answered = logged.filter("match_id is not null").select("match_id").distinct()
    # one entry may serve very many hits
    joined = lookup_join(logged, stored_usage.join(answered, "match_id", "left_semi"), ["match_id"], "request_id", "left")
    rows = joined.select(
        F.col("request_id").alias("usage_id"), F.col("ts").alias("created_at"), F.col("key_id").alias("virtual_key_id"),
        F.col("model").alias("requested_model"), F.coalesce("served_model", "primary_model").alias("resolved_model"),
        F.when(hit, "cache").otherwise(F.col("served_provider")).alias("provider"),
        F.when(failed, "ERROR:AllProvidersExhaustedException").otherwise("SUCCESS").alias("status"),
        F.when(~failed, F.when(hit, F.col("stored_prompt_tokens")).otherwise(F.col("prompt_tokens"))).alias("prompt_tokens"),
        F.when(~failed, F.when(hit, F.col("stored_completion_tokens")).otherwise(
            F.col("completion_tokens"))).alias("completion_tokens"),
        F.col("cache_hit"), (failed | F.col("fallback_used")).alias("fallback_used"), "latency_ms")
    zero = F.lit(0).cast("decimal(18,6)")
    return price_usage(rows, pricing).withColumn(
        "cost_usd", F.when(F.col("cache_hit"), zero).otherwise(F.col("cost_usd"))).drop(
        "model_provider", "total_tokens", "price_error")
