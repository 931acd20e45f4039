"""Authentication, allowlists, alias resolution, failover and body validation, as joins against small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.clock import epoch_us
from trafficlens.functions.text import classify_tier, extract_credential, is_blank, user_text_of, with_difficulty
from trafficlens.operators.skew import lookup_join
from trafficlens.sources.dims import one_per


def authenticate(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds key_id, tenant, allowed, rpm, budget; auth_error and auth_message where no active key matches."""
    given = requests.withColumn("credential", extract_credential(F.col("authorization"), F.col("api_key")))
    active = one_per(keys.filter("active"), "key_value").select(
        F.col("key_value").alias("_key"), "key_id", "tenant", "allowed", "rpm", "budget")
    matched = given.join(active, given["credential"] == active["_key"], "left").drop("_key")
    blank, unknown = F.col("credential") == "", F.col("key_id").isNull()
    return matched.withColumns({
        "auth_error": F.when(blank | unknown, "INVALID_VIRTUAL_KEY"),
        "auth_message": F.when(blank, "no key was sent").when(unknown, "key is unknown or revoked")})


def check_allowlist(requests: DataFrame) -> DataFrame:
    """An absent or empty list allows everything; otherwise the raw requested name must be in it, case included."""
    open_list = F.coalesce(F.size("allowed") == 0, F.lit(True))
    allowed = open_list | F.coalesce(F.array_contains(F.col("allowed"), F.col("model")), F.lit(False))
    return requests.withColumn("allow_error", F.when(~allowed, "MODEL_NOT_ALLOWED"))


def resolve_route(requests: DataFrame, aliases: DataFrame, pricing: DataFrame) -> DataFrame:
    """Adds primary_model, chain, auto_routed; route_error where neither an alias nor a priced model matches.

    'auto' in any case goes to the tier's alias; aliases match case-insensitively, models exactly."""
    auto = F.lower("model") == "auto"
    # only 'auto' requests have their text read
    read = requests.withColumn("auto_routed", auto).withColumn(
        "_text", F.when(F.col("auto_routed"), user_text_of(F.col("messages"))))
    named = with_difficulty(read, "_text").withColumn(
        "_alias", F.when(F.col("auto_routed"), classify_tier(F.col("score"))).otherwise(F.lower("model")))
    by_alias = one_per(aliases, "alias").select(F.col("alias").alias("_a"), F.col("primary_model").alias("_p"), F.col("chain").alias("_c"))
    by_model = pricing.select(F.col("model").alias("_m")).distinct()
    joined = (named.join(by_alias, named["_alias"] == by_alias["_a"], "left")
              .join(by_model, (named["model"] == by_model["_m"]) & ~named["auto_routed"], "left"))
    return joined.withColumns({
        "primary_model": F.coalesce("_p", "_m"),
        "chain": F.coalesce("_c", F.when(F.col("_m").isNotNull(), F.array().cast("array<string>"))),
    }).withColumn("route_error", F.when(F.col("primary_model").isNull(), "UNKNOWN_MODEL_ALIAS")).drop(
        "_text", "_alias", "_a", "_p", "_c", "_m", "keyword_signal", "code_signal", "step_signal", "lexical_signal",
        "length_signal", "score")


def expand_chain(routed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per request and chain position; position 0 is the primary model."""
    full = F.concat(F.array("primary_model"), F.col("chain"))
    return routed.filter(F.col("primary_model").isNotNull()).select(
        *columns, F.posexplode(full).alias("position", "model"))


def healthy_routes(aliases: DataFrame, pricing: DataFrame, health: DataFrame) -> DataFrame:
    """For every route the dimensions define: the first model whose provider is healthy, and its position."""
    routes = aliases.select("primary_model", "chain").unionByName(
        pricing.select(F.col("model").alias("primary_model"), F.array().cast("array<string>").alias("chain"))).distinct()
    down = health.filter(~F.col("healthy")).select("provider")
    steps = expand_chain(routes, ["primary_model", "chain"]).join(one_per(pricing, "model").select("model", "provider"), "model")
    up = steps.join(down, "provider", "left_anti")
    return up.groupBy("primary_model", "chain").agg(
        F.min(F.struct("position", "model", "provider")).alias("served"))


def route_around_outage(routed: DataFrame, aliases: DataFrame, pricing: DataFrame, health: DataFrame) -> DataFrame:
    """Adds served_model, served_provider, fallback_used, dispatch_error.

    Requests must carry a primary model and chain as resolve_route gives them for these aliases and prices; another
    chain has no route and counts as exhausted.

    A route depends on (primary, chain) alone, so chains are walked once per route of the dimensions and the answer
    joined to the requests: requests are neither exploded nor shuffled."""
    served = healthy_routes(aliases, pricing, health).select(
        F.col("primary_model").alias("_p"), F.col("chain").alias("_c"), "served")
    joined = routed.join(
        served, (routed["primary_model"] == served["_p"]) & (routed["chain"] == served["_c"]), "left").drop("_p", "_c")
    return joined.withColumns({
        "served_model": F.col("served.model"), "served_provider": F.col("served.provider"),
        "fallback_used": F.col("served.position") > 0,
        "dispatch_error": F.when(
            F.col("primary_model").isNotNull() & F.col("served").isNull(), "ALL_PROVIDERS_EXHAUSTED"),
    }).drop("served")


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds violations: every broken rule as 'field: message', joined by '; ' ('' when the body is valid); body_error.

    The error is decided without the texts, which are not built where nobody asks for them."""
    def turn_faults(m, i):
        at = F.concat(F.lit("messages["), i.cast("string"), F.lit("]"))
        return F.array_compact(F.array(
            F.when(is_blank(m["role"]), F.concat(at, F.lit(".role: needs a role"))),
            F.when(is_blank(m["content"]), F.concat(at, F.lit(".content: needs some text")))))

    msgs, temp = F.col("messages"), F.col("temperature")
    empty = F.coalesce(F.size(msgs) <= 0, F.lit(True))
    head = F.array_compact(F.array(
        F.when(is_blank(F.col("model")), F.lit("model: needs a name")),
        F.when(empty, F.lit("messages: needs a message"))))
    turns = F.when(empty, F.array().cast("array<string>")).otherwise(F.flatten(F.transform(msgs, turn_faults)))
    tail = F.array_compact(F.array(
        F.when(temp < 0.0, F.lit("temperature: below 0")),
        F.when(temp > 2.0, F.lit("temperature: above 2"))))
    faults = F.concat(head, turns, tail)
    faulty = (is_blank(F.col("model")) | empty | F.exists(msgs, lambda m: is_blank(m["role"]) | is_blank(m["content"]))
              | (temp < 0.0) | (temp > 2.0))
    return requests.withColumns({
        "violations": F.array_join(faults, "; "), "body_error": F.when(faulty, "VALIDATION_FAILED")})


def dispatch_outcome(attempts: DataFrame, backoff_ms: int = 200, max_retries: int = 2) -> DataFrame:
    """One row per request from its attempt log: first success by (position, attempt), fallback, total backoff.

    Only 'unavailable' failures are retried, so only those wait before the next attempt."""
    retried = (~F.col("ok")) & (F.col("error_kind") == "unavailable") & (F.col("attempt") < max_retries)
    wait = F.when(retried, F.lit(backoff_ms) * F.expr("shiftleft(1, attempt)")).otherwise(0)
    won = F.min(F.when(F.col("ok"), F.struct("position", "attempt")))
    done = attempts.groupBy("request_id").agg(won.alias("w"), F.sum(wait).cast("bigint").alias("backoff_ms"))
    return done.select(
        "request_id", F.col("w.position").alias("position"), F.col("w.attempt").alias("attempt"),
        F.coalesce(F.col("w.position") > 0, F.lit(True)).alias("fallback_used"),
        F.when(F.col("w").isNull(), "ALL_PROVIDERS_EXHAUSTED").otherwise("SUCCESS").alias("outcome"), "backoff_ms")


def breaker_events(attempts: DataFrame) -> DataFrame:
    """What a circuit breaker is told of a dispatch: one row per request and chain position, with failed and the time.

    Retries count once, by how the position ended. A timeout is neither retried nor told, unless the request streams,
    where any error counts. Needs request_id, position, attempt, ok, error_kind, stream, ts."""
    last = F.max_by(F.struct("ok", "error_kind", "stream", "ts"), "attempt").alias("last")
    ended = attempts.groupBy("request_id", "position").agg(last).select("request_id", "position", "last.*")
    told = F.col("ok") | F.col("stream") | (F.col("error_kind") == "unavailable")
    return ended.filter(told).select("request_id", "position", "ts", (~F.col("ok")).alias("failed"))


def breaker_openings(replayed: DataFrame, key: str, ts: str) -> DataFrame:
    """provider, opened_at: when a breaker opened or opened again, from the rows of a breaker replay."""
    opened = F.col("allowed") & (F.col("state_after") == "OPEN")
    return replayed.filter(opened).select(F.col(key).alias("provider"), F.col(ts).alias("opened_at"))


def route_around_breakers(routed: DataFrame, aliases: DataFrame, pricing: DataFrame, openings: DataFrame, ts: str,
                          row_id: str, cooldown_us: int = 10_000_000) -> DataFrame:
    """Adds served_model, served_provider, fallback_used, dispatch_error: the first model of the chain whose provider's
    breaker is not open at the request's time. Requests must carry a route as for route_around_outage.

    A breaker is open from its opening, that moment included, for one cooldown. Time is cut into slots one cooldown wide:
    an opening reaches into its own slot and the next, and a provider's openings are at least a cooldown apart, so a slot
    has at most two of each provider. They are gathered per slot and looked up by it: no window over a busy provider, no
    request is exploded, and a slot with very many requests is spread over several tasks. Without a time none is open."""
    at, slot = epoch_us(F.col("opened_at")), F.floor(F.col("_at") / cooldown_us)
    down = (openings.select("provider", at.alias("_at")).select("provider", "_at", F.explode(F.array(slot, slot + 1)).alias("_slot"))
            .groupBy("_slot").agg(F.collect_set(F.struct("provider", "_at")).alias("_down")))
    routes = aliases.select("primary_model", "chain").unionByName(
        pricing.select(F.col("model").alias("primary_model"), F.array().cast("array<string>").alias("chain"))).distinct()
    steps = (expand_chain(routes, ["primary_model", "chain"])
             .join(one_per(pricing, "model").select("model", "provider"), "model").groupBy("primary_model", "chain")
             .agg(F.sort_array(F.collect_list(F.struct("position", "model", "provider"))).alias("_steps"))
             .select(F.col("primary_model").alias("_p"), F.col("chain").alias("_c"), "_steps"))
    timed = routed.withColumn("_at", epoch_us(F.col(ts))).withColumn("_slot", slot)
    known = lookup_join(timed, down, ["_slot"], row_id, "left").join(
        steps, (F.col("primary_model") == F.col("_p")) & (F.col("chain") == F.col("_c")), "left")
    refused = F.coalesce("_down", F.array().cast("array<struct<provider: string, _at: bigint>>"))
    up = F.filter("_steps", lambda s: ~F.exists(refused, lambda o: (
        (o["provider"] == s["provider"]) & (o["_at"] <= F.col("_at")) & (F.col("_at") < o["_at"] + cooldown_us))))
    return known.withColumn("_served", F.get(up, F.lit(0))).withColumns({
        "served_model": F.col("_served.model"), "served_provider": F.col("_served.provider"),
        "fallback_used": F.col("_served.position") > 0,
        "dispatch_error": F.when(
            F.col("primary_model").isNotNull() & F.col("_served").isNull(), "ALL_PROVIDERS_EXHAUSTED"),
    }).drop("_at", "_slot", "_down", "_p", "_c", "_steps", "_served")
