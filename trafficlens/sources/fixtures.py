"""Gateway tables derived from the supplied parquet tables, by formulas that SQL engines agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.operators.metering import price_usage
from trafficlens.session import spread
from trafficlens.sources import dims

# Labelled prompts (text, tier it should get, why it is in the set).
LABELLED_PROMPTS = [
    ("Prove that sqrt(2) is irrational.", "smart", "short-but-hard"),
    ("Why does TCP use a three-way handshake instead of a two-way one?", "smart", "short-but-hard"),
    ("Debug this: for(i=0;i<n;i++) { arr[i]=arr[i+1]; } throws IndexOutOfBounds.", "smart", "short-but-hard"),
    ("Compare the trade-offs of optimistic vs pessimistic locking in a database.", "smart", "short-but-hard"),
    ("Explain the CAP theorem and why a distributed system can't have all three.", "smart", "short-but-hard"),
    ("hi", "fast", "trivial"),
    ("What time zone is Tokyo in?", "fast", "trivial"),
    ("Say hello in French.", "fast", "trivial"),
    ("Please continue this story about a dog who likes to play fetch in the park every single sunny afternoon with "
     "his best friend, a golden retriever named Max, who also enjoys long walks and chasing squirrels around the old "
     "oak tree near the pond where the ducks like to swim in circles all day long while children watch nearby and "
     "laugh at their antics for hours on end.", "fast", "long-but-trivial"),
    ("List, in as much detail as you enjoy, every color you can think of, one per line, starting with red and going "
     "through the whole rainbow and then some pastel shades too, just for fun, no need to be fast about it, take "
     "your time and be thorough and friendly about it.", "fast", "long-but-trivial"),
    ("Write a long, cheerful good-morning message wishing someone a wonderful day, mentioning coffee, sunshine, and "
     "a productive day ahead, and keep it warm and simple throughout the whole message from start to finish.",
     "fast", "long-but-trivial"),
]
KEY_BY_USER = ["key-atlas", "key-birch", "key-cedar", "key-dune", "key-ember", "nope", ""]
NAME_BY_EVENT = ["fast", "smart", "auto", "swift-s", "delta-l", "FAST", "Auto", "no-such-model"]
MODEL_BY_EVENT = ["swift-s", "swift-l", "delta-s", "delta-l"]
#: planes and tables of the index of several tables, for recall above that of the one table of the default
LSH_PLANES, LSH_TABLES = 10, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def usage_of(events: DataFrame) -> DataFrame:
    """Request log rows from an events frame, batch or streaming."""
    spark = events.sparkSession
    failed = F.col("event_type") == "error"
    base = events.select(
        F.col("event_id").alias("usage_id"),
        F.col("ts").alias("created_at"),
        (F.col("user_id") % 10).alias("virtual_key_id"),
        _pick(NAME_BY_EVENT, F.col("event_id") % 8).alias("requested_model"),
        _pick(MODEL_BY_EVENT, F.col("event_id") % 4).alias("resolved_model"),
        F.when(failed, "ERROR:ProviderUnavailableException").otherwise("SUCCESS").alias("status"),
        (F.col("event_type") == "view").alias("cache_hit"),
        (failed | ((F.col("event_type") == "signup") & (_k() % 2 == 0))).alias("fallback_used"),
        F.when(~failed, 10 + 7 * _k()).alias("prompt_tokens"),
        F.when(~failed, 1 + F.floor("value")).cast("int").alias("completion_tokens"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
    )
    priced = price_usage(base, dims.load_pricing(spark))
    return priced.select(
        "usage_id", "created_at", "virtual_key_id", "requested_model", "resolved_model",
        F.when(F.col("status") != "SUCCESS", None).when(F.col("cache_hit"), "cache")
        .otherwise(F.col("model_provider")).alias("provider"),
        "status", "prompt_tokens", "completion_tokens",
        F.when(F.col("cache_hit"), F.lit(0).cast("decimal(18,6)")).otherwise(F.col("cost_usd")).alias("cost_usd"),
        "cache_hit", "fallback_used", "latency_ms")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_of(table(spark, sf_dir, "events"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat requests: credential headers, model name, messages, sampling parameters."""
    e, n, k = spread(table(spark, sf_dir, "events"), "event_id").withColumn("k", _k()), F.col("event_id"), F.col("k")
    key = _pick(KEY_BY_USER, F.col("user_id") % 7)
    return e.select(
        n.alias("request_id"), "ts", key.alias("key_value"),
        F.when(n % 10 == 3, None).when(n % 2 == 0, F.concat(F.lit("Bearer "), key))
        .otherwise(F.concat(F.lit("bearer  "), key)).alias("authorization"),
        F.when(n % 10 == 3, F.concat(F.lit(" "), key, F.lit(" "))).alias("api_key"),
        _pick(NAME_BY_EVENT, n % 8).alias("model"),
        _pick([p for p, _, _ in LABELLED_PROMPTS], n % 11).alias("prompt"),
        _pick([t for _, t, _ in LABELLED_PROMPTS], n % 11).alias("expected_tier"),
        _pick([t for _, _, t in LABELLED_PROMPTS], n % 11).alias("trap"),
        F.when(n % 17 == 0, 2.5).when(n % 17 != 1, 0.5).alias("temperature"),
        F.when(k % 3 != 0, 10 * k).alias("max_tokens"),
        (n % 3 == 0).alias("stream"), (1 + F.floor("value")).cast("int").alias("completion_tokens"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
    ).withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))))


def raw_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the faults a client can send: blank model, role or content, no messages."""
    n = F.col("request_id")
    body = F.struct(
        F.when(n % 13 == 0, "").otherwise("user").alias("role"),
        F.when(n % 19 == 0, " \t").otherwise(F.col("prompt")).alias("content"))
    # the first turn is always valid, so that a fault sits at index 1
    first = F.struct(F.lit("system").alias("role"), F.lit("be brief").alias("content"))
    return requests(spark, sf_dir).select(
        "request_id", F.when(n % 29 == 0, "  ").otherwise(F.col("model")).alias("model"),
        F.when(n % 23 == 0, F.slice(F.array(first), 1, 0)).otherwise(F.array(first, body)).alias("messages"),
        "stream", "temperature", "max_tokens")


def request_bodies_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bodies as JSON text; odd requests spell the limit ``maxTokens``."""
    r, odd = raw_bodies(spark, sf_dir), F.col("request_id") % 2 == 1
    body = F.struct(
        "model", "messages", "stream", "temperature",
        F.when(~odd, F.col("max_tokens")).alias("max_tokens"), F.when(odd, F.col("max_tokens")).alias("maxTokens"))
    return r.select("request_id", F.to_json(body).alias("body"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form messages: request_id, turn, role, content."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request_id"), "turn", "role", F.col("text").alias("content"))


def turns_of(conversations: DataFrame, role: str) -> DataFrame:
    """Turns of one role as cache traffic, batch or streaming: id, tenant, model, prompt, ts."""
    stamp = F.col("conv_id") * 100 + F.col("turn")
    return conversations.filter(F.col("role") == role).select(
        stamp.alias("id"), F.concat(F.lit("team-"), (F.col("conv_id") % 4).cast("string")).alias("tenant"),
        F.lit("swift-s").alias("model"), F.col("text").alias("prompt"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(mins=stamp.cast("int"))).alias("ts"))


def _turns(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    return turns_of(table(spark, sf_dir, "conversations"), role)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as cache traffic: id, tenant, model, prompt, ts."""
    return _turns(spark, sf_dir, "user")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir, "assistant")


def doc_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("tenant"), F.lit("swift-s").alias("model"),
        F.col("text").alias("prompt"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied embeddings, scoped by label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("label-"), F.col("label").cast("string")).alias("tenant"),
        F.lit("swift-s").alias("model"), F.col("embedding").alias("vec"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispatch attempts: six per request, two chain positions of three attempts. A position ends with its first success
    or its first timeout, a request with its first success. Every third request streams."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.floor(n / 6).alias("request_id"), F.floor((n % 6) / 3).cast("int").alias("position"),
        (n % 3).cast("int").alias("attempt"), ((F.col("event_type") != "error") & (F.col("value") < 20)).alias("ok"),
        F.when(n % 7 == 2, "timeout").otherwise("unavailable").alias("kind"), "ts")
    last = rows.groupBy("request_id", "position").agg(
        F.coalesce(F.min(F.when(F.col("ok") | (F.col("kind") == "timeout"), F.col("attempt"))), F.lit(2)).alias("last"))
    kept = rows.join(last, ["request_id", "position"]).filter(F.col("attempt") <= F.col("last"))
    first = kept.filter("ok").groupBy("request_id").agg(F.min("position").alias("first_ok"))
    return (kept.join(first, "request_id", "left").filter(F.col("first_ok").isNull() | (F.col("position") <= F.col("first_ok")))
            .select("request_id", "position", "attempt", "ok", F.when(~F.col("ok"), F.col("kind")).alias("error_kind"),
                    (F.col("request_id") % 3 == 0).alias("stream"), "ts"))
