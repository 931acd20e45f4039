"""Small dimensions: price sheet, alias map, tenant keys, error codes.

Inline rows become local relations, so Catalyst knows their exact size and picks a broadcast join by itself
(`spark.sql.autoBroadcastJoinThreshold`); a large sheet read from JSON falls back to a shuffled join. No hint is forced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sample price sheet: model, provider, USD per 1000 prompt tokens, USD per 1000 completion tokens.
PRICING = [
    ("swift-s", "north", "0.0004", "0.0011"),
    ("swift-l", "north", "0.0022", "0.0091"),
    ("delta-s", "harbor", "0.0005", "0.0009"),
    ("delta-l", "harbor", "0.0041", "0.0123"),
    ("field-m", "meadow", "0.0012", "0.0031"),
]

# Sample aliases: alias, primary model, fallback chain. The tiers of the classifier are named fast and smart.
ALIASES = [
    ("fast", "swift-s", ["delta-s", "field-m"]),
    ("smart", "delta-l", ["swift-l", "field-m"]),
    ("bulk", "field-m", []),
]

# Sample keys: id, key value, tenant alias, allowed names, requests per minute, budget, active.
KEYS = [
    (11, "key-atlas", "atlas", ["fast", "smart", "auto", "bulk", "swift-s", "delta-l"], 45, "12.50", True),
    (12, "key-birch", "birch", ["fast", "auto", "swift-s", "delta-s"], 15, "2.75", True),
    (13, "key-cedar", "cedar", ["auto", "fast", "smart"], 90, "0.02", True),
    (14, "key-dune", "dune", [], 30, "20.00", False),
    (15, "key-ember", "ember", [], 30, "20.00", True),
    (16, "key-fjord", "fjord", ["smart", "bulk"], 10, "8.00", True),
]

# Error code, HTTP status, exception class recorded in the status column.
ERROR_CODES = [
    ("INVALID_VIRTUAL_KEY", 401, "InvalidVirtualKeyException"),
    ("MODEL_NOT_ALLOWED", 403, "ModelNotAllowedException"),
    ("RATE_LIMITED", 429, "RateLimitExceededException"),
    ("BUDGET_EXHAUSTED", 402, "BudgetExhaustedException"),
    ("VALIDATION_FAILED", 400, "MethodArgumentNotValidException"),
    ("PROVIDER_TIMEOUT", 504, "ProviderTimeoutException"),
    ("PROVIDER_UNAVAILABLE", 502, "ProviderUnavailableException"),
    ("ALL_PROVIDERS_EXHAUSTED", 503, "AllProvidersExhaustedException"),
    ("UNKNOWN_MODEL_ALIAS", 400, "UnknownModelAliasException"),
    ("CACHE_SERVICE_UNAVAILABLE", 200, "CacheServiceUnavailableException"),
    ("INTERNAL_ERROR", 500, "RuntimeException"),
]


def one_per(df: DataFrame, key: str, in_order: bool = False) -> DataFrame:
    """One row of each key. From a file, rows have an order, and the last entry of a key counts; a frame has none, and of
    several rows the one with the greatest values counts, column by column."""
    rest = F.struct(*(c for c in df.columns if c != key))
    if in_order:
        last = df.withColumn("_n", F.monotonically_increasing_id()).groupBy(key).agg(F.max_by(rest, "_n").alias("_last"))
    else:
        last = df.groupBy(key).agg(F.max(rest).alias("_last"))
    return last.select(*(F.col(key) if c == key else F.col(f"_last.{c}").alias(c) for c in df.columns))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _texts(values: list[str]) -> str:
    return f"array({', '.join(map(_text, values))})" if values else "cast(array() as array<string>)"


def load_pricing(spark: SparkSession, path: str | None = None) -> DataFrame:
    """model, provider, price_in, price_out — the built-in sheet, or a JSON array of the same facts."""
    if path:
        return one_per(spark.read.schema(
            "model string, provider string, inputPricePer1k decimal(12,6), outputPricePer1k decimal(12,6)"
        ).json(path, multiLine=True).withColumnsRenamed(
            {"inputPricePer1k": "price_in", "outputPricePer1k": "price_out"}), "model", in_order=True)
    rows = ", ".join(
        f"({_text(m)}, {_text(p)}, cast({i} as decimal(12,6)), cast({o} as decimal(12,6)))" for m, p, i, o in PRICING)
    return spark.sql(f"select * from values {rows} as t(model, provider, price_in, price_out)")


def load_aliases(spark: SparkSession, path: str | None = None) -> DataFrame:
    """alias, primary_model, chain — from rows, or from a JSON object {"aliases": {name: {primary, fallbackChain}}}."""
    if path:
        nested = spark.read.schema(
            "aliases map<string, struct<primary: string, fallbackChain: array<string>>>").json(path, multiLine=True)
        return nested.select(F.explode("aliases").alias("alias", "d")).select(
            "alias", F.col("d.primary").alias("primary_model"),
            F.coalesce("d.fallbackChain", F.array().cast("array<string>")).alias("chain"))
    rows = ", ".join(f"({_text(a)}, {_text(p)}, {_texts(c)})" for a, p, c in ALIASES)
    return spark.sql(f"select * from values {rows} as t(alias, primary_model, chain)")


def load_keys(spark: SparkSession, path: str | None = None) -> DataFrame:
    """key_id, key_value, tenant, allowed, rpm, budget, spend, active."""
    if path:
        raw = spark.read.schema(
            "keyValue string, alias string, allowedModels array<string>, requestsPerMinute int,"
            " monthlyBudgetUsd decimal(18,6)").json(path, multiLine=True)
        return one_per(raw, "keyValue", in_order=True).select(
            F.xxhash64("keyValue").alias("key_id"), F.col("keyValue").alias("key_value"), F.col("alias").alias("tenant"),
            F.array_distinct("allowedModels").alias("allowed"), F.col("requestsPerMinute").alias("rpm"),
            F.col("monthlyBudgetUsd").alias("budget"), F.lit(0).cast("decimal(18,6)").alias("spend"),
            F.lit(True).alias("active"))
    rows = ", ".join(
        f"({i}L, {_text(v)}, {_text(a)}, {_texts(m)}, {r}, cast({b} as decimal(18,6)), cast(0 as decimal(18,6)),"
        f" {str(on).lower()})" for i, v, a, m, r, b, on in KEYS)
    return spark.sql(f"select * from values {rows} as t(key_id, key_value, tenant, allowed, rpm, budget, spend, active)")


def error_codes(spark: SparkSession) -> DataFrame:
    """error_code, http_status, exception_name."""
    rows = ", ".join(f"({_text(c)}, {s}, {_text(e)})" for c, s, e in ERROR_CODES)
    return spark.sql(f"select * from values {rows} as t(error_code, http_status, exception_name)")


def seed_missing(keys: DataFrame, seed: DataFrame) -> DataFrame:
    """Existing keys plus the seed rows whose key_value has no active row; existing spend is left alone."""
    taken = keys.filter("active").select("key_value").distinct()
    fresh = seed.join(taken, "key_value", "left_anti")
    return keys.unionByName(fresh, allowMissingColumns=True)
