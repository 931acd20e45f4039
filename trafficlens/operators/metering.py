"""Costs: price sheet joins, estimates, true-up, status parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.text import estimate_tokens
from trafficlens.sources.dims import one_per

DEFAULT_COMPLETION_TOKENS = 256


def cost_of(prompt_tokens, completion_tokens, price_in, price_out):
    """USD to six decimals, rounded half up once after adding the input and the output part."""
    total = prompt_tokens.cast("decimal(10,0)") * price_in + completion_tokens.cast("decimal(10,0)") * price_out
    return (total * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(18,6)")


def _with_prices(rows: DataFrame, pricing: DataFrame, model: str) -> DataFrame:
    sheet = one_per(pricing, "model").select(
        F.col("model").alias("_model"), F.col("provider").alias("model_provider"), "price_in", "price_out")
    return rows.join(sheet, rows[model] == sheet["_model"], "left")


def price_usage(usage: DataFrame, pricing: DataFrame, model: str = "resolved_model") -> DataFrame:
    """Adds model_provider, cost_usd, total_tokens and price_error; a model without a price is an error row, kept."""
    return (
        _with_prices(usage, pricing, model)
        .withColumn("cost_usd", cost_of(
            F.col("prompt_tokens"), F.col("completion_tokens"), F.col("price_in"), F.col("price_out")))
        .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
        .withColumn("price_error", F.when(F.col("_model").isNull(), "UNKNOWN_MODEL_ALIAS"))
        .drop("_model", "price_in", "price_out"))


def provider_of(models: DataFrame, pricing: DataFrame, model: str = "model") -> DataFrame:
    """Adds the provider that serves each model (first by name when several do)."""
    serving = pricing.groupBy(F.col("model").alias("_model")).agg(F.min("provider").alias("provider"))
    return models.join(serving, models[model] == serving["_model"], "left").drop("_model")


def prompt_tokens_of(messages: DataFrame) -> DataFrame:
    """request_id, prompt_tokens from long-form messages; partial sums before the shuffle."""
    return messages.groupBy("request_id").agg(
        F.sum(estimate_tokens(F.col("content"))).cast("bigint").alias("prompt_tokens"))


def estimate_cost(requests: DataFrame, pricing: DataFrame, model: str = "primary_model") -> DataFrame:
    """Price of the estimated prompt plus max_tokens (256 when absent) on the primary model, as estimate_usd."""
    limit = F.coalesce("max_tokens", F.lit(DEFAULT_COMPLETION_TOKENS))
    return (_with_prices(requests, pricing, model)
            .withColumn("estimate_usd", cost_of(F.col("prompt_tokens"), limit, F.col("price_in"), F.col("price_out")))
            .drop("_model", "model_provider", "price_in", "price_out"))


def true_up(charges: DataFrame) -> DataFrame:
    """Ledger adjustments: actual - estimate, or a full refund on failure; zero deltas dropped, overruns flagged.

    Needs estimate_usd, cost_usd (actual) and failed."""
    delta = F.when(F.col("failed"), -F.col("estimate_usd")).otherwise(F.col("cost_usd") - F.col("estimate_usd"))
    return (charges.withColumn("delta_usd", delta.cast("decimal(18,6)"))
            .filter(F.col("delta_usd") != 0)
            .withColumn("over_estimate", F.col("delta_usd") > 0))


def parse_status(usage: DataFrame, errors: DataFrame) -> DataFrame:
    """Splits SUCCESS / ERROR:<exception> into outcome, error_name and the error code behind the exception."""
    failed = F.startswith(F.col("status"), F.lit("ERROR"))
    named = usage.withColumns({
        "outcome": F.when(failed, "ERROR").otherwise(F.col("status")),
        "error_name": F.when(failed, F.split_part(F.col("status"), F.lit(":"), F.lit(2)))})
    codes = errors.select(F.col("exception_name").alias("error_name"), "error_code")
    return named.join(codes, "error_name", "left")


def cache_savings(hits: DataFrame, pricing: DataFrame) -> DataFrame:
    """Cost avoided per tenant and model: hits are logged at cost 0 but keep the stored entry's token counts."""
    return (price_usage(hits, pricing).groupBy("virtual_key_id", "resolved_model")
            .agg(F.count("*").alias("hits"), F.sum("cost_usd").cast("decimal(18,6)").alias("saved_usd")))
