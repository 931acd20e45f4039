"""Usage reports. Every report is one scan with partial aggregation; time filters reach the parquet reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.clock import minus_days

MAX_PAGE = 100


def _zero() -> Column:
    return F.lit(0).cast("decimal(18,6)")


def _since(usage: DataFrame, since: Column) -> DataFrame:
    return usage.filter(F.col("created_at") >= since)


def _cost() -> Column:
    return F.coalesce(F.sum("cost_usd").cast("decimal(18,6)"), _zero())


def key_totals_since(usage: DataFrame, since: Column) -> DataFrame:
    """Per key: total_cost_usd, total_requests, cache_hits — three figures, one pass."""
    return _since(usage, since).groupBy("virtual_key_id").agg(
        _cost().alias("total_cost_usd"), F.count("*").alias("total_requests"),
        F.count_if("cache_hit").alias("cache_hits"))


def key_cost_since(usage: DataFrame, since: Column) -> DataFrame:
    return key_totals_since(usage, since).select("virtual_key_id", "total_cost_usd")


def key_requests_since(usage: DataFrame, since: Column) -> DataFrame:
    return key_totals_since(usage, since).select("virtual_key_id", "total_requests")


def key_cache_hits_since(usage: DataFrame, since: Column) -> DataFrame:
    return key_totals_since(usage, since).select("virtual_key_id", "cache_hits")


def usage_summary(usage: DataFrame, keys: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """One row per key, also for keys without traffic (hit rate 0.0 then)."""
    totals = key_totals_since(usage, minus_days(as_of, days)).withColumnRenamed("virtual_key_id", "key_id")
    n, hits = F.coalesce("total_requests", F.lit(0)), F.coalesce("cache_hits", F.lit(0))
    return keys.join(totals, "key_id", "left").select(
        "key_id", "tenant", F.lit(days).alias("window_days"), n.alias("total_requests"),
        F.coalesce("total_cost_usd", _zero()).alias("total_cost_usd"), hits.alias("cache_hits"),
        F.when(n == 0, 0.0).otherwise(hits / n).alias("cache_hit_rate"), "budget", "spend")


def provider_breakdown(usage: DataFrame, since: Column) -> DataFrame:
    """Requests, cost and mean latency per provider, busiest first (ties by name)."""
    return (_since(usage, since).filter(F.col("provider").isNotNull()).groupBy("provider")
            .agg(F.count("*").alias("request_count"), _cost().alias("total_cost_usd"),
                 F.avg("latency_ms").alias("avg_latency_ms"))
            .orderBy(F.desc("request_count"), "provider"))


def top_providers(usage: DataFrame, since: Column, n: int) -> DataFrame:
    return provider_breakdown(usage, since).limit(n)


def total_spend_since(usage: DataFrame, since: Column) -> DataFrame:
    return _since(usage, since).agg(_cost().alias("total_spend_usd"))


def fallback_count_since(usage: DataFrame, since: Column) -> DataFrame:
    return _since(usage, since).agg(F.count_if("fallback_used").alias("fallback_count"))


def usage_report(usage: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row: window, total spend, fallbacks and the provider breakdown as an array, from a single scan.

    Rows are first reduced to one per provider (null included), so the array holds providers, never requests."""
    per = _since(usage, minus_days(as_of, days)).groupBy("provider").agg(
        F.count("*").alias("n"), F.sum("cost_usd").alias("cost"), F.sum("latency_ms").alias("lat"),
        F.count("latency_ms").alias("lat_n"), F.count_if("fallback_used").alias("fb"))
    line = F.when(F.col("provider").isNotNull(), F.struct(
        (-F.col("n")).alias("rank"), "provider", F.col("n").alias("request_count"),
        F.coalesce(F.col("cost").cast("decimal(18,6)"), _zero()).alias("total_cost_usd"),
        (F.col("lat") / F.col("lat_n")).alias("avg_latency_ms")))
    ordered = F.array_sort(F.collect_list(line))
    return per.agg(
        F.lit(days).alias("window_days"),
        F.coalesce(F.sum("cost").cast("decimal(18,6)"), _zero()).alias("total_spend_usd"),
        F.coalesce(F.sum("fb"), F.lit(0)).alias("fallback_count"),
        F.transform(ordered, lambda x: F.struct(
            x["provider"].alias("provider"), x["request_count"].alias("request_count"),
            x["total_cost_usd"].alias("total_cost_usd"), x["avg_latency_ms"].alias("avg_latency_ms"),
        )).alias("by_provider"))


def served_by(usage: DataFrame) -> DataFrame:
    """What the response headers said, counted: provider, HIT/MISS, fallback, cost per tenant."""
    return (usage.withColumn("cache", F.when(F.col("cache_hit"), "HIT").otherwise("MISS"))
            .groupBy("virtual_key_id", "provider", "cache", "fallback_used")
            .agg(F.count("*").alias("requests"), _cost().alias("cost_usd")))


def recent_requests(usage: DataFrame, page: int = 0, size: int = 25) -> DataFrame:
    """A page of each key's newest requests, with the key's total.

    The rank filter lets Spark keep only the page's rows of each key in every map task before the shuffle; the total
    comes from its own pre-aggregated count, so a very busy key is never gathered in one task."""
    if size > MAX_PAGE:
        raise ValueError(f"a page has at most {MAX_PAGE} rows, not {size}")
    newest = Window.partitionBy("virtual_key_id").orderBy(F.desc("created_at"), F.desc("usage_id"))
    slim = usage.select("virtual_key_id", "usage_id", "created_at", "resolved_model", "status", "cost_usd")
    last = (page + 1) * size
    ranked = slim.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= last)
    totals = usage.groupBy("virtual_key_id").agg(F.count("*").alias("total_requests"))
    return ranked.filter(F.col("rank") > page * size).join(totals, "virtual_key_id")


def status_histogram(outcomes: DataFrame, by: list[str]) -> DataFrame:
    ok, limited, broke = (F.count_if(F.col("http_status") == s) for s in (200, 429, 402))
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("total"), ok.alias("ok"), limited.alias("rate_limited"),
        broke.alias("budget_exhausted"), (F.count("*") - ok - limited - broke).alias("other"))


def latency_percentiles(usage: DataFrame, by: list[str], points=(0.50, 0.95, 0.99), block: int = 1024) -> DataFrame:
    """Exact percentiles at index min(n-1, int(n*p)), and the mean to one decimal.

    Rows shrink to a histogram of distinct latencies before any ordering. Ranks come from two levels, running counts
    of whole blocks of 1024 ms and running counts inside a block, so no task sees more than a block of distinct values
    (or the list of blocks)."""
    at = [F.lit(i) for i in by] if not by else [F.col(c) for c in by]
    hist = (usage.filter(F.col("latency_ms").isNotNull())
            .groupBy(*by, F.floor(F.col("latency_ms") / block).alias("block"), "latency_ms")
            .agg(F.count("*").alias("c")))
    blocks = hist.groupBy(*by, "block").agg(
        F.sum("c").alias("bc"), F.sum(F.col("c") * F.col("latency_ms")).alias("bs"))
    upto = Window.partitionBy(*at).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*at)
    blocks = blocks.select(
        *(F.col(c).alias(f"_{c}") for c in by), F.col("block").alias("_block"),
        F.coalesce(F.sum("bc").over(upto), F.lit(0)).alias("before"),
        F.sum("bc").over(whole).alias("n"), F.sum("bs").over(whole).alias("total"))
    # null groups count too
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "block"]]
    inside = Window.partitionBy(*by, "block").orderBy("latency_ms")
    ranked = (hist.withColumn("upto", F.sum("c").over(inside)).join(blocks, same)
              .withColumn("hi", F.col("before") + F.col("upto")).withColumn("lo", F.col("hi") - F.col("c")))
    index = [F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(float(p)))) for p in points]
    picks = [F.max(F.when((F.col("lo") <= i) & (i < F.col("hi")), F.col("latency_ms"))).alias(f"p{round(p * 100)}")
             for i, p in zip(index, points)]
    return ranked.groupBy(*by).agg(
        F.max("n").alias("n"), *picks, F.round(F.max("total") / F.max("n"), 1).alias("mean"))


def latency_percentiles_approx(usage: DataFrame, by: list[str], points=(0.50, 0.95, 0.99)) -> DataFrame:
    """The one-pass sketch, for dashboards that do not need exact ranks."""
    return usage.groupBy(*by).agg(*[
        F.percentile_approx("latency_ms", p).alias(f"p{round(p * 100)}") for p in points])


def sorted_latencies(usage: DataFrame) -> DataFrame:
    return usage.select("usage_id", "latency_ms").orderBy("latency_ms", "usage_id")


def routing_accuracy(labelled: DataFrame) -> DataFrame:
    """Share of right tiers per trap for the classifier and for the length rule; passes when strictly better.

    Needs tier, baseline_tier, expected_tier, trap."""
    right = (F.col("tier") == F.col("expected_tier")).cast("double")
    base = (F.col("baseline_tier") == F.col("expected_tier")).cast("double")
    return labelled.groupBy("trap").agg(
        F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.avg(base).alias("baseline_accuracy"),
        (F.sum(right) > F.sum(base)).alias("beats_baseline"))


def over_admission_check(admitted: DataFrame, key: str) -> DataFrame:
    """Per key: admitted requests against the allowance and accepted spend against the budget.

    Needs admitted (flag), cost, allowance, budget."""
    took = F.count_if("admitted")
    spent = F.coalesce(F.sum(F.when(F.col("admitted"), F.col("cost"))), F.lit(0)).cast("decimal(18,6)")
    return admitted.groupBy(key).agg(
        took.alias("admitted"), spent.alias("spent"),
        (took <= F.max("allowance")).alias("within_allowance"), (spent <= F.max("budget")).alias("within_budget"))


def rejection_report(rejections: DataFrame, errors: DataFrame) -> DataFrame:
    """Rejections per tenant, code and HTTP status, with the mean Retry-After in whole seconds."""
    counted = rejections.groupBy("tenant", "error_code").agg(
        F.count("*").alias("rejections"),
        F.avg(F.floor(F.col("retry_after_ms") / 1000)).alias("mean_retry_after_s"))
    return counted.join(errors.select("error_code", "http_status"), "error_code").select(
        "tenant", "error_code", "http_status", "rejections", "mean_retry_after_s")
