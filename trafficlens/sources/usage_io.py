"""Usage events in and out: wire JSON to typed records, typed records to JSON files and to the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: shape of a wire time.
ISO_INSTANT = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z$"
WIRE = ("virtualKeyId bigint, requestedModel string, resolvedModel string, provider string, status string,"
        " promptTokens int, completionTokens int, costUsd string, cacheHit boolean, fallbackUsed boolean,"
        " latencyMs bigint, createdAt string, _corrupt_record string")
BODY = ("model string, messages array<struct<role: string, content: string>>, stream boolean, temperature double,"
        " max_tokens int, maxTokens int")

#: bits of a rank in the clustered layout of the fact table
CELL_BITS = 4


def to_wire(usage: DataFrame) -> DataFrame:
    """Adds wire: the JSON event of a request log row (cost as plain text, null cost as "0", time as ISO text)."""
    iso = F.concat(F.replace(F.col("created_at").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    event = F.struct(
        F.col("virtual_key_id").alias("virtualKeyId"), F.col("requested_model").alias("requestedModel"),
        F.col("resolved_model").alias("resolvedModel"), "provider", "status",
        F.col("prompt_tokens").alias("promptTokens"), F.col("completion_tokens").alias("completionTokens"),
        F.coalesce(F.col("cost_usd").cast("string"), F.lit("0")).alias("costUsd"),
        F.col("cache_hit").alias("cacheHit"), F.col("fallback_used").alias("fallbackUsed"),
        F.col("latency_ms").alias("latencyMs"), iso.alias("createdAt"))
    return usage.withColumn("wire", F.to_json(event))


def export_usage_events(usage: DataFrame, path: str) -> None:
    to_wire(usage).select("wire").write.mode("append").text(path)


def read_usage_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "wire")


def _parsed(rows: DataFrame, column: str, schema: str, mode: str) -> DataFrame:
    """Adds e, the parsed JSON of a column. The one-element explode keeps the optimizer from moving the parse into each
    filter and field that uses it: a document is parsed once."""
    return rows.select("*", F.explode(F.array(F.from_json(column, schema, {"mode": mode}))).alias("e"))


def ingest_usage(events: DataFrame, received_at: Column, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined) from a ``wire`` JSON column; other columns pass through.

    Missing cost is 0, missing time is ``received_at``; an unreadable cost, time or document quarantines the row, or
    fails the job when ``strict``."""
    read = _parsed(events, "wire", WIRE, "PERMISSIVE")
    e = F.col("e")
    cost = F.when(e["costUsd"].isNull(), F.lit(0).cast("decimal(18,6)")).otherwise(e["costUsd"].try_cast("decimal(18,6)"))
    # wire times are UTC: the zone mark is cut so that no session time zone can shift them
    instant = F.rlike(e["createdAt"], F.lit(ISO_INSTANT))
    when = F.when(e["createdAt"].isNull(), received_at).when(
        instant, F.regexp_replace(e["createdAt"], "Z$", "").try_cast("timestamp_ntz"))
    typed = read.withColumns({"_cost": cost, "_at": when})
    bad = e.isNull() | e["_corrupt_record"].isNotNull() | F.col("_cost").isNull() | F.col("_at").isNull()
    if strict:
        typed = typed.withColumn("_cost", F.when(bad, F.raise_error(F.concat(F.lit("bad usage event: "), "wire")).cast(
            "decimal(18,6)")).otherwise(F.col("_cost")))
        bad = F.lit(False)
    kept = [c for c in events.columns if c != "wire"]
    records = typed.filter(~bad).select(
        *kept, e["virtualKeyId"].alias("virtual_key_id"), e["requestedModel"].alias("requested_model"),
        e["resolvedModel"].alias("resolved_model"), e["provider"].alias("provider"), e["status"].alias("status"),
        e["promptTokens"].alias("prompt_tokens"), e["completionTokens"].alias("completion_tokens"),
        F.col("_cost").alias("cost_usd"), F.coalesce(e["cacheHit"], F.lit(False)).alias("cache_hit"),
        F.coalesce(e["fallbackUsed"], F.lit(False)).alias("fallback_used"),
        F.coalesce(e["latencyMs"], F.lit(0).cast("bigint")).alias("latency_ms"), F.col("_at").alias("created_at"))
    return records, typed.filter(bad).select(*kept, "wire")


def parse_requests(bodies: DataFrame, strict_types: bool = False) -> DataFrame:
    """JSON ``body`` to model, messages, stream, temperature, max_tokens (also spelled maxTokens), with defaults.

    Absent stream is false; temperature_or_default and completion_limit fill 0.7 and 256; the given values stay."""
    read, b = _parsed(bodies, "body", BODY, "FAILFAST" if strict_types else "PERMISSIVE"), F.col("e")
    kept = [c for c in bodies.columns if c != "body"]
    limit = F.coalesce(b["max_tokens"], b["maxTokens"])
    return read.select(
        *kept, b["model"].alias("model"), b["messages"].alias("messages"),
        F.coalesce(b["stream"], F.lit(False)).alias("stream"), b["temperature"].alias("temperature"),
        F.coalesce(b["temperature"], F.lit(0.7)).alias("temperature_or_default"), limit.alias("max_tokens"),
        F.coalesce(limit, F.lit(256)).alias("completion_limit"))


def write_usage(usage: DataFrame, path: str, mode: str = "append", partitions: int | None = None) -> None:
    """Fact files by day, sorted by key and time inside, for "this key, this period" reads.

    Range partitioning on (day, key, time) sizes files evenly even when one key or day dominates."""
    dated = usage.withColumn("created_on", F.to_date("created_at"))
    layout = ["created_on", "virtual_key_id", "created_at"]
    _laid_out(dated, layout, partitions).write.mode(mode).partitionBy("created_on").parquet(path)


def _laid_out(rows: DataFrame, layout: list[str], partitions: int | None) -> DataFrame:
    ranged = rows.repartitionByRange(partitions, *layout) if partitions else rows.repartitionByRange(*layout)
    return ranged.sortWithinPartitions(*layout)


def _rank(column: str, cuts: list) -> Column:
    """How many of the cuts lie below the value, 0 for null: its place among 2**CELL_BITS."""
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(column))), F.lit(0)) if cuts else F.lit(0)


def write_usage_clustered(usage: DataFrame, path: str, mode: str = "append", partitions: int | None = None) -> None:
    """Fact files by day, near in key and in provider alike, for "this key" and "this provider" reads of a period.

    Key and provider become ranks between quantiles of the rows, whose bits are interleaved; files hold ranges of that
    order and then of time, so each spans few keys and few providers, which the statistics in its footer tell. A hot key or
    provider takes several ranges, as time goes on within a cell. The providers, and the quantiles of the keys, reach the
    driver: 15 values each."""
    dated = usage.withColumn("created_on", F.to_date("created_at"))
    places = 1 << CELL_BITS
    shares = [k / places for k in range(1, places)]
    keys = usage.agg(F.percentile_approx("virtual_key_id", shares).alias("cuts")).first()["cuts"] or []
    names = [r["provider"] for r in usage.groupBy("provider").agg(F.count("*").alias("n")).filter("provider is not null")
             .orderBy(F.desc("n"), "provider").limit(places - 1).collect()]
    ranks = [_rank("virtual_key_id", sorted(set(keys))), _rank("provider", sorted(names))]
    cell = sum((F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)), 2 * bit + at)
                for bit in range(CELL_BITS) for at, rank in enumerate(ranks)), F.lit(0))
    layout = ["created_on", "_cell", "created_at"]
    (_laid_out(dated.withColumn("_cell", cell), layout, partitions).drop("_cell")
     .write.mode(mode).partitionBy("created_on").parquet(path))


def read_usage(spark: SparkSession, path: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """The fact table, or its rows with since <= created_at < until; folders of other days are not read."""
    rows = spark.read.parquet(path)
    if since is not None:
        rows = rows.filter((F.col("created_on") >= F.to_date(since)) & (F.col("created_at") >= since))
    if until is not None:
        rows = rows.filter((F.col("created_on") <= F.to_date(until)) & (F.col("created_at") < until))
    return rows


def write_batch(usage: DataFrame, path: str, writer: str, batch: int) -> None:
    """One micro-batch of a writer, in a folder of its own: writing it again replaces it, so that nothing counts twice."""
    write_usage(usage, f"{path}/writer={writer}/batch={batch}", "overwrite")


def read_batches(spark: SparkSession, path: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """All micro-batches of all writers, pruned by day as in read_usage."""
    return read_usage(spark, path, since, until).drop("writer", "batch")
