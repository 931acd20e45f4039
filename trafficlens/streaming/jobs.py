"""Streaming twins of the batch operators, on Structured Streaming state.

Rows of one key that arrive in one micro-batch are ordered by (time, id) before they are applied; a row that arrives in
a later batch is applied on arrival. Feeding a source in time order therefore gives the batch result. The size of a
micro-batch (``maxFilesPerTrigger`` or the source's own limit) bounds what one key brings into a task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trafficlens.functions.clock import epoch_us, instant, wall_time
from trafficlens.operators.admission import MICRO, BreakerFold, RateFold, SpendFold
from trafficlens.operators.scan import Fold
from trafficlens.session import scratch_path
from trafficlens.sources import usage_io

_STATE = T.StructType([T.StructField("state", T.BinaryType())])
SWEEP_MS = 60_000
#: rows of a key that are folded at once
STEP_ROWS = 20_000


def _marked(rows: DataFrame, lateness: str | None) -> DataFrame:
    """rows with a watermark on `at`, or as they are where nothing is ever late."""
    return rows if lateness is None else rows.withWatermark("at", lateness)


def _timeout(lateness: str | None) -> str:
    return GroupStateTimeout.NoTimeout if lateness is None else GroupStateTimeout.EventTimeTimeout


def read_table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A parquet table as a stream of files; the table is one file or a folder of part files. A missing one fails."""
    path = f"{sf_dir}/{name}.parquet"
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_per_trigger)
    if [f.rstrip("/").rsplit("/", 1)[-1] for f in table.inputFiles()] == [f"{name}.parquet"]:
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(path)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Drain the available input into a parquet table in the shared folder and read it back."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", scratch_path(spark, name + "-log"))
             .trigger(availableNow=True).start(path))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_to_latest(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Drain the available input in update mode and read back the last value of each key.

    Every micro-batch writes its own folder, by overwriting, so that a batch that is run again does no harm."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/number={number}")

    query = (stream.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", scratch_path(spark, name + "-log")).trigger(availableNow=True).start())
    query.awaitTermination()
    if not any(p["numInputRows"] for p in query.recentProgress):
        return spark.createDataFrame([], stream.schema)
    rest = [c for c in stream.columns if c not in keys]
    batches = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("number", T.LongType())])).parquet(path)
    last = batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), "number").alias("_last"))
    return last.select(*(F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in stream.columns))


def _fold_stream(rows: DataFrame, key: str, order: list[str], fold: Fold) -> DataFrame:
    keep = [f for f in rows.schema if f.name == key or f.name in order]
    added = [T.StructField(n, T.DataType.fromDDL(kind)) for n, (kind, _) in fold.output.items()]

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState):
        batch = pd.concat(list(frames), ignore_index=True).sort_values(order, ignore_index=True)
        after = pickle.loads(state.get[0]) if state.exists else fold.start()
        # a key's rows are held as columns; only those of one step become Python objects
        for a in range(0, len(batch), STEP_ROWS):
            part = batch.iloc[a:a + STEP_ROWS]
            found, after = fold.run(after, {c: part[c].to_numpy() for c in fold.columns})
            done = part[[f.name for f in keep]].copy()
            for column, values in found.items():
                done[column] = pd.Series(values, dtype=object, index=done.index)
            yield done
        state.update((pickle.dumps(after),))

    return rows.groupBy(key).applyInPandasWithState(
        step, T.StructType([*keep, *added]), _STATE, "append", GroupStateTimeout.NoTimeout)


def rate_limit_stream(requests: DataFrame, key: str, ts: str, row_id: str, capacity: Column,
                      window_us: int = 60 * MICRO) -> DataFrame:
    rows = requests.select(key, row_id, epoch_us(F.col(ts)).alias("us"), capacity.alias("capacity"))
    return _fold_stream(rows, key, ["us", row_id], RateFold(window_us))


def budget_stream(entries: DataFrame, key: str, ts: str, row_id: str, amount: Column, guarded: Column,
                  budget: Column) -> DataFrame:
    micro = [(c.cast("decimal(18,6)") * F.lit(MICRO)).cast("bigint") for c in (amount, budget)]
    rows = entries.select(
        key, row_id, epoch_us(F.col(ts)).alias("us"), micro[0].alias("amount"), guarded.alias("guarded"),
        micro[1].alias("budget_micro"), F.lit(0).cast("bigint").alias("opening"))
    return _fold_stream(rows, key, ["us", row_id], SpendFold())


def breaker_stream(attempts: DataFrame, key: str, ts: str, row_id: str, failed: Column, threshold: int = 3,
                   cooldown_us: int = 10 * MICRO) -> DataFrame:
    rows = attempts.select(key, row_id, epoch_us(F.col(ts)).alias("us"), failed.alias("failed"))
    return _fold_stream(rows, key, ["us", row_id], BreakerFold(threshold, cooldown_us))


def cache_stream(prompts: DataFrame, threshold: float, ttl_seconds: int, lateness: str | None = "10 minutes") -> DataFrame:
    """Hits and misses per scope over a stream of (id, tenant, model, ts, vec); entries live ttl seconds.

    State: the live entries of a scope (id, time, unit vector). Only misses are stored, so it holds prompts that are
    mutually dissimilar, never copies. Expired entries go on every batch; an idle scope is swept by an event-time timer.
    Rows later than `lateness` are left out; with None, for a stored table, none are, and there are no timers."""
    ttl = ttl_seconds * MICRO
    rows = _marked(prompts.select(
        "id", "tenant", "model", instant(F.col("ts")).alias("at"), epoch_us(F.col("ts")).alias("us"), "vec",
    ), lateness)

    def unit(vectors):
        m = np.stack(vectors).astype(np.float64)
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m, size[:, 0]

    def step(scope, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        ids, times, vecs = pickle.loads(state.get[0]) if state.exists else ([], [], [])
        batch = pd.concat(list(frames), ignore_index=True).sort_values(["us", "id"], ignore_index=True)
        matrix, sizes = unit(batch["vec"].to_numpy())
        hit, match, score = [], [], []
        for i, (now, row) in enumerate(zip(batch["us"].tolist(), batch["id"].tolist())):
            live = [j for j, t in enumerate(times) if t + ttl >= now]
            if len(live) < len(times):
                ids, times, vecs = ([s[j] for j in live] for s in (ids, times, vecs))
            best = None
            if vecs and sizes[i] > 0:
                stored, lengths = unit(vecs)
                scale = lengths * sizes[i]
                sims = np.divide(stored @ matrix[i], scale, out=np.zeros_like(scale), where=scale > 0)
                top = sims.max()
                if top >= threshold:
                    best = min(ids[j] for j in np.flatnonzero(sims == top)), float(top)
            if best is None:
                ids, times, vecs = [*ids, row], [*times, now], [*vecs, batch["vec"].iat[i]]
            hit.append(best is not None)
            match.append(best[0] if best else None)
            score.append(round(best[1], 6) if best else 0.0)
        state.update((pickle.dumps((ids, times, vecs)),))
        if lateness is not None:
            last = (max(times) + ttl) // 1000 + SWEEP_MS if times else 0
            state.setTimeoutTimestamp(int(max(last, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame({
            "id": batch["id"], "us": batch["us"], "hit": hit,
            "match_id": pd.Series(match, dtype=object), "similarity": score})

    return rows.groupBy("tenant", "model").applyInPandasWithState(
        step, "id bigint, us bigint, hit boolean, match_id bigint, similarity double", _STATE, "append",
        _timeout(lateness))


def usage_rollup_stream(usage: DataFrame, window: str = "1 day", lateness: str | None = "1 hour") -> DataFrame:
    """Requests, cost, fallbacks and latency per window and provider; in update mode each window comes as it grows.

    The watermark only bounds the state: rows that come later than `lateness` behind the newest are left out.
    With None, for a stored table whose files come in any order, none are, and all windows are kept to the end."""
    return (_marked(usage.withColumn("at", instant(F.col("created_at"))), lateness)
            .groupBy(F.window("at", window), "provider")
            .agg(F.count("*").alias("request_count"),
                 F.coalesce(F.sum("cost_usd").cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)")).alias("total_cost_usd"),
                 F.count_if("fallback_used").alias("fallback_count"), F.avg("latency_ms").alias("avg_latency_ms"))
            .select(wall_time(F.col("window.start")).alias("window_start"), "provider", "request_count", "total_cost_usd",
                    "fallback_count", "avg_latency_ms"))


def assemble_chunks_stream(chunks: DataFrame, timeout_ms: int = 60_000, lateness: str | None = "10 minutes") -> DataFrame:
    """A completion's text once its end row and all rows before it have arrived; an unfinished one goes after 60 s of
    event time. With a `lateness` of None, for a stored table whose files come in any order, no row is late and unfinished
    ones wait to the end.

    Needs completion_id, position, delta, finish_reason, prompt_tokens, completion_tokens, ts."""
    rows = _marked(chunks.select(
        "completion_id", "position", "delta", "finish_reason", "prompt_tokens", "completion_tokens",
        instant(F.col("ts")).alias("at"), F.floor(epoch_us(F.col("ts")) / 1000).alias("ms")), lateness)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        parts, end, newest = pickle.loads(state.get[0]) if state.exists else ({}, None, 0)
        for frame in frames:
            parts.update(zip(frame["position"].tolist(), frame["delta"].tolist()))
            newest = max(newest, int(frame["ms"].max()))
            closing = frame[frame["finish_reason"] == "stop"]
            if len(closing):
                row = closing.iloc[0]
                end = int(row["position"]), int(row["prompt_tokens"]), int(row["completion_tokens"])
        if end is not None and len(parts) == end[0] + 1:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"completion_id": [key[0]], "content": ["".join(parts[i] for i in sorted(parts))],
                                "prompt_tokens": [end[1]], "completion_tokens": [end[2]]})
        else:
            state.update((pickle.dumps((parts, end, newest)),))
            if lateness is not None:
                state.setTimeoutTimestamp(max(newest + timeout_ms, state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("completion_id").applyInPandasWithState(
        step, "completion_id bigint, content string, prompt_tokens int, completion_tokens int", _STATE, "append",
        _timeout(lateness))


def ingest_usage_stream(records: DataFrame, name: str = "usage") -> tuple[DataFrame, DataFrame]:
    """(local, central): the same stream appended to two tables by two independent queries, so that a failing central
    table never holds back the local one."""
    return run_to_table(records, name + "-local"), run_to_table(records, name + "-central")


def usage_sink(records: DataFrame, path: str, writer: str, log: str) -> None:
    """Drains a stream of usage records into the fact table at `path`, each row once, whatever is run again.

    The log keeps the range of the input that each micro-batch stands for. A micro-batch that fails, or whose end was not
    noted, runs again over the same range after the restart and replaces the folder its first run left. A writer and its log
    belong together: another log under one name would replace that writer's batches, so the log lies under its name.
    Several sinks of one stream are writers with tables of their own and do not wait for each other. While a batch is
    written, readers may see part of it."""
    query = (records.writeStream
             .foreachBatch(lambda rows, batch: usage_io.write_batch(rows, path, writer, batch))
             .option("checkpointLocation", f"{log}/{writer}").trigger(availableNow=True).start())
    query.awaitTermination()
