"""Long-form messages and completions: rendering, user text, chunking and reassembly.

A request's messages end up in one string, so grouping them by request gathers exactly what one output row holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.text import classify_tier, length_baseline, with_difficulty


def _in_order(*columns: str):
    return F.array_sort(F.collect_list(F.struct("turn", *columns)))


def render_prompt(messages: DataFrame) -> DataFrame:
    """request_id, prompt: 'role: content' lines of all messages in order."""
    lines = F.transform(_in_order("role", "content"),
                        lambda m: F.concat(m["role"], F.lit(": "), m["content"], F.lit("\n")))
    return messages.groupBy("request_id").agg(F.array_join(lines, "").alias("prompt"))


def user_text(messages: DataFrame) -> DataFrame:
    """request_id, user_text: user messages in order, each followed by a blank; else the last message."""
    mine = F.lower("role") == "user"
    said = F.array_sort(F.collect_list(F.when(mine, F.struct("turn", "content"))))
    joined = F.array_join(F.transform(said, lambda m: F.concat(m["content"], F.lit(" "))), "")
    last = F.max(F.struct("turn", "content"))["content"]
    return messages.groupBy("request_id").agg(
        F.when(F.count_if(mine) > 0, joined).otherwise(last).alias("user_text"))


def score_prompts(prompts: DataFrame, text: str = "prompt") -> DataFrame:
    """Adds the five signals, score, tier and baseline_tier."""
    return with_difficulty(prompts, text).withColumns({"tier": classify_tier(F.col("score")), "baseline_tier": length_baseline(F.col(text))})


def chunk_completion(completions: DataFrame, extra: list[str] = ()) -> DataFrame:
    """completion_id, position, delta, finish_reason, prompt_tokens, completion_tokens.

    One row per word, blank kept except on the last, then an end row that carries the usage."""
    # trailing empty words disappear, as in a plain split without limit
    trimmed = F.regexp_replace("content", " +$", "")
    words = F.when((trimmed == "") & (F.col("content") != ""), F.array().cast("array<string>")).otherwise(
        F.split(trimmed, " "))
    # words and their number are settled below the explode; an expression next to it would run once per exploded row
    split = completions.withColumn("_words", words).withColumn("n", F.size("_words"))
    exploded = split.select(
        "completion_id", "prompt_tokens", "completion_tokens", "n", *extra,
        F.posexplode(F.concat("_words", F.array(F.lit(None).cast("string")))).alias("position", "word"))
    end = F.col("position") == F.col("n")
    delta = F.when(end, "").when(F.col("position") < F.col("n") - 1, F.concat("word", F.lit(" "))).otherwise(F.col("word"))
    return exploded.select(
        "completion_id", "position", delta.alias("delta"), F.when(end, "stop").alias("finish_reason"),
        F.when(end, F.col("prompt_tokens")).alias("prompt_tokens"),
        F.when(end, F.col("completion_tokens")).alias("completion_tokens"), *extra)


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """completion_id, content, prompt_tokens, completion_tokens: deltas joined in order, usage from the end row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "delta")))
    return chunks.groupBy("completion_id").agg(
        F.array_join(F.transform(parts, lambda p: p["delta"]), "").alias("content"),
        F.max("prompt_tokens").alias("prompt_tokens"), F.max("completion_tokens").alias("completion_tokens"),
        F.max(F.col("finish_reason") == "stop").alias("complete"))
