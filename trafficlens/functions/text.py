"""Prompt text as column expressions: difficulty signals, tier, prompt rendering, token estimates, credentials, chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that mark a prompt as hard (matched as substrings of the lowercased text).
HARD_KEYWORDS = [
    "prove", "why", "explain", "derive", "optimi", "algorithm", "debug", "architecture",
    "compare", "trade-off", "tradeoff", "design", "analyze", "analyse", "reason", "complexity",
    "concurrency", "distributed", "security", "vulnerability", "proof", "theorem", "step by step",
    "tcp", "handshake", "protocol", "lock", "mutex", "database", "cap theorem", "irrational",
    "indexoutofbounds", "deadlock",
]
# Phrases of multi-step requests.
STEP_PHRASES = ["and then", "after that", "next,", "step by step"]
# Fixed value: code or mathematics in the original-case text.
CODE_OR_MATH = r"[{}<>=;()\[\]]|```|\b(sqrt|sum|integral|O\()\b"
#: its single marks, and what a text without any of them must hold to match it
CODE_MARKS, CODE_WORDS = r"[{}<>=;()\[\]]", ["```", "sqrt", "sum", "integral"]
#: what \s matches
SPACES = " \t\n\x0b\f\r"
# Weights of keyword, code, multi-step, lexical and length signals; bar of the smart tier.
WEIGHTS = (0.40, 0.25, 0.20, 0.10, 0.05)
SMART_AT = 0.35
BASELINE_WORDS = 40


def _hits(haystack: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(haystack, F.lit(n)).cast("int") for n in needles])


def word_count(text: Column) -> Column:
    """Whitespace-separated words; trailing blanks do not count, a leading blank does."""
    trailing = F.when(F.substring(text, -1, 1).isin(*SPACES), 1).otherwise(0)
    return F.greatest(F.lit(1), F.size(F.split(text, r"\s+")) - trailing)


def has_code(text: Column) -> Column:
    """Whether CODE_OR_MATH matches. Its alternatives are tried at every character, so it is left to the texts that need it."""
    word = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in CODE_WORDS])
    return F.rlike(text, F.lit(CODE_MARKS)) | (word & F.rlike(text, F.lit(CODE_OR_MATH)))


def with_difficulty(rows: DataFrame, text: str) -> DataFrame:
    """Adds the five signals and the score of a text column.

    The lowercased text and the word count are columns of their own: Catalyst keeps a projection whose costly result is
    used many times, so each is computed once per row and not once per keyword."""
    low, words = F.col("_lower"), F.col("_words")
    staged = rows.withColumn("_lower", F.lower(text)).withColumn("_words", word_count(low))
    letters = F.length(F.replace(low, F.lit(" "), F.lit("")))
    marks = F.length(text) - F.length(F.replace(F.col(text), F.lit("?"), F.lit("")))
    half = F.lit(0.5)
    signals = {
        "keyword_signal": F.least(F.lit(1.0), _hits(low, HARD_KEYWORDS) / F.lit(2.0)),
        "code_signal": F.when(has_code(F.col(text)), 1.0).otherwise(0.0),
        "step_signal": F.least(
            F.lit(1.0), F.when(marks > 1, half).otherwise(0.0) + _hits(low, STEP_PHRASES) * half),
        "lexical_signal": F.least(F.lit(1.0), F.greatest(F.lit(0.0), (letters / words - 4.0) / 4.0)),
        "length_signal": F.least(F.lit(1.0), words / F.lit(400.0)),
    }
    weighted = [F.lit(w) * F.col(name) for w, name in zip(WEIGHTS, signals)]
    return (staged.withColumns(signals)
            .withColumn("score", F.least(F.lit(1.0), reduce(lambda a, b: a + b, weighted)))
            .drop("_lower", "_words"))


def classify_tier(score: Column) -> Column:
    return F.when(score >= SMART_AT, "smart").otherwise("fast")


def length_baseline(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) > BASELINE_WORDS, "smart").otherwise("fast")


def estimate_tokens(text: Column) -> Column:
    """About four characters per token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def estimate_message_tokens(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0), lambda acc, m: acc + estimate_tokens(m["content"]))


def render_messages(messages: Column) -> Column:
    return F.array_join(
        F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"], F.lit("\n"))), "")


def user_text_of(messages: Column) -> Column:
    """User messages, each followed by a blank; without any, the last message."""
    mine = F.filter(messages, lambda m: F.lower(m["role"]) == "user")
    joined = F.array_join(F.transform(mine, lambda m: F.concat(m["content"], F.lit(" "))), "")
    return F.when(F.size(mine) > 0, joined).otherwise(F.element_at(messages, -1)["content"])


def extract_credential(authorization: Column, api_key: Column) -> Column:
    """The bearer token, else the key header, else ''. Only blanks and control characters are trimmed."""
    bearer = F.lower(F.substring(authorization, 1, 7)) == "bearer "
    raw = F.when(bearer, F.substr(authorization, F.lit(8))).otherwise(F.coalesce(api_key, F.lit("")))
    return F.btrim(raw, F.lit("".join(map(chr, range(0x21)))))


def is_blank(text: Column) -> Column:
    return F.coalesce(~F.rlike(text, F.lit(r"[^\x00-\x20]")), F.lit(True))
