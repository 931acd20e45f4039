"""Secret scans: known forms by pattern, unknown ones by sliding-window Shannon entropy, in DataFrame operations only.

Spans are [start, end) in code points. Known forms (`BASE`) are found by regular expressions, leftmost and not
overlapping within a kind. Places follow from the pieces between matches: a split by the same expression.

Unknown secrets are searched in candidate strings: runs of at least `WINDOW` characters of one class. A window of
`WINDOW` characters slides over each; the sum of n log2 n over its character counts changes only by the character that
enters and the one that leaves, whose counts the window gives; entropy is log2 WINDOW less the mean of that sum. A
candidate is a secret if its highest window reaches the class's threshold and no allow-list expression suppresses it.
Base spans are never suppressed.

Null and empty texts have no spans. Repeated rows and null ids are rows of their own. Extra columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

_NAME = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""(?:{_NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, expression, expression of the group that counts, group, least code points. Runs of a single class shorter than
#: asked for are no matches at all, which gives the same spans as dropping them afterwards.
BASE = [
    ("assign", _ASSIGN, _ASSIGN, 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", r"[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", r"[0-9a-f]+", 0, 24),
]
WINDOW = 20
#: a run is whole if no character of a candidate stands before or behind it
_BEFORE, _BEHIND = "(?<![A-Za-z0-9+/_=-])", "(?![A-Za-z0-9+/_=-])"
#: pairs of letters that words do without
_ODD = "q(?!u)|j[b-df-hj-np-tv-z]|x[bdfghjkmnqrsvwxz]|[vz][bdfgjkmnpqtx]"
#: kind, candidate runs, what a candidate must also contain, and the least entropy of its highest window
CLASSES = [
    ("entropy_hex", r"[0-9A-Fa-f]{20,}", [r"[0-9]", r"[A-Fa-f]"], 2.8),
    ("entropy_mixed", r"[A-Za-z0-9+/_=-]{20,}", [r"[0-9]", r"[A-Z]", r"[a-z]"], 3.5),
    # whole runs of fewer kinds of characters; digits between letters, or letters as no word has them, tell them from names
    ("entropy_lower", rf"{_BEFORE}[a-z0-9]{{20,}}{_BEHIND}", [r"[g-z]", r"[a-z][0-9]+[a-z]"], 3.4),
    ("entropy_upper", rf"{_BEFORE}[A-Z0-9]{{20,}}{_BEHIND}", [r"[G-Z]", r"[A-Z][0-9]+[A-Z]"], 3.4),
    ("entropy_letters", rf"{_BEFORE}[A-Za-z]{{20,}}{_BEHIND}", [rf"(?i)(?:{_ODD}).*(?:{_ODD})"], 3.4),
]
#: candidates that are no secrets: UUIDs, runs of one word and digits, dates and versions, paths, placeholders
ALLOW = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]+[-_=/]*[0-9]{1,8}$",
    r"^[0-9+/_=-]*$",
    r"^(/?[A-Za-z_-]{2,}[0-9]{0,4}/)+[A-Za-z0-9_-]*$",
    r"(?i)example|placeholder|your[-_]?(key|token)|x{6,}|0123456789|abcdefgh",
]


def entropy(s: Column, window: int = WINDOW) -> Column:
    """The highest entropy of a window over s, by incremental counts; s has at least `window` characters."""
    terms = F.array(*(F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(window + 1)))
    gain = lambda n: F.get(terms, n + 1) - F.get(terms, n)

    def lowest(chars: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:  # i counts from 0; the window holds window - 1 characters that stay
            stays = F.slice(chars, F.greatest(i - window + 2, F.lit(1)), F.least(i, F.lit(window - 1)))
            count = lambda c: F.size(F.filter(stays, lambda x: x == c))
            total = acc["sum"] + gain(count(F.get(chars, i))) - F.when(i >= window, gain(count(F.get(chars, i - window)))).otherwise(0.0)
            return F.struct(total.alias("sum"), F.when(i >= window - 1, F.least(acc["low"], total)).otherwise(acc["low"]).alias("low"))

        # the sum over all counts of the window, and its least value so far
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(1e9).alias("low"))
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda acc: acc["low"])

    # as the argument of a lambda the characters are split once
    low = F.get(F.transform(F.array(F.split(s, "")), lowest), 0)
    return F.lit(math.log2(window)) - low / window


def _spans(kind: str, order: int, pattern: str, keep, text: Column) -> Column:
    """Spans of the matches that `keep` holds for, from the matches and the pieces of text before each."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"))
    item = "struct<start:bigint,order:int,kind:string,end:bigint>"
    none, nones = F.array().cast(f"array<{item}>"), F.array().cast(f"array<array<{item}>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), end.alias("end"))
        now = F.when(keep(x["match"]), F.concat(acc["now"], F.array(span))).otherwise(acc["now"])
        full = F.size(acc["now"]) >= 128  # spans are gathered in blocks, which keeps appending cheap
        return F.struct(
            F.coalesce(end, acc["at"]).alias("at"),
            F.when(full, F.when(keep(x["match"]), F.array(span)).otherwise(none)).otherwise(now).alias("now"),
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("now"), nones.alias("done"))
    found = F.aggregate(each, begin, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["now"]))
    return F.when(text.rlike(pattern), found).otherwise(none)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=CLASSES, allow=ALLOW,
                 window: int = WINDOW) -> DataFrame:
    """doc_id and spans array<struct<start, order, kind, end>>, by start, then kind as listed; one row per document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    base = [_spans(kind, k, pattern, lambda m, p=checked, g=group, n=least: F.length(F.regexp_extract(m, p, g)) >= n, text)
            for k, (kind, pattern, checked, group, least) in enumerate(BASE)]

    def secret(needs: list[str], threshold: float):
        def keep(m: Column) -> Column:
            ok = m.isNotNull()
            for need in needs:
                ok = ok & m.rlike(need)
            for pattern in allow:
                ok = ok & ~m.rlike(pattern)
            return F.when(ok, entropy(m, window) >= threshold).otherwise(False)
        return keep

    found = [_spans(kind, len(BASE) + k, pattern, secret(needs, threshold), text) for k, (kind, pattern, needs, threshold) in enumerate(classes)]
    # entropy adds what known forms have not found
    out = docs.select("doc_id", F.concat(*base).alias("base"), F.concat(*found).alias("more"))
    new = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return out.select("doc_id", F.sort_array(F.concat("base", new)).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
