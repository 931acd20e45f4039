"""Language identification by hierarchical discrimination.

A linear model first tells the family (one-versus-rest support vector machines), then one-versus-one linear support
vector machines tell the languages of that family apart. Features are shares of hashed character bigrams and trigrams of
the whole text, lower-cased, with every run of non-letters as one space.

Fitting sees about `SAMPLE` documents of each language at most, drawn by a hash of the id; each machine is fitted in a
task of its own on the rows it needs. Languages that the table of families does not know are families of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .names import fresh
from .lineage import cut

#: Language families.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk"],
}

#: bound on the documents of one language that are fitted on, about; buckets of features
SAMPLE, BUCKETS = 800, 1 << 13
EPOCHS, PENALTY = 30, 1e-3
UNKNOWN = "und"

_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """For each code point of the first planes its lower-case letter, or a space for what is no letter."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x20000, 32, np.uint32)
        for c in range(len(table)):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low[0])
        _FOLD = table
    return _FOLD


def _folded(points: np.ndarray) -> np.ndarray:
    """Lower-case letters, and spaces for all else; code points above the table are decided one by one, each distinct one once."""
    fold = _fold()
    low = fold[np.minimum(points, len(fold) - 1)]
    high = np.flatnonzero(points >= len(fold))
    if len(high):
        distinct, which = np.unique(points[high], return_inverse=True)
        low[high] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in distinct.tolist()], np.uint32)[which]
    return low


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of each gram, the text of each gram, and whether each text has a letter."""
    strings = ["" if x is None else x for x in texts.to_pylist()]
    points = np.frombuffer((" " + " ".join(strings) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    row = np.repeat(np.arange(len(strings)), lengths + 1)
    low = _folded(points)[1:]
    letter = low != 32
    has = np.bincount(row[letter], minlength=len(strings)) > 0
    # runs of spaces as one
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    low, row = low[keep], row[keep]
    x = np.concatenate([[np.uint32(32), np.uint32(32)], low])
    a, b, c = x[:-2], x[1:-1], x[2:]
    two = (b * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA77))
    three = two ^ (a * np.uint32(0xC2B2AE3D))

    def bucket(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return (h ^ (h >> np.uint32(12))) & np.uint32(BUCKETS - 1)

    # a gram may not start in the text before
    same = np.concatenate([[-1, -1], row])
    second = np.where(same[1:-1] == row, two, c * np.uint32(0x85EBCA77) ^ np.uint32(32 * 0x9E3779B1 & 0xFFFFFFFF))
    third = np.where(same[:-2] == row, three, second ^ np.uint32(32 * 0xC2B2AE3D & 0xFFFFFFFF))
    return np.stack([bucket(second), bucket(third)], 1), row, has


def features(texts: pa.Array) -> np.ndarray:
    """Square roots of gram shares: rows of length about one."""
    found, row, _ = grams(texts)
    out = np.zeros((len(texts), BUCKETS), np.float32)
    np.add.at(out, (row[:, None], found), 1)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1))


def fit_svm(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, penalty: float = PENALTY, seed: int = 1) -> np.ndarray:
    """Linear support vector machine by averaged subgradient steps; y is +1 or -1; classes weigh alike; bias last."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    w, total, steps = np.zeros(x.shape[1], np.float64), np.zeros(x.shape[1], np.float64), 0
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for part in np.array_split(order, max(1, len(y) // 32)):
            steps += 1
            rate = 1 / (penalty * (steps + 1 / penalty))
            wrong = part[y[part] * (x[part] @ w) < 1]
            w *= 1 - rate * penalty
            if len(wrong):
                w += rate / len(part) * ((weight[wrong] * y[wrong]) @ x[wrong])
            if epoch >= epochs // 2:
                total += w
    return total / max(1, (epochs - epochs // 2) * max(1, len(y) // 32))


@dataclass
class Model:
    families: list[str]
    members: dict[str, list[str]]
    family_weights: np.ndarray  # families x (BUCKETS + 1)
    pairs: list[tuple[str, str]]
    pair_weights: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the chance of the family times the mean chance in its pairs, by a logistic curve."""
        n = len(texts)
        found, row, has = grams(texts)
        keys = (row[:, None] * BUCKETS + found).ravel()
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(keys)))
        of, feature = keys[first] // BUCKETS, keys[first] % BUCKETS
        totals = np.maximum(np.bincount(row, minlength=n) * 2, 1)
        value = np.sqrt(counts / totals[of])
        margin = lambda w: np.bincount(of, value * w[feature], n) + w[BUCKETS]
        chance = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -20, 20)))
        if not self.families:
            return [UNKNOWN] * n, np.zeros(n)
        by_family = np.stack([margin(w) for w in self.family_weights]) if len(self.families) > 1 else np.ones((1, n))
        family = by_family.argmax(0)
        family_chance = chance(by_family.max(0)) if len(self.families) > 1 else np.ones(n)
        out, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
        margins = {p: margin(w) for p, w in zip(self.pairs, self.pair_weights, strict=True)}
        for k, name in enumerate(self.families):
            langs, mine = self.members[name], np.flatnonzero((family == k) & has)
            votes, belief = np.zeros((len(langs), len(mine))), np.zeros((len(langs), len(mine)))
            for i, j in combinations(range(len(langs)), 2):
                m = margins[langs[i], langs[j]][mine]
                votes[i] += m > 0
                votes[j] += m <= 0
                belief[i] += chance(m)
                belief[j] += 1 - chance(m)
            best = (votes + belief / (2 * len(langs))).argmax(0)
            out[mine] = np.array(langs, dtype=object)[best]
            score[mine] = family_chance[mine] * (belief[best, np.arange(len(mine))] / (len(langs) - 1) if len(langs) > 1 else 1)
        return out.tolist(), score


def _families(langs: list[str], families: dict[str, list[str]]) -> dict[str, list[str]]:
    known = {x: name for name, each in families.items() for x in each}
    out: dict[str, list[str]] = {}
    for x in sorted(langs):
        out.setdefault(known.get(x, x), []).append(x)
    return dict(sorted(out.items()))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
        families: dict[str, list[str]] = FAMILIES) -> Model:
    """Fits on about `sample` rows of each language at most; rows with a null language, text or id are left out."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .where("lang is not null and text is not null and doc_id is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    members = _families(list(counts), families)
    if not counts:
        return Model([], {}, np.zeros((0, BUCKETS + 1)), [], np.zeros((0, BUCKETS + 1)))
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, sample / n))), F.col("lang"))
    drawn = cut(rows.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) < share * (1 << 30)).select("doc_id", "text", "lang"))
    family_of = {x: name for name, each in members.items() for x in each}
    names = list(members)
    machines: list[tuple[str, str, str]] = [("family", name, "") for name in names] if len(names) > 1 else []
    machines += [("pair", a, b) for each in members.values() for a, b in combinations(each, 2)]
    if not machines:
        return Model(names, members, np.zeros((0, BUCKETS + 1)), [], np.zeros((0, BUCKETS + 1)))
    takes = F.element_at(F.create_map(*(x for lang in counts for x in (F.lit(lang), F.array(*(
        F.lit(k) for k, (kind, a, b) in enumerate(machines) if kind == "family" or lang in (a, b))).cast("array<int>")))), F.col("lang"))

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        kind, a, _ = machines[table.column("machine")[0].as_py()]
        langs = table.column("lang").to_pylist()
        y = np.array([1.0 if (family_of[x] == a if kind == "family" else x == a) else -1.0 for x in langs])
        x = np.concatenate([features(c) for c in table.column("text").chunks])
        return pa.table({"machine": table.column("machine").slice(0, 1), "w": pa.array([fit_svm(x, y)])})

    fitted = drawn.withColumn("machine", F.explode(takes)).groupBy("machine").applyInArrow(train, "machine int, w array<double>").collect()
    weights = np.zeros((len(machines), BUCKETS + 1))
    for r in fitted:
        weights[r["machine"]] = r["w"]
    n = sum(kind == "family" for kind, _, _ in machines)
    return Model(names, members, weights[:n], [(a, b) for _, a, b in machines[n:]], weights[n:])


def _predicting(shared, text_col: str):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for part in W.slices(batch, text_col):
                langs, scores = model.predict(part.column(text_col))
                columns = [c for name, c in zip(part.schema.names, part.columns, strict=True) if name not in ("lang_pred", "score")]
                names = [name for name in part.schema.names if name not in ("lang_pred", "score")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    return predict


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1); only the text is looked at.

    Texts that are null or have no letter are 'und' with score 0. All columns are kept, but for columns of the two new
    names. With no labelled row to learn from, every text is 'und'.
    """
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(_predicting(docs.sparkSession.sparkContext.broadcast(model), text_col), schema)


def known_languages(docs: DataFrame, learnt_from: Column, text_col: str = "text", **names) -> DataFrame:
    """docs whose text has a language: rows that come out as 'und' go. Columns stay as they are."""
    model = fit(docs.where(learnt_from), text_col=text_col, **names)
    columns = docs.columns
    text = fresh(docs, "_text")
    marked = docs.select("*", F.col(text_col).alias(text))
    return predict(marked, model, text).where(F.col("lang_pred") != UNKNOWN).select(*columns)
