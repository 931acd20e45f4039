"""Ranked lexical search by hashed max-sketches.

Every document's impacts fold into a sketch: a term's coordinate is given by its hash, and a coordinate holds the greatest
impact of the terms that share it. An item's terms, looked up in a sketch and weighed, give an upper bound of the document's
score; all items of a block look up all sketches of a slice in one matrix product. Documents are then scored exactly in the
order of their bounds, until an item's next bound is below its tenth best score, which is carried from slice to slice.

Two passes over the texts, nothing but counts and the best of each task is shuffled: the first counts documents, terms, and
the documents that hold each term of the items; the second keeps the best per item and task, merged in two levels. Items are
the query set; they go to the tasks in parts of at most `QUERY_BYTES` of text, each with passes of its own.

Null and empty texts hold no term: they do not count and are never found; items without a term find nothing. Rows of items
that share an id are one item with the terms of all; a null item id is an id like others. Repeated documents are found each;
of equal scores the smaller id comes first, a null id last. Very long texts are a slice of their own. Extra columns play no
part. No documents or no items give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import words as W

TOP = 10
#: coordinates of a sketch; most rows of a slice; most items looked up at once; documents scored in an item's first round
COORDINATES, SLICE_ROWS, BLOCK_ITEMS, FIRST_ROUND = 4096, 1024, 512, 16
#: most text of items that is broadcast at once
QUERY_BYTES = 16 << 20
#: groups in which the best of all tasks are merged first
SALTS = 64
NO_ID = 2**63 - 1


@dataclass
class Queries:
    ids: pa.Array  # distinct item ids
    terms: np.ndarray  # sorted hashes of all terms
    rows: np.ndarray  # n + 1 offsets of items into `term_of`
    term_of: np.ndarray  # positions in `terms`
    weights: np.ndarray | None = None  # by term
    n_docs: int = 0
    n_terms: int = 0


def build_queries(ids: pa.Array, texts: pa.Array) -> Queries:
    found = W.words(texts, W.ALPHANUMERIC)
    coded = ids.dictionary_encode(null_encoding="encode")
    terms, which = np.unique(found.hashes, return_inverse=True)
    item = coded.indices.to_numpy(zero_copy_only=False)[found.row_of()] if len(ids) else np.zeros(0, np.int64)
    pairs = np.unique(item.astype(np.int64) * max(1, len(terms)) + which)
    rows = np.searchsorted(pairs, np.arange(len(coded.dictionary) + 1) * max(1, len(terms)))
    return Queries(coded.dictionary, terms, rows, pairs % max(1, len(terms)))


def _known(terms: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a hash is one of the terms, and which."""
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return terms[at] == hashes, at


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    for part in W.slices(batch, column):
        for row in range(0, part.num_rows, SLICE_ROWS):
            yield part.slice(row, SLICE_ROWS)


def _counting(shared):
    """(term, n): documents that hold each term; documents and terms of all under -1 and -2."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        n_docs, n_terms, held = 0, 0, np.zeros(len(queries.terms), np.int64)
        for batch in batches:
            for part in W.slices(batch, "text"):
                found = W.words(part.column("text"), W.ALPHANUMERIC)
                n_docs += int(np.count_nonzero(found.counts()))
                n_terms += len(found.hashes)
                if len(held) and len(found.hashes):
                    known, at = _known(queries.terms, found.hashes)
                    once = np.unique(found.row_of()[known] * len(held) + at[known])
                    held += np.bincount(once % len(held), minlength=len(held))
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, [-1, -2])), pa.array(np.append(held[seen], [n_docs, n_terms]))], ["term", "n"])

    return count


@dataclass
class Best:
    """The best documents of each item so far, highest first; places without one have score 0."""

    scores: np.ndarray
    docs: np.ndarray

    def take(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        top = self.scores.shape[1]
        items = np.unique(item)
        item = np.concatenate([item, np.repeat(items, top)])
        doc = np.concatenate([doc, self.docs[items].ravel()])
        score = np.concatenate([score, self.scores[items].ravel()])
        order = np.lexsort((doc, -score, item))
        first = np.searchsorted(item[order], items)
        chosen = order[first[:, None] + np.arange(top)]
        self.scores[items], self.docs[items] = score[chosen], doc[chosen]


def impacts(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * length)


def search_slice(docs: np.ndarray, texts: pa.Array, queries: Queries, best: Best, coordinates: int = COORDINATES) -> int:
    """Puts the documents of a slice among the best of each item; the number of pairs that were scored exactly."""
    found = W.words(texts, W.ALPHANUMERIC)
    if not len(found.hashes) or not len(queries.terms):
        return 0
    length = 10 + (90 * found.counts() * queries.n_docs) // queries.n_terms
    asked, column_of = np.unique(queries.terms % np.uint64(coordinates), return_inverse=True)
    column = np.full(coordinates, -1)
    column[asked] = np.arange(len(asked))
    # the distinct terms of each document, at coordinates that an item looks up
    folded = column[found.hashes % np.uint64(coordinates)]
    use = np.flatnonzero(folded >= 0)
    row = found.row_of()[use]
    order = np.lexsort((found.hashes[use], row))
    row, term, folded = row[order], found.hashes[use][order], folded[use][order]
    new = np.append(True, (row[1:] != row[:-1]) | (term[1:] != term[:-1]))[: len(row)]
    first = np.flatnonzero(new)
    row, term, folded = row[first], term[first], folded[first]
    impact = impacts(np.diff(np.append(first, len(use))), length[row])
    sketch = np.zeros((len(texts), len(asked)))
    np.maximum.at(sketch.reshape(-1), row * len(asked) + folded, impact)
    known, at = _known(queries.terms, term)
    keys, held = row[known] * len(queries.terms) + at[known], impact[known]
    n_items, scored = len(queries.ids), 0
    for begin in range(0, n_items, BLOCK_ITEMS):
        end = min(n_items, begin + BLOCK_ITEMS)
        terms = queries.term_of[queries.rows[begin] : queries.rows[end]]
        lookup = np.zeros((len(asked), end - begin))
        np.add.at(lookup, (column_of[terms], np.repeat(np.arange(end - begin), np.diff(queries.rows[begin : end + 1]))), queries.weights[terms])
        bound = (sketch @ lookup).T  # whole numbers below 2 ** 53, so no bound is rounded
        item, doc = np.nonzero(bound >= np.maximum(best.scores[begin:end, -1:], 1))
        order = np.lexsort((-bound[item, doc], item))
        item, doc = item[order], doc[order]
        bound, item = bound[item, doc], item + begin
        size = FIRST_ROUND
        while len(item):
            now = np.arange(len(item)) - np.searchsorted(item, item) < size
            score = _scores(item[now], doc[now], queries, keys, held)
            scored += len(score)
            if (score > 0).any():
                best.take(item[now][score > 0], docs[doc[now]][score > 0], score[score > 0])
            left = ~now & (bound >= np.maximum(best.scores[item, -1], 1))
            item, doc, bound, size = item[left], doc[left], bound[left], size * 2
    return scored


def _scores(item: np.ndarray, doc: np.ndarray, queries: Queries, keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Exact score of each pair; keys are the sorted places (document, term) whose impacts are `held`."""
    many = np.diff(queries.rows)[item]
    term = queries.term_of[W.ragged(queries.rows[item], many)]
    pair = np.repeat(np.arange(len(item)), many)
    found, at = _known(keys, doc[pair] * len(queries.terms) + term) if len(keys) else (np.zeros(len(term), bool), None)
    out = np.zeros(len(item), np.int64)
    if found.any():
        np.add.at(out, pair[found], queries.weights[term[found]] * held[at[found]])
    return out


def _searching(shared, top: int, schema: pa.Schema):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        n = len(queries.ids)
        best = Best(np.zeros((n, top), np.int64), np.full((n, top), NO_ID))
        for batch in batches:
            for part in _parts(batch, "text"):
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                search_slice(ids, part.column("text"), queries, best)
        item, place = np.nonzero(best.scores)
        ids = best.docs[item, place]
        yield pa.RecordBatch.from_arrays(
            [queries.ids.take(pa.array(item)), pa.array(ids, mask=ids == NO_ID), pa.array(best.scores[item, place])], schema=schema)

    return search


def _item_parts(items: DataFrame, limit: int) -> Iterator[pa.Table]:
    """Items in parts of about `limit` bytes at most, all rows of an id in one; their size is asked before any is fetched."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-int(total) // limit))
    for k in range(parts):
        yield (items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)).toArrow()


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
           top: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of highest score above 0 for each item, rank from 1."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    kind = items.schema["item_id"].dataType
    made = T.StructType().add("item_id", kind).add("doc_id", T.LongType()).add("score", T.LongType())
    best = spark.createDataFrame([], made)
    for part in _item_parts(items, query_bytes):
        queries = build_queries(part.column("item_id").combine_chunks(), part.column("text").combine_chunks())
        counted = docs.select("text").mapInArrow(_counting(spark.sparkContext.broadcast(queries)), "term bigint, n bigint")
        counts = {r["term"]: r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}
        queries.n_docs, queries.n_terms = counts.get(-1, 0), counts.get(-2, 0)
        queries.weights = np.array([math.floor(1000 * math.log((2 * queries.n_docs + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(queries.terms))], np.int64)
        schema = pa.schema([("item_id", queries.ids.type), ("doc_id", pa.int64()), ("score", pa.int64())])
        found = docs.mapInArrow(_searching(spark.sparkContext.broadcast(queries), top, schema), made)
        best = best.unionByName(found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = best.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = Window.partitionBy("item_id", "salt").orderBy(*order)
    last = Window.partitionBy("item_id").orderBy(*order)
    kept = salted.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).drop("rank")
    return kept.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
