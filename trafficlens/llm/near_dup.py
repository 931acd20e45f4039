"""Near-duplicate documents: b-bit MinHash over word shingles, bands for candidates, exact sets for links.

1. One pass over the texts gives each document the size of its shingle set, a 128-bit name of the set, the low four bits
   of 128 minima packed into eight integers, and 32 band keys of four minima each. A pair at the threshold 0.75 shares no
   band with probability (1 - 0.75^4)^32 = 5e-6.
2. Documents with equal sets become one node.
3. Each node meets the smallest node of its buckets. The collision-corrected similarity of the packed bits,
   (matches / 128 - 1/16) / (1 - 1/16), sorts out candidates far below the threshold (by more than four standard
   deviations); full sets decide.
4. Buckets that still hold several components are compared in full inside tasks, in blocks: first by bit counts, to find
   the nodes that have a candidate in another component at all, then, for those, by bit counts and full sets. A task
   gives one link for any two components, not their pairs.

Copies and large groups never become all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .lineage import cut
from .names import fresh
from .components import components

SHINGLE = 5
THRESHOLD = 75  # per cent
HASHES, BAND_ROWS, BITS = 128, 4, 4
#: estimates below this are no candidates
LEAST_ESTIMATE = 0.57
#: nodes of a block that is compared in one task
BLOCK = 2048

_rng = np.random.default_rng(20260103)
_A = _rng.integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_STEPS = np.array([pow(0xD6E8FEB86659FD93, k, 2**64) for k in range(1, 64)], dtype=np.uint64)

SKETCH = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bits array<bigint>, bands array<bigint>"


def shingle_sets(found: W.Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, text after text, and the n + 1 offsets."""
    counts = found.counts()
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = W.ragged(found.rows[:-1], n)
    longer = np.concatenate([found.hashes, np.zeros(size, np.uint64)])
    hashes = np.zeros(len(at), np.uint64)
    for k in range(size):
        hashes += longer[at + k] * _STEPS[k]
    hashes = W.mix(hashes)
    row = np.repeat(np.arange(len(n)), n)
    short = (counts < size) & (counts > 0)
    for r in np.flatnonzero(short):
        own = found.hashes[found.rows[r] : found.rows[r + 1]]
        hashes[row == r] = W.mix(np.array([int((own * _STEPS[: len(own)]).sum(dtype=np.uint64)) ^ len(own)], np.uint64))
    keys = W.mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    kept = np.sort(order[new])
    return hashes[kept], np.searchsorted(row[kept], np.arange(len(n) + 1))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def sketch(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (n x 8) and band keys (n x 32) of non-empty sets."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((HASHES, len(offsets) - 1), np.uint32)
    for k in range(HASHES):
        minima[k] = np.minimum.reduceat(x * _A[k] + _B[k], offsets[:-1])
    low = W.mix(minima.astype(np.uint64)) & np.uint64(2**BITS - 1)
    per = 64 // BITS
    bits = np.zeros((HASHES // per, minima.shape[1]), np.uint64)
    for k in range(HASHES):
        bits[k // per] |= low[k] << np.uint64(BITS * (k % per))
    bands = np.zeros((HASHES // BAND_ROWS, minima.shape[1]), np.uint64)
    for k in range(HASHES):
        bands[k // BAND_ROWS] = W.mix(bands[k // BAND_ROWS] * np.uint64(31) + minima[k] + np.uint64(k + 1))
    return bits.T, bands.T


def _nested(rows: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """A list column with rows[i] at place of[i] and empty lists elsewhere."""
    lengths = np.zeros(n, np.int32)
    lengths[of] = rows.shape[1]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).ravel().view(np.int64)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            hashes, offsets = shingle_sets(W.words(part.column("text")))
            sizes = np.diff(offsets)
            some = np.flatnonzero(sizes)
            bits, bands = sketch(hashes, np.append(offsets[:-1][some], len(hashes))) if len(some) else (np.zeros((0, 8), np.uint64), np.zeros((0, 32), np.uint64))
            names = [_sums(W.mix(hashes ^ np.uint64(c)), offsets).view(np.int64) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(sizes), *map(pa.array, names),
                 _nested(bits, some, len(sizes)), _nested(bands, some, len(sizes))],
                names=["doc_id", "n_shingles", "k1", "k2", "bits", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in W.slices(batch, "text"):
            hashes, offsets = shingle_sets(W.words(part.column("text")))
            items = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), items], names=["doc_id", "items"])


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed bits: four-bit groups that agree, less those that agree by chance."""
    differing = None
    for k in range(HASHES * BITS // 64):
        x = F.get(a, k).bitwiseXOR(F.get(b, k))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differing = F.bit_count(x) if differing is None else differing + F.bit_count(x)
    chance = 1 / 2**BITS
    return ((HASHES - differing) / HASHES - chance) / (1 - chance)


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (a, b) that may be similar enough by their packed bits."""
    bits = nodes.select("node", "bits")
    both = pairs.select("a", "b").join(bits.toDF("b", "bits_b"), "b").join(bits.toDF("a", "bits_a"), "a")
    return cut(both.where(estimate(F.col("bits_a"), F.col("bits_b")) >= LEAST_ESTIMATE).select("a", "b").distinct())


def _linked(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Those pairs whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id bigint, items array<bigint>")
    b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b")), "b")
    both = b.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), "a")
    common = F.size(F.array_intersect("items_a", "items_b"))
    sized = both.select("a", "b", common.alias("common"), (F.size("items_a") + F.size("items_b")).alias("sizes"))
    return sized.where(100 * F.col("common") >= threshold * (F.col("sizes") - F.col("common"))).select("a", "b").distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (bucket, lo, hi) at a time; they come sorted by it."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(c).to_numpy() for c in ("bucket", "lo", "hi")], 1)
        cuts = np.concatenate([[0], np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1, [len(names)]])
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            own = tuple(names[start])
            if held and own != key:
                yield pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def _lists(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    lists = table.column(column).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy().view(np.uint64), offsets - offsets[0]


def _candidates(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each row and the rows of other components that are near it by bit counts; a pair comes in its first common bucket only."""
    node, comp, block, lo, hi, bucket = (table.column(c).to_numpy() for c in ("node", "component", "block", "lo", "hi", "bucket"))
    bits, bands = (_lists(table, c)[0].reshape(len(node), -1) for c in ("bits", "bands"))
    band = int(np.argmax(bands[0].view(np.int64) == bucket[0]))
    left, right = np.flatnonzero(block == lo[0]), np.flatnonzero(block == hi[0])
    most = HASHES * (1 - (LEAST_ESTIMATE * (1 - 1 / 2**BITS) + 1 / 2**BITS))
    for i in left:
        other = right[(comp[right] != comp[i]) & ((right > i) | (lo[0] != hi[0]))]
        x = bits[other] ^ bits[i]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        near = other[np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1) <= most]
        yield i, near[~(bands[near, :band] == bands[i, :band]).any(1)]


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node) of the rows that have a candidate."""
    for table in _runs(batches):
        flags = np.zeros(table.num_rows, bool)
        for i, near in _candidates(table):
            flags[near] = True
            flags[i] |= len(near) > 0
        if flags.any():
            yield from table.select(["bucket", "node"]).filter(pa.array(flags)).combine_chunks().to_batches()


def _joining(threshold: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between components by full sets, one for any two components of a run."""
        for table in _runs(batches):
            node, comp = (table.column(c).to_numpy() for c in ("node", "component"))
            items, at = _lists(table, "items")
            sets = [np.sort(items[at[k] : at[k + 1]]) for k in range(len(node))]
            up: dict[int, int] = {}

            def root(x: int, up: dict[int, int] = up) -> int:
                while x in up:
                    x = up[x]
                return x

            links = []
            for i, near in _candidates(table):
                for j in near.tolist():
                    a, b = root(int(comp[i])), root(int(comp[j]))
                    if a == b:
                        continue
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                        up[max(a, b)] = min(a, b)
                        links.append((node[i], node[j]))
            if links:
                a, b = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return join


def _placed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, component, n) of the buckets that hold several components; n is the bucket's size."""
    placed = rows.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return placed.join(mixed.select("bucket", "n"), "bucket")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows of a bucket once for each block of it that they meet, bucket by bucket; `n` is the bucket's size."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("bigint")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks)) \
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))) \
        .withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "n")
    return rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def _rest(nodes: DataFrame, rows: DataFrame, labels: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Links that are left between components, from full comparison of the buckets that hold several."""
    placed = cut(_placed(rows, labels))
    sketches = nodes.select("node", "bits", "bands")
    near = cut(_in_blocks(placed.join(sketches, "node")).mapInArrow(_flagged, "bucket bigint, node bigint").distinct())
    sets = docs.join(near.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi") \
        .mapInArrow(_sets, "doc_id bigint, items array<bigint>").withColumnRenamed("doc_id", "node")
    whole = placed.join(near, ["bucket", "node"]).join(sketches, "node").join(sets, "node")
    return _in_blocks(whole).mapInArrow(_joining(threshold), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    Null, empty and blank texts have no shingles, are linked with nothing and are kept. Rows with a null id take part in
    nothing: their component_id is null and they are kept. Rows that share an id are one document; ids are integers.
    Extra columns play no part.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = cut(docs.mapInArrow(_sketches, SKETCH))
    nodes = cut(sketched.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("node"), F.first("bits").alias("bits"), F.first("bands").alias("bands")))
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    firsts = buckets.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    rows = cut(buckets.join(firsts.select("bucket", "first"), "bucket"))
    pairs = rows.where("node > first").groupBy(F.col("node").alias("b")).agg(F.min("first").alias("a"))
    links = cut(_linked(_near(pairs, nodes), docs, threshold))
    # a node's first, or its first's first, is enough to tell most of what is linked already
    firsts = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    again = firsts.toDF("component", "further")
    labels = firsts.join(again, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    rest = _rest(nodes, rows.select("bucket", "node"), labels, docs, threshold)
    labels = components(links.unionByName(rest))
    classes = nodes.join(labels, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("class"))
    out = sketched.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """docs without the rows whose document is a near-duplicate of one with a smaller id."""
    found = near_duplicates(docs, id_col, text_col, threshold)
    name = fresh(docs, "_dropped")
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, docs[id_col].cast("bigint") == dropped[name], "left_anti")
