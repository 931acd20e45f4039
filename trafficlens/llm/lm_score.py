"""Language-model scores from a weighted backoff automaton over word bigrams, learnt from the corpus itself.

States are the empty context and every word (and the start of a text). An arc (h, w) exists for each bigram seen in
training; it weighs (c(hw) - D) / c(h) + back(h) p(w). From any state a failure arc of weight
back(h) = 1 - sum of (c(hw) - D) over its arcs / c(h) leads to the empty state, whose arcs weigh
p(w) = (c(w) + 1) / (N + V + 1); each state's weights sum to one over the vocabulary and the unknown word. One pass from
left to right carries the state (the word just read) and adds up logarithms.

Nothing of the vocabulary meets in one place. Documents keep the input partition they came in (their part). A part sends
its distinct n-grams with its training counts to buckets by hash; buckets add up and answer each part with the totals of
the n-grams it asked for, in the order in which it asked; documents and answers meet by part. Bigrams go to buckets by their first word, so that sums of
an arc's siblings are at hand; words with more than a bucket's share of all tokens (fewer than there are buckets, so the
list is bounded) are spread over all buckets. The input must be read from files or a checkpoint, so that two scans give
equal partitions; a part that misses a word fails loudly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .lineage import cut

DISCOUNT_QUARTERS = 3  # D = 0.75
#: bytes of a word's hash that tell the words after one first word apart
SUCCESSOR = 5
#: text of a part and of a bucket, about
PART_BYTES, BUCKET_BYTES = 16 << 20, 6 << 20

#: not hashes of words but by chance of 2^-64
START, END = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)

ASKED = "bucket int, part bigint, a binary, b binary, c binary, d binary"
ANSWERS = "kind string, part bigint, bucket int, a binary, b binary, n_tokens bigint, n_types bigint"


def _small(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _large(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _planes(x: np.ndarray, width: int | None = None) -> bytes:
    """Integers byte plane by byte plane, as many low bytes as asked for: like bytes lie together, which compresses."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)[:, :width]
    return _small(bytes([planes.shape[1]]) + np.ascontiguousarray(planes.T).tobytes())


def _unplaned(data: bytes) -> np.ndarray:
    raw = _large(data)
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view(np.uint64).ravel()


def _rows(x: np.ndarray, width: int) -> bytes:
    """The low bytes of integers one after another: frequent ones repeat, which compresses."""
    return _small(bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize)[:, :width]).tobytes())


def _from_rows(data: bytes) -> np.ndarray:
    raw = _large(data)
    out = np.zeros(((len(raw) - 1) // raw[0], 8), np.uint8)
    out[:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0])
    return out.view(np.uint64).ravel()


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return W.mix(h + w * np.uint64(0x9E3779B97F4A7C15))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each distinct key, in key order, and which of them each key is."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _framed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with a START before and an END after each text, and the n + 1 offsets."""
    found = W.words(texts)
    rows = found.rows + 2 * np.arange(len(found.rows))
    out = np.full(rows[-1], END, np.uint64)
    out[rows[:-1]] = START
    out[np.arange(len(found.hashes)) + 2 * found.row_of() + 1] = found.hashes
    return out, rows


@dataclass
class Grams:
    """The distinct words and bigrams of a part, in an order that only depends on them; a part asks for and is answered
    the n-grams of a bucket in this order."""

    tokens: np.ndarray
    at: np.ndarray  # places of the tokens among all with STARTs
    names: np.ndarray  # distinct words
    word: np.ndarray  # which word each token is

    @classmethod
    def of(cls, framed: np.ndarray) -> Grams:
        at = np.flatnonzero(framed != START)
        tokens = framed[at]
        first, word = _distinct(tokens)
        return cls(tokens, at, tokens[first], word)

    def pairs(self, framed: np.ndarray, bits: int, hot: np.ndarray) -> None:
        """Adds h, w and bucket of the distinct bigrams, by bucket, h and w, and which of them ends at each token."""
        before, after = framed[self.at - 1], self.tokens >> np.uint64(64 - 8 * SUCCESSOR)
        first, which = _distinct(_pair(before, after))
        h, w = before[first], after[first]
        bucket = np.where(np.isin(h, hot), _pair(h, w), h) >> np.uint64(64 - bits)
        order = np.lexsort((w, h, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.h, self.w, self.bucket, self.pair = h[order], w[order], bucket[order].astype(np.int64), rank[which]
        # heads: the distinct first words of each bucket
        new = np.ones(len(order), bool)
        new[1:] = (self.h[1:] != self.h[:-1]) | (self.bucket[1:] != self.bucket[:-1])
        self.head = np.cumsum(new) - 1


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_ASKED = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), *((c, pa.binary()) for c in "abcd")])
_ANSWERS = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()),
                      ("n_tokens", pa.int64()), ("n_types", pa.int64())])


def _asking(bits: int, hot: np.ndarray | None):
    """A part's distinct words (hot is None) or bigrams with their training counts, by bucket."""

    def send(held: list[tuple[np.ndarray, ...]], part: int) -> pa.RecordBatch:
        framed, trains = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        grams = Grams.of(framed)
        if hot is None:
            bucket = (grams.names >> np.uint64(64 - bits)).astype(np.int64)
            counts = np.bincount(grams.word, trains[grams.at], len(bucket)).astype(np.int64)
        else:
            grams.pairs(framed, bits, hot)
            bucket = grams.bucket
            counts = np.bincount(grams.pair, trains[grams.at], len(bucket)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(2**bits + 1))
        rows = []
        for k in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[k], cuts[k + 1])
            if hot is None:
                rows.append((k, part, _planes(grams.names[own]), _planes(counts[own]), None, None))
            else:
                n = np.bincount(grams.head[own] - grams.head[cuts[k]])
                heads = grams.h[own][np.cumsum(n) - n]
                rows.append((k, part, _planes(heads), _planes(n), _rows(grams.w[own], SUCCESSOR), _planes(counts[own])))
        return _batch(rows, _ASKED)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for piece in W.slices(batch, "text"):
                framed, rows = _framed(piece.column("text"))
                trains = np.repeat(piece.column("trains").to_numpy(zero_copy_only=False).astype(np.int8), np.diff(rows))
                parts = piece.column("part").to_numpy()
                of = np.repeat(parts, np.diff(rows))
                for part in np.unique(parts):
                    own = of == part
                    held.setdefault(part, []).append((framed[own], trains[own]))
        for part in list(held):
            yield send(held.pop(part), part)

    return ask


def _add_words(table: pa.Table) -> pa.Table:
    """A bucket of words: totals to every part that asked, the bucket's totals, and its numbers of tokens and types."""
    bucket = table.column("bucket")[0].as_py()
    each = [_unplaned(x) for x in table.column("a").to_pylist()]
    names = np.concatenate(each)
    first, which = _distinct(names)
    totals = np.bincount(which, np.concatenate([_unplaned(x) for x in table.column("b").to_pylist()]).astype(np.int64), len(first)).astype(np.int64)
    ends = np.cumsum(list(map(len, each)))
    rows = [("words", part, bucket, _planes(totals[which[end - len(x) : end]]), None, None, None)
            for part, x, end in zip(table.column("part").to_pylist(), each, ends, strict=True)]
    seen = totals > 0
    rows.append(("totals", None, bucket, _planes(names[first[seen]]), _planes(totals[seen]), int(totals.sum()), int(seen.sum())))
    return pa.Table.from_batches([_batch(rows, _ANSWERS)])


def _adding_bigrams(hot: np.ndarray):
    def add(table: pa.Table) -> pa.Table:
        """A bucket of bigrams: to each part the totals of those that are arcs, and what the arcs of its first words hold.

        First words that are spread over buckets come as rows of their own."""
        bucket = table.column("bucket")[0].as_py()
        asked, h, w, counts = [], [], [], []
        for a, b, c, d in zip(*(table.column(x).to_pylist() for x in "abcd"), strict=True):
            asked.append(_unplaned(a))
            h.append(np.repeat(asked[-1], _unplaned(b).astype(np.int64)))
            w.append(_from_rows(c))
            counts.append(_unplaned(d).astype(np.int64))
        ends = np.cumsum(list(map(len, w)))
        h, w, counts = map(np.concatenate, (h, w, counts))
        first, which = _distinct(_pair(h, w))
        totals = np.bincount(which, counts, len(first)).astype(np.int64)
        arc = totals > 0
        heads, head = np.unique(h[first], return_inverse=True)
        quarters = np.bincount(head[arc], 4 * totals[arc] - DISCOUNT_QUARTERS, len(heads)).astype(np.int64)
        is_hot = np.isin(heads, hot)
        rows = [("hot", int(heads[k : k + 1].view(np.int64)[0]), bucket, None, None, int(quarters[k]), None) for k in np.flatnonzero(is_hot & (quarters > 0))]
        quarters[is_hot] = 0
        totals[~arc] = 0
        for part, own, start, end in zip(table.column("part").to_pylist(), asked, [0, *ends[:-1]], ends, strict=True):
            rows.append(("bigrams", part, bucket, _planes(quarters[np.searchsorted(heads, own)]), _planes(totals[which[start:end]]), None, None))
        return pa.Table.from_batches([_batch(rows, _ANSWERS)])

    return add


def _scoring(n: int, v: int, bits: int, hot: np.ndarray, held: dict[int, int]):
    hot_quarters = np.array([held.get(int(x), 0) for x in np.sort(hot).view(np.int64)], np.int64)

    def answered(answers: pa.Table, kind: str, column: str, size: int) -> np.ndarray:
        own = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("bucket")
        parts = [_unplaned(x).view(np.int64) for x in own.column(column).to_pylist()]
        out = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if len(out) != size:
            raise ValueError("a part was not the same in two scans; write the documents to a table first")
        return out

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SCORED.empty_table()
        pieces = [pa.ipc.open_stream(x).read_all() for x in docs.column("docs").to_pylist()]
        framed, lengths = [], []
        for piece in pieces:
            own, rows = _framed(piece.column("text").combine_chunks())
            framed.append(own)
            lengths.append(np.diff(rows) - 1)
        framed, lengths = np.concatenate(framed), np.concatenate(lengths)
        grams = Grams.of(framed)
        grams.pairs(framed, bits, hot)
        counts = answered(answers, "words", "a", len(grams.names))
        quarters = answered(answers, "bigrams", "a", int(grams.head[-1]) + 1)[grams.head[grams.pair]]
        arc = answered(answers, "bigrams", "b", len(grams.h))[grams.pair]
        # the state before each token: how often it was seen, and the weight of its failure arc
        before = framed[grams.at - 1]
        opens = before == START
        state = np.concatenate([[0], grams.word[:-1]])
        state[opens] = np.searchsorted(grams.names, END)  # as many starts as ends
        seen = counts[state]
        ordered = np.sort(hot)
        place = np.minimum(np.searchsorted(ordered, before), len(ordered) - 1)
        quarters = np.where(ordered[place] == before, hot_quarters[place], quarters)
        back = 1 - np.divide(quarters / 4, seen, out=np.zeros(len(seen)), where=seen > 0)
        low = np.log10((counts + 1) / (n + v + 1))[grams.word]
        logs = np.log10(back) + low
        follow = arc > 0
        logs[follow] = np.log10((arc[follow] - DISCOUNT_QUARTERS / 4) / seen[follow] + back[follow] * 10.0 ** low[follow])
        starts = np.cumsum(lengths) - lengths
        sums = [np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64)[grams.word], low, logs)]
        ids, held_out = (pa.concat_arrays([p.column(c).combine_chunks() for p in pieces]) for c in ("doc_id", "held_out"))
        return pa.Table.from_arrays(
            [ids, held_out, pa.array(lengths), pa.array(sums[0]), pa.array(np.full(len(lengths), n)), pa.array(sums[1]), pa.array(sums[2])], schema=_SCORED)

    return score


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a part, about 2 MB at a time, as compressed Arrow streams: whole texts cross the network once."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        for piece in W.slices(batch, "text"):
            parts = piece.column("part").to_numpy()
            for part in np.unique(parts):
                own = piece.select(["doc_id", "text", "held_out"]).filter(pa.array(parts == part))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=options) as out:
                    out.write_batch(own)
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([sink.getvalue().to_pybytes()])], names=["part", "docs"])


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10), one row per document.

    `held_out` tells which documents are not learnt from; null counts as learnt from. Tokens are words and one end per
    text; null and empty texts have the end alone. Null ids and repeated rows are rows like others; integer ids are
    expected. An empty table gives an empty result; with nothing to learn from, every word is unknown. Extra columns
    play no part.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = docs.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("text") + 8).alias("b")).agg(
        F.coalesce(F.sum("b"), F.lit(0)).alias("total"), F.coalesce(F.max("b"), F.lit(0)).alias("largest")).first()
    bits = max(3, int(size["total"] // BUCKET_BYTES).bit_length())
    pieces = max(1, -(-int(size["largest"]) // PART_BYTES))
    part = F.spark_partition_id().cast("bigint") * pieces + F.pmod(F.xxhash64("doc_id", "text"), F.lit(pieces))
    docs = docs.withColumn("part", part)
    texts = docs.select("part", "text", (~F.col("held_out")).alias("trains"))

    words = cut(texts.mapInArrow(_asking(bits, None), ASKED).groupBy("bucket").applyInArrow(_add_words, ANSWERS))
    total = words.where("kind = 'totals'").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_types"), F.lit(0)).alias("v")).first()
    n, v = int(total["n"]), int(total["v"])

    def frequent(batches):
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _unplaned(a)[_unplaned(b).view(np.int64) * 2**bits > n]
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["w"])

    found = words.where("kind = 'totals'").select("a", "b").mapInArrow(frequent, "w bigint").toArrow().column("w").to_numpy()
    hot = np.append(np.asarray(found, np.int64).view(np.uint64), START)

    bigrams = cut(texts.mapInArrow(_asking(bits, hot), ASKED).groupBy("bucket").applyInArrow(_adding_bigrams(hot), ANSWERS))
    held = {r["part"]: r["q"] for r in bigrams.where("kind = 'hot'").groupBy("part").agg(F.sum("n_tokens").alias("q")).collect()}
    answers = words.where("kind = 'words'").unionByName(bigrams.where("kind = 'bigrams'")).select("kind", "part", "bucket", "a", "b")
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    packed = docs.mapInArrow(_packing, "part bigint, docs binary")
    return packed.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_scoring(n, v, bits, hot, held), schema)
