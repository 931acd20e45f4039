"""Token ids in files: canonical length-limited Huffman codes over blocks of whole documents.

A file set is a folder with three tables that any Spark reader opens:

    codes    id, length                     canonical code lengths; codes follow from (length, id)
    blocks   part, block, doc_ids, n_tokens (by document), payload, checkpoints
    tokens   part, seq, doc_id, ids         the ids before coding, kept for another code

Parts are in ascending order of document ids, and so are the blocks of a part (a block is named by its first document's
place in the part). A payload is a bit stream, first bit highest;
checkpoints are the bit offsets of every 256th id of the block, so that a block decodes from many places at once, by a
table over the longest code. Each block decodes on its own. Every document ends with the end id.

Tokenising works on the distinct pieces of a text: white space with the letters after it always encodes alike, because the
tokenizer never joins a non-space and a following white space. Where it cuts by the usual byte-level pattern, a piece also ends
between an ASCII letter or digit and a mark such as a full stop. Texts with white space beyond ASCII
or with a special token of the tokenizer, which the library takes as that token, are encoded whole.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trafficlens.session import shared_dir

from . import words as W

END_ID = 0
LONGEST = 18
EVERY = 256
#: ids of a block, about: a block holds whole documents
BLOCK_IDS = 1 << 16
#: text of a part, and distinct pieces that a worker remembers
PART_BYTES, REMEMBERED = 16 << 20, 2_500_000
#: text that is tokenised at once
SLICE_BYTES = 1 << 20

TOKENS = pa.schema([("doc_id", pa.int64()), ("seq", pa.int64()), ("ids", pa.binary())])
BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())),
                    ("payload", pa.binary()), ("checkpoints", pa.binary())])
BLOCK_TYPES = "part int, block bigint, doc_ids array<bigint>, n_tokens array<int>, payload binary, checkpoints binary"


# -- text to ids ---------------------------------------------------------------------------------------------------------

#: code points of white space beyond ASCII, and of separators that some libraries count as such
_SPACES = "[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]"


#: ASCII letters and digits, and marks that begin a token of their own behind them under the usual byte-level pattern
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_MARK = np.isin(np.arange(256), list(b'.,;:!?)"'))
#: how byte-level vocabularies write a space and a line feed
_OPENERS = "\u0120\u010a"


class Encoder:
    """One tokenizer and the ids of the pieces seen so far; a worker keeps it between tasks."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        cutter = json.loads(self.tokenizer.to_str()).get("pre_tokenizer") or {}
        self.cuts_marks = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True)
        #: tokens that are taken from a text before it is cut into words
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.opens = np.zeros(max(names.values(), default=0) + 1, bool)
        self.opens[[i for name, i in names.items() if name[0] in _OPENERS]] = True
        # open addressing: hash of a piece (0 where free), and which piece it is
        self.keys, self.slots = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int32)
        # all ids end to end, where each piece starts, and how many pieces are remembered; what lies behind is spare
        self.ids, self.starts, self.known = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, by the library's call that leaves out offsets."""
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and their lengths.

        Pieces of one space or line feed and letters are encoded as one text, since calls cost more than letters: in it
        just the first token of each begins with that character. Others are encoded one by one.
        """
        first, then = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
        joint = ((first == 0x20) | (first == 0x0A)) & (ends - starts > 1) & W.NOT_SPACE[then] & W.NOT_SPACE[data[ends - 1]]
        ids, lengths = np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        if joint.any():
            text = data[W.ragged(starts[joint], (ends - starts)[joint])].tobytes().decode()
            ids = self.whole([text])[0]
            at = np.flatnonzero(self.opens[ids])
            if len(at) == joint.sum():
                lengths[joint] = np.diff(np.append(at, len(ids)))
            else:
                ids, joint = ids[:0], np.zeros(len(starts), bool)
        if joint.all():
            return ids, lengths
        rest = np.flatnonzero(~joint)
        made = self.whole([data[a:b].tobytes().decode() for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])
        lengths[rest] = np.fromiter(map(len, made), np.int64, len(made))
        own = np.repeat(joint, lengths)
        out = np.empty(len(own), np.uint32)
        out[own], out[~own] = ids, np.concatenate(made)
        return out, lengths

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the table, or the free place where it would go."""
        at = (keys >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)
        found = self.keys[at]
        open_ = np.flatnonzero((found != keys) & (found != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            open_ = open_[(found != keys[open_]) & (found != 0)]
        return at

    def _put(self, keys: np.ndarray, pieces: np.ndarray) -> None:
        """New distinct keys into free places; where several want one, the first has it and the others look on."""
        while len(keys):
            at = self._find(keys)
            _, one = np.unique(at, return_index=True)
            self.keys[at[one]], self.slots[at[one]] = keys[one], pieces[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, pieces = keys[rest], pieces[rest]

    def _learn(self, keys: np.ndarray, made: np.ndarray, lengths: np.ndarray) -> None:
        """Writes new pieces behind those there are, and remembers them while there is room; frequent ones came first."""
        begin, stop = int(self.starts[self.known]), self.known + len(keys)
        if begin + len(made) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids) // 2, len(made)), np.uint32)])
        if stop >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts) // 2, len(keys) + 1), np.int64)])
        self.ids[begin : begin + len(made)] = made
        self.starts[self.known + 1 : stop + 1] = begin + np.cumsum(lengths)
        if self.known >= REMEMBERED:
            return
        if 2 * stop > len(self.keys):
            kept = self.keys != 0
            old, pieces = self.keys[kept], self.slots[kept]
            size = 1 << (4 * stop).bit_length()
            self.keys, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._put(old, pieces)
        self._put(keys, np.arange(self.known, stop, dtype=np.int32))
        self.known = stop

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with END_ID after each, and the n + 1 offsets."""
        whole = pc.match_substring_regex(texts, _SPACES)
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        whole = pc.fill_null(whole, False)
        strange = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        data, offsets = W.flat(pc.if_else(whole, pa.scalar("", texts.type), texts) if len(strange) else texts)
        _, ends = W.edges(W.NOT_SPACE[data], offsets)
        # a piece runs from the end of the one before to its own; white space at the end of a text is one more
        stops = np.zeros(len(data) + 1, bool)
        stops[ends] = True
        stops[offsets[1:][np.diff(offsets) > 0]] = True
        if self.cuts_marks:
            stops[1:-1] |= _ALNUM[data[:-1]] & _MARK[data[1:]]
        ends = np.flatnonzero(stops)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        keys = np.maximum(W.span_hashes(data, starts, ends, W.EXACT), np.uint64(1))
        at = self._find(keys)
        piece = self.slots[at].astype(np.int64)
        missing = np.flatnonzero(self.keys[at] != keys)
        if len(missing):
            new, first, which = np.unique(keys[missing], return_index=True, return_inverse=True)
            piece[missing] = self.known + which
            first = missing[first]
            self._learn(new, *self.pieces(data, starts[first], ends[first]))
        starts_of = self.starts[piece]
        lengths = self.starts[piece + 1] - starts_of
        ids = self.ids[W.ragged(starts_of, lengths)]
        before = np.concatenate([[0], np.cumsum(lengths)])
        rows = before[np.searchsorted(ends, offsets, "right") if len(ends) else np.zeros(len(offsets), np.int64)]
        if len(strange):
            own = dict(zip(strange.tolist(), self.whole([texts[int(k)].as_py() for k in strange]), strict=True))
            each = [own.get(k, ids[rows[k] : rows[k + 1]]) for k in range(len(rows) - 1)]
            ids, rows = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        out_rows = rows + np.arange(len(rows))
        out = np.full(out_rows[-1], END_ID, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(rows) - 1), np.diff(rows))] = ids
        return out, out_rows


def _tokenising(path: str):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seq = Encoder.at(path), 0
        for batch in batches:
            for part in W.slices(batch, "text", SLICE_BYTES):
                ids, rows = encoder.encode(part.column("text"))
                packed = pa.py_buffer(_packed(ids))
                column = pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, pa.py_buffer((rows * WIDTH).astype(np.int32)), packed])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.arange(seq, seq + part.num_rows)), column], schema=TOKENS)
                seq += part.num_rows

    return tokenise


#: bytes of an id in the table between tokenising and coding
WIDTH = 3


def _packed(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4)[:, :WIDTH]).tobytes()


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = W.flat(column)
    out = np.zeros((len(data) // WIDTH, 4), np.uint8)
    out[:, :WIDTH] = data.reshape(-1, WIDTH)
    return out.view(np.uint32).ravel(), offsets // WIDTH


# -- codes ---------------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 2**longest:
        raise ValueError(f"{n} ids don't fit codes of {longest} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    merged, flags = leaves, []
    for _ in range(longest - 1):
        flags.append(None)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        flags[-1] = by < n
        merged = both[by]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(flags):
        leaf = int(is_leaf[:take].sum())
        lengths[:leaf] += 1
        take = 2 * (take - leaf)
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass
class Code:
    """Canonical code: shorter codes first, ids in order within a length."""

    ids: np.ndarray
    lengths: np.ndarray

    def __post_init__(self):
        self.most = int(self.lengths.max(initial=1))
        order = np.lexsort((self.ids, self.lengths))
        ids, lengths = self.ids[order], self.lengths[order]
        steps = np.left_shift(1, self.most - lengths)
        firsts = np.cumsum(steps) - steps
        size = int(ids.max(initial=0)) + 1
        self.bits, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.bits[ids], self.length[ids] = (firsts >> (self.most - lengths)).astype(np.uint64), lengths
        self.table_id = np.zeros(2**self.most, np.uint32)
        self.table_length = np.full(2**self.most, 1, np.uint8)
        used = int(steps.sum())
        self.table_id[:used], self.table_length[:used] = np.repeat(ids, steps), np.repeat(lengths, steps)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream and the bit offset of every EVERY-th id."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        total = int(ends[-1]) if len(ends) else 0
        # each code touches one 64-bit word or two; bits of different codes never overlap, so sums are unions
        words = np.zeros(total // 64 + 2, np.uint64)
        at, shift = starts >> 6, 64 - (starts & 63) - lengths
        bits = self.bits[ids]
        over = shift < 0
        own = np.where(over, bits >> np.where(over, -shift, 0).astype(np.uint64), bits << np.where(over, 0, shift).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
        if len(first):
            words[at[first]] = np.add.reduceat(own, first)
            words[at[over] + 1] += bits[over] << (64 + shift[over]).astype(np.uint64)
        return words.byteswap().tobytes()[: -(-total // 8)], starts[::EVERY].astype(np.uint32)

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        """Ids of several blocks, one after another; all checkpoints advance together, an id a step."""
        sizes = np.array([len(p) + 8 for p in payloads], np.int64)
        data = np.frombuffer(b"".join(p + bytes(8) for p in payloads) + bytes(8), np.uint8)
        at = np.cumsum(sizes) - sizes
        lanes = np.concatenate([c.astype(np.int64) + 8 * a for c, a in zip(checkpoints, at, strict=True)])
        left = np.concatenate([np.minimum(EVERY, n - EVERY * np.arange(len(c))) for c, n in zip(checkpoints, counts, strict=True)])
        out = np.zeros((EVERY, len(lanes)), np.uint32)
        # the 32 bits from any byte on, highest first
        wide = data.astype(np.uint32)
        wide = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
        order = np.argsort(-left, kind="stable")
        pos, alive = lanes[order], -left[order]
        down = np.uint32(32 - self.most)
        for step in range(int(left.max(initial=0))):
            live = int(np.searchsorted(alive, -step, "left"))
            p = pos[:live]
            key = (wide[p >> 3] << (p & 7).astype(np.uint32)) >> down
            out[step, :live] = self.table_id[key]
            p += self.table_length[key]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        whole = np.ascontiguousarray(out.T)[back]
        return whole[np.arange(EVERY)[None, :] < left[:, None]]


# -- files ---------------------------------------------------------------------------------------------------------------


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(0, np.int64)
    for batch in batches:
        for part in W.slices(batch, "ids"):
            own = np.bincount(_unpacked(part.column("ids"))[0])
            if len(own) > len(totals):
                own, totals = totals, own.astype(np.int64)
            totals[: len(own)] += own
    some = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], names=["id", "n"])


def _coding(shared):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: Code = shared.value
        for batch in batches:
            for part in W.slices(batch, "ids"):
                ids, rows = _unpacked(part.column("ids"))
                docs, pids, seq = part.column("doc_id").to_pylist(), part.column("part").to_numpy(), part.column("seq").to_numpy()
                # a slice may hold the end of one file of the table and the start of another
                cuts = np.append(np.flatnonzero((np.diff(pids) != 0) | (np.diff(seq) != 1)) + 1, len(docs))
                row = 0
                while row < len(docs):
                    stop = max(row + 1, int(np.searchsorted(rows, rows[row] + BLOCK_IDS, "right")) - 1)
                    stop = min(stop, int(cuts[np.searchsorted(cuts, row, "right")]))
                    payload, marks = code.encode(ids[rows[row] : rows[stop]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([pids[row]], pa.int32()), pa.array([seq[row]]), pa.array([docs[row:stop]], pa.list_(pa.int64())),
                         pa.array([np.diff(rows[row : stop + 1])], pa.list_(pa.int32())), pa.array([payload]), pa.array([marks.tobytes()])], schema=BLOCKS)
                    row = stop

    return encode


def write_token_files(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenises, writes a file set at `path` and returns it. Null texts are empty; null ids come first; repeated rows are
    documents of their own, in any order among equal ids; an empty table gives empty files. Extra columns play no part.

    Documents are dealt by ranges of ids, so parts are even whatever the ids are; the ids table between tokenising and
    coding lies beside the files, because global counts come before the first code.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    parts = max(int(size) // PART_BYTES + 1, spark.sparkContext.defaultParallelism)
    ranged = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    tokens = ranged.mapInArrow(_tokenising(tokenizer), "doc_id bigint, seq bigint, ids binary").select(F.spark_partition_id().alias("part"), "doc_id", "seq", "ids")
    tokens.write.option("compression", "zstd").parquet(f"{path}/tokens")
    tokens = spark.read.parquet(f"{path}/tokens")
    # at most one row per id of the vocabulary
    counts = tokens.select("ids").mapInArrow(_counting, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    ids, lengths = counts.column("id").to_numpy(), code_lengths(counts.column("n").to_numpy())
    spark.createDataFrame(pa.table({"id": ids, "length": lengths})).coalesce(1).write.parquet(f"{path}/codes")
    code = spark.sparkContext.broadcast(Code(ids, lengths))
    blocks = tokens.mapInArrow(_coding(code), BLOCK_TYPES)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def _decoding(shared, with_ids: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: Code = shared.value
        for batch in batches:
            for row in range(0, batch.num_rows, 16):
                own = batch.slice(row, 16)
                lists = own.column("n_tokens")
                lengths = lists.flatten().to_numpy().astype(np.int64)
                docs_of = np.diff(lists.offsets.to_numpy())
                firsts = np.cumsum(docs_of) - docs_of
                marks = [np.frombuffer(x, np.uint32) for x in own.column("checkpoints").to_pylist()]
                ids = code.decode(own.column("payload").to_pylist(), marks, np.add.reduceat(lengths, firsts))
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                block = pa.array(np.repeat(np.arange(len(docs_of)), docs_of))
                columns = {
                    "part": own.column("part").take(block), "block": own.column("block").take(block), "doc_id": own.column("doc_ids").flatten(),
                    "place": pa.array(starts - np.repeat(starts[firsts], docs_of)), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    offsets = pa.py_buffer(np.append(starts * 4, len(raw)).astype(np.int32))
                    columns["ids"] = pa.Array.from_buffers(pa.binary(), len(lengths), [None, offsets, pa.py_buffer(raw)])
                yield pa.RecordBatch.from_pydict(columns)

    return decode


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if wanted, ids (little-endian, 32 bits each)."""
    codes = spark.read.parquet(f"{path}/codes").orderBy("id").toArrow()
    code = spark.sparkContext.broadcast(Code(codes.column("id").to_numpy(), codes.column("length").to_numpy()))
    blocks = spark.read.parquet(f"{path}/blocks")
    schema = "part int, block bigint, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    docs = blocks.mapInArrow(_decoding(code, with_ids), schema)
    return docs.join(_starts(blocks), ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def _starts(blocks: DataFrame) -> DataFrame:
    """part, block and `first`, the ids of all blocks before: sums by part first, then within a part."""
    sized = blocks.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sized.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("base"))
    own = sized.select("part", "block", before(Window.partitionBy("part").orderBy("block")).alias("own"))
    return own.join(parts, "part").select("part", "block", (F.col("base") + F.col("own")).alias("first"))


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
