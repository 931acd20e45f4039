"""SentencePiece encoding and decoding by vectorised merge rounds.

For byte-pair models with byte fallback, no normalisation and a dummy prefix (the model is asked, others are refused). A
slice of texts becomes one flat array of bytes, cut into words: a word is a run of spaces and what follows it up to the next
space; no piece of the model spans a word's start, so words are independent, and each distinct word of a slice is encoded
once. The symbols of all distinct words lie in one flat array. A round looks up the rank of every adjacent pair, takes the
least rank of each word (a segmented minimum), merges that pair wherever it stands in the word, leftmost first and without
overlap, and compacts the array. Words without a pair leave it; rounds go on until it is empty.

The library merges one pair at a time. Merging a pair at several places of a word at once gives the same result unless a
merge makes a new pair of the same or a better rank; in such a round the word's merges stop after the place where that
happens, and the rest waits for the next round. So every round does at least one merge of every word left.

Null and empty texts have no ids. Ids null or empty decode to the empty text. Very long texts are a slice of their own;
a very long word takes as many rounds as it has dependent merges, alone in the array by then. Repeated rows are encoded
each. All columns stay; only a column named like the output is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from . import words as W

SPACE = "▁"
#: bytes of text, and ids, that are handled at once
SLICE_BYTES, SLICE_IDS = 2 << 20, 1 << 19
NEVER, EMPTY = np.int32(2**31 - 1), np.int64(-1)
#: shape of the texts that models handled here leave as they are, but for the prefix and the signs for spaces
_PROBE = " Ａﬁ\t x  "


@dataclass
class Vocabulary:
    symbol_of: np.ndarray  # by code point: symbol that a character begins as, -1 where no piece has it
    n_pieces: int  # symbols from here on are characters that only occur inside longer pieces
    keys: np.ndarray  # open addressing: left symbol << 32 | right symbol, EMPTY where free
    ranks: np.ndarray  # NEVER where free
    merged: np.ndarray
    byte_ids: np.ndarray
    surface: np.ndarray  # bytes of all pieces as they are decoded, end to end
    surface_at: np.ndarray
    is_byte: np.ndarray
    is_silent: np.ndarray
    is_spaced: np.ndarray  # begins with the sign for a space

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NEVER where it does not merge, and the symbol it becomes."""
        key = (left.astype(np.int64) << 32) | right
        slot = _slots(key, len(self.keys))
        found = self.keys[slot]
        open_ = np.flatnonzero((found != key) & (found != EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            open_ = open_[(found != key[open_]) & (found != EMPTY)]
        return self.ranks[slot], self.merged[slot]


def _slots(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _table(rows: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, ranks and merged symbols by slot, filled at most an eighth; each round places one key of every wanted free slot."""
    size = 1 << max(4, (8 * len(rows)).bit_length())
    keys, ranks, merged = np.full(size, EMPTY), np.full(size, NEVER), np.zeros(size, np.int32)
    left = np.array(rows, dtype=np.int64).reshape(-1, 3)
    slot = _slots(left[:, 0], size)
    while len(left):
        free = np.flatnonzero(keys[slot] == EMPTY)
        _, one = np.unique(slot[free], return_index=True)
        put = free[one]
        keys[slot[put]], ranks[slot[put]], merged[slot[put]] = left[put].T
        rest = np.ones(len(left), bool)
        rest[put] = False
        left, slot = left[rest], (slot[rest] + 1) & (size - 1)
    return keys, ranks, merged


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    silent = np.array([model.is_control(i) for i in range(n)])
    byte = np.array([model.is_byte(i) for i in range(n)])
    unknown = np.array([model.is_unknown(i) for i in range(n)])
    plain = np.flatnonzero(~(silent | byte | unknown))
    if byte.sum() != 256 or any(model.is_unused(i) for i in range(n)) or model.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
        raise ValueError(f"{path}: only byte-pair models with byte fallback, without normalisation, are handled")
    if any(SPACE in pieces[i].lstrip(SPACE) for i in plain):
        raise ValueError(f"{path}: a piece spans the start of a word")
    id_of = {pieces[i]: int(i) for i in plain}
    alone = sorted({c for p in id_of for c in p} - id_of.keys())
    symbols = id_of | {c: n + k for k, c in enumerate(alone)}
    symbol_of = np.full(0x110000, -1, np.int32)
    for c, s in symbols.items():
        if len(c) == 1:
            symbol_of[ord(c)] = s
    scores = np.array([model.get_score(int(i)) for i in plain])
    rank_of = dict(zip(plain.tolist(), np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
    rows = [(symbols[p[:k]] << 32 | symbols[p[k:]], rank_of[i], i) for p, i in id_of.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
    byte_ids = np.zeros(256, np.int32)
    surface: list[bytes] = []
    for i, p in enumerate(pieces):
        if byte[i]:
            byte_ids[int(p[3:5], 16)] = i
        surface.append(bytes([int(p[3:5], 16)]) if byte[i] else b"" if silent[i] else " ⁇ ".encode() if unknown[i] else p.replace(SPACE, " ").encode())
    return Vocabulary(
        symbol_of, n, *_table(rows), byte_ids, np.frombuffer(b"".join(surface), np.uint8),
        np.cumsum([0, *map(len, surface)]), byte, silent, np.array([p.startswith(SPACE) for p in pieces]) & ~silent & ~byte & ~unknown)


def merge_rounds(symbols: np.ndarray, word: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols left of each word when no pair is left, as (word, first character, symbol) in order; `word` is ascending."""
    symbols, word, place = symbols.astype(np.int32), word.astype(np.int32), np.arange(len(symbols), dtype=np.int32)
    rank, merged = np.full(len(symbols), NEVER), np.zeros(len(symbols), np.int32)
    _look_up(symbols, word, np.arange(len(symbols)), rank, merged, vocabulary)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(symbols):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        length = np.diff(np.append(first, len(symbols)))
        best = np.minimum.reduceat(rank, first)
        if (best == NEVER).any():
            over = np.repeat(best == NEVER, length)
            done.append((word[over], place[over], symbols[over]))
            symbols, word, place, rank, merged = (x[~over] for x in (symbols, word, place, rank, merged))
            best, length = best[best != NEVER], length[best != NEVER]
            if not len(symbols):
                break
        hits = np.flatnonzero(rank == np.repeat(best, length))
        # of neighbouring hits every other one, from the left
        begins = np.append(True, np.diff(hits) != 1)
        if not begins.all():
            run = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
        if len(hits) > len(best):
            hits = hits[_safe(symbols, word, hits, merged[hits], rank[hits], vocabulary)]
        symbols[hits] = merged[hits]
        keep = np.ones(len(symbols), bool)
        keep[hits + 1] = False
        symbols, word, place, rank, merged = (x[keep] for x in (symbols, word, place, rank, merged))
        hits -= np.arange(len(hits))
        _look_up(symbols, word, np.concatenate([hits, hits[hits > 0] - 1]), rank, merged, vocabulary)
    if not done:
        return word, place, symbols
    word, place, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(place)
    return word[order], place[order], symbols[order]


def _look_up(symbols, word, at, rank, merged, vocabulary) -> None:
    """Rank and result of the pairs that begin at `at`, put into `rank` and `merged`."""
    after = np.minimum(at + 1, len(symbols) - 1)
    found, into = vocabulary.pairs(symbols[at], symbols[after])
    rank[at] = np.where((word[after] == word[at]) & (after > at), found, NEVER)
    merged[at] = into


def _safe(symbols, word, hits, merged, rank, vocabulary) -> np.ndarray:
    """Which merges may be done together: those up to the first of a word that makes a pair of the same or a better rank."""
    new = np.append(True, word[hits[1:]] != word[hits[:-1]])
    group = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1)  # words with one merge have nothing to wait for
    at, n = hits[several], len(symbols)
    follows = np.append(False, (np.diff(at) == 2) & (word[at[1:]] == word[at[:-1]]))
    left = np.where(follows, np.append(-1, merged[several][:-1]), symbols[np.maximum(at - 1, 0)])
    left[(at == 0) | (word[np.maximum(at - 1, 0)] != word[at])] = -1
    after = np.minimum(at + 2, n - 1)
    right = np.where((at + 2 < n) & (word[after] == word[at]), symbols[after], -1)
    made, limit = merged[several], rank[several]
    clash = np.zeros(len(hits), bool)
    clash[several] = (vocabulary.pairs(left, made)[0] <= limit) | (vocabulary.pairs(made, right)[0] <= limit)
    before = np.cumsum(clash) - clash
    return before == before[np.flatnonzero(new)[group]]


def encode_column(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the n + 1 offsets of the texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if pc.any(pc.match_substring(texts, SPACE)).as_py():
        texts = pc.replace_substring(texts, SPACE, " ")
    prefix = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    data, offsets = W.flat(pc.binary_join_element_wise(prefix, texts, pa.scalar("", pa.large_string())))
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    space = data == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    _, first, which = np.unique(W.span_hashes(data, starts, ends, W.EXACT), return_index=True, return_inverse=True)
    starts_of, lengths = starts[first], (ends - starts)[first]
    spelled = data[W.ragged(starts_of, lengths)]
    points = np.frombuffer(spelled.tobytes().decode().encode("utf-32-le"), np.uint32)
    firsts = (spelled & 0xC0) != 0x80  # bytes that begin a character
    word = np.repeat(np.arange(len(first)), lengths)[firsts]
    points = np.where(points == 0x20, np.uint32(ord(SPACE)), points)
    word, place, symbols = merge_rounds(vocabulary.symbol_of[points], word, vocabulary)
    # characters without a piece become their bytes
    raw = (symbols < 0) | (symbols >= vocabulary.n_pieces)
    byte_at = np.append(np.flatnonzero(firsts), len(spelled))
    width = np.where(raw, byte_at[place + 1] - byte_at[place], 1)
    ids = np.repeat(symbols, width)
    ids[np.repeat(raw, width)] = vocabulary.byte_ids[spelled[W.ragged(byte_at[place[raw]], width[raw])]]
    n_ids = np.bincount(word, weights=width, minlength=len(first)).astype(np.int64)
    id_at = np.cumsum(n_ids) - n_ids
    out = ids[W.ragged(id_at[which], n_ids[which])].astype(np.int32)
    ends_of = np.append(0, np.cumsum(n_ids[which]))
    return out, ends_of[np.searchsorted(starts, offsets)]


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


def decode_column(lists: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    """Texts of lists of ids; a byte that is no part of a character reads as U+FFFD."""
    codecs.register_error("each_byte", _each_byte)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ids = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.append(0, np.cumsum(counts))
    at, size = vocabulary.surface_at[ids], np.diff(vocabulary.surface_at)[ids]
    # the prefix goes from the first piece that says something
    heard = np.flatnonzero(~vocabulary.is_silent[ids])
    place = np.searchsorted(heard, rows[:-1])
    found = place < np.searchsorted(heard, rows[1:])
    first = heard[place[found]]
    first = first[vocabulary.is_spaced[ids[first]]]
    at[first] += 1
    size[first] -= 1
    data = vocabulary.surface[W.ragged(at, size)].tobytes()
    ends = np.append(0, np.cumsum(size))[rows]
    return pa.array([data[a:b].decode("utf-8", "each_byte") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())


def _slices_of_ids(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most SLICE_IDS ids each, or one row where a list is longer."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    row = 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + SLICE_IDS, "right")))
        yield batch.slice(row, stop - row)
        row = stop


def _with_column(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in docs.schema.fields if f.name != name]).add(name, kind)


def _put(part: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [k for k, f in enumerate(part.schema.names) if f != name]
    return pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), column], [*(part.schema.names[k] for k in kept), name])


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with `ids_col`, the ids of each whole text, without begin and end ids."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in batches:
            for part in W.slices(batch, text_col, SLICE_BYTES):
                ids, rows = encode_column(part.column(text_col), vocabulary)
                yield _put(part, ids_col, pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids)))

    return docs.mapInArrow(task, _with_column(docs, ids_col, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with `text_col`, the text that the ids stand for."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load(path)
        for batch in batches:
            for part in _slices_of_ids(batch, ids_col):
                yield _put(part, text_col, decode_column(part.column(ids_col), vocabulary))

    return docs.mapInArrow(task, _with_column(docs, text_col, T.StringType()))
