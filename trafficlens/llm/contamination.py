"""Benchmark decontamination with training suffix arrays.

Each slice of the corpus (about 2 MB of text) is a shard with a suffix array over its words; every benchmark suffix is
binary-searched in every shard. The array is ordered to the depth of the shortest match that counts (a window of ten
words); longer verbatim matches are runs of such matches on one diagonal of a document and an item. Of each run only its two
ends are formed, so the work grows with the matches found and not with the windows in them. The corpus is never shuffled: it streams past
the benchmark, which is the query set. A benchmark beyond `QUERY_BYTES` is searched in several passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .lineage import cut
from .names import fresh

#: words of a window
WINDOW = 10
#: most benchmark text that is broadcast at once
QUERY_BYTES = 64 << 20
PACK, BITS = 3, 21
_LOW = np.uint64((1 << BITS) - 1)

MATCH = "array<struct<doc_word:bigint,n_words:bigint,item_id:string,item_word:bigint>>"


@dataclass
class Places:
    """Positions of each window, sorted by (window, window beside the position within its item, or -1)."""

    position: np.ndarray
    key: np.ndarray
    n: int  # windows

    def other(self, window: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into the arguments, position): all positions of `window` but those that have `beside` (-1: none) next to them."""
        wide = self.n + 1
        lo, hi = (np.searchsorted(self.key, (window + k) * wide) for k in (0, 1))
        skip = [np.searchsorted(self.key, window * wide + beside + 1, side) for side in ("left", "right")]
        a, b = (np.where(beside < 0, hi, x) for x in skip)
        took = np.concatenate([W.ragged(lo, a - lo), W.ragged(b, hi - b)])
        of = np.concatenate([np.repeat(np.arange(len(window)), a - lo), np.repeat(np.arange(len(window)), hi - b)])
        return of, self.position[took]


def _places(position: np.ndarray, window: np.ndarray, beside: np.ndarray, n: int) -> Places:
    key = window * (n + 1) + beside + 1
    by = np.lexsort((position, key))
    return Places(position[by], key[by], n)


@dataclass
class Queries:
    """Distinct windows of the benchmark by length: positions into `hashes`, and the items that have each window."""

    ids: np.ndarray  # item ids as strings
    hashes: np.ndarray  # words of all items
    item_of: np.ndarray  # by word
    first_word: np.ndarray  # by item
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> (position, n + 1 offsets, items)
    places: dict[int, tuple[Places, Places]]  # length -> all positions, by the window before and by the window after


def build_queries(ids: list[str], texts: pa.Array, window: int = WINDOW) -> Queries:
    found = W.words(texts, W.ALPHANUMERIC)
    counts, item_of = found.counts(), found.row_of()
    of_length: dict[int, list[np.ndarray]] = {}
    for n in np.unique(counts[counts > 0]):
        first = found.rows[:-1][counts == n]
        spread = first[:, None] + np.arange(max(1, n - window + 1))[None, :]
        of_length.setdefault(int(min(n, window)), []).append(spread.ravel())
    built, places = {}, {}
    for n, parts in of_length.items():
        at = np.sort(np.concatenate(parts))
        keys = np.zeros(len(at), np.uint64)
        for k in range(n):
            keys = W.mix(keys * np.uint64(31) + found.hashes[at + k])
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([group, item_of[at]], 1), axis=0)
        built[n] = (at[first], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), pairs[:, 1])
        follows = (np.diff(at) == 1) & (np.diff(item_of[at]) == 0)
        before, after = np.full(len(at), -1), np.full(len(at), -1)
        before[1:] = np.where(follows, group[:-1], -1)
        after[:-1] = np.where(follows, group[1:], -1)
        places[n] = tuple(_places(at, group, beside, len(first)) for beside in (before, after))
    return Queries(np.array(ids, dtype=object), found.hashes, item_of, found.rows[:-1], built, places)


def _codes(hashes: np.ndarray) -> np.ndarray:
    """21 bits of each word, never 0; words that share a code are told apart after the search."""
    return np.maximum(hashes >> np.uint64(64 - BITS), np.uint64(1))


def _packed(codes: np.ndarray) -> np.ndarray:
    """Three words from each position on in one integer, so that comparing integers compares word sequences."""
    longer = np.concatenate([codes, np.zeros(PACK - 1, np.uint64)])
    n = len(codes)
    return (longer[:n] << np.uint64(2 * BITS)) | (longer[1 : n + 1] << np.uint64(BITS)) | longer[2 : n + 2]


def suffix_array(packed: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the `depth` words that follow; only ties go on to the next three words."""
    order = np.argsort(packed)
    keys = packed[order]
    far = len(packed) - 1
    tied, at = None, 0
    while True:
        same = keys[1:] == keys[:-1]
        if tied is not None:
            same &= groups[1:] == groups[:-1]
        edge = np.zeros(len(keys), bool)
        edge[1:] |= same
        edge[:-1] |= same
        at += PACK
        if at >= depth or not edge.any():
            return order
        places = np.flatnonzero(edge) if tied is None else tied[edge]
        starts = np.ones(len(keys), bool)
        starts[1:] = ~same
        groups = np.cumsum(starts)[edge]
        keys = packed[np.minimum(order[places] + at, far)]
        by = np.lexsort((keys, groups))
        order[places] = order[places][by]
        keys, tied = keys[by], places


def _search(order: np.ndarray, packed: np.ndarray, first: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `codes` (word sequences of one length) the range of suffixes that begin with it."""
    n, length = codes.shape
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order))
    live = np.arange(n)
    far = len(packed) - 1
    for at in range(0, length, PACK):
        part = codes[live, at : at + PACK]
        low, spare = np.zeros(len(live), np.uint64), BITS * PACK
        for k in range(part.shape[1]):
            spare -= BITS
            low |= part[:, k] << np.uint64(spare)
        high = low | np.uint64((1 << spare) - 1)
        if not at:
            left, right = np.searchsorted(first, low, "left"), np.searchsorted(first, high, "right")
        else:
            left, right = (_bisect(order, packed, at, far, lo[live], hi[live], x, up) for x, up in ((low, False), (high, True)))
        lo[live], hi[live] = left, right
        live = live[left < right]
    return lo, np.maximum(lo, hi)


def _bisect(order, packed, at, far, lo, hi, value, up) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        keys = packed[np.minimum(order[np.minimum(mid, len(order) - 1)] + at, far)]
        right = open_ & ((keys <= value) if up else (keys < value))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)
    return lo


@dataclass
class Found:
    n_words: np.ndarray
    hits: np.ndarray  # bool by word
    rows: np.ndarray  # n + 1 offsets into the words
    doc_items: np.ndarray  # (document, item), unique and sorted
    matches: list[tuple[int, int, int, int, int]]  # document, word, length, item, word of the item


def search_shard(texts: pa.Array, queries: Queries, want_matches: bool = True) -> Found:
    found = W.words(texts, W.ALPHANUMERIC)
    n_docs, n = len(found.rows) - 1, len(found.hashes)
    hits = np.zeros(n, bool)
    nothing = Found(found.counts(), hits, found.rows, np.zeros((0, 2), np.int64), [])
    if not n or not queries.windows:
        return nothing
    # words with one empty place after each document, so that no match runs into the next one
    place = np.arange(n) + found.row_of()
    hashes = np.zeros(n + n_docs + WINDOW + PACK, np.uint64)
    hashes[place] = found.hashes
    codes = np.zeros(len(hashes), np.uint64)
    codes[place] = _codes(found.hashes)
    packed = _packed(codes)
    order = suffix_array(packed, max(queries.windows))
    first = packed[order]
    word_at = np.full(len(hashes), -1)
    word_at[place] = np.arange(n)
    row_of = found.row_of()
    deltas = np.zeros(n + 1, np.int64)
    pairs, spots = [], []
    for length, (at, offsets, items) in queries.windows.items():
        lo, hi = _search(order, packed, first, _codes(queries.hashes)[at[:, None] + np.arange(length)])
        window = np.repeat(np.arange(len(at)), hi - lo)
        where = order[W.ragged(lo, hi - lo)]
        same = np.ones(len(where), bool)
        for k in range(length):
            same &= hashes[np.minimum(where + k, len(hashes) - 1)] == queries.hashes[at[window] + k]
        window, where = window[same], word_at[where[same]]
        np.add.at(deltas, where, 1)
        np.add.at(deltas, where + length, -1)
        docs = np.unique(np.stack([row_of[where], window], 1), axis=0)
        n_items = offsets[docs[:, 1] + 1] - offsets[docs[:, 1]]
        pairs.append(np.stack([np.repeat(docs[:, 0], n_items), items[W.ragged(offsets[docs[:, 1]], n_items)]], 1))
        if want_matches and len(where):
            spots.append(_maximal(where, window, length, row_of, queries.places[length]))
    nothing.hits[:] = np.cumsum(deltas[:-1]) > 0
    nothing.doc_items = np.unique(np.concatenate(pairs), axis=0)
    for spot in spots:
        for doc, word, many, item_word in spot:
            item = queries.item_of[item_word]
            nothing.matches.append((int(doc), int(word - found.rows[doc]), int(many), int(item), int(item_word - queries.first_word[item])))
    nothing.matches.sort()
    return nothing


def _maximal(where: np.ndarray, window: np.ndarray, length: int, row_of: np.ndarray, places: tuple[Places, Places]) -> np.ndarray:
    """Verbatim matches that cannot be made longer on either side: document, word, words, word of the item, as rows.

    An occurrence of a window and a position of it in an item begin a match unless the windows before both are the same, and
    end one unless the windows after both are. Matches on one diagonal do not overlap, so its beginnings and ends, in order,
    belong together."""
    spot = where + row_of[where]  # with an empty place after each document
    seen = np.full(len(row_of) + row_of[-1] + 3, -1)
    seen[spot + 1] = window
    edges = []
    for beside, place in zip((seen[spot], seen[spot + 2]), places, strict=True):
        of, item_word = place.other(window, beside)
        by = np.lexsort((where[of], spot[of] - item_word))
        edges.append((where[of][by], item_word[by]))
    (begin, item_word), (end, _) = edges
    return np.stack([row_of[begin], begin, end - begin + length, item_word], 1)


def _passes(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[tuple[list[str], pa.Array]]:
    """The benchmark in parts of about `limit` bytes at most; its size is asked before anything is fetched."""
    items = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.length("id") + 16), F.lit(0)).alias("b")).first()["b"]
    parts = max(1, -(-int(total) // limit))
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        table = part.toArrow()
        yield table.column("id").to_pylist(), table.column("text").combine_chunks()


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """docs with n_words, n_hit, item_ids (sorted as strings) and matches, one row out for each row in.

    A document word is hit if it lies in an occurrence of an item window (`window` consecutive words, or the whole of a
    shorter item). Null and empty texts have no words and no hits; an item without words never matches; repeated items
    count by id; a null item id reads as ''. ``matches`` holds every verbatim match of a document and an item, of at least a
    window, that cannot be made longer on either side: its first word and words, the item and its first word there; each
    once, also for repeated items. All columns of docs are kept, but for columns of the four new names.
    """
    new = {"n_words": "bigint", "n_hit": "bigint", "item_ids": "array<string>", "matches": MATCH}
    docs = docs.drop(*new)
    own = fresh(docs, "_runs")
    state = docs.select("*", F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias(own), *(F.lit(None).cast(t).alias(c) for c, t in new.items()))
    schema = state.schema
    spark = docs.sparkSession
    for k, (ids, texts) in enumerate(_passes(items, item_id, item_text, query_bytes)):
        shared = spark.sparkContext.broadcast(build_queries(ids, texts, window))
        if k:
            state = cut(state)
        state = state.mapInArrow(_searching(shared, text_col, own), schema)
    return state.drop(own)


def _searching(shared, text_col: str, own: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for batch in batches:
            for part in W.slices(batch, text_col):
                found = search_shard(part.column(text_col), queries)
                yield _merged(part, found, queries, own)

    return search


def _merged(part: pa.RecordBatch, found: Found, queries: Queries, own_col: str) -> pa.RecordBatch:
    """The rows of a shard with what this pass found joined to what earlier passes found."""
    n = part.num_rows
    starts, ends = W.edges(found.hits, found.rows)
    of_row = np.searchsorted(starts, found.rows)
    by_row = np.searchsorted(found.doc_items[:, 0], np.arange(n + 1))
    matches: dict[int, list] = {}
    for doc, word, many, item_id, item_word in sorted({(d, w, n, queries.ids[item], at) for d, w, n, item, at in found.matches}):
        matches.setdefault(doc, []).append({"doc_word": word, "n_words": many, "item_id": item_id, "item_word": item_word})
    before_runs, before_ids, before = (part.column(c).to_pylist() for c in (own_col, "item_ids", "matches"))
    runs, n_hit, ids, all_matches = [], [], [], []
    for k in range(n):
        own = [(int(starts[j] - found.rows[k]), int(ends[j] - found.rows[k])) for j in range(of_row[k], of_row[k + 1])]
        if before_runs[k]:
            own = _union(own + [(x["a"], x["b"]) for x in before_runs[k]])
        runs.append([{"a": a, "b": b} for a, b in own])
        n_hit.append(sum(b - a for a, b in own))
        ids.append(sorted({*queries.ids[found.doc_items[by_row[k] : by_row[k + 1], 1]], *(before_ids[k] or ())}))
        all_matches.append((before[k] or []) + matches.get(k, []))
    made = {own_col: runs, "n_words": found.n_words, "n_hit": n_hit, "item_ids": ids, "matches": all_matches}
    columns = [pa.array(made[f.name], f.type) if f.name in made else part.column(f.name) for f in part.schema]
    return pa.RecordBatch.from_arrays(columns, schema=part.schema)


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """docs without the rows that repeat a window of the benchmark; null and empty texts stay."""
    columns = docs.columns
    found = contamination(docs, items, **names)
    return found.where(F.col("n_hit") == 0).select(*columns)


def item_digest(item_ids: Column) -> Column:
    return F.sha2(F.array_join(item_ids, ","), 256)


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple[int, int, list[str]]]:
    """n_words, n_hit and item ids by comparing word lists; for tests."""
    import re

    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for text in texts:
        own, hit, ids = split(text), set(), set()
        for item, item_text in items:
            theirs = split(item_text)
            size = min(window, len(theirs))
            for i in range(len(theirs) - size + 1 if size else 0):
                for p in range(len(own) - size + 1):
                    if own[p : p + size] == theirs[i : i + size]:
                        hit.update(range(p, p + size))
                        ids.add(item)
        out.append((len(own), len(hit), sorted(ids)))
    return out


def brute_matches(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple[int, int, str, int]]:
    """The matches of one text by walking along every diagonal; for tests."""
    import re

    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, out = split(text), set()
    for item, item_text in items:
        theirs = split(item_text)
        for shift in range(-len(theirs), len(own) + 1):
            run = 0
            for d in range(max(0, shift), min(len(own), shift + len(theirs)) + 1):
                if d < min(len(own), shift + len(theirs)) and own[d] == theirs[d - shift]:
                    run += 1
                    continue
                if run and run >= min(window, len(theirs)):
                    out.add((d - run, run, item, d - run - shift))
                run = 0
    return sorted(out)


def sha256_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
