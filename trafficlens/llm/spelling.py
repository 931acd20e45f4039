"""Spelling variants by finite-state composition.

Words at one edit are pairs accepted by: vocabulary acceptor, one-edit transducer, vocabulary acceptor. The composition is cut
into parts that know their initial states: a window of the shorter word (first its two halves) holds the edit, and
all that stands outside of the window is the part's initial state, shared by both words. Parts are dealt out by it. In a task the
windows of all parts form one minimal acyclic acceptor, built level by level: states with equal outgoing transitions are
one state, whichever part they come from. States count the words they accept, so a path tells its word's number. The
composition runs over whole levels at once: pairs of equal states before the edit, pairs of states after it. Pairs never
leave the task; a word's number of partners and its best one do.

A part with more than `PART_WORDS` words is split by halving its window, again and again if need be; a window of one code
point has few words by the size of the alphabet. So no part grows with the vocabulary.

Null and empty texts have no words. A null id counts as '' in the checksum. Texts, however long, are split by Spark's own
expressions; repeated rows count each. Of partners with equally many occurrences the first in code-point order counts. Extra
columns play no part. An empty table gives an empty result.
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

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: one run in so many loses a code point
SLIPS = 31
#: a form has at least so many times the occurrences of the word
FORM_TIMES = 10
#: most words of a part, and words that a task composes at once
PART_WORDS, CHUNK_WORDS = 8192, 1 << 16
#: rows of a task
TASK_ROWS = 400_000
_LABELS = np.int64(1) << 21

_PARTIAL = "word string, n_near bigint, best struct<lost:bigint,word:string>"
_PARTIAL_ARROW = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.struct([("lost", pa.int64()), ("word", pa.string())]))])


def slipped(doc_id: Column, run: Column) -> Column:
    """The run, or for one in SLIPS by checksum, the run without one of its code points."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % SLIPS == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least LEAST_LENGTH code points that occur LEAST_COUNT times or more."""
    text = F.translate(F.col(text_col), UPPER, LOWER)
    # a run may lose one code point, never gain one
    runs = F.filter(F.regexp_extract_all(text, F.lit(RUN), 0), lambda x: F.length(x) >= LEAST_LENGTH)
    each = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    words = each.select(slipped(F.col("id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _windows(words: DataFrame) -> DataFrame:
    """(word, n, m, a, b): the code points a .. b - 1 of a shorter word of length m as the place of the edit; halves of all."""
    size = F.length("word")
    lengths = F.filter(F.array(size, size - 1), lambda m: m >= LEAST_LENGTH)
    each = words.select("word", "n", F.explode(lengths).alias("m"))
    half = F.expr("m div 2")
    return each.select("word", "n", "m", F.explode(F.array(
        F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("m").alias("b")))).alias("w")).select("word", "n", "m", "w.a", "w.b")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with `part`, a hash of the window and of what stands outside of it."""
    behind = F.col("b") + F.length("word") - F.col("m")
    return rows.withColumn("part", F.xxhash64("m", "a", "b", F.expr("substring(word, 1, a)"), F.col("word").substr(behind + 1, F.length("word"))))


@dataclass
class Level:
    """Transitions of the states before one symbol, by state and label."""

    start: np.ndarray  # n + 1 offsets of states
    label: np.ndarray
    target: np.ndarray  # state of the next level
    skip: np.ndarray  # words of the state before this transition
    key: np.ndarray  # state * _LABELS + label


def acceptor(part: np.ndarray, spelled: np.ndarray) -> tuple[list[Level], list[tuple[np.ndarray, np.ndarray]]]:
    """The minimal acceptor of distinct rows sorted by part and symbols, and for each level the (state, first row) of all prefixes."""
    n, width = spelled.shape
    new = np.zeros((width + 1, n), bool)
    new[0] = np.append(True, part[1:] != part[:-1])
    for d in range(width):
        new[d + 1] = new[d] | np.append(True, spelled[1:, d] != spelled[:-1, d])
    state = np.zeros(int(new[width].sum()), np.int64)  # every word ends in the one last state
    accepted = np.ones(1, np.int64)
    levels, prefixes = [], [(state, np.flatnonzero(new[width]))]
    for d in range(width - 1, -1, -1):
        child = np.flatnonzero(new[d + 1])  # first rows of the prefixes one symbol longer
        parent = np.cumsum(new[d])[child] - 1
        label = spelled[child, d].astype(np.int64)
        sums = np.zeros(int(new[d].sum()), np.uint64)
        np.add.at(sums, parent, W.mix(label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + W.mix(state.astype(np.uint64) + np.uint64(1))))
        _, one, which = np.unique(sums, return_index=True, return_inverse=True)
        first = np.searchsorted(parent, one)
        many = np.searchsorted(parent, one, "right") - first
        edges = W.ragged(first, many)
        start = np.append(0, np.cumsum(many))
        words = accepted[state[edges]]
        before = np.cumsum(words) - words
        skip = before - np.repeat(before[start[:-1]], many)
        accepted = np.add.reduceat(words, start[:-1])
        owner = np.repeat(np.arange(len(one)), many)
        levels.append(Level(start, label[edges], state[edges], skip, owner * _LABELS + label[edges]))
        state = which
        prefixes.append((state, np.flatnonzero(new[d])))
    return levels[::-1], prefixes[::-1]


def _leave(level: Level, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All transitions out of each state: which of the given states, which transition."""
    many = level.start[state + 1] - level.start[state]
    return np.repeat(np.arange(len(state)), many), W.ragged(level.start[state], many)


def _meet(one: Level, other: Level, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moves of pairs of states along equal labels. Items are rows (state, state, word, word, label not to be read)."""
    which, edge = _leave(one, items[0])
    key = items[1][which] * _LABELS + one.label[edge]
    at = np.minimum(np.searchsorted(other.key, key), len(other.key) - 1)
    good = (other.key[at] == key) & (one.label[edge] != items[4][which])
    which, edge, at = which[good], edge[good], at[good]
    nothing = np.full(len(which), -1)
    return one.label[edge], np.stack([one.target[edge], other.target[at], items[2][which] + one.skip[edge], items[3][which] + other.skip[at], nothing])


def compose(part: np.ndarray, spelled: np.ndarray, whole_end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (the longer or later one, the other) at exactly one edit, whose first difference lies in the window.

    `spelled` holds the window's symbols, one more than the window for longer words, 0 at the end of shorter ones; rows are
    distinct and sorted by part and symbols. `whole_end` says that the window reaches the end of the word, so that the
    longer word's extra code point may stand behind it. Two words of the greater length are no pair here.
    """
    levels, prefixes = acceptor(part, spelled)
    last = spelled.shape[1] - 1
    swaps, drops = (np.zeros((5, 0), np.int64) for _ in range(2))  # drops: the first word is one symbol ahead
    found: list[np.ndarray] = []
    for d in range(last + 1):
        level = levels[d]
        state, row = prefixes[d]
        label, moved = _meet(level, level, swaps)
        swaps = moved if d < last else moved[:, label == 0]
        if d < last:
            ahead = levels[d + 1]
            many = level.start[state + 1] - level.start[state]
            which, edge = _leave(level, state)
            # each transition with those behind it in the same state
            behind = np.repeat(level.start[state] + many, many) - edge - 1
            pair, other = np.repeat(np.arange(len(edge)), behind), W.ragged(edge + 1, behind)
            x = edge[pair]
            fresh = np.stack([level.target[other], level.target[x], row[which[pair]] + level.skip[other], row[which[pair]] + level.skip[x], np.full(len(x), -1)])
            dropped = np.stack([level.target[edge], state[which], row[which] + level.skip[edge], row[which], level.label[edge]])
            swaps, (_, drops) = np.concatenate([swaps, fresh], 1), _meet(ahead, level, np.concatenate([drops, dropped], 1))
        else:
            # the first word is at its end, the other one has to end
            items = drops
            if whole_end:
                which, edge = _leave(level, state)
                use = level.label[edge] != 0
                which, edge = which[use], edge[use]
                items = np.concatenate([items, np.stack([level.target[edge], state[which], row[which] + level.skip[edge], row[which], np.full(len(edge), -1)])], 1)
            key = items[1] * _LABELS
            at = np.minimum(np.searchsorted(level.key, key), len(level.key) - 1)
            good = level.key[at] == key
            found.append(np.stack([items[2][good], items[3][good] + level.skip[at[good]]]))
    found.append(swaps[2:4])
    pairs = np.concatenate(found, 1)
    return pairs[0], pairs[1]


def _code_points(words: pa.Array, length: int) -> np.ndarray:
    joined = "".join(words.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(-1, length)


def near_words(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each word of whole parts: how many words are near it here, and the best of them."""
    words, n = chunk.column("word").combine_chunks(), chunk.column("n").to_numpy()
    part, m, a, b = (chunk.column(c).to_numpy() for c in ("part", "m", "a", "b"))
    length = pc.utf8_length(words).to_numpy()
    pairs = []
    for m_, a_, b_ in np.unique(np.stack([m, a, b], 1), axis=0).tolist():
        rows = np.flatnonzero((m == m_) & (a == a_) & (b == b_))
        short, long_ = rows[length[rows] == m_], rows[length[rows] == m_ + 1]
        if not len(short):
            continue
        x, y = _code_points(words.take(pa.array(short)), m_), _code_points(words.take(pa.array(long_)), m_ + 1)
        spelled = np.zeros((len(short) + len(long_), b_ - a_ + 1), np.uint32)
        spelled[: len(short), :-1] = x[:, a_:b_]
        spelled[len(short) :] = y[:, a_ : b_ + 1]
        outside = np.concatenate([np.delete(x, np.s_[a_:b_], 1), np.delete(y, np.s_[a_ : b_ + 1], 1)])
        own = np.concatenate([short, long_])
        order = np.lexsort((*spelled.T[::-1], part[own]))
        left, right = (order[x] for x in compose(part[own][order], spelled[order], b_ == m_))
        same = (outside[left] == outside[right]).all(1)  # parts are hashes
        pairs.append(np.stack([own[left[same]], own[right[same]]]))
    if not pairs:
        return
    both = np.concatenate(pairs, 1)
    of, near = np.concatenate(both), np.concatenate(both[::-1])
    if not len(of):
        return
    spelling = pc.rank(words, tiebreaker="dense").to_numpy()
    order = np.lexsort((spelling[near], -n[near], of))
    of, near = of[order], near[order]
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    best = pa.StructArray.from_arrays([pa.array(-n[near[first]]), words.take(pa.array(near[first]))], ["lost", "word"])
    yield pa.RecordBatch.from_arrays([words.take(pa.array(of[first])), pa.array(np.diff(np.append(first, len(of)))), best], schema=_PARTIAL_ARROW)


def _composing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part; whole parts are composed, about CHUNK_WORDS rows at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= CHUNK_WORDS:
            table = pa.Table.from_batches(held)
            part = table.column("part").to_numpy()
            end = int(np.searchsorted(part, part[-1]))  # the last part may go on
            if end:
                yield from near_words(table.slice(0, end))
                held = table.slice(end).to_batches()
    if held and sum(x.num_rows for x in held):
        yield from near_words(pa.Table.from_batches(held))


def near_counts(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, n_near, best): for words that have near ones, their number and the one of largest n, the first among equals."""
    rows = cut(_keyed(_windows(words)))
    found = None
    while True:
        total = rows.count()
        large = cut(rows.groupBy("part").agg(F.count("*").alias("k"), F.max(F.col("b") - F.col("a")).alias("width"))
                    .where((F.col("k") > part_words) & (F.col("width") > 1)).select("part"))
        split = large.limit(1).count() > 0
        fit = rows.join(large, "part", "left_anti") if split else rows
        tasks = max(1, -(-total // TASK_ROWS))
        tasks = max(tasks, min(total // 2000, words.sparkSession.sparkContext.defaultParallelism))
        dealt = fit.repartition(max(1, tasks), "part").sortWithinPartitions("part")
        near = dealt.select("word", "n", "m", "a", "b", "part").mapInArrow(_composing, _PARTIAL)
        found = near if found is None else found.unionByName(near)
        if not split:
            break
        middle = F.expr("a + (b - a) div 2")
        halves = F.explode(F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), F.col("b")))).alias("w")
        rows = cut(_keyed(rows.join(large, "part", "left_semi").select("word", "n", "m", halves).select("word", "n", "m", "w.a", "w.b")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends. Pointers double, so rounds grow with the logarithm of the longest way."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = cut(vocabulary(docs, id_col, text_col))
    near = near_counts(words, part_words)
    form = F.when(-F.col("best.lost") >= F.col("n") * FORM_TIMES, F.col("best.word"))
    joined = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form.alias("form"),
        F.when(form.isNotNull(), -F.col("best.lost")).alias("form_n")))
    found = joined.join(roots(joined.where("form is not null")), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
