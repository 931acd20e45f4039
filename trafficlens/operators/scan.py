"""Order-dependent folds over keyed rows, with no limit on the size of a key.

Rows are laid out by a range partitioning on (key, order): partitions are balanced whatever the key sizes, because a
busy key simply spans many of them. Each partition then folds its runs in order, reading Arrow batches as they come.
Only a run that began in an earlier partition needs to know something it cannot see, the fold's state at the boundary.
That is a prefix scan over partitions:

1. every partition emits at most one record: its first and last key, a *summary* of its first run (what the run does to
   any incoming state), and the state after its last run;
2. the summaries are chained in partition order, one small step per partition (never per row);
3. every partition replays its rows from the known boundary state and emits results.

Summaries have a size of their own, whatever the number of rows (a few kB at most): what would not fit is left out.
A fold whose summary cannot answer for some incoming state returns None; that one boundary is settled by replaying just
that partition. The laid-out rows are checkpointed first, so all passes see the same boundaries and a lost executor costs
a re-read.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.session import shared_dir

_SUMMARY = "pid int, first_key binary, last_key binary, runs int, summary binary, tail binary"
_SUMMARY_ARROW = pa.schema([("pid", pa.int32()), ("first_key", pa.binary()), ("last_key", pa.binary()),
                            ("runs", pa.int32()), ("summary", pa.binary()), ("tail", pa.binary())])
_TAIL_ARROW = pa.schema([("pid", pa.int32()), ("tail", pa.binary())])


#: "no key yet", as null is a key like any other
_NO_KEY = object()
#: the fold's columns over consecutive rows of one key
Rows = dict[str, np.ndarray]


class Fold:
    """State machine over one key's rows in order. Subclasses keep states small and picklable."""

    columns: list[str] = []
    #: output columns: name -> (Spark type, Arrow type)
    output: dict[str, tuple[str, pa.DataType]] = {}

    #: number of summary passes; a later pass may use what the earlier one found out about the boundary
    passes = 1

    def start(self):
        return None

    def run(self, state, rows: Rows):
        """Replay rows from a known state: (dict of output lists, state after)."""
        raise NotImplementedError

    def summarise(self, rows: Rows, hint, level: int):
        """What the rows do to an unknown incoming state. ``hint`` is the boundary state of the previous level."""
        return None

    def advance(self, state, summary, level: int):
        """State after the summarised rows, or None when the summary cannot tell."""
        return None


def widest_steps(until: list, values: list, limit: int) -> tuple:
    """A step function of time as (end, steps): a step (before, until, value) holds for before < t <= until.

    Of more than `limit` steps the widest are kept; the first one has no lower end. A plain tuple, as summaries are pickled."""
    befores = [None, *until[:-1]]
    chosen = range(len(until))
    if len(until) > limit:
        width = lambda k: float("inf") if befores[k] is None else until[k] - befores[k]
        chosen = sorted(sorted(chosen, key=width, reverse=True)[:limit])
    return until[-1], [(befores[k], until[k], values[k]) for k in chosen]


def step_at(steps: tuple, t):
    """The value at t, not beyond the end; None where the step was left out."""
    known = steps[1]
    k = bisect.bisect_left(known, t, key=lambda step: step[1])
    return known[k][2] if k < len(known) and (known[k][0] is None or known[k][0] < t) else None


def _runs(batch: pa.RecordBatch, fold: Fold, key: str) -> Iterator[tuple[object, Rows]]:
    """(key, the fold's columns) for each run of equal keys in a batch; slices are views, so short runs stay cheap."""
    columns = {c: batch.column(c).to_pandas().to_numpy() for c in fold.columns}
    arrow = batch.column(key)
    keys = arrow.to_pandas(integer_object_nulls=True).to_numpy()
    # null is one key and NaN is one key, for every type: neither equals itself as a plain value
    kind = np.where(arrow.is_null().to_numpy(zero_copy_only=False), 1, np.where(pd.isna(keys), 2, 0))
    differ = (kind[1:] != kind[:-1]) | ((kind[1:] == 0) & (keys[1:] != keys[:-1]))
    cuts = (np.flatnonzero(differ) + 1).tolist()
    for a, b in zip([0, *cuts], [*cuts, len(keys)]):
        yield (keys[a] if kind[a] == 0 else (None, "NaN")[kind[a] - 1]), {c: v[a:b] for c, v in columns.items()}


def _pid(batch: pa.RecordBatch) -> int:
    return batch.column("_pid")[0].as_py()


def _joined(parts: list[Rows]) -> Rows:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _replay(fold: Fold, key: str, carry: dict):
    def task(batches: Iterator[pa.RecordBatch]):
        last, state = _NO_KEY, None
        for batch in batches:
            if not batch.num_rows:
                continue
            found: dict[str, list] = {name: [] for name in fold.output}
            for name, rows in _runs(batch, fold, key):
                if last is _NO_KEY:
                    state = carry.get(_pid(batch), fold.start())
                elif name != last:
                    state = fold.start()
                columns, state = fold.run(state, rows)
                for column, values in columns.items():
                    found[column].extend(values)
                last = name
            arrays = [pa.array(found[n], type=t) for n, (_, t) in fold.output.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *fold.output])
    return task


def _summaries(fold: Fold, key: str, hints: dict, level: int):
    """Summary of a partition's first run and the state after its last; the runs between need no work here."""
    def task(batches: Iterator[pa.RecordBatch]):
        first, last, pid, runs = _NO_KEY, _NO_KEY, None, 0
        head: list[Rows] = []
        current: list[Rows] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            for name, rows in _runs(batch, fold, key):
                if first is _NO_KEY:
                    first, pid = name, _pid(batch)
                if last is _NO_KEY or name != last:
                    runs, current = runs + 1, []
                last = name
                (head if runs == 1 else current).append(rows)
        if first is not _NO_KEY:
            hint = hints.get(pid, fold.start())
            summary = fold.summarise(_joined(head), hint, level)
            state = fold.run(fold.start(), _joined(current))[1] if current else None
            record = {"pid": pid, "first_key": pickle.dumps(first), "last_key": pickle.dumps(last), "runs": runs,
                      "summary": pickle.dumps(summary), "tail": pickle.dumps(state)}
            yield pa.RecordBatch.from_pylist([record], schema=_SUMMARY_ARROW)
    return task


def _tail_state(fold: Fold, key: str, carry: dict):
    """State after a partition's first run, from a known boundary state (used where a summary could not tell)."""
    def task(batches: Iterator[pa.RecordBatch]):
        first, state, pid = _NO_KEY, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            for name, rows in _runs(batch, fold, key):
                if first is _NO_KEY:
                    first, pid = name, _pid(batch)
                    state = carry.get(pid, fold.start())
                if name != first:
                    break
                _, state = fold.run(state, rows)
        if first is not _NO_KEY:
            yield pa.RecordBatch.from_pylist([{"pid": pid, "tail": pickle.dumps(state)}], schema=_TAIL_ARROW)
    return task


def _chain(fold: Fold, records: list, level: int, settled: dict) -> tuple[dict, dict]:
    """Boundary state per partition, and the boundaries whose partition must be replayed to go on."""
    carry, blocked = {}, {}
    key, state, known = _NO_KEY, None, True
    for r in records:
        first, last = pickle.loads(r["first_key"]), pickle.loads(r["last_key"])
        continued = key is not _NO_KEY and first == key
        if not continued:
            incoming, known = fold.start(), True
        else:
            incoming = state
        if known and continued:
            carry[r["pid"]] = incoming
        if r["runs"] > 1:
            state, known = pickle.loads(r["tail"]), True
        elif known:
            after = settled.get(r["pid"])
            if after is None:
                after = fold.advance(incoming, pickle.loads(r["summary"]), level)
            if after is None:
                blocked[r["pid"]] = incoming
                known = False
            state = after
        key = last
    return carry, blocked


def _boundaries(laid: DataFrame, fold: Fold, key: str) -> dict:
    spark = laid.sparkSession
    laid = laid.select("_pid", key, *(c for c in fold.columns if c != key))
    carry: dict = {}
    for level in range(fold.passes):
        # at most one record of bounded size per partition: bounded by the partition count, not by the data
        records = laid.mapInArrow(_summaries(fold, key, carry, level), _SUMMARY).collect()
        records.sort(key=lambda r: r["pid"])
        edges = [(pickle.loads(a["last_key"]), pickle.loads(b["first_key"])) for a, b in zip(records, records[1:])]
        if not any(a == b for a, b in edges):
            return {}
        settled: dict = {}
        while True:
            carry, blocked = _chain(fold, records, level, settled)
            # a blocked partition only matters when the next one goes on with its key
            at = {r["pid"]: i for i, r in enumerate(records)}
            blocked = {p: s for p, s in blocked.items() if at[p] < len(edges) and edges[at[p]][0] == edges[at[p]][1]}
            if not blocked:
                break
            replay = laid.mapInArrow(_tail_state(fold, key, blocked), "pid int, tail binary").rdd
            rows = spark.sparkContext.runJob(replay, list, sorted(blocked))
            settled.update({row["pid"]: pickle.loads(row["tail"]) for row in rows})
    return carry


def ordered_scan(df: DataFrame, key: str, order: list[str], fold: Fold, partitions: int | None = None) -> DataFrame:
    """Apply ``fold`` to each key's rows in ``order``; adds the fold's output columns to ``df``."""
    shared_dir(df.sparkSession)
    by = [key, *order]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    laid = ranged.sortWithinPartitions(*by).withColumn("_pid", F.spark_partition_id()).checkpoint()
    carry = _boundaries(laid, fold, key) if laid.rdd.getNumPartitions() > 1 else {}
    schema = T.StructType(list(laid.schema.fields))
    for name, (kind, _) in fold.output.items():
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return laid.mapInArrow(_replay(fold, key, carry), schema).drop("_pid")
