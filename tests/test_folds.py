"""Folds against plain one-key-at-a-time replays, with a key that spans many partitions and with many small ones."""

import random

import pytest
from pyspark.sql import functions as F

from trafficlens.operators import admission as A
from trafficlens.operators.admission import _Gap
from trafficlens.operators.scan import Fold

SECOND = 1_000_000


def log(seed, n, keys, step_us, hot=0.5):
    rnd, at = random.Random(seed), 0
    rows = []
    for i in range(n):
        at += rnd.choice([0, 1, step_us // 7, step_us, step_us * 3])
        key = 0 if rnd.random() < hot else rnd.randrange(1, keys)
        rows.append((key, i, at, rnd.random() < 0.55, rnd.randrange(0, 400)))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "k bigint, id bigint, us bigint, failed boolean, cents bigint")
    return df.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz")).repartition(3)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def plain_bucket(rows, capacity, window):
    result = {}
    for mine in by_key(rows).values():
        level, last = capacity * window, None
        for _, i, t, _, _ in mine:
            if last is not None:
                level = min(capacity * window, level + capacity * (t - last))
            last = t
            if level >= window:
                level -= window
                result[i] = (True, None)
            else:
                result[i] = (False, (window - level) // (capacity * 1000))
    return result


@pytest.mark.parametrize("capacity,step", [(1, SECOND), (1, 13 * SECOND), (3, 5 * SECOND), (7, SECOND), (7, 9 * SECOND), (20, 2 * SECOND)])
def test_rate_limit_equals_plain_replay(spark, capacity, step):
    rows = log(capacity * 31 + step, 900, 5, step)
    expected = plain_bucket(rows, capacity, 60 * SECOND)
    df = frame(spark, rows)
    for parts in (1, 11):
        got = A.rate_limit(df, "k", "ts", "id", F.lit(capacity), 60 * SECOND, partitions=parts)
        assert {r.id: (r.admitted, r.retry_after_ms) for r in got.collect()} == expected


def test_sequential_and_simultaneous_requests_of_the_limiter(spark):
    burst = [(1, i, 5, False, 0) for i in range(200)]
    got = A.rate_limit(frame(spark, burst), "k", "ts", "id", F.lit(50), 60 * SECOND, partitions=7)
    assert got.filter("admitted").count() == 50
    got = A.rate_limit(frame(spark, burst[:11]), "k", "ts", "id", F.lit(10), 60 * SECOND)
    assert [r.admitted for r in got.orderBy("id").collect()] == [True] * 10 + [False]


def test_gap_map_equals_stepwise_gap():
    rnd, w = random.Random(5), 97
    for _ in range(200):
        gap, ops = _Gap(w), []
        for _ in range(rnd.randrange(1, 12)):
            if rnd.random() < 0.5:
                e = rnd.randrange(0, w)
                gap.cut(e)
                ops.append(lambda x, e=e: min(x, e))
            else:
                o = rnd.randrange(1, w + 1)
                gap.turn(o)
                ops.append(lambda x, o=o: (x - o) % w)
        for x in range(w):
            y = x
            for op in ops:
                y = op(y)
            assert _Gap.value(gap.packed(), x, w) == y


def plain_spend(rows, budget):
    result = {}
    for mine in by_key(rows).values():
        spent = 0
        for _, i, _, _, cents in mine:
            if spent + cents <= budget:
                spent += cents
                result[i] = (True, spent)
            else:
                result[i] = (False, spent)
    return result


@pytest.mark.parametrize("budget", [0, 100, 5_000, 40_000, 10_000_000])
def test_budget_equals_plain_replay(spark, budget):
    rows = log(budget, 900, 6, SECOND)
    df = frame(spark, rows)
    cost = (F.col("cents") * F.lit("0.01").cast("decimal(3,2)"))
    for parts in (1, 11):
        got = A.budget_admit(df, "k", ["ts", "id"], cost, F.lit(budget).cast("decimal(18,2)") / 100, partitions=parts)
        assert {r.id: (r.admitted, round(r.spend * 100)) for r in got.collect()} == plain_spend(rows, budget)


def test_fifty_charges_on_a_ten_dollar_budget(spark):
    rows = [(1, i, i, False, 100) for i in range(50)]
    got = A.budget_admit(frame(spark, rows), "k", ["ts", "id"], F.lit(1), F.lit(10), partitions=8)
    row = got.agg(F.count_if("admitted").alias("n"), F.max("spend").alias("s")).first()
    assert (row.n, float(row.s)) == (10, 10.0)


def test_ledger_with_corrections_equals_plain_replay(spark):
    rows = log(77, 800, 4, SECOND)
    amounts = {i: (-c if f and i % 3 == 0 else c) for _, i, _, f, c in rows}
    expected, budget = {}, 9_000
    for mine in by_key(rows).values():
        spent = 0
        for _, i, _, f, _ in mine:
            loose = f and i % 3 == 0
            ok = loose or spent + amounts[i] <= budget
            spent += amounts[i] if ok else 0
            expected[i] = (ok, spent)
    loose = F.col("failed") & (F.col("id") % 3 == 0)
    amount = F.when(loose, -F.col("cents")).otherwise(F.col("cents"))
    for parts in (1, 9):
        got = A.spend_ledger(frame(spark, rows), "k", ["ts", "id"], amount, ~loose, F.lit(budget), partitions=parts)
        assert {r.id: (r.admitted, int(r.spend)) for r in got.collect()} == expected


def plain_breaker(rows, threshold, cooldown):
    result = {}
    for mine in by_key(rows).values():
        state, fails, opened = "CLOSED", 0, None
        for _, i, t, failed, _ in mine:
            if state == "OPEN":
                if t - opened < cooldown:
                    result[i] = (False, "OPEN")
                    continue
                state = "HALF_OPEN"
            if failed:
                fails += 1
                if state == "HALF_OPEN" or fails >= threshold:
                    state, opened = "OPEN", t
            else:
                state, fails = "CLOSED", 0
            result[i] = (True, state)
    return result


@pytest.mark.parametrize("threshold,cooldown", [(1, 4 * SECOND), (3, 10 * SECOND), (2, 100 * SECOND), (3, 0)])
def test_breaker_equals_plain_replay(spark, threshold, cooldown):
    rows = log(threshold + cooldown, 900, 4, SECOND)
    df = frame(spark, rows)
    for parts in (1, 11):
        got = A.breaker_replay(df, "k", "ts", "id", F.col("failed"), threshold, cooldown, partitions=parts)
        assert {r.id: (r.allowed, r.state_after) for r in got.collect()} == plain_breaker(rows, threshold, cooldown)


def test_one_key_in_many_partitions_is_summarised_not_replayed(spark, monkeypatch):
    """A single saturated key over many partitions needs no boundary replay: two summary passes settle it."""
    from trafficlens.operators import scan
    called = []
    monkeypatch.setattr(scan, "_tail_state", lambda *a: called.append(a) or (lambda it: iter(())))
    rows = [(0, i, i * 1000, False, 1) for i in range(3000)]
    got = A.rate_limit(frame(spark, rows), "k", "ts", "id", F.lit(20), 60 * SECOND, partitions=16)
    assert {r.id: (r.admitted, r.retry_after_ms) for r in got.collect()} == plain_bucket(rows, 20, 60 * SECOND)
    assert not called


def test_fold_interface_defaults():
    assert Fold().summarise(None, None, 0) is None and Fold().advance(None, None, 0) is None


def test_rows_without_a_key_form_one_group(spark):
    df = frame(spark, [(1, i, i, False, 1) for i in range(20)]).withColumn("k", F.when(F.col("id") % 2 == 0, F.col("k")))
    got = A.rate_limit(df, "k", "ts", "id", F.lit(4), 60 * SECOND, partitions=3)
    assert {r.k: r.n for r in got.filter("admitted").groupBy("k").agg(F.count("*").alias("n")).collect()} == {1: 4, None: 4}


def test_limits_that_change_within_a_key(spark):
    """Each row's own limit counts, whatever the partitioning; decreasing limits cut what is held."""
    rows = log(77, 900, 3, 5 * SECOND, hot=0.8)
    caps = {i: (0, 2, 9, 4, 30)[i // 60 % 5] for _, i, *_ in rows}
    expected = {}
    for mine in by_key(rows).values():
        units, last = None, None
        for _, i, t, _, _ in mine:
            full = caps[i] * 60 * SECOND
            units = full if units is None else min(full, units + caps[i] * (t - last))
            last = t
            expected[i] = units >= 60 * SECOND
            units -= 60 * SECOND * expected[i]
    capacity = F.element_at(F.array(*map(F.lit, (0, 2, 9, 4, 30))), (F.floor(F.col("id") / 60) % 5 + 1).cast("int"))
    for parts in (1, 3, 8, 29):
        got = A.rate_limit(frame(spark, rows), "k", "ts", "id", capacity, 60 * SECOND, partitions=parts)
        assert {r.id: r.admitted for r in got.collect()} == expected


def test_budgets_that_change_within_a_key(spark):
    rows = log(78, 600, 3, SECOND, hot=0.8)
    budgets = {i: (50, 400, 90, 700)[i // 70 % 4] for _, i, *_ in rows}
    expected = {}
    for mine in by_key(rows).values():
        spend = 0
        for _, i, _, free, cents in mine:
            fits = free or spend + cents <= budgets[i] * 100
            spend += cents if fits else 0
            expected[i] = (fits, spend)
    budget = F.element_at(F.array(*map(F.lit, (50, 400, 90, 700))), (F.floor(F.col("id") / 70) % 4 + 1).cast("int"))
    for parts in (1, 3, 8):
        got = A.spend_ledger(frame(spark, rows), "k", ["ts", "id"], F.col("cents") * F.lit("0.01").cast("decimal(3,2)"), ~F.col("failed"), budget, partitions=parts)
        assert {r.id: (r.admitted, int(r.spend * 100)) for r in got.collect()} == expected


@pytest.mark.parametrize("kind", ["bigint", "string", "date", "double", "timestamp_ntz", "timestamp"])
def test_null_keys_are_one_key(spark, kind):
    df = spark.range(20).select(F.lit(None).cast(kind).alias("k"), "id", F.timestamp_micros(F.col("id")).cast("timestamp_ntz").alias("ts"))
    for parts in (1, 3):
        assert A.rate_limit(df, "k", "ts", "id", F.lit(4), 60 * SECOND, partitions=parts).filter("admitted").count() == 4


def test_ledger_with_corrections_needs_no_job_for_a_boundary(spark, monkeypatch):
    """One key with charges, refunds and true-ups over 32 partitions: boundaries follow from the summaries alone."""
    from pyspark import SparkContext

    rnd = random.Random(77)
    rows = [(1, i, i * SECOND, rnd.random() < 0.6, rnd.randrange(1, 40) * (1 if rnd.random() < 0.6 else -1)) for i in range(1600)]
    rows = [(k, i, t, guarded, abs(c) if guarded else c) for k, i, t, guarded, c in rows]
    jobs = []
    run = SparkContext.runJob
    monkeypatch.setattr(SparkContext, "runJob", lambda self, *a, **b: jobs.append(1) or run(self, *a, **b))
    df = spark.createDataFrame(rows, "k bigint, id bigint, us bigint, guarded boolean, cents bigint").repartition(5)
    got = A.spend_ledger(df, "k", ["us", "id"], F.col("cents") / 100, F.col("guarded"), F.lit(2), partitions=32).collect()
    spend, expected = 0, {}
    for _, i, _, guarded, c in rows:
        fits = not guarded or spend + c <= 200
        spend += c if fits else 0
        expected[i] = (fits, spend)
    assert {r.id: (r.admitted, int(r.spend * 100)) for r in got} == expected
    assert not jobs and any(not ok for ok, _ in expected.values())


def test_pieces_equal_stepwise_ledgers():
    import numpy as np

    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randrange(1, 40)
        guarded = [rnd.random() < 0.7 for _ in range(n)]
        amounts = [rnd.randrange(0, 30) if g else rnd.randrange(-30, 30) for g in guarded]
        budgets = [rnd.choice([60, 60, 80]) for _ in range(n)]
        starts, shifts = A._pieces(amounts, guarded, budgets, -20, 120)
        for x in range(-20, 121):
            spend = x
            for a, g, b in zip(amounts, guarded, budgets):
                spend += a if not g or spend + a <= b else 0
            assert x + shifts[np.searchsorted(starts, x, side="right") - 1] == spend


def test_summaries_keep_their_size():
    """100,000 rows inside one cooldown or one TTL, and as many that are each a step of their own."""
    import pickle

    import numpy as np

    from trafficlens.operators.cache import CacheFold

    n = 100_000
    for span in (1, 50):
        us = np.arange(n, dtype=np.int64) * span
        breaker = A.BreakerFold(3, 10 * SECOND)
        failed = np.array([random.Random(k).random() < 0.9 for k in range(n)])
        made = breaker.summarise({"us": us, "failed": failed}, None, 0)
        assert len(pickle.dumps(made)) < 1500
        cache = CacheFold(10 * SECOND)
        none = np.empty(n, object)
        none[:] = [np.array([])] * n
        rows = {"us": us, "id": np.arange(n), "gid": np.zeros(n, np.int64), "near": none, "near_similarity": none}
        assert len(pickle.dumps(cache.summarise(rows, None, 0))) < 1500
        # what the summary does know is what a replay gives
        for opened in (-9 * SECOND, -5 * SECOND, -SECOND, 0):
            state = 3, opened
            told = breaker.advance(state, made, 0)
            assert told is None or told == breaker.run(state, {"us": us, "failed": failed})[1]


def test_steps_beyond_the_limit_are_unknown():
    from trafficlens.operators.scan import step_at, widest_steps

    steps = widest_steps([10, 11, 12, 50, 51, 90], list("abcdef"), 3)
    assert [step_at(steps, t) for t in (3, 10, 11, 12, 13, 50, 51, 52, 90)] == ["a", "a", None, None, "d", "d", None, "f", "f"]
