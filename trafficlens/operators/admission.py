"""Rate limits, budgets and circuit breakers replayed over logs, exact for keys of any size (see scan.py)."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.clock import epoch_us
from trafficlens.operators.scan import Fold, Rows, ordered_scan, step_at, widest_steps

MICRO = 1_000_000
#: most steps and most pieces of a summary
STEPS, PIECES = 16, 512


class RateFold(Fold):
    """Token bucket in integers: one token is ``window`` units and a microsecond refills ``capacity`` units.

    The state is the units left and the time of the last request (None: a full bucket). Each row has its own capacity: it
    refills at the row's rate and holds at most the row's capacity. To carry the state across partitions, let B be the
    same bucket with admission never refused but the level cut off at zero. B's step is
    x -> max(min(x + refill, top) - w, 0), and such clamps compose, so B is a plain scan. Moreover 0 <= D - B < w always
    holds for the real bucket D: the gap turns only when B is cut off by some overflow o, and then becomes
    (gap - o) mod w; while B is less than w below a full bucket the gap is cut down to that. A second summary tracks it.
    """

    columns = ["us", "capacity"]
    output = {"admitted": ("boolean", pa.bool_()), "tokens_before": ("double", pa.float64()),
              "retry_after_ms": ("bigint", pa.int64())}
    passes = 2

    def __init__(self, window_us: int):
        self.w = int(window_us)

    def _refilled(self, state, cap: int, t: int) -> int:
        if state is None:
            return cap * self.w
        units, last = state
        return min(cap * self.w, units + cap * (t - last))

    def run(self, state, rows: Rows):
        w = self.w
        ok, level, retry = [], [], []
        for t, cap in zip(rows["us"].tolist(), map(int, rows["capacity"].tolist())):
            units = self._refilled(state, cap, t)
            level.append(units / w)
            fits = units >= w
            ok.append(fits)
            # a key without any allowance never gets a token
            retry.append(None if fits or not cap else (w - units) // (cap * 1000))
            state = units - w if fits else units, t
        return {"admitted": ok, "tokens_before": level, "retry_after_ms": retry}, state

    def summarise(self, rows, hint, level):
        times, caps, w = rows["us"].tolist(), list(map(int, rows["capacity"].tolist())), self.w
        first, last = (caps[0], times[0]), times[-1]
        if level == 0:
            shift, low, high = -w, 0, max(0, caps[0] * w - w)
            for before, t, cap in zip(times, times[1:], caps[1:]):
                refill, most = cap * (t - before), cap * w
                shift += refill - w
                low, high = max(0, min(most, low + refill) - w), max(0, min(most, high + refill) - w)
            return *first, last, shift, low, high
        incoming = bound = self._refilled(hint, *first)
        gap, before = _Gap(w), times[0]
        for t, cap in zip(times, caps):
            bound = min(cap * w, bound + cap * (t - before))
            before = t
            if cap * w - bound < w:
                gap.cut(cap * w - bound)
            if bound < w:
                gap.turn(w - bound)
                bound = 0
            else:
                bound -= w
        return *first, last, incoming, bound, gap.packed()

    def advance(self, state, summary, level):
        cap, first, last, *rest = summary
        x = self._refilled(state, cap, first)
        if level == 0:
            shift, low, high = rest
            return min(high, max(low, x + shift)), last
        incoming, outgoing, packed = rest
        return outgoing + _Gap.value(packed, x - incoming, self.w), last


class _Gap:
    """The map gap_in -> gap_out as intervals of gap_in: those only rotated so far, and those already sent to a point.

    Rotations are kept as one offset. Points and intervals are in sorted lists, so a cut touches only what it moves, and
    intervals of merged points are joined small to large."""

    def __init__(self, w: int):
        self.w, self.turned = w, 0
        self.starts, self.ends = [0], [w]
        self.points, self.fixed = [], {}

    def turn(self, o: int):
        self.turned = (self.turned + o) % self.w

    def cut(self, e: int):
        """gap = min(gap, e)"""
        w, r = self.w, self.turned
        if e + 1 >= w:
            return
        lo, hi = (e + 1 + r) % w, (w + r) % w
        moved: list[list] = []
        for x, y in ([(lo, hi)] if lo < hi else [(lo, w), (0, hi)]):
            moved.append(self._take(x, y))
            i, j = bisect.bisect_left(self.points, x), bisect.bisect_left(self.points, y)
            moved += [self.fixed.pop(g) for g in self.points[i:j]]
            del self.points[i:j]
        spans = max(moved, key=len)
        for other in moved:
            if other is not spans:
                spans.extend(other)
        if spans:
            target = (e + r) % w
            if target in self.fixed:
                small, large = sorted((spans, self.fixed[target]), key=len)
                large.extend(small)
                self.fixed[target] = large
            else:
                bisect.insort(self.points, target)
                self.fixed[target] = spans

    def _take(self, lo: int, hi: int) -> list:
        """Removes [lo, hi) from the free intervals and returns what was there."""
        i, j = bisect.bisect_right(self.ends, lo), bisect.bisect_left(self.starts, hi)
        if i >= j:
            return []
        found = list(zip(self.starts[i:j], self.ends[i:j]))
        left, right = (found[0][0], lo), (hi, found[-1][1])
        rest = [p for p in (left, right) if p[0] < p[1]]
        self.starts[i:j], self.ends[i:j] = [p[0] for p in rest], [p[1] for p in rest]
        return [(max(a, lo), min(b, hi)) for a, b in found]

    def packed(self):
        pieces = [(a, b, None) for a, b in zip(self.starts, self.ends)]
        pieces += [(a, b, g) for g, spans in self.fixed.items() for a, b in spans]
        return self.turned, sorted(pieces, key=lambda p: p[0])

    @staticmethod
    def value(packed, x: int, w: int) -> int:
        turned, pieces = packed
        a, b, g = pieces[bisect.bisect_right(pieces, x, key=lambda p: p[0]) - 1]
        return ((x if g is None else g) - turned) % w


class SpendFold(Fold):
    """Running spend: a guarded charge is taken only if it fits the budget, an unguarded entry always counts.

    Between the spend at which all of a run fits and the one at which nothing does, a run with corrections is a piecewise
    shift of the incoming spend; its pieces are kept while they are at most `PIECES`, so boundaries of a key with corrections
    need no job each. Otherwise the summary answers when the whole run fits, when nothing in it fits, or, for charges alone, when the money left
    separates the charges that surely fit from those too large: with 2^k <= left < 2^(k+1), all charges below 2^k fit as
    long as their total leaves 2^k, and those above ``left`` never will. Each replay forced by an undecided run uses up
    a power of two of the remaining budget or passes a charge of its own size, so they stay few.
    """

    columns = ["amount", "guarded", "budget_micro", "opening"]
    output = {"admitted": ("boolean", pa.bool_()), "spend_micro": ("bigint", pa.int64())}

    def run(self, state, rows: Rows):
        spend = state if state is not None else int(rows["opening"][0])
        ok, after = [], []
        for amount, guarded, budget in zip(rows["amount"].tolist(), rows["guarded"].tolist(), rows["budget_micro"].tolist()):
            fits = not guarded or spend + amount <= budget
            if fits:
                spend += amount
            ok.append(fits)
            after.append(spend)
        return {"admitted": ok, "spend_micro": after}, spend

    def summarise(self, rows, hint, level):
        amount = rows["amount"].astype(np.int64)
        guarded = rows["guarded"].astype(bool)
        prefix = np.cumsum(amount)
        loose = np.where(guarded, 0, amount)
        ends = np.cumsum(loose)
        charges = amount[guarded]
        budget = rows["budget_micro"].astype(np.int64)
        # a budget that changes within the run leaves only "everything fits" and "nothing fits"
        simple = bool(guarded.all()) and (not len(charges) or int(charges.min()) >= 0) and bool((budget == budget[0]).all())
        sums, mins = {}, {}
        if simple:
            bits = np.array([int(c).bit_length() for c in charges])
            for b in np.unique(bits[charges > 0]):
                mine = charges[bits == b]
                sums[int(b)], mins[int(b)] = int(mine.sum()), int(mine.min())
        most = int((budget - prefix)[guarded].min()) if guarded.any() else None
        none = int((budget - ends - amount)[guarded].max()) if guarded.any() else None
        pieces = None if simple or most is None or none <= most else _pieces(amount.tolist(), guarded.tolist(), budget.tolist(), most + 1, none)
        return {
            "pieces": pieces, "budget": int(budget[0]), "opening": int(rows["opening"][0]), "simple": simple,
            # the most spend at which every charge still fits, and the most at which any of them does
            "total": int(prefix[-1]), "all": most,
            "loose": int(ends[-1]), "any": none,
            "sums": sums, "mins": mins}

    def advance(self, state, s, level):
        spend = state if state is not None else s["opening"]
        if s["all"] is None or spend <= s["all"]:
            return spend + s["total"]
        if spend > s["any"]:
            return spend + s["loose"]
        if s["pieces"] is not None:
            starts, shifts = s["pieces"]
            return spend + int(shifts[np.searchsorted(starts, spend, side="right") - 1])
        left = s["budget"] - spend
        if not s["simple"] or left <= 0:
            # left == 0: charges of zero still fit and change nothing; below zero nothing fits
            return spend if s["simple"] else None
        k = left.bit_length()
        small = sum(v for b, v in s["sums"].items() if b < k)
        if left - small >= 1 << (k - 1) and s["mins"].get(k, left + 1) > left:
            return spend + small
        return None


def _pieces(amounts: list, guarded: list, budgets: list, low: int, high: int):
    """What entries add to an incoming spend from low to high: starts of pieces and their shifts, None beyond PIECES pieces."""
    starts, shifts, common = np.array([low], np.int64), np.array([0], np.int64), 0
    top = high  # the greatest spend any incoming one has led to, less `common`
    for amount, is_guarded, budget in zip(amounts, guarded, budgets):
        if not is_guarded or common + top + amount <= budget:
            common += amount
            continue
        room = budget - amount - common - shifts  # the greatest incoming spend of each piece that still fits
        ends = np.append(starts[1:] - 1, high)
        cut = (starts <= room) & (room < ends)
        if cut.any():
            starts, shifts = np.append(starts, room[cut] + 1), np.append(shifts, shifts[cut])
            room = np.append(room, room[cut])
            order = np.argsort(starts, kind="stable")
            starts, shifts, room = starts[order], shifts[order], room[order]
        shifts = np.where(starts <= room, shifts + amount, shifts)
        new = np.append(True, shifts[1:] != shifts[:-1])
        starts, shifts = starts[new], shifts[new]
        if len(starts) > PIECES:
            return None
        top = int((np.append(starts[1:] - 1, high) + shifts).max())
    return starts, shifts + common


class BreakerFold(Fold):
    """CLOSED / OPEN / HALF_OPEN: opens after ``threshold`` failures in a row or a failed trial, refuses for a while.

    State: (failures in a row, time it opened or None). The summary is the end state for each count of failures, and,
    for an open breaker, a step function of the time from which it may try again. Where nearly every row is a step of its own
    (failed trials within one cooldown) only the widest `STEPS` are kept."""

    columns = ["us", "failed"]
    output = {"allowed": ("boolean", pa.bool_()), "state_after": ("string", pa.string())}

    def __init__(self, threshold: int, cooldown_us: int):
        self.threshold, self.cooldown = threshold, int(cooldown_us)

    def start(self):
        return 0, None

    def run(self, state, rows: Rows):
        fails, opened = state
        ok, names = [], []
        for t, failed in zip(rows["us"].tolist(), rows["failed"].tolist()):
            trial = opened is not None
            if trial and t - opened < self.cooldown:
                ok.append(False)
                names.append("OPEN")
                continue
            ok.append(True)
            if failed:
                fails += 1
                opened = t if trial or fails >= self.threshold else None
            else:
                fails, opened = 0, None
            names.append("OPEN" if opened is not None else "CLOSED")
        # the count beyond the threshold has no effect: a trial decides alone, a success clears it
        return {"allowed": ok, "state_after": names}, (min(fails, self.threshold), opened)

    def summarise(self, rows, hint, level):
        us = rows["us"].astype(np.int64)
        failed = rows["failed"].astype(bool).tolist()
        n, top = len(us), self.threshold
        again = np.searchsorted(us, us + self.cooldown, side="left").tolist()
        stamps = us.tolist()
        # ends[f]: end state when row i is met with f failures, breaker closed; trial[i]: when row i is the trial
        ends = [(f, None) for f in range(top)]
        trial = [None] * n
        for i in range(n - 1, -1, -1):
            after_opening = trial[again[i]] if again[i] < n else (top, stamps[i])
            if failed[i]:
                trial[i] = after_opening
                ends = [ends[f + 1] if f + 1 < top else after_opening for f in range(top)]
            else:
                trial[i] = ends[0]
                ends = [ends[0]] * top
        # the breaker opened before the first row, so it tries again at most one cooldown after it
        reach = min(n - 1, int(np.searchsorted(us, us[0] + self.cooldown, side="left")))
        steps = [i for i in range(reach + 1) if i == reach or trial[i] != trial[i + 1]]
        return ends, widest_steps([stamps[i] for i in steps], [trial[i] for i in steps], STEPS)

    def advance(self, state, summary, level):
        fails, opened = state
        ends, steps = summary
        if opened is None:
            return ends[fails]
        if opened + self.cooldown > steps[0]:
            return fails, opened
        return step_at(steps, opened + self.cooldown)


def _micro(amount) -> F.Column:
    return (amount.cast("decimal(18,6)") * F.lit(MICRO)).cast("bigint")


def rate_limit(requests: DataFrame, key: str, ts: str, row_id: str, capacity, window_us: int = 60 * MICRO,
               partitions: int | None = None) -> DataFrame:
    """Token bucket per key: adds admitted, tokens_before and, on refusals, retry_after_ms."""
    timed = requests.withColumns({"us": epoch_us(F.col(ts)), "capacity": capacity})
    return ordered_scan(timed, key, ["us", row_id], RateFold(window_us), partitions).drop("us", "capacity")


def budget_admit(requests: DataFrame, key: str, order: list[str], cost, budget, opening=None,
                 partitions: int | None = None) -> DataFrame:
    """In order, admit iff spend + cost <= budget; a refused charge changes nothing. Adds admitted, spend."""
    return spend_ledger(requests, key, order, cost, F.lit(True), budget, opening, partitions)


def spend_ledger(entries: DataFrame, key: str, order: list[str], amount, guarded, budget, opening=None,
                 partitions: int | None = None) -> DataFrame:
    """Running spend over guarded reservations and unguarded corrections. Adds admitted, spend."""
    sized = entries.withColumns({
        "amount": _micro(amount), "guarded": guarded, "budget_micro": _micro(budget), "opening": _micro(F.lit(0) if opening is None else opening)})
    return (ordered_scan(sized, key, order, SpendFold(), partitions)
            .withColumn("spend", (F.col("spend_micro") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)"))
            .drop("amount", "guarded", "budget_micro", "opening", "spend_micro"))


def breaker_replay(attempts: DataFrame, key: str, ts: str, row_id: str, failed, threshold: int = 3,
                   cooldown_us: int = 10 * MICRO, partitions: int | None = None) -> DataFrame:
    """Circuit breaker per provider over an attempt log: adds allowed and state_after."""
    timed = attempts.withColumns({"us": epoch_us(F.col(ts)), "failed": failed})
    return ordered_scan(timed, key, ["us", row_id], BreakerFold(threshold, cooldown_us), partitions).drop("us", "failed")
