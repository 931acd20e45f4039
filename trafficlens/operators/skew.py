"""Joins whose hot keys are cut into blocks before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: most rows of one key and side in a task that compares all pairs
PAIR_ROWS = 10_000
#: into so many blocks of each side a key is cut before blocks grow
SPLITS = 6
#: most rows of one key in a task that only looks one row up per key
LOOKUP_ROWS = 1_000_000
#: longest list of hot keys that is sent to every task; beyond it the list is joined like any table
BROADCAST_KEYS = 200_000


def _hot(counts: DataFrame, sizes: dict[str, str], keys: list[str], block: int, wide: int = 1) -> DataFrame | None:
    """Keys of ``counts`` with more than ``block`` rows, and their number of blocks per side; None when there are none.

    With ``wide`` blocks are block / wide rows at first, and from SPLITS of them on they grow to wide * block rows: a row is
    copied once for each block of the other side, so few large blocks cost less to send than many small ones.
    At most rows / block keys can be hot. The list is materialised, so its length is known before it is broadcast."""
    def blocks(n):
        least = F.ceil(n / (wide * block))
        return least if wide == 1 else F.greatest(least, F.least(F.ceil(n * wide / block), F.lit(SPLITS)))

    over = [F.col(c) > block // wide for c in sizes.values()]
    wanted = over[0] if len(over) == 1 else over[0] | over[1]
    hot = counts.filter(wanted).select(*keys, *(
        F.greatest(F.lit(1), blocks(F.col(c))).cast("int").alias(name) for name, c in sizes.items())).checkpoint()
    n = hot.count()
    if n == 0:
        return None
    return F.broadcast(hot) if n <= BROADCAST_KEYS else hot


def _salt(df: DataFrame, hot: DataFrame, keys: list[str], splits: str, row_id: str, name: str) -> DataFrame:
    """A block number per row, a hash of the row id, so that a retried task reproduces it."""
    block: Column = F.pmod(F.xxhash64(row_id), F.coalesce(F.col(splits), F.lit(1)).cast("bigint")).cast("int")
    return df.join(hot.select(*keys, splits), keys, "left").withColumn(name, block).drop(splits)


def _copies(df: DataFrame, hot: DataFrame, keys: list[str], splits: str, name: str) -> DataFrame:
    """One copy of a row per block of the other side."""
    blocks = F.sequence(F.lit(0), F.coalesce(F.col(splits), F.lit(1)) - 1)
    return df.join(hot.select(*keys, splits), keys, "left").withColumn(name, F.explode(blocks)).drop(splits)


def split_blocks(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str,
                 block: int = PAIR_ROWS, *, wide: int = 1) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with block numbers, and the columns to join on: every pair of a key meets in exactly one block.

    A key with L and R blocks becomes L x R groups; keys below the limit stay whole. Counts are pre-aggregated."""
    none = F.lit(0).cast("bigint")
    l = left.groupBy(*keys).agg(F.count("*").alias("_a"), none.alias("_b"))
    r = right.groupBy(*keys).agg(none.alias("_a"), F.count("*").alias("_b"))
    both = l.unionByName(r).groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    hot = _hot(both, {"_ls": "_a", "_rs": "_b"}, keys, block, wide)
    if hot is None:
        return left, right, keys
    a = _copies(_salt(left, hot, keys, "_ls", left_id, "_l"), hot, keys, "_rs", "_r")
    b = _copies(_salt(right, hot, keys, "_rs", right_id, "_r"), hot, keys, "_ls", "_l")
    return a, b, [*keys, "_l", "_r"]


def triangle_blocks(rows: DataFrame, keys: list[str], row_id: str, block: int = PAIR_ROWS, *,
                    wide: int = 1) -> tuple[DataFrame, list[str]]:
    """Rows with block numbers and a side, and the columns to group by: any two rows of a key meet in exactly one group.

    A key of B blocks becomes B(B+1)/2 groups, and a row goes to B of them: with the rows of its own block (side 2: both), and
    as side 0 or 1 with those of each other block."""
    hot = _hot(rows.groupBy(*keys).agg(F.count("*").alias("_a")), {"_n": "_a"}, keys, block, wide)
    if hot is None:
        return rows.withColumn("_side", F.lit(2)), keys
    a = _copies(_salt(rows, hot, keys, "_n", row_id, "_own"), hot, keys, "_n", "_other")
    own, other = F.col("_own"), F.col("_other")
    return a.withColumns({
        "_l": F.least(own, other), "_r": F.greatest(own, other),
        "_side": F.when(own == other, 2).when(own < other, 0).otherwise(1)}).drop("_own", "_other"), [*keys, "_l", "_r"]


def split_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str,
               block: int = PAIR_ROWS) -> DataFrame:
    """Inner equi join with hot keys of either side spread over several tasks."""
    a, b, on = split_blocks(left, right, keys, left_id, right_id, block)
    return a.join(b, on).drop("_l", "_r")


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, how: str = "inner",
                block: int = LOOKUP_ROWS) -> DataFrame:
    """Join against a side with one row per key: the left rows of a hot key are spread, its right row is copied."""
    hot = _hot(left.groupBy(*keys).agg(F.count("*").alias("_a")), {"_ls": "_a"}, keys, block)
    if hot is None:
        return left.join(right, keys, how)
    a, b = _salt(left, hot, keys, "_ls", left_id, "_l"), _copies(right, hot, keys, "_ls", "_l")
    return a.join(b, [*keys, "_l"], how).drop("_l")
