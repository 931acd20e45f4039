"""Cutting lineage into the shared folder, so that lost executors cost a read and not a recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from trafficlens.session import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder named by spark.checkpoint.dir."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
