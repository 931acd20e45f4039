"""Names for internal columns beside those a user's table brings along."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(docs: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of docs has it (Spark tells no case apart)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name
