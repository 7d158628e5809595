"""Names of temporary columns that clash with none of a table's."""

from __future__ import annotations

from pyspark.sql import DataFrame


def prefix(df: DataFrame, start: str = "__") -> str:
    """A prefix that no column of ``df`` begins with, whatever the letters' case."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(start.lower()) for c in taken):
        start += "_"
    return start
