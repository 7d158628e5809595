"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.lineage import stash

#: Rows and bytes up to which a table of a few narrow columns is broadcast.
MOST_ROWS, MOST_BYTES = 500_000, 64 << 20


def _bytes(field: T.StructField) -> Column:
    """About what a value takes, at least 16 bytes; nested ones by their JSON."""
    kind, c = field.dataType, F.col(f"`{field.name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        size = F.octet_length(F.to_json(F.struct(c)))
    else:
        return F.lit(16)
    return F.lit(16) + F.coalesce(size, F.lit(0))


def is_small(df: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> bool:
    """Whether ``df`` has at most that many rows and bytes."""
    size = F.lit(0)
    for field in df.schema:
        size = size + _bytes(field)
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return n <= most_rows and total <= most_bytes


def broadcast_if_small(df: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it is within both bounds, else as it is.

    Meant for narrow tables that are cheap to measure (written ones); beyond the bounds
    the join is a shuffle whose skewed partitions AQE splits.
    """
    return F.broadcast(df) if is_small(df, most_rows, most_bytes) else df


def small_table(df: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``df`` written once, and broadcast if it is small: computed once for measure and join."""
    return broadcast_if_small(stash(df), most_rows)
