"""Which rows may have a key among many others, without a shuffle of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.names import prefix

#: Bits of the map: 2 MB however many keys there are; among n keys, about n / BITS of the other rows pass.
BITS = 1 << 24


def maybe_among(df: DataFrame, key: str, keys: DataFrame, out: str) -> DataFrame:
    """``df`` with a boolean ``out``, true for every row whose ``key`` is in ``keys``' one column, and for few others.

    Both are 64-bit hashes, without nulls.  An exact join of the rows that pass follows where it matters.
    """
    p = prefix(df)
    bit = lambda c: F.pmod(F.col(c), F.lit(BITS))
    theirs = keys.toDF("key").select(F.bitmap_bucket_number(bit("key")).alias(f"{p}bucket"), F.bitmap_bit_position(bit("key")).alias("at"))
    bitmap = theirs.repartition(f"{p}bucket").groupBy(f"{p}bucket").agg(F.bitmap_construct_agg("at").alias(f"{p}map"))
    mine = df.withColumns({f"{p}bucket": F.bitmap_bucket_number(bit(key)), f"{p}at": F.bitmap_bit_position(bit(key))})
    found = mine.join(F.broadcast(bitmap), f"{p}bucket", "left").withColumn(out, F.coalesce(_bit(F.col(f"{p}map"), F.col(f"{p}at")), F.lit(False)))
    return found.select(*[f"`{c}`" for c in df.columns], out)


def _bit(bitmap: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1
