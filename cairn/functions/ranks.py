"""Order statistics without sorting a column or gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.bounded import small_table

BINS, FEW = 4096, 20_000


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """Exact k-th largest (from 1) of a finite double column; None if there are fewer.

    Each round counts equal-width bins and goes on in the bin that holds it; a bin of
    few values is gathered (at most ``FEW``), one of a single value is the answer.
    """
    x = F.col(column)
    df = df.select(x.alias("x")).where(F.col("x").isNotNull())
    n, lo, hi = df.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if k < 1 or n < k:
        return None
    while lo < hi:
        if n <= FEW:
            values = [r[0] for r in df.where(F.col("x").between(lo, hi)).collect()]
            return sorted(values, reverse=True)[k - 1]
        at = F.least(F.floor((F.col("x") - lo) / (hi - lo) * BINS), F.lit(BINS - 1)).alias("bin")
        bins = df.where(F.col("x").between(lo, hi)).groupBy(at).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: -r["bin"]):  # at most BINS rows
            if k <= r["n"]:
                n, lo, hi = r["n"], r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def grouped_percentile(df: DataFrame, keys: list[str], column: str, share: float, out: str, rounds: int = 2) -> DataFrame:
    """(keys, out): exact percentile of a double column by group, with linear interpolation.

    The built-in aggregate keeps a group's distinct values in one task's memory.  Here
    rounds of equal-width bins, counted with map-side sums, narrow each group down to
    the values between the two ranks asked for; only those are sorted, as counted
    distinct values.  Null values are left out; a group without values has no row.
    """
    x = F.col("x")
    rows = df.select(*keys, F.col(column).cast("double").alias("x")).where(x.isNotNull())
    at = (F.col("n") - 1) * F.lit(float(share))
    scope = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    # ``below`` values of the group lie under lo; ranks count from 0
    scope = small_table(scope.select(*keys, F.floor(at).alias("first"), F.ceil(at).alias("last"), (at - F.floor(at)).alias("part"),
                                     "lo", "hi", F.lit(0).cast("long").alias("below")))
    inside = lambda s: rows.join(s, keys).where(x.between(F.col("lo"), F.col("hi")))
    carried = ["first", "last", "part", "below"]
    for _ in range(rounds):
        width = F.col("hi") - F.col("lo")
        place = F.when(width > 0, F.least(F.floor((x - F.col("lo")) / F.when(width > 0, width) * BINS), F.lit(BINS - 1))).otherwise(0)
        bins = inside(scope).groupBy(*keys, *carried, place.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        run = F.sum("n").over(W.partitionBy(*keys).orderBy("bin"))  # at most BINS rows of a group
        held = bins.withColumn("to", F.col("below") + run).withColumn("from", F.col("to") - F.col("n"))
        held = held.where("`to` > first and `from` <= last")
        scope = small_table(held.groupBy(*keys, "first", "last", "part").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("from").alias("below")).select(*keys, "first", "last", "part", "lo", "hi", "below"))
    values = inside(scope).groupBy(*keys, *carried, "x").agg(F.count("*").alias("n"))
    ranked = values.withColumn("to", F.col("below") + F.sum("n").over(W.partitionBy(*keys).orderBy("x")))
    ranked = ranked.withColumn("from", F.col("to") - F.col("n"))
    holds = lambda r: F.max(F.when((F.col("from") <= F.col(r)) & (F.col(r) < F.col("to")), x))
    ends = ranked.groupBy(*keys, "part").agg(holds("first").alias("a"), holds("last").alias("b"))
    return ends.select(*keys, (F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")).alias(out))
