"""Connected components by alternating large-star and small-star rounds.

Kiveris et al. 2014, "Connected components in MapReduce and beyond".  Every round
is two aggregations and two joins over the edges.  The aggregates are written before
they are joined, so that either side of a join is a plain shuffle and AQE can split
the edges of a hub; nothing is gathered on the driver but one fingerprint of the edge
set per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.lineage import settle, stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return (
        both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = stash(edges.groupBy("a").agg(F.min("b").alias("m")))
    near = edges.join(least, "a")
    return (
        near.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                      F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        .select("e.*").where("a != b").distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h))).first()
    return tuple(row)


def _united(ends: DataFrame) -> DataFrame:
    """The same by union-find on the driver, for edges known to be few."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for a, b in ends.collect():
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    kind = ends.schema["a"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])
    return ends.sparkSession.createDataFrame([(x, find(x)) for x in list(root)], schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", gather: int = 0) -> DataFrame:
    """``(node, component)`` for every node that an edge names; component = least node.

    Self loops and repeated edges are harmless; edges with a null end are dropped.
    A node that only has a self loop does not appear.  Up to ``gather`` different edges
    are united on the driver, which spares a small graph the rounds; by default none are.
    """
    spark = edges.sparkSession

    def rounds() -> DataFrame:
        ends = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        ends = stash(ends.where("a != b and a is not null and b is not null").distinct())
        seen = _fingerprint(ends)
        if seen[0] <= gather:
            return _united(ends)
        while seen[0]:
            ends = settle(spark, lambda now=ends: _small_star(stash(_large_star(now))))
            now = _fingerprint(ends)
            if now == seen:
                break
            seen = now
        roots = ends.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
        return ends.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

    return settle(spark, rounds)
