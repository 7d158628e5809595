"""Point clouds and records as views of the test tables, in Spark and in SQL.

The tables hold no point clouds; these stand in for them.  ``SQL`` gives the same
views as common table expressions, so a query and its SQL read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.geometry import vector
from cairn.operators.summaries import box


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def room(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """A room of 11 layers; ``by`` names a column whose values are scenes.  Ids are not unique."""
    scene = F.lit("0") if by is None else F.col(by)
    x, y, z = F.col("l_quantity") / 10.0, F.col("l_extendedprice") / 20000.0, F.col("l_discount") * 30.0
    none = F.lit(None).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        scene.alias("scene_id"), F.col("l_orderkey").alias("point_id"), x.alias("x"), y.alias("y"), z.alias("z"), none.alias("r"), none.alias("nx"), "l_orderkey")


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud with unique ids: the first three components of the embeddings."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.lit("0").alias("scene_id"), F.col("vec_id").alias("point_id"), *[e[k].cast("double").alias(c) for k, c in enumerate("xyz")], "label")


def objects(spark: SparkSession, sf_dir: str, shrink: float = 1.0) -> DataFrame:
    """Cluster rows: the room grouped by order; ``shrink`` scales the dimensions."""
    found = room(spark, sf_dir).groupBy("scene_id", F.col("l_orderkey").alias("cluster_id")).agg(F.count("*").alias("n_points"), *box())
    dims = [F.col("dims")[k] * F.lit(shrink) for k in range(3)]
    return found.withColumn("dims", vector(*dims)).withColumn("footprint_m2", F.col("dims")[0] * F.col("dims")[1])


def embedded_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane rows: a normal and a height from the embeddings."""
    e = [F.col("embedding")[k].cast("double") for k in range(4)]
    return table(spark, sf_dir, "embeddings").select(
        F.lit("0").alias("scene_id"), F.col("vec_id").alias("plane_id"), vector(e[0], e[1], e[2] * 6.0).alias("normal"),
        (F.abs((e[3] + 0.4) * 3.75 - 1.5) * 2.0).alias("centroid_z"))


LABEL_NAMES = ("floor", "ceiling", "wall", "furniture", "chair", "small_object", "unknown")


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, true_label, pred_label): two columns of the orders, mapped to labels."""
    names = F.array(*map(F.lit, LABEL_NAMES))
    n = len(LABEL_NAMES)
    key = F.col("o_orderkey")
    true = (F.col("o_custkey") % n).cast("int")
    pred = F.when(key % 3 == 0, (key % n).cast("int")).otherwise(true)
    return table(spark, sf_dir, "orders").select(key.alias("position"), names[true].alias("true_label"), names[pred].alias("pred_label"))


_NAMES = ", ".join(f"'{n}'" for n in LABEL_NAMES)
SQL = {
    "room": "room AS (SELECT '0' AS scene_id, l_orderkey AS point_id, l_quantity / 10.0::DOUBLE AS x, l_extendedprice / 20000.0::DOUBLE AS y, "
            "l_discount * 30.0::DOUBLE AS z, l_orderkey, l_returnflag FROM lineitem)",
    "embedded": "embedded AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)",
    "objects": "objects AS (SELECT l_orderkey AS cluster_id, count(*) AS n_points, min(x) AS x0, min(y) AS y0, min(z) AS z_min, max(x) AS x1, max(y) AS y1, "
               "max(z) AS z_max, max(x) - min(x) AS w, max(y) - min(y) AS d, max(z) - min(z) AS h, (max(x) - min(x)) * (max(y) - min(y)) AS footprint_m2, "
               "avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM room GROUP BY l_orderkey)",
    "objects_small": "objects_small AS (SELECT cluster_id, n_points, z_min, z_max, w * 0.3::DOUBLE AS w, d * 0.3::DOUBLE AS d, h * 0.3::DOUBLE AS h, "
                     "(w * 0.3::DOUBLE) * (d * 0.3::DOUBLE) AS footprint_m2 FROM objects)",
    "embedded_planes": "embedded_planes AS (SELECT vec_id AS plane_id, embedding[1]::DOUBLE AS nx, embedding[2]::DOUBLE AS ny, embedding[3]::DOUBLE * 6.0::DOUBLE AS nz, "
                       "abs((embedding[4]::DOUBLE + 0.4::DOUBLE) * 3.75::DOUBLE - 1.5::DOUBLE) * 2.0::DOUBLE AS centroid_z FROM embeddings)",
    "pairs": f"names AS (SELECT [{_NAMES}] AS n), pairs AS (SELECT o_orderkey AS position, n[o_custkey % {len(LABEL_NAMES)} + 1] AS true_label, "
             f"n[CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % {len(LABEL_NAMES)} ELSE o_custkey % {len(LABEL_NAMES)} END + 1] AS pred_label FROM orders, names)",
}


def with_views(*names: str) -> str:
    """``WITH RECURSIVE`` clause of the views named."""
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names)
