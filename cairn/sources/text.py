"""Point clouds in text files: .xyz, .xyzrgb, .pts, and rooms of annotation files.

Files are read as lines by Spark, so one file is split over tasks and many files or
scenes make one job; the path may be anything that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.bounded import small_table
from cairn.schemas import points

#: Columns of each layout after x, y, z; .pts files may begin with a line of the count.
LAYOUTS = {".xyz": (), ".xyzrgb": ("r", "g", "b"), ".pts": ("i", "r", "g", "b")}


def _fields() -> Column:
    return F.split(F.trim(F.regexp_replace("value", r"[\s,;]+", " ")), " ")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``file`` and ``block``, where their split begins) with dense ids by file name and line.

    A split's rows follow each other, so that its first number and its count place them;
    the rows are read twice for that.
    """
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = F.sum("n").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1))  # one row for each split
    splits = small_table(splits.withColumn("ahead", F.coalesce(ahead, F.lit(0))).drop("n"))
    return rows.join(splits, ["file", "block"]).withColumn("point_id", F.col("ahead") + F.col("at") - F.col("first")).drop("at", "ahead", "first")


def read_text_cloud(spark: SparkSession, path: str, suffix: str = ".xyz", scene: Column | None = None, dense: bool = False) -> DataFrame:
    """POINT rows of text files.  Lines without three numbers are passed over.

    Colours over 1 count as 0 to 255 in .pts, and as they are in .xyzrgb.  Ids are unique;
    with ``dense`` they count up from 0 by file name and line, at the cost of a second read.
    """
    if suffix not in LAYOUTS:
        raise ValueError(f"unsupported file format {suffix!r}")
    names = ["x", "y", "z", *LAYOUTS[suffix]]
    lines = spark.read.text(path).select(_fields().alias("f"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    df = lines.select("file", "block", *[F.try_element_at("f", F.lit(k + 1)).try_cast("double").alias(c) for k, c in enumerate(names)])
    df = df.where("x is not null and y is not null and z is not null")
    if suffix == ".pts":
        df = df.withColumns({c: F.col(c) / 255.0 for c in "rgb"})
    df = numbered(df) if dense else df.withColumn("point_id", F.monotonically_increasing_id())
    return points(df.withColumn("scene_id", scene if scene is not None else F.lit("0")))


def read_annotated_room(spark: SparkSession, path: str, scene: str = "0") -> DataFrame:
    """POINT rows of a room: ``path/Annotations/*.txt``, or ``path/*.txt`` if there are none.

    A row is X Y Z R G B; without colours they are 128; colours are divided by 255.  A
    file with a row that has no three numbers is left out whole.  Ids count up from 0 by
    file name and line.  RuntimeError if no file can be read.
    """
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def listed(folder: str) -> list[str]:
        found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.txt"))
        return sorted(s.getPath().toString() for s in found) if found else []

    files = listed(f"{path}/Annotations") or listed(path)
    if not files:
        raise RuntimeError(f"no annotation files in {path}")
    lines = spark.read.text(files).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), _fields().alias("f")).where("size(f) > 1 or f[0] != ''")
    values = lines.select("file", "block", *[F.try_element_at("f", F.lit(k + 1)).try_cast("double").alias(c) for k, c in enumerate("xyzrgb")])
    bad = values.where("x is null or y is null or z is null").select("file").distinct()
    good = values.join(F.broadcast(bad) if len(files) <= 100_000 else bad, "file", "left_anti")
    half = F.col("r").isNull() | F.col("g").isNull() | F.col("b").isNull()
    coloured = good.withColumns({c: F.when(half, F.lit(128.0)).otherwise(F.col(c)) / 255.0 for c in "rgb"})
    out = points(numbered(coloured).withColumn("scene_id", F.lit(scene)))
    if out.isEmpty():
        raise RuntimeError(f"no annotation file of {path} can be read")
    return out
