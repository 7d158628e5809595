"""Colours of labels, as tables and as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# RGB of each label, 0 to 1.
LABEL_COLOURS = {
    "floor": (0.6, 0.4, 0.2),
    "ceiling": (0.9, 0.9, 0.9),
    "wall": (0.5, 0.6, 0.8),
    "furniture": (0.2, 0.8, 0.3),
    "chair": (0.3, 0.9, 0.3),
    "table": (0.1, 0.6, 0.1),
    "shelf": (0.4, 0.4, 0.1),
    "tall_furniture": (0.1, 0.4, 0.1),
    "small_object": (0.9, 0.6, 0.1),
    "high_fixture": (0.9, 0.2, 0.2),
    "horizontal_surface": (0.4, 0.4, 0.1),
    "unknown": (0.6, 0.0, 0.6),
    "noise": (0.3, 0.3, 0.3),
}
# Fixed value: on the map walls are drawn darker.
MAP_COLOURS = LABEL_COLOURS | {"wall": (0.25, 0.25, 0.25)}


def colour_table(spark: SparkSession, colours: dict = LABEL_COLOURS) -> DataFrame:
    """(label, r, g, b)"""
    return spark.createDataFrame([(k, *v) for k, v in colours.items()], "label string, r double, g double, b double")


def colour(label: Column, channel: int, colours: dict = LABEL_COLOURS) -> Column:
    """One channel of a label's colour; labels without one get that of ``unknown``."""
    table = F.create_map(*[F.lit(x) for k, v in colours.items() for x in (k, v[channel])])
    return F.coalesce(F.try_element_at(table, label), F.lit(colours["unknown"][channel]))


def colorize(df: DataFrame, label: str = "label", colours: dict = LABEL_COLOURS) -> DataFrame:
    """``df`` with r, g, b of its label."""
    return df.withColumns({c: colour(F.col(label), k, colours) for k, c in enumerate("rgb")})
