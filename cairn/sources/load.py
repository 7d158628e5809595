"""One entry for all file formats."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession

from cairn.sources.binary import PARSERS, read_binary_cloud
from cairn.sources.text import LAYOUTS, read_text_cloud

FORMATS = (*PARSERS, *LAYOUTS)


def load_cloud(spark: SparkSession, path: str, scene: Column | None = None) -> DataFrame:
    """POINT rows of a file (or a glob of files) by its suffix.

    ValueError for an unsupported suffix, tested before existence; FileNotFoundError for
    no such file; ValueError if there are no points.
    """
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file format {suffix!r}; known: {', '.join(sorted(FORMATS))}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
        raise FileNotFoundError(path)
    read = read_text_cloud if suffix in LAYOUTS else read_binary_cloud
    found = read(spark, path, suffix, scene)
    if found.isEmpty():
        raise ValueError(f"{path} has no points")
    return found
