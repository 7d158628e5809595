"""Scenes as they arrive: the batch pipeline on each micro-batch of new points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cairn.config import PipelineConfig
from cairn.plans.scene import Segmentation, segment
from cairn.schemas import POINT


def watch_points(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of POINT rows from Parquet files; a file holds whole scenes."""
    return spark.readStream.schema(POINT).parquet(folder)


def segment_stream(stream: DataFrame, sink: Callable[[Segmentation, int], None], checkpoint: str, config: PipelineConfig | None = None) -> StreamingQuery:
    """Segment each micro-batch and hand it to ``sink`` with the batch's number.

    Exactly-once is the sink's to give: a batch may come again under the same number
    after a failure.
    """

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(segment(batch, config), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
