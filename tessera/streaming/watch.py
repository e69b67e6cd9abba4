"""Blobs as they arrive: the operators on single blobs, run on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import identify
from tessera.sources.blobs import blob_stream


def detected(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """A stream of path, format and confidence of the files that appear in a folder; it keeps no state."""
    return identify.identify(blob_stream(spark, folder, glob))


def run_on_arrival(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, glob: str | None = None) -> StreamingQuery:
    """Applies work to each batch of new blobs and writes what it gives to a folder of its own below target.

    A batch that runs again after a failure replaces its own folder, so each blob counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return blob_stream(spark, folder, glob).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
