"""Continuous ingest: a stream over a folder of batches, each merged into the next snapshot once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import upsert_stats
from ..schema import STATS_ALL


def stats_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of statistics as they arrive."""
    return spark.readStream.schema(STATS_ALL).parquet(path)


def merge_stream(stream: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is merged with what ``load`` gives and handed to ``store`` with its number. A batch that is played again after a failure has the same number, so a store that
    keeps a snapshot for each number is idempotent."""

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store(upsert_stats(load(), batch.withColumn("ord", F.col("id"))), number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
