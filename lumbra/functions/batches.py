"""The size of what Python workers handle at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch at most.
BATCH = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sees that an Arrow batch takes BATCH bytes at most, however long the texts are; a smaller limit of the user's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH:
        spark.conf.set(key, str(BATCH))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... as many as counts[0], then the same of the next."""
    return np.repeat(starts - (counts.cumsum() - counts), counts) + np.arange(counts.sum())


def runs(sizes: np.ndarray, limit: int, most: int) -> list[tuple[int, int]]:
    """Neighbours whose sizes add up to about ``limit`` at most, and no more than ``most`` of them; a larger one comes alone."""
    ends = sizes.cumsum()
    out, at = [], 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = min(max(int(np.searchsorted(ends, before + limit, "right")), at + 1), at + most)
        out.append((at, to))
        at = to
    return out
