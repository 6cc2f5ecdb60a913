"""Results written between the steps of a long cascade, so that each step is planned and run once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, by spark.checkpoint.dir. Where that is unset a local master gets a folder of its own; on a cluster it is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
    own = tempfile.mkdtemp(prefix="lumbra-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _forget(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended
        pass


def staged(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``df``, written to the shared folder and read back: its plan ends there, and a lost executor loses none of it. ``by``: columns whose values have folders of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumbra-stage-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)
