"""Snapshot upserts and embeddings. Tables are immutable; each operator gives the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import Encoder


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def upsert(table: DataFrame, batch: DataFrame, key: list[str], update: list[str], order: str) -> DataFrame:
    """``table`` with ``batch`` merged by ``key``, null keys being equal.

    A known key takes the last batch row's values of ``update`` and keeps the rest; a new key takes the first batch row's values but for ``update``. One
    aggregation does both: the table's rows come before all of the batch."""
    columns = [c for c in table.columns if c != order]
    missing = [c for c in columns if c not in batch.columns]
    rows = table.select(*columns, F.lit(0).alias("__b"), F.lit(0).cast("long").alias("__o")).unionByName(batch.withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in missing}).select(*columns, F.lit(1).alias("__b"), F.col(order).cast("long").alias("__o")))
    at = F.struct("__b", "__o")
    keep = [c for c in columns if c not in key and c not in update]
    return rows.groupBy(*key).agg(*[F.min_by(c, at).alias(c) for c in keep], *[F.max_by(c, at).alias(c) for c in update]).select(*columns)


def upsert_questions(table: DataFrame, batch: DataFrame, order: str = "ord") -> DataFrame:
    """By hash of the text alone: tema and subtema are the last writer's, all else the first one's."""
    return upsert(table, batch.withColumn("content_hash", content_hash(F.col("raw_text"))), ["content_hash"], ["tema_normalized", "subtema_normalized"], order)


def upsert_stats(table: DataFrame, batch: DataFrame, order: str = "ord") -> DataFrame:
    return upsert(table, batch, ["institution", "category", "tema", "subtema"], ["ranking", "percentage", "num_questions", "cor", "cor_hex"], order)


def with_ids(df: DataFrame, by: str, start: int = 0, id_col: str = "id") -> DataFrame:
    """Stable ids for rows without one, in order of ``by``, without gathering them: ranges are counted, then numbered on their own."""
    have, need = df.filter(F.col(id_col).isNotNull()), df.filter(F.col(id_col).isNull()).drop(id_col)
    dealt = need.repartitionByRange(F.col(by)).withColumn("__p", F.spark_partition_id())
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("__p").count().withColumn("__before", F.coalesce(F.sum("count").over(w), F.lit(0))).drop("count")  # a row for each partition
    numbered = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(by))).join(F.broadcast(before), "__p")
    new = numbered.withColumn(id_col, F.lit(start) + F.col("__before") + F.col("__n")).drop("__p", "__n", "__before")
    return have.unionByName(new.select(*have.columns))


def new_files(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files whose hash is not logged."""
    return files.join(log.select("file_hash"), "file_hash", "left_anti")


def record_ingest(log: DataFrame, files: DataFrame) -> DataFrame:
    """The log with files that it does not hold."""
    return log.unionByName(files.dropDuplicates(["file_hash"]).join(log.select("file_hash"), "file_hash", "left_anti").select(*log.columns))


def set_metadata(table: DataFrame, key: str, value: str) -> DataFrame:
    spark = table.sparkSession
    return table.filter(F.col("key") != key).unionByName(spark.createDataFrame([(key, value)], "key string, value string"))


def model_changed(table: DataFrame, model_id: str) -> bool:
    found = table.filter("key = 'embedding_model'").select("value").head()
    return found is None or found[0] != model_id


def pending_embeddings(table: DataFrame) -> DataFrame:
    return table.filter("embedding is null")


def set_embeddings(table: DataFrame, vectors: DataFrame, id_col: str = "id") -> DataFrame:
    """``table`` with the new vectors (id, embedding) in place of the old where there is one."""
    new = vectors.select(F.col(id_col).alias("__id"), F.col("embedding").alias("__new"))
    return table.join(new, F.col(id_col) == F.col("__id"), "left").withColumn("embedding", F.coalesce("__new", "embedding")).select(*table.columns)


def embed(table: DataFrame, text: Column, encoder: Encoder, everything: bool = False) -> DataFrame:
    """``table`` with embeddings where there is none, or of all rows. Each distinct text is encoded once."""
    need = F.lit(True) if everything else F.col("embedding").isNull()
    rows = table.withColumn("__text", F.when(need, text))
    vectors = encoder(rows.select(F.col("__text").alias("text")).filter("text is not null").distinct()).select(F.col("text").alias("__t"), F.col("embedding").alias("__new"))
    out = rows.join(vectors, F.col("__text") == F.col("__t"), "left")
    return out.withColumn("embedding", F.when(need, F.col("__new")).otherwise(F.col("embedding"))).select(*table.columns)


def stats_text() -> Column:
    return F.concat_ws(" ", "tema", F.coalesce("subtema", F.lit("")))


def questions_text() -> Column:
    return F.concat_ws(" ", F.coalesce("tema_normalized", F.lit("")), F.coalesce("subtema_normalized", F.lit("")), "raw_text")
