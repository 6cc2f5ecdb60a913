"""Tables as numbered snapshots in a folder, and tables of a database by JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.fulltext import ANALYZERS

_TOKENS = T.StructField("tokens", T.ArrayType(T.StringType()))
TABLES = {
    "questions": T.StructType([*S.QUESTIONS.fields, _TOKENS]),
    "theme_stats": T.StructType([*S.STATS.fields, _TOKENS]),
    "themes": S.THEMES,
    "ingest_log": S.INGEST_LOG,
    "metadata": S.METADATA,
}
#: The columns whose tokens a table keeps.
SEARCHED = {"questions": ("tema_normalized", "subtema_normalized", "raw_text"), "theme_stats": ("tema", "subtema")}
#: Snapshots that stay: the newest and those that running plans may still read.
KEPT = 3


class Store:
    """``root``/table/number holds a snapshot. It counts once Spark has marked it complete, so readers never see half of one, and of two writers of one number the second fails."""

    def __init__(self, spark: SparkSession, root: str, analyzer: str = "portuguese") -> None:
        self.spark, self.root, self.analyzer = spark, root.rstrip("/"), analyzer
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, table: str) -> list[int]:
        folder = self._path(f"{self.root}/{table}")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _complete(self, table: str) -> list[int]:
        return [n for n in self._numbers(table) if self._fs.exists(self._path(f"{self.root}/{table}/{n}/_SUCCESS"))]

    def init(self) -> list[str]:
        """Creates the tables that aren't there, empty, and names them; run again it does nothing."""
        missing = [t for t in TABLES if not self._complete(t)]
        for t in missing:
            self.write(t, self.spark.createDataFrame([], TABLES[t]))
        return missing

    def read(self, table: str) -> DataFrame:
        found = self._complete(table)
        if not found:
            raise ValueError(f"the store has no table {table}: run migrate")
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{table}/{found[-1]}")

    def write(self, table: str, df: DataFrame) -> None:
        """``df`` as the next snapshot; the tokens of searched tables are made anew with their texts."""
        if table in SEARCHED:
            own = ANALYZERS[self.analyzer](F.concat_ws(" ", *SEARCHED[table]))
            df = df.withColumn("tokens", own)
        numbers = self._numbers(table)
        columns = [F.col(f.name).cast(f.dataType.simpleString()).alias(f.name) for f in TABLES[table]]
        df.select(*columns).write.mode("error").option("compression", "zstd").parquet(f"{self.root}/{table}/{max(numbers, default=0) + 1}")
        for n in self._complete(table)[:-KEPT]:
            self._fs.delete(self._path(f"{self.root}/{table}/{n}"), True)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A table of a database, read by ranges of ``key`` in ``parts`` connections; columns and filters reach the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    return reader.option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts).load()
