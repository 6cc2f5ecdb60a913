"""Input sheets of any format in one shape, file fingerprints, curriculum."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .xlsx import XlsxDataSource, canonical_headers

OPTIONAL = tuple(n for n in K.HEADERS if n != K.REQUIRED_HEADER)


def shape_sheet(df: DataFrame) -> DataFrame:
    """Canonical column names; the required column must be there, missing optional ones are null; rows without a tema go (blank ones stay)."""
    out = df.toDF(*canonical_headers(df.columns))
    if K.REQUIRED_HEADER not in out.columns:
        raise ValueError(f"the sheet has no column {K.REQUIRED_HEADER}: {', '.join(out.columns)}")
    for name in OPTIONAL:
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out.na.drop(subset=[K.REQUIRED_HEADER])


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """An input sheet from .xlsx, .csv or Parquet. Only .xlsx numbers its rows; give others a column row_idx if order matters."""
    if path.endswith(".xlsx"):
        spark.dataSource.register(XlsxDataSource)
        return shape_sheet(spark.read.format("xlsx").load(path))
    if path.endswith(".csv"):
        return shape_sheet(spark.read.csv(path, header=True))
    return shape_sheet(spark.read.parquet(path))


def read_curriculum(spark: SparkSession, path: str) -> DataFrame:
    """(position, semana, tema, subtema): the first, fourth and fifth column of a sheet."""
    spark.dataSource.register(XlsxDataSource)
    df = spark.read.format("xlsx").load(path)
    week, tema, subtema = (df.columns[i] for i in (1, 4, 5))
    return df.select(F.col("row_idx").alias("position"), F.col(f"`{week}`").alias("semana"), F.col(f"`{tema}`").alias("tema"), F.col(f"`{subtema}`").alias("subtema"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_hash, size) of the files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, line_no, line) of extracted text files; a form feed begins a page."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\f")).alias("page", "t"))
    return text.select("file", "page", F.posexplode(F.split("t", "\r?\n")).alias("line_no", "line"))
