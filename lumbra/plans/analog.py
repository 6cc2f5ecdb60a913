"""The tables of the topic domain, derived from a star schema of orders: so that every operator runs over whole tables.

Institutions are nations, categories part types, temas brands, subtemas part names; a question is an order line. A tema's own
level is the roll-up of its subtemas. The input sheet comes from the parts, with the noise that sheets have. The encoder gives a text one
of the table's vectors by its MD5, so equal texts have equal vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import color
from ..operators.reconcile import Base
from ..operators.search import Encoder
from ..operators.stage import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stats(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    where = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    # counted by part and nation before the names come in
    few = line.join(where, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey", "n_name").agg(F.count(F.lit(1)).alias("n"))
    low = few.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("n_name", "p_type", "p_brand", "p_name").agg(F.sum("n").alias("num_questions"))
    top = low.groupBy("n_name", "p_type", "p_brand").agg(F.sum("num_questions").alias("num_questions")).withColumn("p_name", F.lit(None).cast("string"))
    rows = low.unionByName(top).select(
        F.md5(F.concat_ws("|", "n_name", "p_type", "p_brand", F.coalesce("p_name", F.lit("")))).alias("id"), F.col("n_name").alias("institution"), F.col("p_type").alias("category"), F.col("p_brand").alias("tema"), F.col("p_name").alias("subtema"), F.col("num_questions").cast("long").alias("num_questions")
    )
    level = F.col("subtema").isNull()
    rank = Window.partitionBy("institution", "category", level).orderBy(F.desc("num_questions"), "tema", "subtema")
    share = F.col("num_questions") * 100.0 / F.sum("num_questions").over(Window.partitionBy("institution", "category", level))
    rows = rows.withColumns({"ranking": F.row_number().over(rank), "percentage": share, "c": color(F.col("num_questions"))}).select("*", "c.cor", "c.cor_hex").drop("c")
    if vectors:
        rows = staged(rows.withColumn("__t", F.concat_ws(" ", "tema", "subtema")))
        v = encoder(spark, sf_dir)(rows.select(F.col("__t").alias("text")).distinct()).select(F.col("text").alias("__t"), "embedding")
        rows = staged(rows.join(v, "__t").drop("__t"))
    return rows


def encoder(spark: SparkSession, sf_dir: str) -> Encoder:
    known = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = known.count()

    def encode(texts: DataFrame) -> DataFrame:
        place = F.conv(F.substring(F.md5(F.lower("text")), 1, 7), 16, 10).cast("long") % n
        return texts.select("text").withColumn("__p", place).join(known, F.col("__p") == F.col("vec_id")).select("text", "embedding")

    return encode


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = lambda n, *xs: f"case p_partkey % {n} " + " ".join(f"when {i} then {x}" for i, x in enumerate(xs)) + " end"
    return table(spark, sf_dir, "part").selectExpr("p_partkey as row_idx", f"{case(8, *TEMA)} as tema", f"{case(5, *SUBTEMA)} as subtema", f"{case(7, *EQUIVALENT)} as equivalencia")


TEMA = ("upper(p_brand)", "concat(p_brand, ' | ', p_name)", "concat('  ', lower(p_brand), ' ')", "p_brand", "'pcr'", "p_name", "concat(p_brand, ' series')", "concat(p_type, ' ', p_brand)")
SUBTEMA = ("null", "upper(p_name)", "'nan'", "p_name", "''")
EQUIVALENT = ("concat(p_brand, ' | ', p_name)", "'None'", "p_brand", "null", "null", "null", "null")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("institution"), F.col("lang").alias("tema_normalized"), F.lit(None).cast("string").alias("subtema_normalized"), F.col("text").alias("raw_text"))
    return docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


def curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week for each brand and name, by the least part that has both."""
    parts = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("position"))
    return parts.select("position", (F.col("position") % 40 + 1).cast("string").alias("semana"), F.col("p_brand").alias("tema"), F.col("p_name").alias("subtema"))


def base(spark: SparkSession, sf_dir: str) -> Base:
    own = stats(spark, sf_dir, vectors=True)
    return Base(questions(spark, sf_dir), own, own.drop("embedding"), encoder(spark, sf_dir))
