"""Lookups and counts on the topic statistics, for all keys at once.

``stats`` has id, institution, tema, subtema, num_questions and more; ``keys`` has tema and subtema (null: the
tema's own level). Names are compared without case. Where several rows fit, the lowest id decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fulltext import fulltext_search
from ..functions.scalar import color
from .stage import staged

STAT = ("id", "institution", "ranking", "tema", "subtema", "num_questions", "cor_hex")


def lower_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"tema_lc": F.lower("tema"), "subtema_lc": F.lower("subtema")})


def stat_struct(stats: DataFrame) -> Column:
    return F.struct(*[c for c in STAT if c in stats.columns])


def topic_rollup(stats_all: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Questions of each (tema, subtema) and the lexicographic maximum of its colours; ``stats`` is taken if ``stats_all`` is empty."""
    source = stats if stats is not None and stats_all.isEmpty() else stats_all
    return source.groupBy("tema", "subtema").agg(F.sum("num_questions").cast("long").alias("num_questions"), F.max("cor_hex").alias("cor_hex"))


def restore_colors(stats: DataFrame) -> DataFrame:
    """cor_hex by count; cor stays."""
    return stats.withColumn("cor_hex", color(F.col("num_questions"))["cor_hex"])


def first_stats(stats: DataFrame) -> DataFrame:
    """(tema_lc, subtema_lc, stat): the row of lowest id."""
    return lower_keys(stats).groupBy("tema_lc", "subtema_lc").agg(F.min_by(stat_struct(stats), "id").alias("stat"))


def exact_stats(keys: DataFrame, stats: DataFrame, institution: str | None = None) -> DataFrame:
    """``keys`` with stat, a struct or null: at most one row of the same level."""
    source = stats if institution is None else stats.filter(F.col("institution") == institution)
    best = first_stats(source)
    on = (F.lower(F.col("tema")) == F.col("tema_lc")) & F.lower(F.col("subtema")).eqNullSafe(F.col("subtema_lc"))
    return keys.join(best, on, "left").drop("tema_lc", "subtema_lc")


def subtemas_of(stats: DataFrame, institution: str | None = None) -> DataFrame:
    """(tema_lc, subtemas): names below a tema, most questions first; one for each row, so names can repeat."""
    source = stats if institution is None else stats.filter(F.col("institution") == institution)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("num_questions")).alias("n"), "id", "subtema")))
    return source.filter("subtema is not null").groupBy(F.lower("tema").alias("tema_lc")).agg(F.transform(listed, lambda x: x["subtema"]).alias("subtemas"))


def topic_texts(stats: DataFrame) -> DataFrame:
    """(text_id, text, stat): the most popular row of each distinct (tema, subtema); the corpus of full-text lookups."""
    best = stats.groupBy("tema", "subtema").agg(F.min_by(stat_struct(stats), F.struct((-F.col("num_questions")).alias("n"), F.col("id").alias("i"))).alias("stat"))
    return best.select(F.col("stat.id").alias("text_id"), F.concat_ws(" ", "tema", "subtema").alias("text"), "stat")


def fulltext_stats(queries: DataFrame, stats: DataFrame, limit: int | None = None, analyzer: str = "simple", key: str = "query_id", query_col: str = "query_text") -> DataFrame:
    """(key, stat, rank): rows whose text holds all words of the query, by popularity. Without a limit the first alone, taken from distinct topics."""
    rank = lambda: Window.partitionBy(key).orderBy(F.desc("stat.num_questions"), "stat.id")
    if limit is None:
        corpus = topic_texts(stats)
        hits = fulltext_search(corpus, queries, analyzer, "text_id", "text", key, query_col, rank=False).join(corpus, F.col("id") == F.col("text_id"))
        best = hits.groupBy(key).agg(F.min_by("stat", F.struct((-F.col("stat.num_questions")).alias("n"), F.col("stat.id").alias("i"))).alias("stat"))
        return best.withColumn("rank", F.lit(1))
    # equal topics match together: words are searched in distinct texts, rows are joined behind
    topics = stats.select("tema", "subtema").distinct().withColumns({"text": F.concat_ws(" ", "tema", "subtema"), "topic": F.struct("tema", "subtema")})
    hits = fulltext_search(topics, queries, analyzer, "topic", "text", key, query_col, rank=False)
    rows = stats.select(F.struct("tema", "subtema").alias("topic"), stat_struct(stats).alias("stat"))
    found = hits.join(rows, hits["id"].eqNullSafe(rows["topic"])).select(key, "stat")
    return found.withColumn("rank", F.row_number().over(rank())).filter(F.col("rank") <= limit)


def best_stats(queries: DataFrame, stats: DataFrame, analyzer: str = "simple", query_col: str = "query_text") -> DataFrame:
    """(query_text, stat) of each distinct text with a hit: the exact row of a "tema | subtema", else the exact row of a tema, else the most popular full-text hit."""
    asked = queries.select(F.col(query_col).alias("query_text")).filter("length(trim(query_text)) > 0").distinct()
    parts = F.split("query_text", r"\|", 2)
    both = asked.select("query_text", F.trim(F.get(parts, F.lit(0))).alias("tema"), F.when(F.size(parts) > 1, F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit(""))).alias("subtema"), (F.size(parts) > 1).alias("piped"))
    piped = exact_stats(both.filter("piped"), stats).select("query_text", F.col("stat").alias("s1"))
    whole = exact_stats(asked.select("query_text", F.col("query_text").alias("tema"), F.lit(None).cast("string").alias("subtema")), stats).select("query_text", F.col("stat").alias("s2"))
    text = fulltext_stats(asked.withColumn("query_id", F.col("query_text")), stats, analyzer=analyzer).select(F.col("query_id").alias("query_text"), F.col("stat").alias("s3"))
    found = asked.join(piped, "query_text", "left").join(whole, "query_text", "left").join(text, "query_text", "left")
    return found.select("query_text", F.coalesce("s1", "s2", "s3").alias("stat")).filter("stat is not null")


def institution_counts(keys: DataFrame, stats_all: DataFrame, stats: DataFrame, analyzer: str = "simple") -> DataFrame:
    """(tema, subtema, institution, num_questions, source) of distinct keys: from ``stats_all``, else ``stats``, else full text.

    A tema counts all its rows of both levels; a subtema takes its row of highest id. The first source with any row for a key serves the key whole."""
    asked = staged(keys.select("tema", "subtema").filter("tema is not null").distinct().withColumns({"k_t": F.lower("tema"), "k_s": F.lower("subtema")}))
    # the large tables are read once each; what is written has a row for each topic and institution
    few = lambda table: staged(table.groupBy("tema", "subtema", "institution").agg(F.sum("num_questions").cast("long").alias("n"), F.max(F.struct("id", F.col("num_questions").cast("long").alias("n"))).alias("last")))
    topics = few(stats)
    every_topic = topics if stats_all is stats else few(stats_all)

    def exact(table: DataFrame, source: int) -> DataFrame:
        small = lower_keys(table).groupBy("tema_lc", "subtema_lc", "institution").agg(F.sum("n").alias("total"), F.max("last")["n"].alias("last"))
        below = asked.filter("k_s is not null").join(small, (F.col("k_t") == F.col("tema_lc")) & (F.col("k_s") == F.col("subtema_lc"))).select("tema", "subtema", "institution", F.col("last").alias("num_questions"))
        whole = small.groupBy("tema_lc", "institution").agg(F.sum("total").alias("num_questions"))
        level = asked.filter("k_s is null").join(whole, F.col("k_t") == F.col("tema_lc")).select("tema", "subtema", "institution", "num_questions")
        return below.unionByName(level).withColumn("source", F.lit(source))

    texts = topics.select("tema", "subtema").distinct().withColumns({"text": F.concat_ws(" ", "tema", "subtema"), "topic": F.struct("tema", "subtema")})
    hits = fulltext_search(texts, asked.select("tema").distinct().withColumn("query_text", F.col("tema")), analyzer, "topic", "text", "tema", "query_text", rank=False).select(F.col("tema").alias("asked"), F.col("id.tema").alias("t"), F.col("id.subtema").alias("s"))
    by_text = hits.join(topics, (F.col("t") == F.col("tema")) & F.col("s").eqNullSafe(F.col("subtema"))).groupBy("asked", "institution").agg(F.sum("n").alias("num_questions"))
    text = asked.join(by_text, F.col("tema") == F.col("asked")).select("tema", "subtema", "institution", "num_questions", F.lit(3).alias("source"))
    every = exact(every_topic, 1).unionByName(exact(topics, 2)).unionByName(text)
    first = F.min("source").over(Window.partitionBy("tema", "subtema"))
    return every.withColumn("__first", first).filter("source = __first").drop("__first")
