"""Hybrid search: vector and full-text candidates, joined full outer, for all queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions.fulltext import fulltext_search
from ..functions.vectors import vector_search
from .stage import staged
from .vector_index import Index, index_search

#: Texts (a column ``text``) to (text, embedding).
Encoder = Callable[[DataFrame], DataFrame]
#: Each branch hands on so many times the wanted number.
OVERFETCH = 3


def hybrid_search(corpus: DataFrame, queries: DataFrame, k: int = 5, alpha: float = K.ALPHA, beta: float = K.BETA, analyzer: str = "simple", id_col: str = "id", text_col: str = "text", key: str = "query_id", index: Index | None = None, tokens_col: str | None = None) -> DataFrame:
    """(key, id, similarity, fts_score, hybrid_score), k of each query. ``queries``: key, query_text, embedding.

    A document outside the similar ones of a query counts similarity 0, whatever its own would be; likewise for words.
    With an ``index`` of the corpus the vector branch is approximate; with ``tokens_col`` the corpus's stored tokens are searched."""
    near = index_search(index, queries, OVERFETCH * k, key) if index else vector_search(corpus.select(id_col, "embedding"), queries, OVERFETCH * k, id_col, key)
    texts = _best(fulltext_search(corpus.drop("embedding"), queries, analyzer, id_col, text_col, key, tokens_col=tokens_col), key, "fts_score", OVERFETCH * k)
    return merge_branches(near, texts, k, alpha, beta, key)


def _best(hits: DataFrame, key: str, score: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(score), "id")
    return hits.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def merge_branches(near: DataFrame, texts: DataFrame, k: int, alpha: float, beta: float, key: str) -> DataFrame:
    both = near.join(texts, [key, "id"], "full_outer").select(key, "id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("fts_score", F.lit(0.0)).alias("fts_score"))
    scored = both.withColumn("hybrid_score", alpha * F.col("similarity") + beta * F.col("fts_score"))
    w = Window.partitionBy(key).orderBy(F.desc("hybrid_score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def retrieve(corpus: DataFrame, queries: DataFrame, k: int = K.TOP_K, threshold: float = K.SIMILARITY_THRESHOLD, **options) -> DataFrame:
    """The hybrid hits from the threshold on; it is applied to the k best, not before."""
    return hybrid_search(corpus, queries, k, **options).filter(F.col("hybrid_score") >= threshold)


def search_topics(texts: DataFrame, stats: DataFrame, encoder: Encoder, k: int, analyzer: str = "simple", alpha: float = K.ALPHA, beta: float = K.BETA) -> DataFrame:
    """(text, rank, hybrid_score, stat) of distinct texts. ``stats`` has an embedding of its tema and subtema.

    Rows of one topic share text and vector, and are candidates of their own. Topics are searched once each; the rows of lowest id, as many
    as a branch hands on, then stand for each topic found."""
    n = OVERFETCH * k
    asked = texts.select("text").filter("text is not null and text <> ''").distinct()
    queries = staged(asked.join(encoder(asked), "text").select(F.col("text").alias("query_id"), F.col("text").alias("query_text"), "embedding"))
    topics = stats.groupBy("tema", "subtema").agg(F.min_by("embedding", "id").alias("embedding")).select(F.concat_ws(chr(31), "tema", "subtema").alias("topic"), F.concat_ws(" ", "tema", "subtema").alias("text"), "embedding")
    rank = Window.partitionBy("topic").orderBy("stat.id")
    rows = stats.select(F.concat_ws(chr(31), "tema", "subtema").alias("topic"), F.struct("id", "institution", "ranking", "tema", "subtema", "num_questions", "cor_hex").alias("stat"))
    rows = rows.withColumn("__n", F.row_number().over(rank)).filter(F.col("__n") <= n).drop("__n")
    expand = lambda hits, score: _best(hits.withColumnRenamed("id", "topic").join(rows, "topic").select("query_id", F.col("stat.id").alias("id"), score), "query_id", score, n)
    near = expand(vector_search(topics.select("topic", "embedding"), queries, n, "topic"), "similarity")
    words = expand(fulltext_search(topics, queries, analyzer, "topic", "text"), "fts_score")
    hits = merge_branches(near, words, k, alpha, beta, "query_id")
    return staged(hits.join(rows.select(F.col("stat.id").alias("id"), "stat"), "id").select(F.col("query_id").alias("text"), "rank", "hybrid_score", "stat"))
