"""The registered queries of the topic domain, over the tables of :mod:`analog`, each beside the SQL that must give the same rows."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalar
from ..functions.fulltext import fulltext_search, simple
from ..functions.vectors import vector_search
from ..operators import export, ingest, judge, lookups, parse, reconcile, resolve, search, vector_index
from ..operators.stage import staged
from . import analog
from .analog import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# --- SQL that the oracles share
COLOR_NAME = lambda n: f"CASE WHEN {n} >= 6 THEN 'vermelho' WHEN {n} >= 4 THEN 'laranja' WHEN {n} >= 2 THEN 'amarelo' WHEN {n} >= 1 THEN 'verde' ELSE 'azul' END"
COLOR_HEX = lambda n: f"CASE WHEN {n} >= 6 THEN '#EF4444' WHEN {n} >= 4 THEN '#F97316' WHEN {n} >= 2 THEN '#EAB308' WHEN {n} >= 1 THEN '#22C55E' ELSE '#3B82F6' END"
STATS = f"""stats0 AS (
  SELECT md5(concat_ws('|', n_name, p_type, p_brand, coalesce(p_name, ''))) AS id, n_name AS institution, p_type AS category, p_brand AS tema, p_name AS subtema, count(*)::BIGINT AS num_questions
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY GROUPING SETS ((n_name, p_type, p_brand), (n_name, p_type, p_brand, p_name))),
stats AS (SELECT *, {COLOR_NAME("num_questions")} AS cor, {COLOR_HEX("num_questions")} AS cor_hex FROM stats0)"""
TOKENS = lambda c: f"regexp_extract_all(lower({c}), '[\\pL\\pN_]+')"
_case = lambda n, xs: f"CASE p_partkey % {n} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
SHEET = f"sheet AS (SELECT p_partkey AS row_idx, {_case(8, analog.TEMA)} AS tema, {_case(5, analog.SUBTEMA)} AS subtema, {_case(7, analog.EQUIVALENT)} AS equivalencia FROM part)"
CLEAN = lambda c: f"CASE WHEN lower(trim({c})) IN ('', 'nan', 'none') THEN NULL ELSE trim({c}) END"
EXPAND = lambda c: "CASE lower(trim({0})) {1} ELSE {0} END".format(c, " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**K.ALIASES, **K.ABBREVIATIONS}.items()))
PREPARED = f"""clean AS (SELECT row_idx, coalesce({CLEAN("tema")}, '') AS tema_raw, {CLEAN("subtema")} AS subtema_raw, {CLEAN("equivalencia")} AS equivalencia FROM sheet),
parts AS (SELECT *, CASE WHEN contains(tema_raw, '|') THEN substr(tema_raw, 1, instr(tema_raw, '|') - 1) ELSE tema_raw END AS t0, CASE WHEN contains(tema_raw, '|') THEN substr(tema_raw, instr(tema_raw, '|') + 1) END AS s0 FROM clean),
named AS (SELECT *, trim(t0) AS t1, coalesce(subtema_raw, {CLEAN("s0")}) AS s1 FROM parts),
prepared AS (SELECT row_idx, tema_raw, subtema_raw, equivalencia, {EXPAND("t1")} AS norm_tema, CASE WHEN tema_raw <> '' AND s1 IS NOT NULL THEN {EXPAND("s1")} END AS norm_subtema FROM named)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- roll-ups and scalars


@query(f"WITH {STATS} SELECT tema, subtema, sum(num_questions)::BIGINT AS num_questions, max(cor_hex) AS cor_hex, {COLOR_NAME('sum(num_questions)')} AS cor FROM stats GROUP BY tema, subtema")
def topic_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = lookups.topic_rollup(analog.stats(spark, d)).withColumn("cor", scalar.color(F.col("num_questions"))["cor"])
    return out.orderBy(F.desc("num_questions"), "tema", "subtema")


@query(f"SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) % 9 - 1 AS n, {COLOR_NAME('CAST(l_quantity AS BIGINT) % 9 - 1')} AS cor, {COLOR_HEX('CAST(l_quantity AS BIGINT) % 9 - 1')} AS cor_hex FROM lineitem")
def color_classify(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") % 9 - 1).alias("n"))
    return rows.withColumn("c", scalar.color(F.col("n"))).select("l_orderkey", "l_linenumber", "n", "c.cor", "c.cor_hex")


@query(f"WITH {STATS} SELECT id, 'verde' AS cor, {COLOR_HEX('num_questions')} AS cor_hex FROM stats")
def restore_colors(spark: SparkSession, d: str) -> DataFrame:
    old = analog.stats(spark, d).withColumns({"cor": F.lit("verde"), "cor_hex": F.lit("#22C55E")})
    return lookups.restore_colors(old).select("id", "cor", "cor_hex")


_METHODS = (K.EXACT, K.FTS, K.SEMANTIC, K.LLM, K.NONE)


def _label_sql() -> str:
    arms = []
    for m, steps in K.LABELS.items():
        arms += [f"WHEN m = '{m}'" + (f" AND s >= {least}" if least is not None else "") + f" THEN '{label}'" for least, label in steps]
    return "CASE " + " ".join(arms) + f" ELSE '{K.NO_MATCH_LABEL}' END"


@query(f"SELECT event_id, m AS match_method, s AS match_score, {_label_sql()} AS match_label FROM (SELECT event_id, [{', '.join(repr(m) for m in _METHODS)}][event_id % 5 + 1] AS m, (event_id % 101) / 100.0::DOUBLE AS s FROM events)")
def temperature_label(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.element_at(F.array(*[F.lit(m) for m in _METHODS]), (F.col("event_id") % 5 + 1).cast("int")).alias("match_method"), (F.col("event_id") % 101 / F.lit(100.0)).alias("match_score"))
    return rows.withColumn("match_label", scalar.match_label(F.col("match_method"), F.col("match_score")))


@query(f"WITH {SHEET} SELECT row_idx, coalesce({CLEAN('tema')}, '') AS tema, {CLEAN('subtema')} AS subtema, {CLEAN('equivalencia')} AS equivalencia FROM sheet")
def null_rule_clean(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.prepare(analog.sheet(spark, d)).select("row_idx", F.col("tema_raw").alias("tema"), F.col("subtema_raw").alias("subtema"), "equivalencia")


@query(f"WITH {SHEET}, {PREPARED} SELECT row_idx, norm_tema, norm_subtema FROM prepared")
def pipe_split_normalize(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.prepare(analog.sheet(spark, d)).select("row_idx", "norm_tema", "norm_subtema")


_TERMS = [*K.ABBREVIATIONS, *K.ALIASES]


@query(f"SELECT p_partkey, term, {EXPAND('term')} AS expanded FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE upper([{', '.join(repr(t) for t in _TERMS)}][p_partkey % {len(_TERMS)} + 1]) END AS term FROM part)")
def synonym_expand(spark: SparkSession, d: str) -> DataFrame:
    term = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.upper(F.element_at(F.array(*[F.lit(t) for t in _TERMS]), (F.col("p_partkey") % len(_TERMS) + 1).cast("int"))))
    return table(spark, d, "part").select("p_partkey", term.alias("term")).withColumn("expanded", scalar.expand_synonym(F.col("term")))


@query()
def fuzzy_synonym(spark: SparkSession, d: str) -> DataFrame:
    """All terms with a letter more, and all names of the tables."""
    part = table(spark, d, "part")
    terms = spark.range(len(_TERMS)).select(F.element_at(F.array(*[F.lit(t + "s") for t in _TERMS]), (F.col("id") + 1).cast("int")).alias("word"))
    known = terms.union(part.select("p_name")).union(part.select("p_type")).union(table(spark, d, "nation").select("n_name")).distinct()
    return known.select("word", scalar.fuzzy_synonym(F.col("word")).alias("expanded"))


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {w!r})' for w in ws)} THEN {s!r}" for s, ws in K.SPECIALTIES.items()) + " END AS specialty FROM (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents)")
def specialty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scalar.specialty(scalar.normalize_text(F.col("text"))).alias("specialty"))


@query("SELECT page_id, sha256(html) AS content_hash FROM pages")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", ingest.content_hash(F.col("html")).alias("content_hash"))


# --- lookups

_SHEET_KEYS = f"{SHEET}, {PREPARED}"
_FIRST = "first AS (SELECT lower(tema) AS tl, lower(subtema) AS sl, arg_min(id, id) AS id FROM stats GROUP BY ALL)"


@query(f"WITH {STATS}, {_SHEET_KEYS}, {_FIRST} SELECT row_idx, norm_tema AS tema, norm_subtema AS subtema, f.id AS stat_id FROM prepared LEFT JOIN first f ON lower(norm_tema) = tl AND lower(norm_subtema) IS NOT DISTINCT FROM sl")
def exact_stat_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = reconcile.prepare(analog.sheet(spark, d)).select("row_idx", F.col("norm_tema").alias("tema"), F.col("norm_subtema").alias("subtema"))
    return lookups.exact_stats(keys, analog.stats(spark, d)).select("row_idx", "tema", "subtema", F.col("stat.id").alias("stat_id"))


@query(f"WITH {STATS}, {_SHEET_KEYS}, {_FIRST} SELECT row_idx, norm_tema AS tema, f.id AS stat_id FROM prepared LEFT JOIN first f ON lower(norm_tema) = tl AND sl IS NULL")
def tema_level_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = reconcile.prepare(analog.sheet(spark, d)).select("row_idx", F.col("norm_tema").alias("tema"), F.lit(None).cast("string").alias("subtema"))
    return lookups.exact_stats(keys, analog.stats(spark, d)).select("row_idx", "tema", F.col("stat.id").alias("stat_id"))


@query(f"WITH {STATS} SELECT lower(tema) AS tema_lc, string_agg(subtema, '|' ORDER BY num_questions DESC, id) AS subtemas FROM stats WHERE subtema IS NOT NULL GROUP BY lower(tema)")
def subtemas_of_tema(spark: SparkSession, d: str) -> DataFrame:
    return lookups.subtemas_of(analog.stats(spark, d)).select("tema_lc", F.array_join("subtemas", "|").alias("subtemas"))


_NAMES = f"asked AS (SELECT DISTINCT p_name AS q, list_distinct({TOKENS('p_name')}) AS qt FROM part UNION SELECT DISTINCT p_brand, list_distinct({TOKENS('p_brand')}) FROM part)"
_HITS = f"hits AS (SELECT q, s.* FROM asked JOIN (SELECT *, {TOKENS("concat_ws(' ', tema, subtema)")} AS dt FROM stats) s ON list_has_all(dt, qt))"


def _names(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.select(F.col("p_name").alias("q")).union(part.select("p_brand")).distinct().select(F.col("q").alias("query_id"), F.col("q").alias("query_text"))


@query(f"WITH {STATS}, {_NAMES}, {_HITS} SELECT q AS query_text, arg_min(id, (-num_questions, id)) AS stat_id FROM hits GROUP BY q")
def fts_best_by_popularity(spark: SparkSession, d: str) -> DataFrame:
    return lookups.fulltext_stats(_names(spark, d), analog.stats(spark, d)).select(F.col("query_id").alias("query_text"), F.col("stat.id").alias("stat_id"))


@query(f"WITH {STATS}, {_NAMES}, {_HITS} SELECT q AS query_text, id AS stat_id, CAST(row_number() OVER (PARTITION BY q ORDER BY num_questions DESC, id) AS INTEGER) AS rank FROM hits QUALIFY row_number() OVER (PARTITION BY q ORDER BY num_questions DESC, id) <= 10")
def fts_top10(spark: SparkSession, d: str) -> DataFrame:
    return lookups.fulltext_stats(_names(spark, d), analog.stats(spark, d), limit=10).select(F.col("query_id").alias("query_text"), F.col("stat.id").alias("stat_id"), "rank")


_BEST = f"""{_FIRST},
texts AS (SELECT tema, subtema, concat_ws(' ', tema, subtema) AS txt, arg_min(id, (-num_questions, id)) AS id, max(num_questions) AS n FROM stats GROUP BY tema, subtema),
tried AS (SELECT DISTINCT q FROM tries WHERE length(trim(q)) > 0),
cut AS (SELECT q, contains(q, '|') AS piped, trim(CASE WHEN contains(q, '|') THEN substr(q, 1, instr(q, '|') - 1) ELSE q END) AS a, CASE WHEN contains(q, '|') THEN nullif(trim(substr(q, instr(q, '|') + 1)), '') END AS b, list_distinct({TOKENS("q")}) AS qt FROM tried),
b1 AS (SELECT q, f.id FROM cut JOIN first f ON piped AND lower(a) = tl AND lower(b) IS NOT DISTINCT FROM sl),
b2 AS (SELECT q, f.id FROM cut JOIN first f ON lower(q) = tl AND sl IS NULL),
b3 AS (SELECT q, arg_min(t.id, (-t.n, t.id)) AS id FROM cut JOIN (SELECT *, {TOKENS("txt")} AS dt FROM texts) t ON len(qt) > 0 AND list_has_all(dt, qt) GROUP BY q),
best AS (SELECT q, coalesce(b1.id, b2.id, b3.id) AS id FROM tried LEFT JOIN b1 USING (q) LEFT JOIN b2 USING (q) LEFT JOIN b3 USING (q) WHERE coalesce(b1.id, b2.id, b3.id) IS NOT NULL)"""


@query(f"WITH {STATS}, {SHEET}, {PREPARED}, tries AS (SELECT tema_raw AS q FROM prepared UNION SELECT equivalencia FROM prepared UNION SELECT norm_subtema FROM prepared), {_BEST} SELECT q AS query_text, id AS stat_id FROM best")
def best_stat_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = reconcile.prepare(analog.sheet(spark, d))
    asked = rows.select(F.explode(F.array("tema_raw", "equivalencia", "norm_subtema")).alias("query_text"))
    return lookups.best_stats(asked, analog.stats(spark, d)).select("query_text", F.col("stat.id").alias("stat_id"))


# --- counts


@query(f"WITH {STATS} SELECT tema, institution, sum(num_questions)::BIGINT AS num_questions FROM (SELECT DISTINCT p_brand AS tema FROM part) JOIN (SELECT tema AS t, institution, num_questions FROM stats) ON lower(tema) = lower(t) GROUP BY tema, institution")
def counts_by_institution_tema(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "part").select(F.col("p_brand").alias("tema"), F.lit(None).cast("string").alias("subtema"))
    own = analog.stats(spark, d)
    return lookups.institution_counts(keys, own, own).select("tema", "institution", "num_questions")


@query(f"WITH {STATS} SELECT k.tema, k.subtema, institution, arg_max(num_questions, id) AS num_questions FROM (SELECT DISTINCT p_brand AS tema, p_name AS subtema FROM part) k JOIN stats s ON lower(k.tema) = lower(s.tema) AND lower(k.subtema) = lower(s.subtema) GROUP BY k.tema, k.subtema, institution")
def counts_by_institution_subtema(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "part").select(F.col("p_brand").alias("tema"), F.col("p_name").alias("subtema"))
    own = analog.stats(spark, d)
    return lookups.institution_counts(keys, own, own).filter("source < 3").select("tema", "subtema", "institution", "num_questions")


@query(
    f"""WITH {STATS}, keys AS (SELECT DISTINCT p_brand AS tema FROM part UNION SELECT DISTINCT p_name FROM part),
wide AS (SELECT * FROM stats WHERE category <> 'SMALL' AND tema <> 'Brand#7'),
a AS (SELECT k.tema, institution, sum(num_questions)::BIGINT AS n, 1 AS source FROM keys k JOIN wide s ON lower(k.tema) = lower(s.tema) GROUP BY ALL),
b AS (SELECT k.tema, institution, sum(num_questions)::BIGINT AS n, 2 AS source FROM keys k JOIN stats s ON lower(k.tema) = lower(s.tema) GROUP BY ALL),
c AS (SELECT k.tema, institution, sum(num_questions)::BIGINT AS n, 3 AS source FROM keys k JOIN stats s ON list_has_all({TOKENS("concat_ws(' ', s.tema, s.subtema)")}, list_distinct({TOKENS("k.tema")})) GROUP BY ALL),
every AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT tema, institution, n AS num_questions, CAST(source AS INTEGER) AS source FROM every QUALIFY source = min(source) OVER (PARTITION BY tema)"""
)
def counts_fallback_cascade(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    keys = part.select("p_brand").union(part.select("p_name")).select(F.col("p_brand").alias("tema"), F.lit(None).cast("string").alias("subtema"))
    own = staged(analog.stats(spark, d).select("id", "institution", "category", "tema", "subtema", "num_questions"))
    wide = own.filter("category <> 'SMALL' and tema <> 'Brand#7'")  # a table that knows less than the other
    return lookups.institution_counts(keys, wide, own).select("tema", "institution", "num_questions", "source")


# --- search: the benchmark's items are the queries, all documents the corpus

_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9)"
_NEAR = lambda k: f"near AS (SELECT q.vec_id AS query_id, c.vec_id AS id, {_COS} AS similarity FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings c QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, c.vec_id) <= {k})"
_NEAR_DOCS = lambda k: _NEAR(k).replace("CROSS JOIN embeddings c", "CROSS JOIN (SELECT e.* FROM embeddings e JOIN documents ON doc_id = vec_id) c")
# cover density: of each entry of a query's words the last occurrences of all words up to there; where the earliest of them moves on, a cover ends
_DENSITY_OF = lambda asked, toks=f"SELECT doc_id, {TOKENS('text')} AS dt FROM documents": f"""asked AS ({asked}),
toks AS ({toks}),
found AS (SELECT item_id, doc_id, qt, dt FROM asked JOIN toks ON list_has_all(dt, qt)),
entries AS (SELECT item_id, doc_id, pos, dt[pos] AS tok, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY pos) AS nth, qt FROM (SELECT *, unnest(generate_series(1, len(dt))) AS pos FROM found) WHERE list_contains(qt, dt[pos])),
grid AS (SELECT item_id, doc_id, pos, nth, term, max(CASE WHEN tok = term THEN nth END) OVER (PARTITION BY item_id, doc_id, term ORDER BY pos) AS last FROM (SELECT *, unnest(qt) AS term FROM entries)),
ends AS (SELECT item_id, doc_id, pos, nth, CASE WHEN count(last) = count(*) THEN min(last) END AS begin FROM grid GROUP BY ALL),
covers AS (SELECT *, lag(begin) OVER (PARTITION BY item_id, doc_id ORDER BY pos) AS before FROM ends),
ranked AS (SELECT c.item_id, c.doc_id, sum(0.1::DOUBLE / (1 + (c.pos - b.pos) - (c.nth - b.nth))) AS score FROM covers c JOIN entries b ON b.item_id = c.item_id AND b.doc_id = c.doc_id AND b.nth = c.begin WHERE c.begin IS NOT NULL AND (c.before IS NULL OR c.begin > c.before) GROUP BY ALL)"""  # noqa: E731
_DENSITY = _DENSITY_OF(f"SELECT item_id, list_distinct({TOKENS('text')}) AS qt FROM benchmark WHERE len({TOKENS('text')}) > 0")
_PAIRS = _DENSITY_OF(f"SELECT item_id, list_distinct({TOKENS('item_id')}) AS qt FROM (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS item_id FROM (SELECT w, unnest(generate_series(1, len(w) - 1)) AS i FROM (SELECT {TOKENS('text')} AS w FROM benchmark)))")
_WORDS = lambda k: f"{_DENSITY}, words AS (SELECT item_id AS query_id, doc_id AS id, score AS fts_score FROM ranked QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {k})"
_HYBRID = "hybrid AS (SELECT query_id, id, coalesce(similarity, 0) AS similarity, coalesce(fts_score, 0) AS fts_score, 0.7::DOUBLE * coalesce(similarity, 0) + 0.3::DOUBLE * coalesce(fts_score, 0) AS hybrid_score FROM near FULL OUTER JOIN words USING (query_id, id))"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """All items with all their words."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")).join(vectors, "query_id", "left")


@query(f"WITH {_NEAR(15)} SELECT query_id, id, round(similarity, 6) AS similarity FROM near")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    corpus = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vector_search(corpus, _asked(spark, d), 15).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


def _every_20th(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 20."""
    corpus = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return corpus, corpus.filter("id % 20 = 0").withColumnRenamed("id", "query_id")


@query()
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest by the inverted-file index."""
    corpus, asked = _every_20th(spark, d)
    return vector_index.index_search(vector_index.build(corpus), asked, 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query()
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the exact search's answers the index finds."""
    corpus, asked = _every_20th(spark, d)
    index = vector_index.build(corpus)
    return vector_index.recall_of(vector_index.index_search(index, asked, 10), vector_search(corpus, asked, 10)).withColumn("probes", F.lit(index.probes))


@query(f"WITH {_DENSITY} SELECT item_id AS query_id, doc_id AS id, round(score, 6) AS fts_score FROM ranked")
def fts_rank(spark: SparkSession, d: str) -> DataFrame:
    corpus = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return fulltext_search(corpus, _asked(spark, d)).select("query_id", "id", F.round("fts_score", 6).alias("fts_score"))


@query(f"WITH {_PAIRS} SELECT item_id AS query_id, doc_id AS id, round(score, 6) AS fts_score FROM ranked")
def fts_rank_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All neighbouring words of all items, as queries of two words with many covers."""
    words = simple(F.col("text"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    asked = table(spark, d, "benchmark").select(words.alias("w")).filter("size(w) > 1").select(F.explode(pairs).alias("query_id")).distinct().withColumn("query_text", F.col("query_id"))
    corpus = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return fulltext_search(corpus, asked).select("query_id", "id", F.round("fts_score", 6).alias("fts_score"))


@query(f"SELECT item_id AS query_id, doc_id AS id FROM (SELECT item_id, list_distinct({TOKENS('text')}) AS qt FROM benchmark) JOIN (SELECT doc_id, list_distinct({TOKENS('text')}) AS dt FROM documents) ON list_has_all(dt, qt)")
def fts_containment(spark: SparkSession, d: str) -> DataFrame:
    corpus = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return fulltext_search(corpus, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text")), rank=False)


def _hybrid(spark: SparkSession, d: str, k: int) -> DataFrame:
    docs = analog.questions(spark, d).select("id", F.col("raw_text").alias("text"), "embedding")
    return search.hybrid_search(docs, _asked(spark, d), k)


@query(f"WITH {_NEAR_DOCS(15)}, {_WORDS(15)}, {_HYBRID} SELECT query_id, id, round(similarity, 6) AS similarity, round(fts_score, 6) AS fts_score, round(hybrid_score, 6) AS hybrid_score FROM hybrid QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, id) <= 5")
def hybrid_full_outer(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, 5).select("query_id", "id", *[F.round(c, 6).alias(c) for c in ("similarity", "fts_score", "hybrid_score")])


@query(f"WITH {_NEAR_DOCS(30)}, {_WORDS(30)}, {_HYBRID}, k AS (SELECT * FROM hybrid QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, id) <= 10) SELECT query_id, id, round(hybrid_score, 6) AS hybrid_score FROM k WHERE hybrid_score >= 0.5")
def hybrid_threshold(spark: SparkSession, d: str) -> DataFrame:
    docs = analog.questions(spark, d).select("id", F.col("raw_text").alias("text"), "embedding")
    return search.retrieve(docs, _asked(spark, d)).select("query_id", "id", F.round("hybrid_score", 6).alias("hybrid_score"))


@query()
def portuguese_fts(spark: SparkSession, d: str) -> DataFrame:
    corpus = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return fulltext_search(corpus, _asked(spark, d), "portuguese").select("query_id", "id", F.round("fts_score", 6).alias("fts_score"))


# --- resolution


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """The sheet's rows with the part's own brand as the retrieved candidate, if any."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("row_idx"), F.when(F.col("p_partkey") % 9 == 0, F.lower("p_brand")).alias("candidate_tema"), F.when(F.col("p_partkey") % 9 == 0, F.col("p_name")).alias("candidate_subtema"))
    return reconcile.prepare(analog.sheet(spark, d)).join(part, "row_idx")


_ROWS = "r AS (SELECT p.*, CASE WHEN row_idx % 9 = 0 THEN lower(p_brand) END AS candidate_tema, CASE WHEN row_idx % 9 = 0 THEN p_name END AS candidate_subtema FROM prepared p JOIN part ON p_partkey = row_idx)"
_EXACT = "known AS (SELECT DISTINCT lower(tema) AS t FROM stats), e AS (SELECT row_idx, CASE WHEN lower(candidate_tema) IN (SELECT t FROM known) THEN candidate_tema WHEN lower(norm_tema) IN (SELECT t FROM known) THEN norm_tema WHEN lower(tema_raw) IN (SELECT t FROM known) THEN tema_raw END AS tema FROM r)"


@query(f"WITH {STATS}, {SHEET}, {PREPARED}, {_ROWS}, {_EXACT} SELECT row_idx, tema, 'exato' AS method, 1.0::DOUBLE AS score FROM e WHERE tema IS NOT NULL")
def resolve_tema_exact(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_exact(_rows(spark, d), analog.stats(spark, d))


@query(
    f"""WITH {STATS}, {SHEET}, {PREPARED}, {_ROWS}, tries AS (SELECT tema_raw AS q FROM r UNION SELECT norm_tema FROM r UNION SELECT equivalencia FROM r), {_BEST}
SELECT row_idx, s.tema, 'FTS' AS method, CASE WHEN x.id IS NOT NULL THEN 0.7::DOUBLE WHEN y.id IS NOT NULL THEN 0.6::DOUBLE ELSE 0.49999999999999994::DOUBLE END AS score
FROM r LEFT JOIN best x ON x.q = tema_raw LEFT JOIN best y ON y.q = norm_tema LEFT JOIN best z ON z.q = equivalencia JOIN stats s ON s.id = coalesce(x.id, y.id, z.id)"""
)
def resolve_tema_text(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_text(_rows(spark, d), analog.stats(spark, d))


@query()
def resolve_tema_cascade(spark: SparkSession, d: str) -> DataFrame:
    own = analog.stats(spark, d, vectors=True)
    return resolve.resolve_tema(_rows(spark, d), own, analog.encoder(spark, d)).select("row_idx", "tema", "method", F.round("score", 6).alias("score"))


@query()
def resolve_subtema(spark: SparkSession, d: str) -> DataFrame:
    own = analog.stats(spark, d, vectors=True)
    rows = resolve.resolve_tema(_rows(spark, d), own, analog.encoder(spark, d))
    return resolve.resolve_subtema(rows, own, analog.encoder(spark, d)).select("row_idx", F.col("stat.id").alias("stat_id"), "method", F.round("score", 6).alias("score"))


@query()
def retry_low_score(spark: SparkSession, d: str) -> DataFrame:
    own = analog.stats(spark, d, vectors=True)
    rows = reconcile.prepare(analog.sheet(spark, d)).withColumn("old_score", F.lit(0.1))
    return resolve.retry(rows, own, analog.encoder(spark, d)).select("row_idx", F.col("stat.id").alias("stat_id"), F.round("score", 6).alias("score"), "via")


_VEC = lambda c: f"(('0x' || substr(md5(lower({c})), 1, 7))::BIGINT % (SELECT count(*) FROM embeddings))"


@query(
    f"""WITH {STATS}, q AS (SELECT DISTINCT p_name AS text FROM part),
topics AS (SELECT DISTINCT tema, subtema, concat_ws(' ', tema, subtema) AS txt FROM stats),
sims AS (SELECT q.text, t.tema, t.subtema, round(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS similarity FROM q JOIN embeddings a ON a.vec_id = {_VEC("q.text")} CROSS JOIN topics t JOIN embeddings c ON c.vec_id = {_VEC("t.txt")}),
near AS (SELECT s.text, st.id, similarity FROM sims s JOIN stats st ON st.tema = s.tema AND st.subtema IS NOT DISTINCT FROM s.subtema QUALIFY row_number() OVER (PARTITION BY s.text ORDER BY similarity DESC, st.id) <= 15),
{_DENSITY_OF(f"SELECT text AS item_id, list_distinct({TOKENS('text')}) AS qt FROM q", f"SELECT DISTINCT txt AS doc_id, {TOKENS('txt')} AS dt FROM topics")},
words AS (SELECT item_id AS text, st.id, score AS fts_score FROM ranked JOIN stats st ON concat_ws(' ', st.tema, st.subtema) = doc_id QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, st.id) <= 15),
h AS (SELECT text, id, 0.7::DOUBLE * coalesce(similarity, 0) + 0.3::DOUBLE * coalesce(fts_score, 0) AS hybrid_score FROM near FULL OUTER JOIN words USING (text, id))
SELECT text, id AS stat_id, round(hybrid_score, 6) AS hybrid_score, CAST(row_number() OVER (PARTITION BY text ORDER BY hybrid_score DESC, id) AS INTEGER) AS rank FROM h QUALIFY row_number() OVER (PARTITION BY text ORDER BY hybrid_score DESC, id) <= 5"""
)
def search_topics(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "part").select(F.col("p_name").alias("text"))
    return search.search_topics(texts, analog.stats(spark, d, vectors=True), analog.encoder(spark, d), 5).select("text", F.col("stat.id").alias("stat_id"), F.round("hybrid_score", 6).alias("hybrid_score"), "rank")


@query()
def reconcile_ranking(spark: SparkSession, d: str) -> DataFrame:
    done = reconcile.reconcile(analog.sheet(spark, d), analog.base(spark, d))
    return done.withColumn("questions_by_institution", F.to_json("questions_by_institution"))


@query()
def alternative_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = judge.weak_rows(_done(spark, d))
    return judge.alternative_candidates(rows, analog.base(spark, d)).select("row_idx", "rank", F.col("stat.id").alias("stat_id"))


def stub_judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A judge by rule: by the checksum of an item's first line it confirms, suggests the first candidate, rejects or says nothing."""
    for b in batches:
        replies = []
        for prompt in b.prompt:
            said = []
            for item in re.split(r"\n\n(?=\[\d+\] INPUT)", prompt):
                lines = item.split("\n")
                number, first = lines[0].split("] ", 1)
                rule = zlib.crc32(first.encode()) % 4
                listed = [x[4:] for x in lines if x.startswith("  - ")]
                if rule < 3:
                    said.append({"index": int(number[1:]), "is_equivalent": rule == 0, "confidence": 0.9, "suggested_match": listed[0] if rule == 1 and listed else None, "reasoning": "by rule"})
            replies.append(json.dumps({"results": said}))
        yield pd.DataFrame({"batch": b.batch, "reply": replies})


@query()
def judge_refine(spark: SparkSession, d: str) -> DataFrame:
    base = analog.base(spark, d)
    return judge.apply_judge(_done(spark, d), base, stub_judge).select("row_idx", "normalized_tema", "normalized_subtema", "match_method", F.round("match_score", 6).alias("match_score"), "match_label", "cor_hex")


# --- coverage


def _done(spark: SparkSession, d: str) -> DataFrame:
    """Reconciled rows as the sheet's own topics with scores by number: input of the steps behind, without the cascade."""
    rows = reconcile.prepare(analog.sheet(spark, d))
    score = (F.col("row_idx") % 97 / F.lit(96.0)).alias("match_score")
    return rows.select(
        "row_idx", scalar.display(F.col("tema_raw"), F.col("subtema_raw")).alias("input_tema"), F.col("equivalencia").alias("input_equivalencia"), F.col("norm_tema").alias("normalized_tema"), F.col("norm_subtema").alias("normalized_subtema"),
        F.create_map().cast("map<string,bigint>").alias("questions_by_institution"), F.lit(K.SEMANTIC).alias("match_method"), score, F.lit("").alias("match_label"), F.lit("#22C55E").alias("cor_hex"), F.lit("").alias("notes"),
    )


_DONE = "done AS (SELECT row_idx, concat_ws(' | ', tema_raw, subtema_raw) AS input_tema, norm_tema, norm_subtema, row_idx % 97 / 96.0::DOUBLE AS score FROM prepared)"
_BESTIN = "bestin AS (SELECT lower(norm_tema) AS tl, nullif(lower(norm_subtema), '') AS sl, arg_max(input_tema, (score, -row_idx)) AS input_tema, max(score) AS score FROM done GROUP BY ALL)"
_TOPICS = "topics AS (SELECT tema, subtema, sum(num_questions)::BIGINT AS num_questions, max(cor_hex) AS cor_hex FROM stats GROUP BY tema, subtema)"
_STATUS = "CASE WHEN {0} >= 0.5 THEN 'coberto' WHEN {0} >= 0.35 THEN 'parcial' ELSE 'não coberto' END"
_REVERSE = f"""joined AS (SELECT t.*, b.input_tema, b.score FROM topics t LEFT JOIN bestin b ON lower(t.tema) = tl AND nullif(lower(t.subtema), '') IS NOT DISTINCT FROM sl),
shown AS (SELECT concat_ws(' ', norm_tema, norm_subtema) AS txt, arg_min(input_tema, row_idx) AS shown, min(row_idx) AS ord FROM done GROUP BY ALL),
rest AS (SELECT *, concat_ws(' ', tema, subtema) AS txt FROM joined WHERE score IS NULL OR score < 0.35),
sims AS (SELECT rest.txt, shown, ord, round(list_cosine_similarity(a.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS sim FROM (SELECT DISTINCT txt FROM rest) rest JOIN embeddings a ON a.vec_id = {_VEC("rest.txt")} CROSS JOIN shown JOIN embeddings c ON c.vec_id = {_VEC("shown.txt")}),
bestsim AS (SELECT txt, arg_min(shown, (-sim, ord)) AS shown, max(sim) AS sim FROM sims GROUP BY txt),
reverse AS (SELECT tema, subtema, num_questions, cor_hex, input_tema AS matched_input, score FROM joined WHERE score >= 0.35
  UNION ALL SELECT tema, subtema, num_questions, cor_hex, CASE WHEN sim >= 0.35 THEN shown END, coalesce(sim, 0) FROM rest LEFT JOIN bestsim USING (txt))"""
_REV = f"WITH {STATS}, {SHEET}, {PREPARED}, {_DONE}, {_BESTIN}, {_TOPICS}, {_REVERSE}"


@query(f"WITH {STATS}, {SHEET}, {PREPARED}, {_DONE}, {_BESTIN} SELECT tl AS tema_lc, sl AS subtema_lc, input_tema, score AS match_score FROM bestin")
def best_inputs(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.best_inputs(_done(spark, d)).select("tema_lc", "subtema_lc", "best.input_tema", "best.match_score")


def _reverse(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.reverse_coverage(_done(spark, d), lookups.topic_rollup(analog.stats(spark, d)), analog.encoder(spark, d))


@query(f"{_REV} SELECT tema AS db_tema, subtema AS db_subtema, num_questions AS db_num_questions, cor_hex AS db_cor_hex, matched_input, round(score, 6) AS similarity_score, {_STATUS.format('score')} AS coverage_status FROM reverse")
def reverse_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _reverse(spark, d).select("db_tema", "db_subtema", "db_num_questions", "db_cor_hex", "matched_input", F.round("similarity_score", 6).alias("similarity_score"), "coverage_status")


@query(f"{_REV} SELECT {_STATUS.format('score')} AS coverage_status, count(*)::BIGINT AS topics FROM reverse GROUP BY 1")
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.coverage_summary(_reverse(spark, d))


# --- output

_NATIONS = tuple(f"NATION_{i}" for i in range(25))
_SHORT = {"NATION_7": "NATION_6", "nation_9": "NATION_8"}
_FOLD = "CASE institution WHEN 'NATION_7' THEN 'NATION_6' WHEN 'NATION_9' THEN 'NATION_8' ELSE institution END"


@query(f"WITH {STATS} SELECT tema, {_FOLD} AS institution, sum(num_questions)::BIGINT AS num_questions FROM stats WHERE subtema IS NULL GROUP BY 1, 2")
def alias_fold(spark: SparkSession, d: str) -> DataFrame:
    counts = analog.stats(spark, d).filter("subtema is null").select("tema", "institution", "num_questions")
    return export.fold_aliases(counts, _SHORT, _NATIONS)


@query(f"WITH {STATS} SELECT tema, " + ", ".join(f"coalesce(sum(num_questions) FILTER (WHERE {_FOLD} = '{n}'), 0)::BIGINT AS \"q_{n}\"" for n in _NATIONS) + " FROM stats WHERE subtema IS NULL GROUP BY tema")
def pivot_institutions(spark: SparkSession, d: str) -> DataFrame:
    counts = analog.stats(spark, d).filter("subtema is null").select("tema", "institution", "num_questions")
    return export.pivot_institutions(export.fold_aliases(counts, _SHORT, _NATIONS), "tema", _NATIONS)


@query(
    f"""WITH {SHEET}, {PREPARED}, done AS (SELECT row_idx, lower(tema_raw) AS a, coalesce(lower(subtema_raw), '') AS b, lower(norm_tema) AS c, coalesce(lower(norm_subtema), '') AS e, concat_ws(' | ', tema_raw, subtema_raw) AS shown FROM prepared),
sheetrows AS (SELECT min(p_partkey) AS position, lower(p_brand) AS t, lower(p_name) AS s FROM part GROUP BY p_brand, p_name),
idx AS (SELECT t, s, min(position) AS position FROM (SELECT * FROM sheetrows UNION ALL SELECT position, t, '' FROM sheetrows) GROUP BY t, s),
keyed AS (SELECT *, trim(CASE WHEN contains(shown, ' | ') THEN lower(substr(shown, 1, instr(shown, ' | ') - 1)) ELSE lower(shown) END) AS it, trim(CASE WHEN contains(shown, ' | ') THEN lower(substr(shown, instr(shown, ' | ') + 3)) ELSE '' END) AS isub FROM done)
SELECT row_idx, coalesce(k1.position, k2.position, k3.position, k4.position, 99999)::BIGINT AS position, CASE WHEN coalesce(k1.position, k2.position, k3.position, k4.position) IS NULL THEN '' ELSE printf('%02d', coalesce(k1.position, k2.position, k3.position, k4.position) % 40 + 1) END AS semana
FROM keyed LEFT JOIN idx k1 ON it = k1.t AND isub = k1.s LEFT JOIN idx k2 ON it = k2.t AND k2.s = '' LEFT JOIN idx k3 ON c = k3.t AND e = k3.s LEFT JOIN idx k4 ON c = k4.t AND k4.s = ''"""
)
def curriculum_order(spark: SparkSession, d: str) -> DataFrame:
    placed = export.curriculum_place(_done(spark, d), export.curriculum_index(analog.curriculum(spark, d)))
    return placed.orderBy("week", "position", F.desc("match_score"), "row_idx").select("row_idx", "position", scalar.week_text(F.col("week")).alias("semana"))


@query()
def ranking_table(spark: SparkSession, d: str) -> DataFrame:
    return export.ranking_table(_done(spark, d), export.curriculum_index(analog.curriculum(spark, d)), _NATIONS)


@query(f"WITH {STATS}, {SHEET}, {PREPARED} SELECT CAST(greatest(15, least(55, max(length(tema_raw)) + 4)) AS INTEGER) AS tema_raw, CAST(greatest(15, least(55, coalesce(max(length(subtema_raw)), 0) + 4)) AS INTEGER) AS subtema_raw FROM prepared")
def column_widths(spark: SparkSession, d: str) -> DataFrame:
    return export.column_widths(reconcile.prepare(analog.sheet(spark, d)).select("tema_raw", "subtema_raw"))


# --- ingest

_NEW = "category IN ('LARGE', 'SMALL')"


@query(
    f"""WITH {STATS}, old AS (SELECT * FROM stats WHERE category <> 'SMALL')
SELECT institution, category, tema, subtema, CASE WHEN {_NEW} THEN num_questions + 1 ELSE num_questions END AS num_questions, CASE WHEN {_NEW} THEN {COLOR_HEX("(num_questions + 1)")} ELSE cor_hex END AS cor_hex, CASE WHEN category <> 'SMALL' THEN 'old' ELSE 'new' END AS source_file FROM stats"""
)
def upsert_stats(spark: SparkSession, d: str) -> DataFrame:
    own = analog.stats(spark, d)
    old = own.filter("category <> 'SMALL'").withColumn("source_file", F.lit("old"))
    new = own.filter(_NEW).withColumn("num_questions", F.col("num_questions") + 1).withColumns({"c": scalar.color(F.col("num_questions")), "source_file": F.lit("new"), "ord": F.lit(0)}).withColumns({"cor": F.col("c.cor"), "cor_hex": F.col("c.cor_hex")}).drop("c")
    return ingest.upsert_stats(old, new).select("institution", "category", "tema", "subtema", "num_questions", "cor_hex", "source_file")


@query("SELECT sha256(text) AS content_hash, arg_min(source, doc_id) AS institution, arg_max(lang, doc_id) AS tema_normalized FROM documents GROUP BY 1")
def upsert_questions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("institution"), F.col("text").alias("raw_text"), F.col("lang").alias("tema_normalized"), F.lit(None).cast("string").alias("subtema_normalized"), F.col("doc_id").alias("ord"))
    none = spark.createDataFrame([], "institution string, raw_text string, tema_normalized string, subtema_normalized string, content_hash string")
    return ingest.upsert_questions(none, docs).select("content_hash", "institution", "tema_normalized")


@query("SELECT page_id, sha256(html) AS file_hash FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 3 = 0)")
def ingest_anti_join(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select("page_id", ingest.content_hash(F.col("html")).alias("file_hash"))
    return ingest.new_files(files, files.filter("page_id % 3 = 0")).select("page_id", "file_hash")


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return ingest.pending_embeddings(analog.questions(spark, d)).select("id")


# statistics pages made of order lines: a file for each order
_LINE = "CASE l_linenumber WHEN 1 THEN 'Ranking por área' WHEN 3 THEN 'Temas' WHEN 5 THEN 'Subtemas' ELSE CAST(l_linenumber AS VARCHAR) || 'º Item ' || CAST(l_partkey AS VARCHAR) || ' — ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',5% (' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' questões)' END"


def _stat_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.lit(0).alias("page"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("line_no"), F.expr(_LINE.replace("VARCHAR", "STRING")).alias("line"))


_HEAD = "CASE WHEN contains(lower(line), 'área') OR contains(lower(line), 'area') THEN 'area' WHEN contains(lower(line), 'subtema') THEN 'subtema' WHEN contains(lower(line), 'tema') THEN 'tema' END"
_LINES = f"lines AS (SELECT CAST(l_orderkey AS VARCHAR) AS file, l_linenumber * 10000000 + l_partkey AS line_no, {_LINE} AS line FROM lineitem), marked AS (SELECT *, {_HEAD} AS head FROM lines), filled AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no), 'area') AS section FROM marked)"


@query(f"WITH {_LINES} SELECT file, line_no, section FROM filled WHERE head IS NULL")
def section_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    return parse.sections(_stat_lines(spark, d)).select("file", "line_no", "section")


@query(
    f"""WITH {_LINES}, rows AS (SELECT file, line_no, section, CAST(regexp_extract(line, '^(\\d+)º', 1) AS INTEGER) AS ranking, regexp_extract(line, 'º (.+) — ', 1) AS name, CAST(replace(regexp_extract(line, '— ([0-9,]+)%', 1), ',', '.') AS DOUBLE) AS percentage, CAST(regexp_extract(line, '\\((\\d+) quest', 1) AS INTEGER) AS num_questions FROM filled WHERE head IS NULL),
carried AS (SELECT *, last_value(CASE WHEN section = 'area' THEN name END IGNORE NULLS) OVER w AS area, last_value(CASE WHEN section = 'tema' THEN name END IGNORE NULLS) OVER w AS own FROM rows WINDOW w AS (PARTITION BY file ORDER BY line_no))
SELECT file AS source_file, line_no, ranking, section AS category, CASE WHEN section = 'subtema' THEN coalesce(own, area, name) ELSE name END AS tema, CASE WHEN section = 'subtema' THEN name END AS subtema, percentage, num_questions, {COLOR_HEX("num_questions")} AS cor_hex FROM carried"""
)
def metric_line_parse(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_stats(_stat_lines(spark, d)).select("source_file", "line_no", "ranking", "category", "tema", "subtema", "percentage", "num_questions", "cor_hex")


_QLINE = "CASE WHEN turn = 0 THEN 'Tema: ' || role WHEN turn % 3 = 1 THEN CAST(turn AS VARCHAR) || '. ' || replace(text, chr(10), ' ') ELSE replace(text, chr(10), ' ') END"


@query(
    f"""WITH l AS (SELECT conv_id, turn, {_QLINE} AS line FROM conversations), g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\d+\\.') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS q FROM l WHERE NOT regexp_matches(line, '(?i)^(Tema|Subtema)[:\\s]+.+'))
SELECT CAST(conv_id AS VARCHAR) AS source_file, q AS number, string_agg(line, ' ' ORDER BY turn) AS raw_text FROM g WHERE q > 0 GROUP BY conv_id, q"""
)
def question_group_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.lit(0).alias("page"), F.col("turn").alias("line_no"), F.expr(_QLINE.replace("VARCHAR", "STRING")).alias("line"))
    return parse.parse_questions(lines).select("source_file", "number", "raw_text")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
