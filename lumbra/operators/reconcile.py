"""Reconciliation of an input sheet with the topic statistics, and its reverse.

A row of the result: row_idx, input_tema, input_equivalencia, normalized_tema, normalized_subtema, questions_by_institution (map),
match_method, match_score, match_label, cor_hex, notes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scalar import clean, color_hex, display, match_label, percent_text, split_topic, topic_text
from ..functions.vectors import vector_search
from ..settings import Settings
from .lookups import exact_stats, institution_counts, subtemas_of
from .resolve import resolve_subtema, resolve_tema, retry
from .search import Encoder, retrieve
from .stage import staged

RESULT = ("row_idx", "input_tema", "input_equivalencia", "normalized_tema", "normalized_subtema", "questions_by_institution", "match_method", "match_score", "match_label", "cor_hex", "notes")


@dataclass(frozen=True)
class Base:
    """What rows are reconciled with: questions and stats have embeddings, stats_all has not. Weights, threshold and number of retrieved questions are the settings'."""

    questions: DataFrame
    stats: DataFrame
    stats_all: DataFrame
    encoder: Encoder | None
    analyzer: str = "simple"
    settings: Settings = Settings()


def prepare(sheet: DataFrame) -> DataFrame:
    """Cleaned input columns, the expanded topic and the search text. A subtema inside the tema's cell enriches the search only."""
    rows = sheet.select("row_idx", F.coalesce(clean(F.col("tema")), F.lit("")).alias("tema_raw"), clean(F.col("subtema")).alias("subtema_raw"), clean(F.col("equivalencia")).alias("equivalencia"))
    rows = rows.withColumn("n", split_topic(F.col("tema_raw"), F.col("subtema_raw")))
    return rows.select("*", F.col("n.tema").alias("norm_tema"), F.col("n.subtema").alias("norm_subtema"), topic_text(F.col("n.tema"), F.col("n.subtema"), F.col("equivalencia")).alias("query")).drop("n")


def with_candidates(rows: DataFrame, base: Base) -> DataFrame:
    """``rows`` with the best retrieved question's tema, subtema and similarity, and the number of retrieved questions."""
    texts = rows.select(F.col("query").alias("text")).filter("text <> ''").distinct()
    asked = staged(texts.join(base.encoder(texts), "text").select(F.col("text").alias("query_id"), F.col("text").alias("query_text"), "embedding"))
    stored = [c for c in ("tokens",) if c in base.questions.columns]
    corpus = base.questions.select("id", F.concat_ws(" ", "tema_normalized", "subtema_normalized", "raw_text").alias("text"), "embedding", *stored)
    own = base.settings
    hits = retrieve(corpus, asked, own.retriever_top_k, own.similarity_threshold, alpha=own.hybrid_alpha, beta=own.hybrid_beta, analyzer=base.analyzer, tokens_col=stored[0] if stored else None)
    named = hits.join(base.questions.select("id", "tema_normalized", "subtema_normalized"), "id")
    best = named.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.min_by(F.struct(F.col("tema_normalized").alias("t"), F.col("subtema_normalized").alias("s"), F.col("similarity").alias("sim")), "rank").alias("c"))
    out = rows.join(best, F.col("query") == F.col("query_id"), "left")
    return out.select(*rows.columns, F.col("c.t").alias("candidate_tema"), F.col("c.s").alias("candidate_subtema"), F.col("c.sim").alias("candidate_similarity"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def _counts(rows: DataFrame, tema: str, subtema: str, base: Base) -> DataFrame:
    """``rows`` with qbi, the map of institutions to counts."""
    keys = rows.select(F.col(tema).alias("tema"), F.col(subtema).alias("subtema"))
    found = institution_counts(keys, base.stats_all, base.stats, base.analyzer)
    maps = found.groupBy(F.col("tema").alias("__t"), F.col("subtema").alias("__s")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("institution", F.col("num_questions").cast("long"))))).alias("qbi"))
    out = rows.join(maps, F.col(tema).eqNullSafe(F.col("__t")) & F.col(subtema).eqNullSafe(F.col("__s")), "left").drop("__t", "__s")
    return out.withColumn("qbi", F.coalesce("qbi", F.create_map().cast("map<string,bigint>")))


def _total(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, b: a + b)


def reconcile_rows(sheet: DataFrame, base: Base) -> DataFrame:
    """The first pass; one row for each input row."""
    rows = staged(with_candidates(staged(prepare(sheet)), base))
    rows = resolve_tema(rows, base.stats, base.encoder, base.analyzer)
    below = resolve_subtema(rows, base.stats, base.encoder, base.analyzer).select("row_idx", F.col("stat").alias("sub"), F.col("method").alias("sub_method"), F.col("score").alias("sub_score"))
    level = exact_stats(rows.filter("subtema_raw is null and tema is not null").select("row_idx", "tema", F.lit(None).cast("string").alias("subtema")), base.stats).select("row_idx", F.col("stat").alias("own"))
    rows = rows.join(below, "row_idx", "left").join(level, "row_idx", "left")
    has = F.col("subtema_raw").isNotNull()
    found = F.col("tema").isNotNull()
    rows = rows.withColumns({
        "stat": F.when(has, F.col("sub")).otherwise(F.col("own")),
        # a subtema that isn't found leaves no match, whatever its tema has
        "match_method": F.when(has & found, F.coalesce("sub_method", F.lit(K.NONE))).otherwise(F.col("method")),
        "match_score": F.when(has & found, F.coalesce("sub_score", F.lit(0.0))).otherwise(F.col("score")),
        "final_tema": F.coalesce("tema", "norm_tema"),
    })
    rows = rows.withColumns({"count_tema": F.col("tema"), "count_subtema": F.col("stat.subtema")})
    rows = staged(_counts(staged(rows), "count_tema", "count_subtema", base))
    names = subtemas_of(base.stats)
    rows = rows.join(names, F.lower("final_tema") == F.col("tema_lc"), "left")
    stat = F.col("stat").isNotNull()
    final_subtema = F.coalesce(F.col("stat.subtema"), F.col("norm_subtema"))
    equivalent = (
        F.when(stat & has, display(F.col("final_tema"), F.col("stat.subtema")))
        .when(stat | found, F.col("final_tema"))
        .otherwise(F.coalesce("equivalencia", F.when(has, display(F.col("final_tema"), final_subtema)).otherwise(F.col("final_tema"))))
    )
    notes = F.concat_ws(
        "; ",
        F.when(stat & (F.size("subtemas") > 0), F.concat(F.lit("Subtemas: "), F.array_join("subtemas", " | "))),
        F.when(stat, F.concat(F.lit("Fonte: "), F.col("stat.institution"), F.lit(" (ranking #"), F.coalesce(F.col("stat.ranking").cast("string"), F.lit("?")), F.lit(")"))),
        F.when(~stat & ~found, F.lit("Nenhum match encontrado na base de dados")).when(~stat, F.concat(F.lit("Tema resolvido: "), F.col("tema"), F.lit(" (sem estatísticas de subtema)"))),
        F.when((F.col("candidates") == 0) & ~stat, F.lit("Nenhum candidato encontrado na busca")).when(F.col("candidates") > 0, F.concat(F.lit("Best match: "), F.coalesce("candidate_tema", F.lit("?")), F.format_string(" (sim=%.2f)", F.bround("candidate_similarity", 2)))),
    )
    total = F.when(F.size("qbi") > 0, _total(F.col("qbi"))).otherwise(F.col("candidates"))
    return rows.select(
        "row_idx", display(F.col("tema_raw"), F.col("subtema_raw")).alias("input_tema"), equivalent.alias("input_equivalencia"), F.col("final_tema").alias("normalized_tema"), F.when(has, final_subtema).alias("normalized_subtema"),
        F.col("qbi").alias("questions_by_institution"), "match_method", "match_score", match_label(F.col("match_method"), F.col("match_score")).alias("match_label"), color_hex(total).alias("cor_hex"), notes.alias("notes"),
    )


def retry_rows(done: DataFrame, sheet: DataFrame, base: Base) -> DataFrame:
    """``done`` with rows below a good score replaced where a second attempt is strictly better."""
    done = staged(done)
    weak = done.filter(F.col("match_score") < K.GOOD_SCORE).select("row_idx", F.col("match_score").alias("old_score"), F.col("normalized_subtema").alias("old_subtema"))
    again = retry(prepare(sheet).join(weak, "row_idx"), base.stats, base.encoder, base.analyzer)
    again = _counts(staged(again).withColumns({"t": F.col("stat.tema"), "s": F.col("stat.subtema")}), "t", "s", base)
    better = again.join(prepare(sheet).select("row_idx", "tema_raw", "subtema_raw", "equivalencia"), "row_idx").join(weak.select("row_idx", "old_subtema"), "row_idx")
    new = better.select(
        "row_idx", display(F.col("tema_raw"), F.col("subtema_raw")).alias("input_tema"), F.col("equivalencia").alias("input_equivalencia"), F.col("t").alias("normalized_tema"), F.coalesce("s", "old_subtema").alias("normalized_subtema"),
        F.col("qbi").alias("questions_by_institution"), F.lit(K.SEMANTIC).alias("match_method"), F.col("score").alias("match_score"), match_label(F.lit(K.SEMANTIC), F.col("score")).alias("match_label"), color_hex(_total(F.col("qbi"))).alias("cor_hex"),
        F.concat(F.lit("Retry via '"), F.substring("via", 1, 50), F.lit("'; Fonte: "), F.col("stat.institution")).alias("notes"),
    )
    return done.join(new.select("row_idx"), "row_idx", "left_anti").unionByName(new)


def reconcile(sheet: DataFrame, base: Base) -> DataFrame:
    """All rows, retried, best score first."""
    done = retry_rows(reconcile_rows(sheet, base), sheet, base)
    return done.select(*RESULT).orderBy(F.desc("match_score"), "row_idx")


def best_inputs(done: DataFrame) -> DataFrame:
    """(tema_lc, subtema_lc, best): of the rows of one topic the one of highest score, first among equals."""
    return done.groupBy(F.lower("normalized_tema").alias("tema_lc"), F.nullif(F.lower("normalized_subtema"), F.lit("")).alias("subtema_lc")).agg(
        F.max_by(F.struct("input_tema", "match_score"), F.struct("match_score", (-F.col("row_idx")).alias("o"))).alias("best")
    )


def reverse_coverage(done: DataFrame, topics: DataFrame, encoder: Encoder, covered: float = K.COVERED, partial: float = K.PARTIAL) -> DataFrame:
    """A row for each topic of the roll-up: by which input it is covered, exactly or by the most similar text. Without inputs there are no rows."""
    done = staged(done)
    if done.isEmpty():
        topics = topics.limit(0)
    status = lambda s: F.when(s >= covered, "coberto").when(s >= partial, "parcial").otherwise("não coberto")
    best = best_inputs(done)
    on = (F.lower("tema") == F.col("tema_lc")) & F.nullif(F.lower("subtema"), F.lit("")).eqNullSafe(F.col("subtema_lc"))
    both = staged(topics.join(best, on, "left").drop("tema_lc", "subtema_lc"))
    good = F.coalesce(F.col("best.match_score") >= partial, F.lit(False))
    db = (F.col("tema").alias("db_tema"), F.col("subtema").alias("db_subtema"), F.col("num_questions").alias("db_num_questions"), F.col("cor_hex").alias("db_cor_hex"))
    score = F.col("best.match_score")
    exact = both.filter(good).select(*db, F.col("best.input_tema").alias("matched_input"), score.alias("similarity_score"), status(score).alias("coverage_status"), F.concat(F.lit("Match: "), F.col("best.input_tema"), F.lit(" (score="), percent_text(score), F.lit(")")).alias("notes"))
    rest = both.filter(~good).withColumn("text", F.concat_ws(" ", "tema", "subtema"))
    # the texts of inputs, each shown as its first row; ties of similarity go to the first text
    shown = done.select("row_idx", "input_tema", F.concat_ws(" ", "normalized_tema", "normalized_subtema").alias("text")).groupBy("text").agg(F.min_by("input_tema", "row_idx").alias("shown"), F.min("row_idx").alias("ord"))
    texts = rest.select("text").union(shown.select("text")).distinct()
    vectors = encoder(texts)
    asked = rest.select("text").distinct().join(vectors, "text").select(F.col("text").alias("query_id"), "embedding")
    near = vector_search(shown.join(vectors, "text").select(F.col("ord").alias("id"), "embedding"), asked, 1).join(shown.select(F.col("ord").alias("id"), "shown"), "id")
    sim = F.coalesce("similarity", F.lit(0.0))
    found = rest.join(near.select("query_id", "similarity", "shown"), F.col("text") == F.col("query_id"), "left")
    likeness = F.concat(F.lit("Similaridade: "), F.format_string("%.2f%%", F.bround(sim * 100, 2)))
    semantic = found.select(*db, F.when(sim >= partial, F.col("shown")).alias("matched_input"), sim.alias("similarity_score"), status(sim).alias("coverage_status"), F.concat_ws("; ", F.when(sim >= partial, F.concat(F.lit("Melhor match (semântico): "), F.col("shown"))), likeness).alias("notes"))
    return exact.unionByName(semantic).orderBy(F.desc("similarity_score"), F.desc("db_num_questions"), "db_tema", "db_subtema")


def coverage_summary(reverse: DataFrame) -> DataFrame:
    return reverse.groupBy("coverage_status").agg(F.count(F.lit(1)).alias("topics"))


