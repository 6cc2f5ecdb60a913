"""The topic domain on small tables: expectations of the scalar layer, lookups, search, resolution, coverage, parsers, upserts, sheets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbra import constants as K
from lumbra.functions import fulltext, scalar, stemmer, vectors
from lumbra.functions.vectors import vector_search
from lumbra.operators import export, ingest, lookups, parse, search
from lumbra.settings import Settings
from lumbra.sources import sheets, xlsx


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()[0]


@pytest.fixture(scope="module")
def stats(spark):
    rows = [(1, "FAMERP", 1, "tema", "Trauma", None, 9), (2, "FAMERP", 1, "subtema", "Trauma", "Abordagem inicial", 7), (3, "HCPA", 2, "tema", "Trauma", None, 3), (4, "FAMERP", 9, "tema", "Infecções congênitas", None, 7), (5, "USP SP", 4, "subtema", "Trauma", "Choque", 2)]
    return spark.createDataFrame(rows, "id long, institution string, ranking int, category string, tema string, subtema string, num_questions long").withColumns({"cor": scalar.color(F.col("num_questions"))["cor"], "cor_hex": scalar.color_hex(F.col("num_questions"))})


def test_scalars(spark):
    texts = ["TRAUMA", "classificação", "hello, world!", "  foo   bar  ", "a | b", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalar.normalize_text("t")).collect()]
    assert got == ["trauma", "classificacao", "hello world", "foo bar", "a | b", "", ""]
    rows = spark.createDataFrame([("PCR", None), ("Trauma | Abordagem inicial", None), ("Diabetes", "Tipo 2"), (None, "x"), ("Trauma", "nan"), ("Unknown Topic", "  ")], "t string, s string")
    got = [tuple(r[0]) for r in rows.select(scalar.split_topic(F.col("t"), F.col("s"))).collect()]
    assert got == [("parada cardiorrespiratória", None), ("Trauma", "Abordagem inicial"), ("diabetes mellitus", "Tipo 2"), ("", None), ("Trauma", None), ("Unknown Topic", None)]
    colors = [r[0] for r in spark.createDataFrame([(n,) for n in (9, 6, 5, 4, 3, 2, 1, 0, -5)], "n int").select(scalar.color(F.col("n"))["cor"]).collect()]
    assert colors == ["vermelho", "vermelho", "laranja", "laranja", "amarelo", "amarelo", "verde", "azul", "azul"]
    assert [r[0] for r in spark.createDataFrame([("1,5",), ("1.234,5",), ("x",)], "t string").select(scalar.decimal_comma(F.col("t"))).collect()] == [1.5, None, None]
    assert [r[0] for r in spark.createDataFrame([("7",), ("7.0",), ("x",), ("",), (None,)], "t string").select(scalar.week_number(F.col("t"))).collect()] == [7, 7, 999, None, None]
    assert [r[0] for r in spark.createDataFrame([(5,), (120,), (999,)], "n int").select(scalar.week_text(F.col("n"))).collect()] == ["05", "120", ""]
    assert [r[0] for r in spark.createDataFrame([("* [MATCH ATUAL] Choque (score=45%, metodo=FTS)",), ("- Trauma | X (8 questoes)",), ("Choque (exceto choque séptico)",)], "t string").select(scalar.clean_suggestion(F.col("t"))).collect()] == ["Choque", "Trauma | X", "Choque (exceto choque séptico)"]
    assert [r[0] for r in spark.createDataFrame([("alpha of beta gamma",), ("a b",)], "t string").select(scalar.suffix_chunks(F.col("t"))).collect()] == [["alpha beta gamma", "beta gamma", "gamma"], []]
    assert [r[0] for r in spark.createDataFrame([(0.125,), (0.7,)], "x double").select(scalar.percent_text("x")).collect()] == ["12%", "70%"]
    assert [r[0] for r in spark.createDataFrame([("parada cardiorrespiratorias",), ("asmaa",), ("zzz",)], "t string").select(scalar.fuzzy_synonym("t")).collect()] == [None, "asma", None]
    assert [r[0] for r in spark.createDataFrame([("pcr e ressuscitacao",), ("dpoc avancada",), ("nada",)], "t string").select(scalar.specialty(F.col("t"))).collect()] == ["cardiologia", "pneumologia", None]


def test_stemmer_and_rank():
    assert [stemmer.stem(w) for w in ("quilométricas", "boas", "nação", "infecções", "inicial", "traumas")] == ["quilométr", "boas", "naçã", "infecçõ", "inicial", "traum"]
    assert fulltext.cover_density([(1, "a"), (5, "a")], 1) == pytest.approx(0.2)
    assert fulltext.cover_density([(1, "a"), (2, "b")], 2) == pytest.approx(0.1)
    assert fulltext.cover_density([(1, "a"), (4, "b")], 2) == pytest.approx(0.1 / 3)
    assert fulltext.cover_density([(1, "a"), (2, "a"), (3, "b")], 2) == pytest.approx(0.1)


def test_lookups(spark, stats):
    keys = spark.createDataFrame([(1, "trauma", None), (2, "TRAUMA", "abordagem INICIAL"), (3, "x", None), (4, "Trauma", "x")], "k int, tema string, subtema string")
    assert {r.k: r.stat and r.stat.id for r in lookups.exact_stats(keys, stats).collect()} == {1: 1, 2: 2, 3: None, 4: None}
    assert lookups.subtemas_of(stats).collect()[0].subtemas == ["Abordagem inicial", "Choque"]
    best = {r.query_text: r.stat.id for r in lookups.best_stats(spark.createDataFrame([("trauma",), ("trauma | choque",), ("infecções",), ("inicial trauma",), ("nada",), ("",)], "query_text string"), stats).collect()}
    assert best == {"trauma": 1, "trauma | choque": 5, "infecções": 4, "inicial trauma": 2}
    counts = lookups.institution_counts(spark.createDataFrame([("trauma", None), ("congênitas", None), ("Trauma", "choque")], "tema string, subtema string"), stats.limit(0), stats)
    assert {(r.tema, r.institution): (r.num_questions, r.source) for r in counts.collect()} == {("trauma", "FAMERP"): (16, 2), ("trauma", "HCPA"): (3, 2), ("trauma", "USP SP"): (2, 2), ("congênitas", "FAMERP"): (7, 3), ("Trauma", "USP SP"): (2, 2)}
    rolled = {(r.tema, r.subtema): (r.num_questions, r.cor_hex) for r in lookups.topic_rollup(stats.limit(0), stats).collect()}
    assert rolled[("Trauma", None)] == (12, "#EF4444")


def test_hybrid_search(spark):
    docs = spark.createDataFrame([(1, "trauma inicial", [1.0, 0.0]), (2, "choque", [0.0, 1.0]), (3, "trauma trauma", None), (4, "nada", [0.0, 0.0])], "id long, text string, embedding array<float>")
    asked = spark.createDataFrame([(7, "trauma", [1.0, 0.0])], "query_id long, query_text string, embedding array<float>")
    got = {r.id: (r.similarity, r.fts_score, r.hybrid_score) for r in search.hybrid_search(docs, asked, 5).collect()}
    assert got[1] == (1.0, 0.1, pytest.approx(0.73)) and got[3] == (0.0, 0.2, pytest.approx(0.06)) and got[4][0] == 0
    assert [r.id for r in search.retrieve(docs, asked, 5).collect()] == [1]
    assert [r.id for r in search.hybrid_search(docs, asked, 1).collect()] == [1]


def test_vector_search_against_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<float>").repartition(5)
    got = vector_search(df, df.filter("id < 20").withColumnRenamed("id", "query_id"), 4).collect()
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    want = {(q, i) for q in range(20) for i in np.argsort(-(u @ u[q]), kind="stable")[:4].tolist()}
    assert {(r.query_id, r.id) for r in got} == want


def test_parsers(spark):
    lines = ["Ranking por área", "1º Cirurgia — 12,5% (7 questões)", "", "Temas", "2º Trauma - 3,0% (1 questões)", "Subtemas", "1ª Choque – 2,5% (4 questoes)", "3º Um — 1% (1 questão)"]
    df = spark.createDataFrame([("f", 0, i, x) for i, x in enumerate(lines)], "file string, page int, line_no int, line string")
    got = [(r.category, r.tema, r.subtema, r.percentage, r.num_questions, r.cor) for r in parse.parse_stats(df, "X").orderBy("line_no").collect()]
    assert got == [("area", "Cirurgia", None, 12.5, 7, "vermelho"), ("tema", "Trauma", None, 3.0, 1, "verde"), ("subtema", "Trauma", "Choque", 2.5, 4, "laranja")]
    page = ["Tema: PCR", "1. Primeira", "continua", "2. Segunda", "Subtema: Adulto"]
    df = spark.createDataFrame([("f", 0, i, x) for i, x in enumerate(page)], "file string, page int, line_no int, line string")
    got = [(r.raw_text, r.tema_normalized, r.subtema_normalized) for r in parse.parse_questions(df).orderBy("number").collect()]
    assert got == [("1. Primeira continua", "parada cardiorrespiratória", "Adulto"), ("2. Segunda", "parada cardiorrespiratória", "Adulto")]


def test_upserts(spark, stats):
    table = stats.withColumns({"percentage": F.lit(1.0), "source_file": F.lit("old")})
    batch = table.filter("id in (1, 5)").withColumns({"num_questions": F.lit(50).cast("long"), "source_file": F.lit("new"), "ord": F.col("id")})
    out = {r.id: (r.num_questions, r.source_file) for r in ingest.upsert_stats(table, batch).collect()}
    assert len(out) == 5 and out[1] == (50, "old") and out[5] == (50, "old") and out[3] == (3, "old")
    ids = ingest.with_ids(spark.createDataFrame([(None, f"k{i:02d}") for i in range(20)], "id long, k string"), "k", 100).orderBy("k").collect()
    assert [r.id for r in ids] == list(range(101, 121))


def test_sheets(spark, tmp_path):
    path = xlsx.write_xlsx(tmp_path / "in.xlsx", {"S": (["Tema", "Sub-Tema", "Other Col"], [("Trauma", "Abordagem & inicial", 1), (None, "x", 2), ("", None, 3.5)])})
    df = sheets.read_sheet(spark, str(path))
    rows = df.orderBy("row_idx").collect()
    assert [(r.tema, r.subtema, r.other_col, r.equivalencia) for r in rows] == [("Trauma", "Abordagem & inicial", "1", None), ("", None, "3.5", None)]
    with pytest.raises(ValueError):
        sheets.shape_sheet(spark.createDataFrame([(1,)], "foo int"))
    with pytest.raises(ValueError):
        sheets.shape_sheet(spark.createDataFrame([("a", "b")], "tema string, theme string"))


def test_export(spark):
    counts = spark.createDataFrame([(1, "amp", 2), (1, "AMP-PR", 3), (1, "Nowhere", 4), (2, "Usp SP", 5)], "row_idx long, institution string, num_questions long")
    wide = {r.row_idx: r for r in export.pivot_institutions(export.fold_aliases(counts), "row_idx").collect()}
    assert len(wide[1]) == 28 and wide[1]["q_AMP-PR"] == 5 and wide[2]["q_USP SP"] == 5 and wide[2]["q_UERJ"] == 0
    index = export.curriculum_index(spark.createDataFrame([(0, "3", "Trauma", "Choque"), (1, "x", "Trauma", None), (2, None, "Asma", None)], "position long, semana string, tema string, subtema string"))
    rows = spark.createDataFrame([(1, "trauma | choque", "T", None), (2, "Trauma | other", "T", None), (3, "z", "TRAUMA", "q"), (4, "asma", "asma", None)], "row_idx long, input_tema string, normalized_tema string, normalized_subtema string")
    assert {r.row_idx: (r.week, r.position) for r in export.curriculum_place(rows, index).collect()} == {1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (999, 99999)}


def test_settings_and_labels(spark):
    s = Settings.read({"HYBRID_ALPHA": "0.6", "EMBEDDINGS_DIM": "384"})
    assert s.hybrid_alpha == 0.6 and s.model_id.endswith(":384")
    rows = spark.createDataFrame([("exato", 1.0), ("FTS", 0.7), ("FTS", 0.5), ("semântico", 0.5), ("LLM", 0.9), ("sem match", 0.0)], "m string, s double")
    got = [r[0] for r in rows.select(scalar.match_label(F.col("m"), F.col("s"))).collect()]
    assert got == ["🔴 Quente (exato)", "🟠 Morno (FTS)", "🟡 Frio (FTS)", "🔵 Muito frio (semântico)", "🔴 Quente (LLM)", "⚪ Sem match"] and len(K.INSTITUTIONS) == 27


def test_search_gives_plain_hits_and_moves_only_them(spark, monkeypatch):
    """Blocks of queries, documents with many covers, ids that are structs; no document or candidate is shuffled."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, weights=range(1, 13), k=rng.randint(0, 120)))) for i in range(150)] + [(900, None)]
    asked = [(k, " ".join(rng.sample(words, 1 + k % 5))) for k in range(60)] + [(99, "w1 unknown"), (98, None), (None, "w1")]
    want = {}
    for k, q in asked:
        terms = set((q or "").split())
        for i, t in docs:
            own = [(p, w) for p, w in enumerate((t or "").split()) if w in terms]
            if k is not None and terms and {w for _, w in own} == terms:
                want[k, i] = round(fulltext.cover_density(own, len(terms)), 9)
    corpus = spark.createDataFrame(docs, "i long, text string").withColumn("id", F.struct("i"))
    queries = spark.createDataFrame(asked, "query_id long, query_text string")
    for block, entries in ((1 << 20, 1 << 17), (40, 50)):
        monkeypatch.setattr(fulltext, "QUERY_LEXEMES", block)
        monkeypatch.setattr(fulltext, "ENTRIES", entries)
        hits = fulltext.fulltext_search(corpus, queries)
        assert {(r.query_id, r.id.i): round(r.fts_score, 9) for r in hits.collect()} == want and want
        assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
        assert {(r.query_id, r.id.i) for r in fulltext.fulltext_search(corpus, queries, rank=False).collect()} == set(want)


def test_nearest_is_exact_with_ties_and_bounded(monkeypatch):
    """Every row ties; what is held stays bounded, and the lowest ids win whatever the order and the batches."""
    monkeypatch.setattr(vectors, "CELLS", 64)
    for ids in (np.arange(500)[::-1], np.array([f"{i:03}" for i in range(500)], object)):
        best, held = vectors.Nearest(3, 20), 0
        for at in range(0, 500, 10):
            best.add(np.ones((10, 1)), np.ones((1, 20)), ids[at : at + 10])
            held = max(held, best.rows)
        q, i, s = best.best()
        assert held <= 2 * 3 * 20 + 64 and q.tolist() == np.repeat(np.arange(20), 3).tolist() and i.tolist() == sorted(ids)[:3] * 20
    rng = np.random.default_rng(1)
    rows, asked = vectors.unit(rng.normal(size=(300, 4))), vectors.unit(rng.normal(size=(17, 4)))
    best = vectors.Nearest(5, 17)
    for at in range(0, 300, 7):
        best.add(rows[at : at + 7], asked.T, np.arange(300)[at : at + 7])
    assert best.best()[1].reshape(17, 5).tolist() == np.argsort(-np.round(asked @ rows.T, 9), axis=1, kind="stable")[:, :5].tolist()


def test_long_texts_are_normalised_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "256m")
    texts = spark.range(3).select(F.when(F.col("id") > 0, F.repeat(F.lit("Pâncreas, "), 10)).alias("t"))
    assert {r[0] for r in texts.select(scalar.normalize_text(F.col("t"))).collect()} == {"", " ".join(["pancreas"] * 10)}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20


def test_counts_read_the_statistics_once(spark, stats):
    """No plan of the counts reaches the table itself: a topic and institution are counted before."""
    keys = spark.createDataFrame([("trauma", None), ("Trauma", "choque"), ("inicial", None)], "tema string, subtema string")
    slow = stats.withColumn("num_questions", F.col("num_questions") + F.lit(0) * F.rand(7).cast("long"))
    found = lookups.institution_counts(keys, slow, slow)
    assert "rand(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.tema, r.source) for r in found.collect()} == {("trauma", 1), ("Trauma", 1), ("inicial", 3)}
