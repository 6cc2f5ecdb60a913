"""The store, and the commands from text files to a workbook."""

from __future__ import annotations

import hashlib
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lumbra import cli
from lumbra.functions.fulltext import fulltext_search
from lumbra.operators import export, ingest
from lumbra.settings import Settings
from lumbra.sources import sheets, xlsx
from lumbra.sources.store import KEPT, Store

#: Workers can't import a test module, so its functions are sent whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATS = "Ranking por área\n1º Cirurgia — 50,0% (8 questões)\nTemas\n1º Trauma — 30,0% (7 questões)\nSubtemas\n1º Choque — 12,5% (3 questões)\n"
QUESTIONS = "Tema: Trauma\nSubtema: Choque\n1. Paciente com choque\nhemorrágico.\n2. Outra pergunta"


def encoder(texts):
    """Eight numbers from the words' hashes: texts with common words are alike."""
    out = []
    for t in texts:
        v = [0.01] * 8
        for w in t.lower().split():
            v[hashlib.md5(w.encode()).digest()[0] % 8] += 1.0
        out.append(v)
    return out


def judge(batches):
    for b in batches:
        yield b.assign(reply=json.dumps({"results": [{"index": i, "is_equivalent": True, "confidence": 0.9, "suggested_match": None, "reasoning": "ok"} for i in range(5)]}))[["batch", "reply"]]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "stats").mkdir()
    (d / "questions").mkdir()
    (d / "stats" / "a.txt").write_text(STATS)
    (d / "stats" / "copy.txt").write_text(STATS)
    (d / "questions" / "q.txt").write_text(QUESTIONS)
    xlsx.write_xlsx(d / "in.xlsx", {"S": (["Tema", "Sub-Tema"], [("Trauma", "Choque"), ("trauma", None), ("Nada disso", None)])})
    return d


def run(spark, *given):
    return cli.main([str(x) for x in given], spark)


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path), "simple")
    assert len(store.init()) == 5 and store.init() == []
    for i in range(KEPT + 2):
        store.write("metadata", ingest.set_metadata(store.read("metadata"), "embedding_model", str(i)))
    assert [tuple(r) for r in store.read("metadata").collect()] == [("embedding_model", str(KEPT + 1))]
    assert len(list((tmp_path / "metadata").iterdir())) == KEPT
    (tmp_path / "metadata" / "99").mkdir()  # a writer that broke off
    assert store.read("metadata").count() == 1
    assert ingest.model_changed(store.read("metadata"), "x") and not ingest.model_changed(store.read("metadata"), str(KEPT + 1))
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "other")).read("themes")


def test_stored_tokens_give_the_same_hits(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [(i, "I", t, None) for i, t in enumerate(["dores agudas no tórax", "dor aguda", "febre", "dor"])]
    store.write("theme_stats", spark.createDataFrame(rows, "id long, institution string, tema string, subtema string").select("*", *[F.lit(None).alias(c) for c in ("ranking", "category", "percentage", "num_questions", "cor", "cor_hex", "source_file", "created_at", "embedding")]))
    corpus = store.read("theme_stats").withColumn("text", F.concat_ws(" ", "tema", "subtema"))
    asked = spark.createDataFrame([(1, "dor aguda"), (2, "febre")], "query_id long, query_text string")
    hits = lambda **o: sorted(map(tuple, fulltext_search(corpus, asked, "portuguese", **o).collect()))
    assert hits(tokens_col="tokens") == hits() and hits()


def test_commands(spark, files):
    store = files / "store"
    assert len(run(spark, "migrate", "--store", store)["created"]) == 5
    me = f"{__name__}:encoder"
    assert run(spark, "ingest-stats", "--store", store, "--institution", "HCPA", "--encoder", me, files / "stats") == {"skipped": False, "rows": 3}
    assert run(spark, "ingest-stats", "--store", store, files / "stats") == {"skipped": True, "rows": 0}
    assert run(spark, "ingest-pdf", "--store", store, "--year", 2024, files / "questions") == {"skipped": False, "rows": 2}

    own = Store(spark, str(store))
    stats = {(r.category, r.tema, r.subtema): r for r in own.read("theme_stats").collect()}
    assert {k: (r.institution, r.num_questions) for k, r in stats.items()} == {("area", "Cirurgia", None): ("HCPA", 8), ("tema", "Trauma", None): ("HCPA", 7), ("subtema", "Trauma", "Choque"): ("HCPA", 3)}
    assert all(r.embedding and r.tokens and r.created_at for r in stats.values()) and sorted(r.id for r in stats.values()) == [1, 2, 3]
    questions = own.read("questions").orderBy("id").collect()
    assert [(r.raw_text, r.tema_normalized, r.subtema_normalized, r.year, r.embedding) for r in questions] == [("1. Paciente com choque hemorrágico.", "Trauma", "choque", 2024, None), ("2. Outra pergunta", "Trauma", "choque", 2024, None)]
    log = own.read("ingest_log").orderBy("id").collect()
    assert [(r.file_name, r.row_count) for r in log] == [("a.txt", 3), ("q.txt", 2)]

    said = run(spark, "reconcile", "--store", store, "--encoder", me, "--use-llm", f"{__name__}:judge", files / "in.xlsx", files / "out.xlsx")
    assert said["rows"] == 3 and sum(said["coverage"].values()) == 3
    assert own.read("questions").filter("embedding is null").count() == 0
    assert not ingest.model_changed(own.read("metadata"), Settings.read().model_id)
    rows = sheets.shape_sheet(spark.read.format("xlsx").load(str(files / "out.xlsx")).withColumnRenamed("input_tema", "tema")).collect()
    assert len(rows) == 3 and {r.normalized_tema for r in rows if "Choque" in r.tema} == {"Trauma"}

    export.write_csv(own.read("theme_stats").select("tema", "subtema", "num_questions"), str(files / "csv"))
    assert sorted(map(tuple, spark.read.csv(str(files / "csv"), header=True).collect()), key=str) == sorted([("Cirurgia", None, "8"), ("Trauma", None, "7"), ("Trauma", "Choque", "3")], key=str)


def test_large_files_are_refused(spark, files, monkeypatch):
    monkeypatch.setattr(cli, "MAX_BYTES", 10)
    store = Store(spark, str(files / "second"))
    store.init()
    with pytest.raises(ValueError, match="larger"):
        cli.ingest_stats(store, str(files / "stats"))
