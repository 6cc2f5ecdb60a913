"""Command line: migrate, ingest-stats, ingest-pdf, reembed, reconcile; each prints one line of JSON.

A model is given as module:function. An encoder takes a list of texts and gives their vectors; a judge is described in operators/judge.py.
"""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import encode
from .operators import export, ingest, judge, lookups, parse, reconcile
from .operators.search import Encoder
from .operators.stage import staged
from .schema import CURRICULUM
from .settings import Settings
from .sources import sheets
from .sources.store import Store
from .sources.xlsx import write_xlsx

#: An input file above this size is an error, as at an upload.
MAX_BYTES = 20 * 1024 * 1024
#: Rows of a worksheet below its titles, by the file format.
MAX_ROWS = 1_048_575


def load(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def encoder_of(model: Callable[[list[str]], Any]) -> Encoder:
    return lambda texts: encode(texts, model)


def _new_files(store: Store, path: str) -> DataFrame:
    """(file, file_hash) of the files that the log doesn't hold, one for each content."""
    found = sheets.file_hashes(store.spark, path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "file_hash", "size")
    large = found.filter(F.col("size") > MAX_BYTES).agg(F.min("file")).first()[0]
    if large is not None:
        raise ValueError(f"{large} is larger than {MAX_BYTES} bytes")
    return staged(ingest.new_files(found, store.read("ingest_log")).groupBy("file_hash").agg(F.min("file").alias("file")))


def _ingest(store: Store, path: str, table: str, rows_of: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame], text: Callable, encoder: Encoder | None) -> dict:
    """Rows of new files are merged into ``table``, texts without a vector encoded if there is an encoder, and the files logged last: a run that breaks off is done again by the next."""
    files = _new_files(store, path)
    if files.isEmpty():
        return {"skipped": True, "rows": 0}
    lines = sheets.read_lines(store.spark, path).join(files.select("file"), "file", "left_semi")
    rows = rows_of(lines).withColumns({"id": F.lit(None).cast("long"), "at": F.struct("source_file", "page", F.col("line_no" if table == "theme_stats" else "number"))})
    old = store.read(table)
    last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    batch = staged(ingest.with_ids(rows, "at", last).withColumns({"ord": F.col("id"), "created_at": F.current_timestamp()}).drop("at"))
    new = merge(old, batch)
    store.write(table, ingest.embed(staged(new), text(), encoder) if encoder else new)
    counts = batch.groupBy(F.col("source_file").alias("file")).agg(F.count(F.lit(1)).cast("int").alias("row_count"))
    log = store.read("ingest_log")
    logged = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    done = files.join(counts, "file", "left").select(F.lit(None).cast("long").alias("id"), F.col("file").alias("file_name"), "file_hash", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.current_timestamp().alias("ingested_at"))
    store.write("ingest_log", ingest.record_ingest(log, ingest.with_ids(done, "file_hash", logged)))
    return {"skipped": False, "rows": batch.count()}


def ingest_stats(store: Store, path: str, institution: str = "unknown", encoder: Encoder | None = None) -> dict:
    """Statistics from extracted text files."""
    return _ingest(store, path, "theme_stats", lambda lines: parse.parse_stats(lines, institution), ingest.upsert_stats, ingest.stats_text, encoder)


def ingest_questions(store: Store, path: str, institution: str = "unknown", year: int | None = None, encoder: Encoder | None = None) -> dict:
    """Questions from extracted text files."""
    return _ingest(store, path, "questions", lambda lines: parse.parse_questions(lines, institution, year), ingest.upsert_questions, ingest.questions_text, encoder)


def reembed(store: Store, encoder: Encoder, settings: Settings, everything: bool = True) -> dict:
    """Vectors of all rows, or of those without one; the model's name is kept beside them."""
    for table, text in (("theme_stats", ingest.stats_text()), ("questions", ingest.questions_text())):
        store.write(table, ingest.embed(store.read(table), text, encoder, everything))
    store.write("metadata", ingest.set_metadata(store.read("metadata"), "embedding_model", settings.model_id))
    return {"model": settings.model_id, "everything": everything}


def _numbered(sheet: DataFrame) -> DataFrame:
    """Rows of a sheet without numbers take those of their places in the files."""
    return staged(sheet.withColumn("row_idx", (F.col("row_idx") if "row_idx" in sheet.columns else F.monotonically_increasing_id()).cast("long")))


def _sheet(df: DataFrame) -> tuple[list[str], list[tuple], list[list[str | None]]]:
    """Titles, rows and fills for a workbook: a column x_hex colours the column x."""
    titles = [c for c in df.columns if not c.endswith("_hex")]
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a worksheet holds {MAX_ROWS} rows: write CSV instead")
    return titles, [tuple(r[c] for c in titles) for r in rows], [[r[f"{c}_hex"] if f"{c}_hex" in df.columns else None for c in titles] for r in rows]


def reconcile_sheet(store: Store, sheet: str, out: str, encoder: Encoder, settings: Settings, model: judge.Judge | None = None, curriculum: str | None = None, csv: bool = False) -> dict:
    """The ranking and the reverse coverage of an input sheet: a workbook ``out``, or two folders of CSV below it. A changed embedding model encodes all rows anew."""
    spark = store.spark
    reembed(store, encoder, settings, ingest.model_changed(store.read("metadata"), settings.model_id))
    stats = store.read("theme_stats")
    base = reconcile.Base(store.read("questions"), stats, stats.drop("embedding"), encoder, settings.analyzer, settings)
    done = staged(reconcile.reconcile(_numbered(sheets.read_sheet(spark, sheet)), base))
    if model:
        done = staged(judge.apply_judge(done, base, model))
    reverse = staged(reconcile.reverse_coverage(done, lookups.topic_rollup(stats), encoder))
    plan = sheets.read_curriculum(spark, curriculum) if curriculum else spark.createDataFrame([], CURRICULUM)
    ranking, coverage = export.ranking_table(done, export.curriculum_index(plan)), export.coverage_table(reverse)
    if csv:
        export.write_csv(ranking.select([c for c in ranking.columns if not c.endswith("_hex")]), f"{out}/ranking")
        export.write_csv(coverage, f"{out}/coverage")
    else:
        parts = {name: _sheet(df) for name, df in (("Ranking", ranking), ("Cobertura", coverage))}
        widths = {name: [min(55, max(15, 4 + max((len(str(r[i])) for r in rows if r[i] is not None), default=0))) for i in range(len(titles))] for name, (titles, rows, _) in parts.items()}
        write_xlsx(out, {n: (titles, rows) for n, (titles, rows, _) in parts.items()}, {n: fills for n, (_, _, fills) in parts.items()}, widths)
    return {"rows": done.count(), "coverage": {r.coverage_status: r.topics for r in reconcile.coverage_summary(reverse).collect()}, "out": out}


def arguments(given: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="lumbra", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("migrate", "ingest-stats", "ingest-pdf", "reembed", "reconcile"):
        one = commands.add_parser(name)
        one.add_argument("--store", required=True, help="folder of the tables, on a file system that all executors share")
        if name != "migrate":
            one.add_argument("--encoder", required=name in ("reembed", "reconcile"), help="module:function")
        if name.startswith("ingest"):
            one.add_argument("path", help="extracted text files; a form feed begins a page")
            one.add_argument("--institution", default="unknown")
        if name == "ingest-pdf":
            one.add_argument("--year", type=int)
        if name == "reconcile":
            one.add_argument("sheet")
            one.add_argument("out")
            one.add_argument("--curriculum")
            one.add_argument("--csv", action="store_true")
            one.add_argument("--use-llm", dest="judge", metavar="MODULE:FUNCTION", help="judge that reviews weak matches")
    return top.parse_args(given)


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    asked, settings = arguments(given), Settings.read()
    store = Store(spark or SparkSession.builder.appName("lumbra").getOrCreate(), asked.store, settings.analyzer)
    encoder = encoder_of(load(asked.encoder)) if getattr(asked, "encoder", None) else None
    if asked.command == "migrate":
        said: dict = {"created": store.init()}
    elif asked.command == "ingest-stats":
        said = ingest_stats(store, asked.path, asked.institution, encoder)
    elif asked.command == "ingest-pdf":
        said = ingest_questions(store, asked.path, asked.institution, asked.year, encoder)
    elif asked.command == "reembed":
        said = reembed(store, encoder, settings)
    else:
        said = reconcile_sheet(store, asked.sheet, asked.out, encoder, settings, load(asked.judge) if asked.judge else None, asked.curriculum, asked.csv)
    print(json.dumps(said, ensure_ascii=False))
    return said


if __name__ == "__main__":
    main()
