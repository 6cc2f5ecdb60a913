"""Output shaping: institution pivot, curriculum order, display columns, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scalar import color_hex, nfc, percent_text, week_number, week_text


def fold_aliases(counts: DataFrame, aliases: dict[str, str] | None = None, names: tuple[str, ...] = K.INSTITUTIONS) -> DataFrame:
    """(key..., institution, num_questions) with institutions by their full names, whatever case or short name they came in; what falls together is added. Unknown names stay."""
    known = {**{n.lower(): n for n in names}, **{a.lower(): n for a, n in (K.INSTITUTION_ALIASES if aliases is None else aliases).items()}}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else None
    name = F.coalesce(F.element_at(table, F.lower("institution")), F.col("institution")) if known else F.col("institution")
    keys = [c for c in counts.columns if c not in ("institution", "num_questions")]
    return counts.withColumn("institution", name).groupBy(*keys, "institution").agg(F.sum("num_questions").cast("long").alias("num_questions"))


def pivot_institutions(counts: DataFrame, key: str, names: tuple[str, ...] = K.INSTITUTIONS, prefix: str = "q_") -> DataFrame:
    """A column for each institution of the fixed list, 0 where nothing is known; no job is run to find the columns."""
    wide = counts.groupBy(key).pivot("institution", list(names)).agg(F.sum("num_questions").cast("long"))
    return wide.select(key, *[F.coalesce(F.col(f"`{n}`"), F.lit(0).cast("long")).alias(f"{prefix}{n}") for n in names])


def curriculum_index(sheet: DataFrame) -> DataFrame:
    """(tema_key, subtema_key, week, position): the first row of each (tema, subtema) and of each tema. Rows without a week or tema don't count."""
    rows = sheet.withColumn("week", week_number(F.col("semana"))).filter("week is not null and length(trim(tema)) > 0")
    low = lambda c: F.lower(F.trim(nfc(F.coalesce(F.col(c), F.lit("")))))
    keyed = rows.select(low("tema").alias("tema_key"), F.explode(F.array_distinct(F.array(low("subtema"), F.lit("")))).alias("subtema_key"), "week", "position")
    return keyed.groupBy("tema_key", "subtema_key").agg(F.min_by("week", "position").alias("week"), F.min("position").alias("position"))


def curriculum_place(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` (row_idx, input_tema, normalized_tema, normalized_subtema) with week and position: by the input's topic, its tema, the matched topic, its tema, in this order."""
    parts = F.split("input_tema", r" \| ", 2)
    low = lambda c: F.lower(F.trim(nfc(F.coalesce(c, F.lit("")))))
    it, isub = low(F.get(parts, F.lit(0))), low(F.get(parts, F.lit(1)))
    nt, ns = low(F.col("normalized_tema")), low(F.col("normalized_subtema"))
    none = F.lit("")
    keys = F.array(*[F.struct(a.alias("t"), b.alias("s")) for a, b in ((it, isub), (it, none), (nt, ns), (nt, none))])
    tries = rows.select("row_idx", F.posexplode(keys).alias("ord", "k")).select("row_idx", "ord", "k.t", "k.s").filter("t <> ''")
    hits = tries.join(index, (F.col("t") == F.col("tema_key")) & (F.col("s") == F.col("subtema_key")))
    best = hits.groupBy("row_idx").agg(F.min_by(F.struct("week", "position"), "ord").alias("p"))
    return rows.join(best, "row_idx", "left").select(*rows.columns, F.coalesce("p.week", F.lit(K.UNKNOWN_WEEK)).alias("week"), F.coalesce(F.col("p.position").cast("long"), F.lit(K.UNKNOWN_POSITION).cast("long")).alias("position"))


def ranking_table(done: DataFrame, index: DataFrame, names: tuple[str, ...] = K.INSTITUTIONS) -> DataFrame:
    """The exported ranking, with a colour column beside each count, in curriculum order."""
    counts = done.select("row_idx", F.explode("questions_by_institution").alias("institution", "num_questions"))
    wide = pivot_institutions(fold_aliases(counts, names=names), "row_idx", names)
    placed = curriculum_place(done, index).join(wide, "row_idx", "left")
    shown = [F.concat(F.coalesce(F.col(f"`q_{n}`"), F.lit(0)).cast("string"), F.lit(" questões")).alias(f"q_{n}") for n in names]
    codes = [color_hex(F.coalesce(F.col(f"`q_{n}`"), F.lit(0))).alias(f"q_{n}_hex") for n in names]
    out = placed.orderBy("week", "position", F.desc("match_score"), "row_idx")
    return out.select(week_text(F.col("week")).alias("semana"), "match_label", percent_text(F.col("match_score")).alias("match_score"), "input_tema", "input_equivalencia", "normalized_tema", "normalized_subtema", *shown, "notes", *codes)


def coverage_table(reverse: DataFrame) -> DataFrame:
    return reverse.select("db_tema", "db_subtema", F.concat(F.col("db_num_questions").cast("string"), F.lit(" questões")).alias("db_num_questions"), "matched_input", F.format_string("%.2f%%", F.bround(F.col("similarity_score") * 100, 2)).alias("similarity_score"), "coverage_status", "notes")


def column_widths(df: DataFrame, least: int = 15, most: int = 55) -> DataFrame:
    """One row: the display width of each column, its longest text and 4 more, within bounds."""
    return df.agg(*[F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(F.max(F.length(F.col(f"`{c}`").cast("string"))), F.lit(0)) + 4)).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """With raw column names; one file for each partition, in order."""
    df.write.mode("overwrite").option("header", True).csv(path)
