"""Text to tables: lines of extracted pages to topic statistics and to questions.

``lines`` have file, page, line_no, line. State that a reader would carry from line to line is filled forward by windows: across a
file for statistics, within a page for questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import color, decimal_comma, split_topic

#: Fixed value: a line of a statistic, "1º Name — 12,5% (7 questões)".
METRIC = r"(?i)^(\d+)[ºª°]\s+(.+?)\s*[—\-–]\s*([\d.,]+)%\s*\((\d+)\s*quest[õo]es?\)"


def sections(lines: DataFrame, strict: bool = False) -> DataFrame:
    """The lines that are left when headers of sections are taken out, with the section they are in. ``strict`` takes no statistic for a header."""
    low = F.lower(F.trim("line"))
    head = F.when(F.contains(low, F.lit("área")) | F.contains(low, F.lit("area")), "area").when(F.contains(low, F.lit("subtema")), "subtema").when(F.contains(low, F.lit("tema")), "tema")
    if strict:
        head = F.when(~F.rlike(F.trim("line"), F.lit(METRIC)), head)
    w = Window.partitionBy("file").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.filter("trim(line) <> ''").withColumn("head", head)
    return marked.withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit("area"))).filter("head is null").drop("head")


def parse_stats(lines: DataFrame, institution: str = "unknown", strict: bool = False) -> DataFrame:
    """A row for each statistic; an area's tema ends with the next area."""
    line = F.trim("line")
    part = lambda i: F.regexp_extract(line, METRIC, i)
    rows = sections(lines, strict).filter(F.rlike(line, F.lit(METRIC))).select("file", "page", "line_no", "section", part(1).cast("int").alias("ranking"), F.trim(part(2)).alias("name"), decimal_comma(part(3)).alias("percentage"), part(4).cast("int").alias("num_questions"))
    order = Window.partitionBy("file").orderBy("page", "line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"areas": F.count_if(F.col("section") == "area").over(upto), "area": F.last(F.when(F.col("section") == "area", F.col("name")), ignorenulls=True).over(upto)})
    inside = Window.partitionBy("file", "areas").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.last(F.when(F.col("section") == "tema", F.col("name")), ignorenulls=True).over(inside))
    below = F.col("section") == "subtema"
    c = color(F.col("num_questions"))
    return rows.select(
        F.lit(institution).alias("institution"), "ranking", F.col("section").alias("category"), F.when(below, F.coalesce("own", "area", "name")).otherwise(F.col("name")).alias("tema"), F.when(below, F.col("name")).alias("subtema"),
        "percentage", "num_questions", c["cor"].alias("cor"), c["cor_hex"].alias("cor_hex"), F.col("file").alias("source_file"), "page", "line_no",
    )


def parse_questions(lines: DataFrame, institution: str = "unknown", year: int | None = None) -> DataFrame:
    """A row for each numbered question with its following lines; all questions of a page get the page's last tema and subtema."""
    heading = lambda word: F.nullif(F.trim(F.regexp_extract("line", rf"(?i)^{word}[:\s]+(.+)", 1)), F.lit(""))
    page = Window.partitionBy("file", "page").orderBy("line_no")
    whole = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = lines.withColumns({"t": heading("Tema"), "s": heading("Subtema")})
    rows = rows.withColumns({"tema": F.last("t", ignorenulls=True).over(whole), "subtema": F.last("s", ignorenulls=True).over(whole)})
    body = rows.filter(~F.rlike("line", F.lit(r"(?i)^(Tema|Subtema)[:\s]+.+"))).withColumn("q", F.count_if(F.rlike("line", F.lit(r"^\d+\."))).over(page.rowsBetween(Window.unboundedPreceding, 0))).filter("q > 0")
    joined = body.groupBy("file", "page", "q", "tema", "subtema").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("raw_text"))
    n = split_topic(F.coalesce("tema", F.lit("")), F.col("subtema"))
    return joined.select(F.lit(institution).alias("institution"), F.lit(year).cast("int").alias("year"), "raw_text", n["tema"].alias("tema_normalized"), n["subtema"].alias("subtema_normalized"), F.col("file").alias("source_file"), "page", F.col("q").alias("number"))
