"""Review of weak matches by an injected judge.

The judge is a function from an iterator of pandas batches (batch, prompt) to batches (batch, reply); it runs in mapInPandas. A prompt holds ITEMS rows,
numbered from 0 in order of row_idx; a reply is the JSON of a list of verdicts as a model gives it, each with its item's number. An item without a verdict,
or all items of a reply that can't be read, count as confirmed without confidence, so their rows keep their match and score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as K
from ..functions.scalar import clean_suggestion, color_hex, display, match_label, percent_text
from ..schema import REPLY
from .ingest import with_ids
from .lookups import best_stats, exact_stats
from .reconcile import RESULT, Base, _counts, _total
from .search import search_topics
from .stage import staged

Judge = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
CANDIDATES, PROMPTED, ITEMS = 15, 12, 5


def weak_rows(done: DataFrame, threshold: float = K.JUDGE_THRESHOLD) -> DataFrame:
    """Rows to review, with the input's parts."""
    parts = F.split("input_tema", r" \| ", 2)
    return done.filter((F.col("match_score") < threshold) | (F.col("match_method") == K.NONE)).select("*", F.get(parts, F.lit(0)).alias("in_tema"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("in_subtema"))


def _listed_candidates(rows: DataFrame, base: Base) -> DataFrame:
    """Without an encoder: the full-text hit of the tema, then the five most popular rows below the current match's tema."""
    texts = rows.select("row_idx", F.col("in_tema").alias("text")).filter("text <> ''")
    one = texts.join(best_stats(texts, base.stats, base.analyzer, "text"), F.col("text") == F.col("query_text")).select("row_idx", F.lit(0).alias("ord"), "stat")
    w = Window.partitionBy(F.lower("tema")).orderBy(F.desc("num_questions"), "id")
    below = base.stats.filter("subtema is not null").withColumn("ord", F.row_number().over(w)).filter("ord <= 5").select(F.lower("tema").alias("tl"), "ord", F.struct("id", "institution", "ranking", "tema", "subtema", "num_questions", "cor_hex").alias("stat"))
    more = rows.select("row_idx", F.lower("normalized_tema").alias("t")).join(below, F.col("t") == F.col("tl")).select("row_idx", "ord", "stat")
    return one.unionByName(more).withColumn("rank", F.row_number().over(Window.partitionBy("row_idx").orderBy("ord"))).select("row_idx", "rank", "stat")


def alternative_candidates(rows: DataFrame, base: Base) -> DataFrame:
    """(row_idx, rank, stat): up to CANDIDATES topics of the input's level, by popularity.

    Found by semantic search of the input's texts, by full text, and below the first four candidates' temas and the current one's; the first of
    each (tema, subtema) stays. Rows of equal inputs have equal candidates, which are found once."""
    if base.encoder is None:
        return _listed_candidates(rows, base)
    inputs = ("in_tema", "in_subtema", "input_equivalencia", "normalized_tema")
    asked = staged(rows.select(*inputs).distinct().withColumn("row_idx", F.monotonically_increasing_id()))
    listed = _candidates(asked, base).groupBy("row_idx").agg(F.collect_list(F.struct("rank", "stat")).alias("c"))
    found = staged(asked.join(listed, "row_idx").select(*[F.col(c).alias(f"__{c}") for c in inputs], "c"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in inputs]
    return rows.select("row_idx", *inputs).join(found, reduce(and_, same)).select("row_idx", F.inline("c"))


def _candidates(rows: DataFrame, base: Base) -> DataFrame:
    eq = F.when(~F.lower("input_equivalencia").isin(F.lower("in_tema"), F.lower("in_subtema")), F.col("input_equivalencia"))
    sub = F.nullif("in_subtema", F.lit(""))
    tries = rows.select("row_idx", F.posexplode(F.array("in_tema", F.when(sub.isNotNull(), F.concat_ws(" ", "in_tema", sub)), sub, eq)).alias("ord", "text")).filter("text is not null and text <> ''")
    near = tries.join(search_topics(tries, base.stats, base.encoder, 7, base.analyzer), "text").select("row_idx", (F.col("ord") * 100 + F.col("rank")).alias("ord"), "stat")
    words = rows.select("row_idx", F.posexplode(F.array("in_tema", sub, "input_equivalencia")).alias("ord", "text")).filter("text is not null and text <> ''")
    text = words.join(best_stats(words, base.stats, base.analyzer, "text"), F.col("text") == F.col("query_text")).select("row_idx", (F.col("ord") + 1000).alias("ord"), "stat")
    first = staged(_distinct(near.unionByName(text)))
    four = first.filter("place <= 4").select("row_idx", F.col("stat.tema").alias("t"), (F.col("place") * 100 + 2000).alias("o"))
    current = rows.filter(F.lower("normalized_tema") != F.lower("in_tema")).select("row_idx", F.col("normalized_tema").alias("t"), F.lit(3000).alias("o"))
    w = Window.partitionBy(F.lower("tema")).orderBy(F.desc("num_questions"), "id")
    below = base.stats.filter("subtema is not null").withColumn("r", F.row_number().over(w)).filter("r <= 8")
    stats = below.select(F.lower("tema").alias("tl"), "r", F.struct("id", "institution", "ranking", "tema", "subtema", "num_questions", "cor_hex").alias("stat"))
    more = four.unionByName(current).join(stats, F.lower("t") == F.col("tl")).select("row_idx", (F.col("o") + F.col("r")).alias("ord"), "stat")
    every = _distinct(first.select("row_idx", F.col("place").alias("ord"), "stat").unionByName(more)).join(rows.select("row_idx", "in_subtema"), "row_idx")
    level = every.filter("(stat.subtema is not null) = (trim(in_subtema) <> '')")
    w = Window.partitionBy("row_idx").orderBy(F.desc("stat.num_questions"), "place")
    return level.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= CANDIDATES).select("row_idx", "rank", "stat")


def _distinct(df: DataFrame) -> DataFrame:
    """The first of each topic of a row, with its place among them."""
    first = df.groupBy("row_idx", F.lower("stat.tema").alias("tl"), F.lower("stat.subtema").alias("sl")).agg(F.min("ord").alias("ord"), F.min_by("stat", F.struct("ord", F.col("stat.id").alias("i"))).alias("stat"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("row_idx").orderBy("ord", "stat.id"))).select("row_idx", "place", "stat").withColumn("ord", F.col("place"))


def prompts(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(row_idx, prompt): the input, the current match and up to PROMPTED distinct candidates."""
    current = display(F.col("normalized_tema"), F.col("normalized_subtema"))
    listed = candidates.filter(F.col("rank") <= PROMPTED).groupBy("row_idx").agg(F.sort_array(F.collect_list(F.struct("rank", display(F.col("stat.tema"), F.col("stat.subtema")).alias("name"), F.col("stat.num_questions").alias("n")))).alias("c"))
    both = rows.withColumn("current", current).join(listed, "row_idx", "left")
    others = F.filter(F.coalesce("c", F.array().cast("array<struct<rank:int,name:string,n:bigint>>")), lambda x: F.lower(x["name"]) != F.lower("current"))
    lines = F.transform(others, lambda x: F.concat(F.lit("  - "), x["name"], F.lit(" ("), x["n"].cast("string"), F.lit(" questoes)")))
    state = F.when(F.col("match_score") > 0, F.concat(F.lit("score="), percent_text(F.col("match_score")))).otherwise("sem match automatico")
    head = F.concat(F.lit('INPUT: tema="'), "in_tema", F.lit('" subtema="'), "in_subtema", F.lit('" equivalencia="'), F.coalesce("input_equivalencia", F.lit("")), F.lit('"'))
    own = F.when(F.col("current") != "", F.concat(F.lit("  * [MATCH ATUAL] "), "current", F.lit(" ("), state, F.lit(")")))
    return both.select("row_idx", F.concat_ws("\n", head, own, F.array_join(lines, "\n")).alias("prompt"))


def verdicts(asked: DataFrame, judge: Judge, items: int = ITEMS) -> DataFrame:
    """(row_idx, v) of every row of (row_idx, prompt): the verdict with the row's number in its batch, the last if it is given twice."""
    placed = with_ids(asked.withColumn("place", F.lit(None).cast("long")), "row_idx", -1, "place")
    own = staged(placed.select("row_idx", "prompt", F.floor(F.col("place") / items).alias("batch"), (F.col("place") % items).cast("int").alias("item")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("item", "prompt"))), lambda x: F.concat(F.lit("["), x["item"].cast("string"), F.lit("] "), x["prompt"]))
    batches = own.groupBy("batch").agg(F.array_join(listed, "\n\n").alias("prompt"))
    replies = batches.mapInPandas(judge, "batch long, reply string").select("batch", F.from_json("reply", REPLY).alias("r"))
    said = F.element_at(F.filter("r.results", lambda x: x["index"] == F.col("item")), -1)
    none = lambda why: F.struct(F.col("item").alias("index"), F.lit(True).alias("is_equivalent"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("suggested_match"), F.lit(why).alias("reasoning"))
    found = F.when(F.size(F.filter("r.results", lambda x: x["index"] == F.col("item"))) > 0, said)
    return own.join(staged(replies), "batch", "left").select("row_idx", F.coalesce(found, F.when(F.col("r.results").isNotNull(), none(K.NO_VERDICT)).otherwise(none(K.NO_REPLY))).alias("v"))


def apply_judge(done: DataFrame, base: Base, judge: Judge, threshold: float | None = None) -> DataFrame:
    """``done`` with reviewed rows: confirmed, replaced by a suggestion that exists at the input's level, or rejected; others as they were."""
    done = staged(done)
    rows = weak_rows(done, base.settings.llm_judge_threshold if threshold is None else threshold)
    said = staged(verdicts(prompts(rows, alternative_candidates(rows, base)), judge))
    both = rows.join(said, "row_idx").withColumns({"suggested": F.nullif(clean_suggestion(F.col("v.suggested_match")), F.lit("")), "confidence": F.coalesce("v.confidence", F.lit(0.0)), "why": F.coalesce("v.reasoning", F.lit(""))})
    label = lambda s: match_label(F.lit(K.LLM), s)

    both = staged(both)
    yes = both.filter("coalesce(v.is_equivalent, false)")
    own = exact_stats(yes.select("row_idx", F.col("normalized_tema").alias("tema"), F.col("normalized_subtema").alias("subtema")), base.stats).select("row_idx", F.col("stat").alias("found"))
    yes = yes.join(own, "row_idx").withColumns({"t": F.col("normalized_tema"), "s": F.coalesce("found.subtema", "normalized_subtema"), "new": F.greatest("confidence", "match_score")})
    yes = _counts(staged(yes), "t", "s", base).withColumn("q", F.when(F.size("qbi") > 0, F.col("qbi")).otherwise(F.col("questions_by_institution")))
    confirmed = yes.select(
        "row_idx", "input_tema", F.coalesce("input_equivalencia", display(F.col("t"), F.col("s"))).alias("input_equivalencia"), F.col("t").alias("normalized_tema"), F.col("s").alias("normalized_subtema"), F.col("q").alias("questions_by_institution"),
        F.lit(K.LLM).alias("match_method"), F.col("new").alias("match_score"), label(F.col("new")).alias("match_label"), F.when(_total(F.col("q")) > 0, color_hex(_total(F.col("q")))).otherwise(F.col("cor_hex")).alias("cor_hex"),
        F.concat("notes", F.lit("; LLM confirmado (conf="), percent_text(F.col("confidence")), F.lit("): "), "why").alias("notes"),
    )

    no = both.filter("not coalesce(v.is_equivalent, false)")
    other = no.filter("suggested is not null")
    parts = F.split("suggested", r" \| ", 2)
    keyed = other.select("row_idx", "suggested", F.trim(F.get(parts, F.lit(0))).alias("tema"), F.trim(F.get(parts, F.lit(1))).alias("subtema"))
    exact = staged(exact_stats(keyed, base.stats).select("row_idx", "suggested", "subtema", "stat"))
    text = best_stats(exact.filter("subtema is null and stat is null"), base.stats, base.analyzer, "suggested").select(F.col("query_text").alias("suggested"), F.col("stat").alias("by_text"))
    named = exact.join(text, "suggested", "left").select("row_idx", F.coalesce("stat", F.when(F.col("subtema").isNull(), F.col("by_text"))).alias("found"))
    other = other.join(named.filter("found is not null"), "row_idx").filter("in_subtema = '' or found.subtema is not null").withColumns({"t": F.col("found.tema"), "s": F.col("found.subtema")})
    other = _counts(staged(other), "t", "s", base)
    replaced = other.select(
        "row_idx", "input_tema", display(F.col("t"), F.col("s")).alias("input_equivalencia"), F.col("t").alias("normalized_tema"), F.col("s").alias("normalized_subtema"), F.col("qbi").alias("questions_by_institution"),
        F.lit(K.LLM).alias("match_method"), F.col("confidence").alias("match_score"), label(F.col("confidence")).alias("match_label"), color_hex(_total(F.col("qbi"))).alias("cor_hex"),
        F.concat(F.lit("Match anterior: "), F.coalesce("input_equivalencia", "normalized_tema"), F.lit(" (score="), percent_text(F.col("match_score")), F.lit("); LLM sugeriu: "), display(F.col("t"), F.col("s")), F.lit("; "), "why").alias("notes"),
    )

    lower = F.least("match_score", F.lit(K.REJECT_CAP))
    rejected = no.filter("suggested is null").filter(F.col("match_score") > K.REJECT_CAP).select(
        "row_idx", "input_tema", "input_equivalencia", "normalized_tema", "normalized_subtema", "questions_by_institution", F.lit(K.LLM).alias("match_method"), lower.alias("match_score"), label(lower).alias("match_label"), "cor_hex",
        F.concat("notes", F.lit("; LLM rejeitou match (conf="), percent_text(F.col("confidence")), F.lit("): "), "why").alias("notes"),
    )
    new = confirmed.unionByName(replaced).unionByName(rejected)
    return done.select(*RESULT).join(new.select("row_idx"), "row_idx", "left_anti").unionByName(new)
