"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sizes are summed for each source and each of 4096 bins of a seeded hash, so the one shuffle carries a row
for each source, bin and task. Sources are ranked by ranges, and the water level is found by sums over them, so the driver sees
neither sources nor targets, however many there are. A source takes every document
floor(target / size) times, and one more time those whose hash is below the source's cut; the cut falls
into one bin, and only the documents of that bin are ordered to find the one document that is repeated in
part. The taken words of a source so meet its target to a word.

Null texts count no words and take none. A null source is a source of its own, last in order. Repeated
rows are taken one by one; rows with a null doc_id are told apart by their texts. Extra columns are kept by mixed_documents,
whatever their names, and ignored else. An empty table gives an empty mix.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from .common import WORD, join_unique, unused, written

BINS = 4096


#: A plan of more sources than this is joined by shuffle, not broadcast.
BROADCAST_SOURCES = 100_000


def _key(source: Column) -> Column:
    """Sources as strings without null, in the order of code points with null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def ranked(df: DataFrame, by: str) -> DataFrame:
    """``df``, written, with the place of each row in the order of ``by`` as __rank from 0. Ranges are sorted on their own; the driver gets a count for each."""
    dealt = written(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("__m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("__m", 33).cast("int")
    starts, n = [], 0
    for p, count in sorted(dealt.groupBy(part.alias("p")).count().collect()):  # a row for each partition
        starts.append((p, n))
        n += count
    places = pa.table({"__p": pa.array([p for p, _ in starts], pa.int32()), "__start": pa.array([s for _, s in starts], pa.int64())})
    start = F.broadcast(df.sparkSession.createDataFrame(places))
    return dealt.join(start, part == F.col("__p")).withColumn("__rank", F.col("__start") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__start", "__m")


def water_level(sums: Callable[[float], tuple[int, int, float]], total: float, weight: float, cap: float) -> float:
    """The scale by which weights become targets: ``total`` is shared by weight, and what exceeds ``cap`` times a size is shared again among the
    others, until none is above. ``sums``: by scale, the number and the summed size of the sources above, and the weight of the others."""
    if not weight:
        return 0.0
    scale, before = total / weight, 0
    while True:
        n, size, free = sums(scale)
        if n == before or not free:
            return scale
        scale, before = (total - cap * size) / free, n


def source_plan(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: float = 3.0, share: float = 1.0) -> DataFrame:
    """(__source, __bin, __sum) to a row for each source: source_size, target, whole repetitions, cut bin and what the cut bin still gives."""
    sizes = written(sizes, "sizes")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    totals = ranked(sizes.groupBy("__source").agg(F.sum("__sum").alias("source_size")), "__source")
    table = written(totals.select("__source", "source_size", F.element_at(listed, (F.col("__rank") % len(weights) + 1).cast("int")).alias("__w")), "totals")
    every, weight = table.agg(F.sum("source_size"), F.sum("__w")).first()

    def over(scale: float) -> Column:
        return F.col("__w") * scale > F.lit(float(epochs)) * F.col("source_size")

    def sums(scale: float) -> tuple[int, int, float]:
        r = table.agg(F.count_if(over(scale)), F.sum(F.when(over(scale), F.col("source_size"))), F.sum(F.when(~over(scale), F.col("__w")))).first()
        return r[0], r[1] or 0, r[2] or 0.0

    scale = water_level(sums, share * (every or 0), weight, float(epochs))
    target = F.when(over(scale), F.lit(float(epochs)) * F.col("source_size")).otherwise(F.col("__w") * scale)
    plan = table.select("__source", "source_size", target.alias("target")).withColumn("__whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = written(plan.withColumn("__extra", F.when(F.col("source_size") > 0, F.rint(F.col("target") - F.col("__whole") * F.col("source_size"))).otherwise(0).cast("long")), "plan")
    upto = Window.partitionBy("__source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
    cut = (
        sizes.withColumn("__before", F.coalesce(F.sum("__sum").over(upto), F.lit(0)))
        .join(_small(plan.select("__source", "__extra")), "__source")
        .filter((F.col("__before") <= F.col("__extra")) & (F.col("__extra") < F.col("__before") + F.col("__sum")))
        .select("__source", F.col("__bin").alias("__cut"), (F.col("__extra") - F.col("__before")).alias("__left"))
    )
    # without a cut bin the rest takes no bin or all
    full = plan.join(cut, "__source", "left").withColumns({"__cut": F.coalesce("__cut", F.when(F.col("__extra") <= 0, 0).otherwise(BINS)), "__left": F.coalesce("__left", F.lit(0).cast("long"))})
    return written(full.drop("__extra"), "plan")


def _small(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, source_size, target, taken, copies (whole repetitions) and part (words of one more, partial repetition), besides the columns of ``keep``."""
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"__k_{c}") for c in keep],
        F.col(id_col).alias("doc_id"),
        _key(F.col(source_col)).alias("__source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.when(F.col(id_col).isNotNull(), F.xxhash64(F.lit(seed), F.col(id_col))).otherwise(F.xxhash64(F.lit(seed), F.col(text_col))).alias("__h"),
    ).withColumn("__bin", F.shiftrightunsigned("__h", 52).cast("int"))
    sums = rows.groupBy("__source", "__bin").agg(F.sum("size").alias("__sum"))
    plan = source_plan(sums, weights, epochs)
    joined = rows.join(F.broadcast(plan), "__source") if plan.count() <= BROADCAST_SOURCES else join_unique(rows, plan, ["__source"])
    in_cut = F.col("__bin") == F.col("__cut")
    away = joined.filter(~in_cut).withColumns({"copies": F.col("__whole") + F.when(F.col("__bin") < F.col("__cut"), 1).otherwise(0), "part": F.lit(0).cast("long")})
    upto = Window.partitionBy("__source").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    within = joined.filter(in_cut).withColumn("__before", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    gives = F.greatest(F.lit(0), F.least("size", F.col("__left") - F.col("__before")))
    within = within.withColumns({"copies": F.col("__whole") + F.when((gives == F.col("size")) & (gives > 0), 1).otherwise(0), "part": F.when(gives == F.col("size"), 0).otherwise(gives).cast("long")}).drop("__before")
    both = away.unionByName(within)
    return both.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"), "part", *[F.col(f"`__k_{c}`").alias(f"k_{c}") for c in keep])


@F.arrow_udf(StringType())
def _leading(text: pa.Array, words: pa.Array) -> pa.Array:
    """The text up to the end of its n-th word."""
    word = re.compile(WORD)

    def lead(t: str, n: int) -> str:
        for k, m in enumerate(word.finditer(t), 1):
            if k == n:
                return t[: m.end()]
        return t

    return pa.array([lead(t, n) for t, n in zip(text.to_pylist(), words.to_pylist(), strict=True)], pa.string())


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: whole repetitions as rows, and the one partial repetition of a source as its text up to the end of the last word taken."""
    columns = docs.columns
    text = options.get("text_col", "text")
    (n,) = unused([f"k_{c}" for c in columns], "__n")
    rows = mix(docs, keep=columns, **options)
    whole = rows.filter("copies > 0").withColumn(n, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    part = rows.filter("part > 0").withColumn(f"k_{text}", _leading(F.col(f"k_{text}").cast("string"), F.col("part")))
    pick = lambda df: df.select(*[F.col(f"`k_{c}`").alias(c) for c in columns])
    return pick(whole).unionByName(pick(part))
