"""What the operators share: bounded Arrow batches, tables in the shared folder, reading of inputs."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators of words: the ASCII white space of the contracts.
SPACE = " \t-\r"
WORD = "[^ \t-\r]+"
#: Text bytes that a Python worker handles at once, and at most in an Arrow batch.
CHUNK, BATCH = 1 << 20, 2 << 20
#: Seconds after which a task gives back free memory again.
PAUSE = 1.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Sees that an Arrow batch takes BATCH bytes at most, however long the texts are. One limit serves all operators; a smaller one of the user's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH:
        spark.conf.set(key, str(BATCH))


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text (null: empty), whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose texts take about ``limit`` bytes; a longer single text comes alone."""
    for batch in batches:
        at, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if size and size + (n or 0) > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n or 0
        if at < batch.num_rows:
            yield batch.slice(at)


def give_back() -> None:
    """Returns to the system what this process's allocators hold and nothing uses."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow in bounded batches. A Python worker outlives its task and waits beside the workers of later stages, so free memory is given back at the task's end, and meanwhile."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fed() -> Iterator[pa.RecordBatch]:
            last = time.monotonic()
            for b in batches:
                if time.monotonic() - last > PAUSE:
                    give_back()
                    last = time.monotonic()
                yield b

        try:
            yield from fn(fed())
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_texts(docs: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """Applies ``fn`` to slices of bounded size, in a narrow stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            if (out := fn(part)) is not None and out.num_rows:
                yield out

    return map_arrow(docs, run, schema)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a local master gets a folder of its own; on a cluster it is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir is unset: executors of {master} need a folder that all of them share")
    own = tempfile.mkdtemp(prefix="lumbra-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """``names``, with underscores put in front until none is a column."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


#: A key is hot above so many rows, or above 4 times an even share of a partition if that is more: so hot keys are fewer than a quarter of the partitions.
HOT_ROWS = 1000


def join_unique(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key at most; both are read more than once, so they should be written tables or cheap to make of such.

    No task gathers a hot key: the few rows of ``table`` for hot keys are sent to all tasks, whatever the size of the data. They go as an Arrow table:
    from rows, createDataFrame would start Python workers of another kind on every executor, which stay."""
    keys = list(keys)
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    least = max(HOT_ROWS, 4 * rows.count() // parts)
    hot = counts.filter(F.col("n") > least).select(*keys).toArrow()  # fewer than parts / 4 rows
    if not hot.num_rows:
        return rows.join(table, keys, how)
    hot = F.broadcast(spark.createDataFrame(hot, rows.select(*keys).schema))
    sent = F.broadcast(hot.join(table, keys, how))
    return rows.join(hot, keys, "left_anti").join(table, keys, how).unionByName(rows.join(sent, keys))


def key_filter(keys: DataFrame, column: str, n: int) -> np.ndarray:
    """A bitmap in which the (random) longs of a column are marked by their upper bits; about 16 bits for each of ``n`` keys, 32 MB at most. It lets all of them pass, and few others."""
    bits = min(28, max(18, (16 * max(n, 1)).bit_length()))
    place = F.shiftrightunsigned(column, 64 - bits)
    rows = keys.select(F.shiftright(place, 15).alias("at"), place.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("m")).collect()
    out = np.zeros((1 << (bits - 15), 1 << 12), np.uint8)
    for at, m in rows:
        out[at] = np.frombuffer(m, np.uint8)
    return out.ravel()


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each unsigned key is marked."""
    place = keys >> np.uint64(64 - (len(bitmap).bit_length() + 2))
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(df: DataFrame | None) -> None:
    """Removes a table made by :func:`written` that nothing reads any more."""
    if path := getattr(df, "_lumbra_path", None):
        _delete(df.sparkSession, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the session has ended; the cluster clears its folder
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: lineage ends there, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumbra-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._lumbra_path = path
    return out
