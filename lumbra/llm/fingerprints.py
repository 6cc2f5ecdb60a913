"""Document fingerprints by Order MinHash.

Character k-mers are numbered by their occurrence and hashed; the hash space is split into SKETCHES ranges, and in each
the TUPLE smallest are selected. Put back into the order of the text, their k-mers are hashed as a tuple: a
signature that changes with content and with order, so its agreement follows edit distance. (One hash of each occurrence serves
all sketches, as in one-permutation hashing; a range without k-mers is marked empty.)

Null texts are empty; an empty text has the all-empty fingerprint, whose likeness to itself is 1. A text shorter than a
k-mer is one k-mer. The next document is by descending doc_id, then descending text; null ids come last. Repeated rows follow each other. A
single document is its own next one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks, keyed_texts, map_texts, record

K, TUPLE, SKETCHES = 10, 2, 64
_BASE, _A, _B = np.uint64(0x100000001B3), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_EDGES = (np.arange(SKETCHES, dtype=np.uint64) << np.uint64(64 - int(math.log2(SKETCHES))))
_POWERS = [np.uint64(pow(int(_BASE), j, 1 << 64)) for j in range(K + 1)]
_REST = np.uint64(2**58 - 1)
_S33, _S29 = np.uint64(33), np.uint64(29)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S33)
    x *= _A
    x ^= x >> _S29
    x *= _B
    x ^= x >> _S33
    return x


def _rolling(c: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-mers, put together from those of half the length."""
    if k == 1:
        return c
    half = k // 2
    own = _rolling(c, half)
    out = own[: len(own) - half] * _POWERS[half] + own[half:]
    return out if k % 2 == 0 else out[:-1] * _BASE + c[k - 1 :]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sketch(cp: np.ndarray) -> np.ndarray:
    """Code points to SKETCHES numbers of 16 bits; 0 marks an empty one."""
    out = np.zeros(SKETCHES, np.uint16)
    if not len(cp):
        return out
    k = min(K, len(cp))
    n = len(cp) - k + 1
    h = _mix(_rolling(cp.astype(np.uint64), k))
    order = np.argsort(h)
    hs = h[order]
    same = np.zeros(n + 1, bool)
    np.equal(hs[1:], hs[:-1], out=same[1:-1])
    g = hs
    if same.any():  # repeats get numbers, in the order of the text
        rows = np.flatnonzero(same[1:] | same[:-1])
        first = np.flatnonzero(~same[rows])
        run = np.cumsum(~same[rows])
        rows = rows[np.argsort(rows)]
        order[rows] = order[rows][np.lexsort((order[rows], run))]
        nth = np.arange(len(rows)) - first[run - 1]
        g = hs.copy()
        g[rows] += nth.astype(np.uint64) * _BASE
    g = _mix(g)
    best = starts = None
    if n > 32 * SKETCHES:  # the smallest of each range are among its lowest part, but for bad luck
        rows = np.flatnonzero((g & _REST) < np.uint64(2**58 * 16 * SKETCHES // n))
        best = rows[np.argsort(g[rows])]
        starts = np.searchsorted(g[best], _EDGES)
        if np.diff(starts, append=len(best)).min() < TUPLE:
            best = None
    if best is None:
        best = np.argsort(g)
        starts = np.searchsorted(g[best], _EDGES)
    n_best = len(best)
    ends = np.append(starts[1:], n_best)
    at = starts[:, None] + np.arange(TUPLE)
    have = at < ends[:, None]
    place = np.where(have, order[best[np.minimum(at, n_best - 1)]], n)
    place.sort(1)
    ht = np.append(h, np.uint64(0))[place]
    value = np.zeros(SKETCHES, np.uint64)
    for j in range(TUPLE):
        value = _mix(value * _BASE + ht[:, j] + np.uint64(j + 1))
    out[:] = np.maximum(value & np.uint64(0xFFFF), np.uint64(1))
    out[~have[:, 0]] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal sketches among those that either has."""
    either = (a != 0) | (b != 0)
    n = int(either.sum())
    return float((either & (a == b)).sum() / n) if n else 1.0


def as_text(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def fingerprint(docs: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return record(schema, part.column("doc_id"), [as_text(sketch(code_points(t))) for t in part.column("text").to_pylist()])

    return map_texts(keyed_texts(docs, **columns), run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, **columns: str) -> DataFrame:
    """(bucket, guest, doc_id, text), partitioned by bucket and sorted so that each row is followed by the next document by descending id.

    Buckets are ranges of ids; a guest is the first document of the bucket below (for the lowest: of the highest), put behind the
    bucket's own rows. A bucket has one guest, so nothing but P ids passes the driver."""
    spark = docs.sparkSession
    rows = keyed_texts(docs, **columns)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.col("doc_id").cast("double").alias("x")).na.drop().approxQuantile("x", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    if len(splits) > 2:
        cut = Bucketizer(splits=splits, inputCol="__x", outputCol="__b", handleInvalid="keep")
        rows = cut.transform(rows.withColumn("__x", F.col("doc_id").cast("double"))).withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("__b").cast("int"))).drop("__x", "__b")
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()  # a row for each partition
    to = [(tops[i - 1][1], tops[i][0]) for i in range(len(tops))]
    guests = rows.drop("bucket").join(F.broadcast(spark.createDataFrame(to, "top long, bucket int")), F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("bucket").agg(F.max("text").alias("text"))
    both = rows.select("bucket", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests.select("bucket", F.lit(True).alias("guest"), F.lit(None).cast("long").alias("doc_id"), "text"))
    return both.repartitionById(max(1, len(splits) - 1), F.col("bucket")).sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), F.desc("text"))


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(docs: DataFrame, **columns: str) -> DataFrame:
    """A row for each row of ``docs``: its fingerprint and that of its text whose last third is taken from the next document, and their likeness."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            for part in chunks([whole]):
                rows = []
                for bucket, guest, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text")), strict=True):
                    own = bucket, doc_id, text, sketch(code_points(text)), guest
                    if held is not None and not held[4] and held[0] == bucket:
                        n = len(held[2])
                        new = held[2][: n - n // 3] + text[: n // 3]
                        s = sketch(code_points(new))
                        rows.append((held[1], n, hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_text(held[3]), as_text(s), likeness(held[3], s), likeness(held[3], own[3])))
                    held = own
                if rows:
                    yield record(schema, *zip(*rows, strict=True))

    return with_next(docs, **columns).mapInArrow(run, EDITED)
