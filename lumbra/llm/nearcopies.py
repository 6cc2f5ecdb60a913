"""Near-duplicate documents by exact Jaccard similarity of word shingles.

A text is the set of its shingles of WORDS words; equal sets are one vertex, with the SimHash fingerprint of its shingles.

Candidates are the sets whose fingerprints differ in PROBED bits at most, found by the generalised pigeonhole of :mod:`simhash` (grouped bits,
thresholds by dynamic programming). No pair within that radius is missed: sets are dealt out by classes of size, those of a class and its neighbours
meet as pairs of blocks, and every block is probed with all signatures of the other. The exact similarity of the texts decides.

Similar sets differ in about 10 bits, with a deviation below 3, so some lie beyond any radius that can be probed. Only these pairs are left to
prefix filtering, which misses none: put the shingles of all sets in one order; then two sets of similarity THRESHOLD or more share one among
the first n - ceil(THRESHOLD n) + 1 of each. The order is by hash, with shingles that a sample finds common behind the others; whatever the sample
finds, the result is the same. Positions and sizes rule out pairs that can't be similar enough; so do fingerprints that differ in over RADIUS bits, if both sets
have LEAST shingles or more: that is five deviations off.

A fingerprint, or a prefix shingle, with up to SMALL sets near it gives all its pairs. One with more gives the pairs with a few hubs first; after their
verification only pairs of different components are left to compare, so a large group of copies costs a multiple of its size, not its square.

A text without words is the empty set, equal to others of its kind. Shorter texts are one shingle. Letters A-Z count as a-z, words end at ASCII white space.
Null texts are empty. Of repeated rows one stays; rows with a null id stay and remove nothing. Extra columns are kept, whatever their names.
An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, map_arrow, map_texts, record, unused, written
from .components import components
from .lines import _groups, _mix
from .simhash import Probe, majority, plan, sampled

WORDS, THRESHOLD, SEED = 5, 0.8, 42
#: A shingle is common above this many texts, as a sample of 1 in SAMPLED texts tells; the MOST_COMMON are known to all tasks.
COMMON, SAMPLED, MOST_COMMON = 64, 32, 2_000_000
#: Sets of a prefix shingle that are all compared at once; of more sets, first those with so many hubs.
SMALL, HUBS = 16, 4
#: Bits in which the fingerprints of similar sets differ at most, and the size from which that is asked.
RADIUS, LEAST = 24, 32
#: Bits within which fingerprints are probed for candidates, and the cost of a candidate in memory against that of a signature.
PROBED, PROBED_COST = 13, 1.0
#: Fingerprints from which the partitions and thresholds are planned.
PLANNED = 1000
#: Sets of a block at most, those below which blocks are not made smaller, and those of one that are probed at once.
BLOCK, LEAST_BLOCK, AT_ONCE = 1 << 18, 1 << 12, 1 << 11
#: Rows of one or two longs that are sent to all tasks at most; more are joined by a shuffle.
SENT = 500_000
_EPS = 1e-9


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """``raw``: UTF-8. The distinct shingle hashes, in order."""
    parts = raw.lower().split()  # bytes: A-Z alone, ASCII white space alone
    if not parts:
        return np.zeros(0, np.uint64)
    text = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    ends = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    return np.unique(np.fromiter((digest(text[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n))


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - _EPS:
        return False
    both = np.sort(np.concatenate([a, b]))
    k = int(np.count_nonzero(both[1:] == both[:-1]))
    return k >= threshold * (len(both) - k) - _EPS


def prefix_length(n: int, threshold: float = THRESHOLD) -> int:
    return n - int(np.ceil(threshold * n - _EPS)) + 1 if n else 0


def _differing(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of differing bits; of signed longs numpy would count those of the magnitude."""
    return np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64))


def _possible(size: np.ndarray, pos: np.ndarray, fp: np.ndarray, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
    """Whether sets i and j that share a shingle at these positions can be similar enough; size[i] <= size[j]."""
    near = (size[i] < LEAST) | (_differing(fp, i, j) <= RADIUS)
    si, sj, pi, pj = size[i], size[j], pos[i], pos[j]
    most = np.minimum(pi, pj) + 1 + np.minimum(si - pi - 1, sj - pj - 1)
    return near & (si >= t * sj - _EPS) & (pi <= si - np.ceil(2 * t / (1 + t) * si - _EPS)) & (most >= t / (1 + t) * (si + sj) - _EPS)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed_texts(docs, id_col, text_col).withColumn("k", F.xxhash64("text"))


def common(rows: DataFrame, words: int = WORDS) -> np.ndarray:
    """The most common shingles of a sample of distinct texts, in order."""
    schema = pa.schema([("token", pa.int64())])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return record(schema, np.concatenate([shingles(x, words) for x in part.column("text").cast(pa.binary()).to_pylist()]).view(np.int64))

    sample = rows.filter(F.pmod("k", F.lit(SAMPLED)) == 0).dropDuplicates(["k"])
    found = map_texts(sample, run, "token long").groupBy("token").count().filter(F.col("count") > COMMON // SAMPLED)
    return np.sort(found.orderBy(F.desc("count"), "token").limit(MOST_COMMON).select("token").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def sets(rows: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, k, h, size, fp, prefix): the text's key, its set's hash, size and fingerprint, and the first shingles."""
    last = common(rows, words)
    schema = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("h", pa.int64()), ("size", pa.int32()), ("fp", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        hs, sizes, fps, firsts = [], [], [], []
        for raw in part.column("text").cast(pa.binary()).to_pylist():
            own = shingles(raw, words)
            hs.append(xxhash.xxh3_64_intdigest(own.tobytes()))
            sizes.append(len(own))
            fps.append(majority(own))
            if len(last):
                late = last[np.minimum(np.searchsorted(last, own), len(last) - 1)] == own
                own = np.concatenate([own[~late], own[late]])
            firsts.append(own[: prefix_length(len(own), threshold)].view(np.int64))
        ends = np.cumsum([0, *map(len, firsts)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts), pa.int64()))
        return record(schema, part.column("doc_id"), part.column("k"), np.array(hs, np.uint64).view(np.int64), sizes, np.array(fps, np.uint64).view(np.int64), lists)

    return map_texts(rows, run, "doc_id long, k long, h long, size int, fp long, prefix array<long>")


def _beyond(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether fingerprints i and j are too far apart for probing."""
    return _differing(fp, i, j) > PROBED


def _classes(threshold: float):
    """The class of a size: similar sets are in the same class or in neighbouring ones."""
    return F.floor(F.log(F.col("size").cast("double")) / (max(-np.log(threshold), 0.01) * (1 + 1e-6))).cast("int")


def dealt(vertices: DataFrame, blocks: list[int], threshold: float) -> DataFrame:
    """Each set once for each pair of blocks that it belongs to; ``blocks``: by class, their number."""
    ends = np.cumsum([0, *blocks]).tolist()
    at, c = F.array(*map(F.lit, ends)), _classes(threshold)
    own = F.get(at, c) + F.pmod("h", F.get(at, c + 1) - F.get(at, c)).cast("int")
    others = F.sequence(F.get(at, F.greatest(c - 1, F.lit(0))), F.get(at, F.least(c + 2, F.lit(len(blocks)))) - 1)
    pair = F.least("block", "other").cast("long") * F.lit(1 << 31) + F.greatest("block", "other")
    return vertices.withColumn("block", own).withColumn("other", F.explode(others)).withColumn("pair", pair).drop("other")


def _probe(parts: list[tuple[list[int], int]], threshold: float, again: bool):
    """Sorted (pair, block, h, size, fp) to candidates (a, b) within PROBED bits; a set with more than SMALL gives those with hubs, and itself as (a, null).
    ``again``, with (many, component): of the sets marked as many, all candidates of other components."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def fewer(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each i the SMALL + 1 first j at most, their rank and their number."""
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        count = np.diff(np.append(first, len(i)))
        rank = np.arange(len(i)) - np.repeat(first, count)
        ok = rank <= SMALL
        return i[ok], j[ok], rank[ok], np.repeat(count, count)[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = ["many", "component"] if again else []
        for arrays in _groups(batches, "pair", ["block", "h", "size", "fp", *extra]):
            pair, block, h, size, fp, *more = (x.to_numpy(zero_copy_only=False) for x in arrays)
            fp = fp.view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            for s, e in zip(first.tolist(), np.append(first[1:], len(pair)).tolist(), strict=True):
                x, y = divmod(int(pair[s]), 1 << 31)
                left, right = (s + np.flatnonzero(block[s:e] == z) for z in (x, y))
                if not len(left) or not len(right):
                    continue
                right = right[np.argsort(_mix(h[right].view(np.uint64)), kind="stable")]  # hubs first, the same for all
                place = np.arange(len(left))
                if x == y:
                    left = right
                if again:
                    place = place[more[0][left]]
                held = Probe(fp[right], parts, PROBED) if len(place) else None
                for at in range(0, len(place), AT_ONCE):
                    own = place[at : at + AT_ONCE]
                    is_, js, n = [], [], 0
                    for i, j in held.near(fp[left[own]]):
                        i = own[i]
                        p, q = left[i], right[j]
                        ok = np.minimum(size[p], size[q]) >= threshold * np.maximum(size[p], size[q]) - _EPS
                        if x == y:
                            ok &= j < i
                        if again:
                            ok &= more[1][p] != more[1][q]
                        is_.append(i[ok])
                        js.append(j[ok])
                        n += len(is_[-1])
                        if n > Probe.LIMIT:
                            i, j = np.concatenate(is_), np.concatenate(js)
                            if again:
                                yield record(schema, np.minimum(h[left[i]], h[right[j]]), np.maximum(h[left[i]], h[right[j]]))
                                is_, js, n = [], [], 0
                            else:
                                i, j, *_ = fewer(i, j)
                                is_, js, n = [i], [j], 0
                    if not is_ or not len(i := np.concatenate(is_)):
                        continue
                    j = np.concatenate(js)
                    if not again:
                        i, j, rank, count = fewer(i, j)
                        many = np.unique(i[count > SMALL])
                        ok = (count <= SMALL) | (rank < HUBS)
                        i, j = i[ok], j[ok]
                        if len(many):
                            yield record(schema, h[left[many]], pa.nulls(len(many), pa.int64()))
                    yield record(schema, np.minimum(h[left[i]], h[right[j]]), np.maximum(h[left[i]], h[right[j]]))

    return run


def _meeting(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Without the (a, b) whose prefixes share nothing, which can't be similar; no text is moved for these."""
    both = pairs
    for c in ("a", "b"):
        both = both.join(vertices.select(F.col("h").alias(c), F.col("prefix").alias(f"prefix_{c}")), c)
    return both.filter(F.arrays_overlap("prefix_a", "prefix_b")).select("a", "b")


def probed(vertices: DataFrame, rows: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): set hashes that connect all similar sets whose fingerprints differ in PROBED bits at most."""
    spark = rows.sparkSession
    own = vertices.filter("size > 0").select("h", "size", "fp")
    counts = {c: n for c, n in own.groupBy(_classes(threshold).alias("c")).count().collect()}  # by the logarithm of a size: a few dozen
    n = sum(counts.values())
    most = min(BLOCK, max(LEAST_BLOCK, n // 16))
    blocks = [-(-counts.get(c, 1) // most) for c in range(max(counts, default=0) + 1)]
    parts = plan(sampled(own, n, PLANNED), min(n, most), PROBED, PROBED_COST)
    tasks = sum(b * (b + 1) // 2 + b * after for b, after in zip(blocks, [*blocks[1:], 0], strict=True))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(tasks, 2000))

    def candidates(sets: DataFrame, again: bool) -> DataFrame:
        return map_arrow(dealt(sets, blocks, threshold).repartition(tasks, "pair").sortWithinPartitions("pair"), _probe(parts, threshold, again), "a long, b long")

    found = written(candidates(own, False), "probed")
    pairs = written(found.filter("b is not null").distinct(), "pairs")
    near = written(verified(written(_meeting(pairs, vertices), "meeting"), vertices, rows, words, threshold), "links")
    many = found.filter("b is null").select(F.col("a").alias("h"), F.lit(True).alias("many")).distinct()
    if many.isEmpty():
        return near
    named = components(near).withColumnRenamed("node", "h")
    marked = own.join(many, "h", "left").join(named, "h", "left").withColumn("many", F.coalesce("many", F.lit(False))).withColumn("component", F.coalesce("component", "h"))
    left = written(candidates(marked, True).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    return near.unionByName(written(verified(written(_meeting(left, vertices), "meeting"), vertices, rows, words, threshold), "links"))


def _near(threshold: float):
    """Sorted (token, size, h, pos, fp) to candidates (a, b, token) beyond PROBED bits; a larger group gives those with its hubs, and its token alone."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in _groups(batches, "token", ["h", "size", "pos", "fp"]):
            token, h, size, pos, fp = (x.to_numpy() for x in arrays)
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            count = np.diff(np.append(first, len(token)))
            members = np.repeat(count, count)
            left, right = [], []
            for d in range(1, min(SMALL, len(token))):  # all small groups at once, rows d apart
                i = np.flatnonzero((members[:-d] <= SMALL) & (token[:-d] == token[d:]))
                if not len(i):
                    break
                left.append(i)
                right.append(i + d)
            large = count > SMALL
            for at, n in zip(first[large].tolist(), count[large].tolist(), strict=True):
                every = np.arange(at, at + n)
                for hub in at + np.argsort(_mix(h[every].view(np.uint64)), kind="stable")[:HUBS]:
                    left.append(np.minimum(hub, every))
                    right.append(np.maximum(hub, every))
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                ok = (i != j) & _beyond(fp, i, j) & _possible(size, pos, fp, i, j, threshold)
                i, j = h[i[ok]], h[j[ok]]
                pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1), axis=0)
                if len(pairs):
                    yield record(schema, pairs[:, 0], pairs[:, 1], pa.nulls(len(pairs), pa.int64()))
            if large.any():
                alone = pa.nulls(int(large.sum()), pa.int64())
                yield record(schema, alone, alone, token[first[large]])

    return run


def _across(threshold: float, limit: int = 50_000):
    """Sorted (token, size, h, pos, fp, component) to the candidates (a, b) of different components beyond PROBED bits."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, *rest in _groups(batches, "token", ["h", "size", "pos", "fp", "component"]):
            token = token.to_numpy()
            h, size, pos, fp, component = (x.to_numpy() for x in rest)
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            found, n = [], 0
            for s, e in zip(first.tolist(), np.append(first[1:], len(token)).tolist(), strict=True):
                names, of, count = np.unique(component[s:e], return_inverse=True, return_counts=True)
                if len(names) == 1:
                    continue
                every, main = np.arange(s, e), of == np.argmax(count)
                for x in np.flatnonzero(~main).tolist():  # with all of the largest component, and the others behind it
                    with_ = every[(of != of[x]) & (main | (every - s > x))]
                    i, j = np.minimum(s + x, with_), np.maximum(s + x, with_)
                    ok = _beyond(fp, i, j) & _possible(size, pos, fp, i, j, threshold)
                    if ok.any():
                        a, b = h[i[ok]], h[j[ok]]
                        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
                        n += len(a)
                    if n > limit:
                        pairs = np.unique(np.concatenate(found), axis=0)
                        yield record(schema, pairs[:, 0], pairs[:, 1])
                        found, n = [], 0
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield record(schema, pairs[:, 0], pairs[:, 1])

    return run


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT else df


def verified(pairs: DataFrame, vertices: DataFrame, rows: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(vertices.select("h", "first.k"), "h"), "wanted")
    one = rows.select("k", "text").join(_sent(wanted.select("k")), "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    texts = written(wanted.join(one, "k").select("h", "text"), "texts")
    joined = pairs.join(texts.select(F.col("h").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("h").alias("b"), F.col("text").alias("text_b")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last: list[tuple] = [(None, None), (None, None)]
            found = []
            for x, y, *both in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True):
                for side, (name, text) in enumerate(zip((x, y), both, strict=True)):
                    if last[side][0] != name:
                        last[side] = name, shingles(text.encode("utf-8", "surrogatepass"), words)
                if similar(last[0][1], last[1][1], threshold):
                    found.append((x, y))
            if found:
                yield record(schema, *zip(*found, strict=True))

    return map_arrow(joined.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def links(vertices: DataFrame, rows: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): set hashes that connect all sets of the threshold's similarity or more."""
    close = probed(vertices, rows, words, threshold)
    return close.unionByName(distant(vertices, rows, close, words, threshold))


def distant(vertices: DataFrame, rows: DataFrame, close: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): set hashes that connect the similar sets beyond PROBED bits which the links ``close`` leave apart."""
    keys = vertices.select("h", "size", "fp", F.posexplode("prefix").alias("pos", "token"))
    order = ["token", "size", "h"]
    found = written(map_arrow(keys.repartition("token").sortWithinPartitions(*order), _near(threshold), "a long, b long, token long"), "candidates")
    named = written(components(close), "components")
    pairs = found.filter("a is not null").select("a", "b").distinct()
    for c in ("a", "b"):
        pairs = pairs.join(named.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left")
    pairs = written(pairs.filter("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b"), "pairs")
    near = written(verified(pairs, vertices, rows, words, threshold), "links")
    large = written(found.filter("token is not null").select("token"), "large")
    if large.isEmpty():
        return near
    if not near.isEmpty():
        named = components(close.unionByName(near))
    named = named.withColumnRenamed("node", "h")
    left = keys.join(_sent(large), "token", "left_semi").join(named, "h", "left").withColumn("component", F.coalesce("component", "h"))
    more = map_arrow(left.repartition("token").sortWithinPartitions(*order), _across(threshold), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    more = written(more, "pairs")
    return near.unionByName(written(verified(more, vertices, rows, words, threshold), "links"))


def keep_first(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near-duplicates: of each component the text of the smallest doc_id stays, once. Rows with a null id stay and remove nothing."""
    rows = _rows(docs, id_col, text_col)
    table = written(sets(rows.filter("doc_id is not null"), words, threshold), "sets")
    vertices = written(table.groupBy("h").agg(F.min(F.struct("doc_id", "k")).alias("first"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix")), "vertices")
    found = components(links(vertices, rows, words, threshold))
    classed = vertices.select("h", "first").join(found, F.col("h") == F.col("node"), "left").select("first", F.coalesce("component", "h").alias("class"))
    kept = classed.groupBy("class").agg(F.min("first").alias("first")).select("first.doc_id", "first.k")
    columns = docs.columns
    own, of, many, key = unused(columns, "__id", "__kept", "__many", "__k")
    repeated = table.groupBy("doc_id", "k").count().filter("count > 1").select("doc_id", "k", F.lit(True).alias(many))
    kept = written(kept.join(repeated, ["doc_id", "k"], "left").select(F.col("doc_id").alias(own), F.col("k").alias(of), F.coalesce(many, F.lit(False)).alias(many)), "kept")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    match = (F.col(id_col).cast("long") == F.col(own)) & (F.col(key) == F.col(of))
    out = keyed.join(kept.filter(~F.col(many)), match, "left").filter(F.col(id_col).cast("long").isNull() | F.col(own).isNotNull()).select(*columns)
    kept = kept.filter(many)
    if kept.isEmpty():
        return out
    return out.unionByName(keyed.join(kept, match).dropDuplicates([own, key]).select(*columns))
