"""Line dedup: fuzzy lines by MinHash.

Each distinct line gives a signature of BANDS x ROWS one-permutation MinHash values of its character shingles. Lines that share a band form a bucket;
equal buckets of several bands count once. Within a bucket the exact Jaccard similarity of the shingle sets decides, and
a spanning forest of the links goes to distributed union-find (:mod:`components`). Of each component, and of each set of equal
lines, the first occurrence by (doc_id, line number) stays.

A line that a task has met before is not hashed again there. Bands by which too many different lines meet are found on a hash sample and dealt
out as pairs of blocks, so that no task gathers a hot bucket. Texts are moved for lines that meet another one only: a bitmap of their
hashes, of bounded size, sorts out the others where they lie.

Blank lines are kept and compared with nothing. Lines shorter than a shingle are one shingle. Null texts are one blank line. Rows with the same doc_id count
as one document; lines of rows with a null doc_id are kept and remove nothing. Lines are known by 96-bit hashes; within a bucket
the texts decide. Extra columns are kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, join_unique, key_filter, keyed_texts, map_arrow, map_texts, passes, record, unused, written
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 6
#: A band key is hot above this many lines, as a sample of 1 in SAMPLED lines tells; it is dealt out in blocks of half as many.
HOT, SAMPLED = 4096, 16
#: Characters whose shingles are hashed at once; hashes that a task remembers.
AT_ONCE, SEEN = 128 << 10, 400_000
_P, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_EMPTY = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _A
    x ^= x >> np.uint64(29)
    x *= _B
    return x ^ (x >> np.uint64(32))


def shingle_hashes(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all lines' shingles, one behind the other, and their number by line."""
    text = "".join(lines)
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    if not len(cp):
        return np.zeros(0, np.uint64), np.zeros(len(lines), np.int64)
    h = np.zeros(len(cp), np.uint64)
    padded = np.concatenate([cp, np.zeros(size, np.uint64)])
    for j in range(size):
        h = h * _P + padded[j : j + len(cp)]
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    starts = np.cumsum(lengths) - lengths
    ends = np.cumsum(counts)
    at = np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]))
    out = h[at]
    for i in np.flatnonzero((lengths > 0) & (lengths < size)).tolist():  # its own characters alone
        out[ends[i] - 1] = xxhash.xxh3_64_intdigest(lines[i].encode("utf-8", "surrogatepass"))
    return _mix(out), counts


def signatures(lines: list[str], bins: int = BANDS * ROWS, size: int = SHINGLE) -> np.ndarray:
    """(lines, bins) one-permutation MinHash; an empty bin takes the next full one's value, told apart by the distance."""
    h, counts = shingle_hashes(lines, size)
    sig = np.full(len(lines) * bins, _EMPTY, np.uint64)
    where = np.repeat(np.arange(len(lines)) * bins, counts) + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, where, h)
    sig = sig.reshape(len(lines), bins)
    holes = np.flatnonzero((sig == _EMPTY).any(1) & (counts > 0))
    if len(holes):
        own = sig[holes]
        at = np.where(own == _EMPTY, 4 * bins, np.arange(bins))
        at = np.concatenate([at, at + bins], 1)
        nxt = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1][:, :bins]
        sig[holes] = np.take_along_axis(own, nxt % bins, 1) + _mix((nxt - np.arange(bins)).astype(np.uint64)) * (nxt != np.arange(bins))
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(lines, bands) 64-bit keys."""
    n, bins = sig.shape
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    part = sig.reshape(n, bands, bins // bands)
    for j in range(bins // bands):
        key = _mix(key * _P + part[:, :, j])
    return key


def line_ids(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each line's hash."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(x.encode("utf-8", "surrogatepass")) for x in lines]), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 1], (both[:, 0] & np.uint64(2**32 - 1)).astype(np.uint32)


def _split(text: str) -> list[str]:
    return text.split("\n")


def occurrences(rows: DataFrame) -> DataFrame:
    """(h, g, doc_id, no) of every line that is not blank, in documents with an id."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("doc_id", pa.int64()), ("no", pa.int32())])

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [(doc, no, line) for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) if doc is not None for no, line in enumerate(_split(text)) if line and not line.isspace()]
        if not found:
            return None
        doc, no, lines = zip(*found, strict=True)
        h, g = line_ids(lines)
        return record(schema, h.view(np.int64), g.view(np.int32), doc, no)

    return map_texts(rows, run, "h long, g int, doc_id long, no int")


class _Fresh:
    """The different lines of a task's batches; one that was met before is left out, as long as SEEN hashes hold it."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, part: pa.RecordBatch, keep=None) -> tuple[np.ndarray, np.ndarray, list[str]]:
        lines = list({line for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) if doc is not None for line in _split(text) if line and not line.isspace()})
        h, g = line_ids(lines)
        if keep is not None:
            at = np.flatnonzero(keep(h))
            h, g, lines = h[at], g[at], [lines[i] for i in at.tolist()]
        new = [i for i, x in enumerate(h.tolist()) if x not in self.seen]
        if len(self.seen) > SEEN:
            self.seen = set()
        self.seen.update(h.tolist())
        return h[new], g[new], [lines[i] for i in new]


def _keys(lines: list[str]) -> np.ndarray:
    """The band keys of all lines, a bounded number of characters at a time."""
    out, at, size = [], 0, 0
    for i, line in enumerate(lines):
        if size and size + len(line) > AT_ONCE:
            out.append(band_keys(signatures(lines[at:i])))
            at, size = i, 0
        size += len(line)
    return np.concatenate([*out, band_keys(signatures(lines[at:]))])


def bands(rows: DataFrame, one_in: int = 1, deal=None) -> DataFrame:
    """(key, h) of every line, about once for each task that holds it; ``one_in``: of a sample of lines by hash; ``deal``: what becomes of (keys, hashes)."""
    schema = pa.schema([("key", pa.int64()), ("h", pa.int64())])
    fresh = _Fresh()
    keep = (lambda h: h % np.uint64(one_in) == 0) if one_in > 1 else None

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        h, _, lines = fresh(part, keep)
        if not lines:
            return None
        key, h = _keys(lines).ravel().view(np.int64), np.repeat(h, BANDS).view(np.int64)
        return record(schema, *(deal(key, h) if deal else (key, h)))

    return map_texts(rows, run, "key long, h long")


def line_texts(rows: DataFrame, only: np.ndarray) -> DataFrame:
    """(h, g, line) of the different lines that pass a bitmap."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("line", pa.string())])
    fresh = _Fresh()
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        h, g, lines = fresh(part, lambda h: passes(shared.value, h))
        return record(schema, h.view(np.int64), g.view(np.int32), lines) if lines else None

    return map_texts(rows, run, "h long, g int, line string").repartition("h").groupBy("h", "g").agg(F.first("line").alias("line"))


def _groups(batches: Iterator[pa.RecordBatch], key: str, fields: list[str]) -> Iterator[tuple]:
    """The complete groups of batches sorted by ``key``, many at a time: (key, *fields) arrays without a group cut in two."""
    held: list[pa.RecordBatch] = []  # of one key

    def whole(parts: list[pa.RecordBatch]) -> tuple:
        t = pa.Table.from_batches(parts)
        return tuple(t.column(c).combine_chunks() for c in (key, *fields))

    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        if held and k[0] == k[-1] == held[0].column(key)[0].as_py():
            held.append(b)
            continue
        last = int(np.searchsorted(k, k[-1], "left"))
        if held and k[0] != held[0].column(key)[0].as_py() and not last:
            yield whole(held)
            held = []
        elif last:
            yield whole([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield whole(held)


def _once(key: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of rows in order, those that differ from the one before."""
    out = np.ones(len(key), bool)
    out[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
    return out


#: Hot keys that every task holds; more are joined by a shuffle.
HELD = 100_000


def _dealer(keys: np.ndarray, blocks: np.ndarray):
    """Deals out the rows of hot keys: a row goes to each pair of blocks that its own is in, under a key of the pair's."""

    def deal(key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hot = keys[at] == key
        if not hot.any():
            return key, h
        many = blocks[at[hot]]
        other = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        own = np.repeat((_mix(h[hot].view(np.uint64)) % many.astype(np.uint64)).astype(np.int64), many)
        pair = np.stack([np.minimum(own, other), np.maximum(own, other)]).astype(np.uint64)
        dealt = _mix(_mix(np.repeat(key[hot].view(np.uint64), many) + pair[0] * _P) + pair[1] * _P).view(np.int64)
        return np.concatenate([key[~hot], dealt]), np.concatenate([h[~hot], np.repeat(h[hot], many)])

    return deal


def dealt_bands(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The bands of all lines, with those of hot keys (key, blocks) dealt out as pairs of blocks."""
    n = hot.count()  # a row for each HOT different lines at most
    if not n:
        return bands(rows)
    if n <= HELD:
        names = hot.orderBy("key").toArrow()
        return bands(rows, deal=_dealer(names.column("key").to_numpy(), names.column("blocks").to_numpy()))
    found = bands(rows)
    block = F.pmod(F.xxhash64("h"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.xxhash64("key", F.least(x, block), F.greatest(x, block)))
    return found.join(hot, "key", "left_anti").unionByName(found.join(hot, "key").select(F.explode(pairs).alias("key"), "h"))


def buckets(rows: DataFrame) -> DataFrame:
    """(bucket, h): lines that share a band; a bucket's name is made of its members, so equal buckets are one."""
    sampled = bands(rows, SAMPLED).distinct().groupBy("key").count().filter(F.col("count") > HOT // SAMPLED)
    hot = written(sampled.select("key", F.ceil(F.col("count") * SAMPLED / (HOT // 2)).cast("long").alias("blocks")), "hot")
    dealt = dealt_bands(rows, hot)
    schema = pa.schema([("bucket", pa.int64()), ("h", pa.int64())])

    def run(batches):
        seen: set[int] = set()
        for key, h in _groups(batches, "key", ["h"]):
            key, h = key.to_numpy(), h.to_numpy()
            order = np.lexsort((h, key))
            key, h = key[order], h[order]
            once = _once(key, h)  # a line comes once from each task that holds it
            key, h = key[once], h[once]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            name = np.add.reduceat(_mix(h.view(np.uint64)), first) + size.astype(np.uint64)
            many = size > 1
            new = np.array([many[i] and x not in seen for i, x in enumerate(name.tolist())], bool) if many.any() else many
            if len(seen) < 200_000:
                seen.update(name[many].tolist())
            _, at = np.unique(name, return_index=True)
            new &= np.isin(np.arange(len(name)), at)
            take = np.repeat(new, size)
            if take.any():
                yield record(schema, np.repeat(name, size)[take].view(np.int64), h[take])

    return map_arrow(dealt.repartition("key").sortWithinPartitions("key"), run, "bucket long, h long").distinct()


def forest(lines: list[str], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Edges between indices of a spanning forest of all links by exact Jaccard similarity: every line is compared with all that its tree has not reached yet."""
    return _forest(shingle_sets(lines), threshold)


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    h, counts = shingle_hashes(lines)
    ends = np.cumsum(counts).tolist()
    out = []
    for e, c in zip(ends, counts.tolist(), strict=True):
        own = np.sort(h[e - c : e])
        new = np.empty(c, bool)
        new[:1] = True
        np.not_equal(own[1:], own[:-1], out=new[1:])
        out.append(own[new])
    return out


def _forest(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    if len(sets) == 2:
        a, b = sets
        n = len(a) + len(b)
        if min(len(a), len(b)) < threshold * max(len(a), len(b)):
            return []
        both = np.sort(np.concatenate(sets))
        k = int(np.count_nonzero(both[1:] == both[:-1]))
        return [(0, 1)] if k >= threshold * (n - k) - 1e-9 else []
    sizes = np.array([len(s) for s in sets])
    left = np.arange(len(sets))
    edges = []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            near = left[(np.minimum(sizes[left], sizes[i]) >= threshold * np.maximum(sizes[left], sizes[i]))]
            if not len(near):
                continue
            own = np.concatenate([sets[j] for j in near.tolist()])
            at = np.minimum(np.searchsorted(sets[i], own), len(sets[i]) - 1)
            both = np.add.reduceat((sets[i][at] == own).astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
            hit = near[both >= threshold * (sizes[i] + sizes[near] - both) - 1e-9]
            edges += [(i, j) for j in hit.tolist()]
            front += hit.tolist()
            left = left[~np.isin(left, hit)]
    return edges


LINKS = "ah long, ag int, bh long, bg int"


def links(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(ah, ag, bh, bg): the hashes of lines, as links that connect all lines found similar."""
    members = written(buckets(rows), "buckets")
    wanted = members.select("h").distinct()
    texts = line_texts(rows, key_filter(wanted, "h", members.count()))
    schema = pa.schema([("ah", pa.int64()), ("ag", pa.int32()), ("bh", pa.int64()), ("bg", pa.int32())])

    def run(batches):
        for bucket, h, g, line in _groups(batches, "bucket", ["h", "g", "line"]):
            key, h, g, line = bucket.to_numpy(), h.to_pylist(), g.to_pylist(), line.to_pylist()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends, found, size = np.append(first[1:], len(key)), [], 0
            at = 0  # buckets whose lines are hashed together
            for k, e in enumerate(ends.tolist()):
                size += sum(map(len, line[first[k] : e]))
                if size < AT_ONCE and k < len(ends) - 1:
                    continue
                low = int(first[at])
                sets = shingle_sets(line[low:e])
                for s, t in zip(first[at : k + 1].tolist(), ends[at : k + 1].tolist(), strict=True):
                    found += [(h[s + i], g[s + i], h[s + j], g[s + j]) for i, j in _forest(sets[s - low : t - low], threshold)]
                at, size = k + 1, 0
            if found:
                yield record(schema, *zip(*found, strict=True))

    return map_arrow(members.join(texts, "h").repartition("bucket").sortWithinPartitions("bucket"), run, LINKS)


def classes(found: DataFrame) -> DataFrame:
    """Written links to (h, g, class): a number for each component, of lines with a link."""
    nodes = written(found.select(F.explode(F.array(F.struct(F.col("ah").alias("h"), F.col("ag").alias("g")), F.struct(F.col("bh").alias("h"), F.col("bg").alias("g")))).alias("x")).select("x.*").distinct().withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = found.join(nodes.selectExpr("h as ah", "g as ag", "node as a"), ["ah", "ag"]).join(nodes.selectExpr("h as bh", "g as bg", "node as b"), ["bh", "bg"]).select("a", "b")
    return nodes.join(components(edges), "node").select("h", "g", F.col("component").alias("class"))


def removed(docs: DataFrame, threshold: float = THRESHOLD, **columns: str) -> DataFrame:
    """(doc_id, no) of every line that goes, as an earlier one of its component stays in its place."""
    rows = keyed_texts(docs, **columns)
    named = classes(written(links(rows, threshold), "links"))
    every = written(occurrences(rows), "lines")
    firsts = every.groupBy("h", "g").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count(F.lit(1)).alias("n"))
    classed = written(firsts.join(named, ["h", "g"], "left").filter("n > 1 or class is not null"), "classed")
    alone = classed.filter("class is null").select("h", "g", "first")
    near = classed.filter("class is not null")
    kept = near.groupBy("class").agg(F.min("first").alias("kept"))
    stays = written(alone.unionByName(near.join(kept, "class").select("h", "g", F.col("kept").alias("first"))), "stays")
    return join_unique(every, stays, ["h", "g"]).filter(F.struct("doc_id", "no") != F.col("first")).select("doc_id", "no")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each document: its lines, how many of them are removed, and their numbers from 0."""
    count = keyed_texts(docs, id_col, text_col).select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n"), F.lit(None).cast("int").alias("no"))
    gone = removed(docs, id_col=id_col, text_col=text_col, **options).select("doc_id", F.lit(0).cast("long").alias("n"), "no")
    return count.unionByName(gone).groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.count("no").alias("n_removed"), F.sort_array(F.collect_list("no")).alias("removed_lines"))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the removed lines; all rows and columns stay, and a text may become empty."""
    columns = docs.columns
    own, gone = unused(columns, "__id", "__gone")
    cut = removed(docs, id_col=id_col, text_col=text_col, **options).groupBy(F.col("doc_id").alias(own)).agg(F.collect_list("no").alias(gone))
    joined = docs.join(cut, docs[id_col].cast("long") == F.col(own), "left").select(*[docs[c] for c in columns], gone)

    def run(batches):
        for whole in batches:
            for b in chunks([whole], text_col):
                texts = []
                for text, lost in zip(b.column(text_col).to_pylist(), b.column(gone).to_pylist(), strict=True):
                    if text is not None and lost:
                        out = set(lost)
                        text = "\n".join(x for i, x in enumerate(_split(text)) if i not in out)
                    texts.append(text)
                yield b.drop_columns([gone]).set_column(columns.index(text_col), text_col, pa.array(texts, pa.string()))

    return map_arrow(joined, run, docs.schema)
