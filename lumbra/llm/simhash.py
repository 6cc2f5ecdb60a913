"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: by bit, the majority of the XXH64 hashes of a text's word shingles. Equal fingerprints are one vertex.
A bounded sample gives the correlation of bits and the odds that two fingerprints differ in few bits
of a group. Correlated bits are grouped into partitions; thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 are allotted by dynamic programming
on the estimated cost of signatures and candidates, for 2 to 5 partitions, and the cheapest plan is taken. Two fingerprints within
the radius agree up to t_i bits in some partition i, so probing each partition with all values within t_i finds every link.
Fingerprints that share a bucket are verified by exact distance; a bucket gives the edges of a spanning forest, not all pairs, and
a bucket above HOT rows is dealt out as pairs of blocks. Components follow from :mod:`components`.
A wide radius has too many signatures to be sent about: there :class:`Probe` looks them up in memory, in pairs of blocks of bounded size.

A text without words (null, empty, white space) has fingerprint zero. Rows with a null doc_id get a fingerprint and the component of
the other rows that share it, or null. Repeated rows are one vertex. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, map_arrow, map_texts, record, written
from .components import components

SEED = 42
BITS = 64
#: Fingerprints in the sample from which the plan is made.
SAMPLE = 3000
#: Rows of a bucket that one task compares; larger ones are dealt out in blocks.
HOT = 2048
#: Cost of a candidate pair against that of a signature row.
PAIR_COST = 0.02


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the unsigned hashes."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 32_768):
        votes += np.unpackbits(hashes[at : at + 32_768].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint(raw: bytes, words: int = 4, seed: int = SEED) -> int:
    """``raw``: UTF-8. The fingerprint as an unsigned integer."""
    parts = raw.lower().split()  # bytes: A-Z alone, ASCII white space alone
    if not parts:
        return 0
    text = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    ends = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    return majority(np.fromiter((digest(text[s:e], seed) for s, e in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n))


def fingerprints(docs: DataFrame, words: int = 4, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x, words, seed) for x in part.column("text").cast(pa.binary()).to_pylist()], np.uint64)
        return record(schema, part.column("doc_id"), fps.view(np.int64))

    return map_texts(keyed_texts(docs, id_col, text_col), run, "doc_id long, fp long")


# --- the plan


def bits_of(fps: np.ndarray) -> np.ndarray:
    """Signed longs to (n, 64) bits, highest first."""
    return np.unpackbits(fps.astype(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def group_bits(bits: np.ndarray, groups: int) -> list[list[int]]:
    """Bits into ``groups`` partitions of nearly equal size; each is filled with what correlates most with it."""
    x = bits.astype(float) - bits.mean(0)
    scale = np.sqrt((x * x).sum(0)) + 1e-9
    c = np.abs((x.T @ x) / np.outer(scale, scale))
    free, out = set(range(BITS)), []
    for g in range(groups):
        size = (BITS - sum(map(len, out))) // (groups - g)
        rest = sorted(free)
        own = [max(rest, key=lambda i: c[i, rest].sum())]
        while len(own) < size:
            free -= {own[-1]}
            own.append(max(sorted(free), key=lambda i: c[i, own].sum()))
        free -= set(own)
        out.append(sorted(own))
    return out


def odds(bits: np.ndarray, group: list[int], most: int) -> list[float]:
    """By t up to ``most``: the estimated chance that two different fingerprints differ in at most t bits of the group. The larger of the sampled share and that of independent bits."""
    p = bits[:, group].mean(0)
    differ = 2 * p * (1 - p)
    dist = np.zeros(most + 2)
    dist[0] = 1
    for d in differ:
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    free = np.cumsum(dist[: most + 1])
    own = bits[:, group].astype(np.float32)
    n = len(own)
    if n < 2:
        return free.tolist()
    ones = own.sum(1)
    d = ones[:, None] + ones[None] - 2 * own @ own.T
    near = [((d <= t + 0.5).sum() - n) / (n * (n - 1)) for t in range(most + 1)]
    return [max(a, b) for a, b in zip(near, free.tolist(), strict=True)]


def signatures(size: int, t: int) -> int:
    out = term = 1
    for k in range(1, t + 1):
        term = term * (size - k + 1) // k
        out += term
    return out


def allot(costs: list[list[float]], total: int) -> tuple[float, list[int]] | None:
    """Dynamic programming: thresholds t_i = -1, 0, ... with sum(t_i + 1) = total of least cost; costs[i][t] for t >= 0. None if they can't reach the total."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for k in range(total - used + 1):
                if k <= len(own):
                    c = cost + (own[k - 1] if k else 0.0)
                    if used + k not in new or c < new[used + k][0]:
                        new[used + k] = (c, [*ts, k - 1])
        best = new
    return best.get(total)


def plan(sample: np.ndarray, n: int, radius: int, pair_cost: float = PAIR_COST) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed."""
    bits = bits_of(sample) if len(sample) else np.zeros((1, BITS), np.uint8)
    n = max(n, 1000)  # with next to no rows the fewest signatures are the cheapest
    found = None
    for m in range(2, radius + 2):
        groups = group_bits(bits, m)
        most = radius - m + 2  # as much as one partition can get while others get little
        costs = []
        for g in groups:
            chance = odds(bits, g, min(most, 3))
            costs.append([n * (1 + signatures(len(g), t)) + pair_cost * chance[t] * n * n / 2 for t in range(min(most, 3) + 1)])
        best = allot(costs, radius + 1)
        if best and (found is None or best[0] < found[0]):
            found = best[0], [(g, t) for g, t in zip(groups, best[1], strict=True) if t >= 0]
    return found[1]


def sampled(vertices: DataFrame, n: int, most: int = SAMPLE) -> np.ndarray:
    """The fingerprints of the bounded sample: those of least hash, the same on every run."""
    share = min(1.0, 2 * most / max(n, 1))
    order = F.xxhash64("fp").bitwiseAND(F.lit((1 << 31) - 1))
    pick = vertices.withColumn("o", order).filter(F.col("o") < int(share * (1 << 31))) if share < 1 else vertices.withColumn("o", order)
    return np.sort(np.array([r[0] for r in pick.orderBy("o", "fp").limit(most).select("fp").collect()], np.int64))


# --- probing and verifying


def _masks(group: list[int], t: int) -> tuple[int, list[int]]:
    """The group's bits as a mask, and all flips of up to t of them, as signed longs."""
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    one = [1 << (BITS - 1 - b) for b in group]
    return signed(sum(one)), [signed(sum(c)) for k in range(t + 1) for c in combinations(one, k)]


class Probe:
    """The partitions of a plan over fingerprints that one task holds, for a radius whose signatures are looked up and not sent."""

    #: Signatures and candidates that are at hand at once, about.
    LIMIT = 1 << 18

    def __init__(self, fps: np.ndarray, parts: list[tuple[list[int], int]], radius: int) -> None:
        self.radius, self.parts = radius, []
        for group, t in parts:
            value = self.values(fps, group)
            order = np.argsort(value, kind="stable")
            first = np.searchsorted(value[order], np.arange((1 << len(group)) + 1))
            one = [1 << k for k in range(len(group))]
            flips = np.array([sum(c) for k in range(t + 1) for c in combinations(one, k)], np.int64)
            mask = np.uint64(sum(1 << (BITS - 1 - b) for b in group))
            self.parts.append((group, t, mask, flips, first, order, fps[order]))

    @staticmethod
    def values(fps: np.ndarray, group: list[int]) -> np.ndarray:
        """The bits of the group as a number."""
        out = np.zeros(len(fps), np.int64)
        for b in group:
            out = out << 1 | (fps >> np.uint64(BITS - 1 - b) & np.uint64(1)).astype(np.int64)
        return out

    def near(self, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All places (i, j) at which own[i] and a held fingerprint j differ in ``radius`` bits at most, each once, in slices."""
        for k, (group, _, _, flips, first, order, fps) in enumerate(self.parts):
            value = self.values(own, group)
            step = max(1, self.LIMIT // max(1, len(own)))
            for f in range(0, len(flips), step):
                probes = flips[f : f + step]
                key = (value[:, None] ^ probes[None]).ravel()
                start = first[key]
                count = first[key + 1] - start
                some = np.flatnonzero(count)
                row, start, count = some // len(probes), start[some], count[some]
                ends = np.cumsum(count)
                at = 0
                while at < len(some):
                    done = int(ends[at - 1]) if at else 0
                    to = max(at + 1, int(np.searchsorted(ends, done + self.LIMIT, "right")))
                    n = count[at:to]
                    i = np.repeat(row[at:to], n)
                    j = np.arange(len(i)) + np.repeat(start[at:to] - (ends[at:to] - n - done), n)
                    differ = own[i] ^ fps[j]
                    ok = np.flatnonzero(np.bitwise_count(differ) <= self.radius)
                    for _, t, mask, *_ in self.parts[:k]:  # pairs of an earlier partition came with that
                        ok = ok[np.bitwise_count(differ[ok] & mask) > t]
                    if len(ok):
                        yield i[ok], order[j[ok]]
                    at = to


def spanning(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The edges of a spanning forest of all links between the given fingerprints: every one is compared with all that its tree has not reached yet."""
    left = np.arange(len(fps))
    edges = []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= radius
            if near.any():
                hit = left[near].tolist()
                edges += [(i, j) for j in hit]
                front += hit
                left = left[~near]
    return edges


class Forest:
    """Union-find that passes on only edges that join two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _verify(radius: int, small: int = 24):
    """Rows sorted by bucket (part, value, i, j) to edges (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> Iterator[tuple[int, int]]:
        """All rows of each bucket at hand; key: bucket numbers in order."""
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        size = np.repeat(sizes, sizes)
        for d in range(1, small):  # small buckets: rows d apart, all buckets at once
            i = np.flatnonzero((size[:-d] > d) & (size[:-d] <= small) & (key[:-d] == key[d:])) if d < len(key) else []
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
            yield from zip(rep[i].tolist(), rep[i + d].tolist(), strict=True)
        for at, n in zip(first[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            own, back = np.unique(fp[at : at + n], return_index=True)
            ids = rep[at : at + n][back]
            yield from ((int(ids[x]), int(ids[y])) for x, y in spanning(own.view(np.uint64), radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, found, held = Forest(), [], None
        names = ("part", "value", "i", "j", "fp", "rep")

        def take(rows: dict, final: bool):
            """Complete buckets are verified; what may go on in the next batch is kept."""
            n = len(rows["fp"])
            new = np.zeros(n, bool)
            new[0] = True
            for c in ("part", "value", "i", "j"):
                new[1:] |= rows[c][1:] != rows[c][:-1]
            cut = n if final else int(np.flatnonzero(new)[-1])
            if cut:
                key = np.cumsum(new[:cut])
                found.extend((a, b) for a, b in links(key, rows["fp"][:cut].view(np.uint64), rows["rep"][:cut]) if a != b and forest.join(a, b))
            return {c: rows[c][cut:] for c in names}

        for b in batches:
            if not b.num_rows:
                continue
            rows = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in names}
            held = take(rows, False)
            if len(found) >= 50_000:
                yield record(schema, *zip(*found, strict=True))
                found.clear()
            if len(forest.up) > 500_000:
                forest.up.clear()
        if held is not None and len(held["fp"]):
            take(held, True)
        if found:
            yield record(schema, *zip(*found, strict=True))

    return run


def links(vertices: DataFrame, radius: int = 4) -> DataFrame:
    """Distinct (fp, rep) to edges (a, b) of reps that connect all fingerprints within the radius of each other."""
    n = vertices.count()
    probes = [(*_masks(g, t),) for g, t in plan(sampled(vertices, n), n, radius)]
    key = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(flip)).alias("value"), F.lit(flip == 0).alias("own")) for k, (mask, flips) in enumerate(probes) for flip in flips])
    rows = vertices.filter("rep is not null").select("fp", "rep", F.explode(key).alias("k")).select("k.part", "k.value", "k.own", "fp", "rep")
    # a bucket counts if it has an owner of the value and another row
    full = rows.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("owned")).filter("n > 1 and owned")
    full = full.select("part", "value", F.ceil(F.col("n") / HOT).cast("int").alias("blocks"))
    both = rows.drop("own").join(full, ["part", "value"])
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, block).alias("i"), F.greatest(x, block).alias("j")))
    )
    dealt = both.select("part", "value", "fp", "rep", F.explode(pairs).alias("p")).select("part", "value", "p.i", "p.j", "fp", "rep")
    keys = ["part", "value", "i", "j"]
    return map_arrow(dealt.repartition(*keys).sortWithinPartitions(*keys), _verify(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable, itself included)."""
    table = written(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    vertices = written(table.groupBy("fp").agg(F.min("doc_id").alias("rep")), "vertices")
    found = components(written(links(vertices, radius), "links"))
    named = vertices.join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return table.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near-duplicates by a similarity of word shingles: of each component one row of the text with the smallest doc_id stays.

    Candidates are the fingerprints within a wide radius, by the same plan of partitions and thresholds; the exact similarity decides. The few similar
    texts beyond that radius come from prefix filtering, so that none is missed (:mod:`nearcopies`)."""
    from .nearcopies import keep_first as kept

    return kept(docs, words, similarity, id_col, text_col)
