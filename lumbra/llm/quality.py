"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives FEATURES statistics of its characters, words and lines, transformed towards normal shape.
Class sums and sums of products are added up over all labelled training rows; from these come the class
means and covariances, shrunk towards the pooled covariance and its diagonal. The Cholesky factors and their inverses are
cached; the log-density difference of the two Mahalanobis distances gives the probability.

Null and empty texts have all statistics zero and get the score of that point. Labels, lang, source and
doc_id are no inputs of a score. Without labelled rows of both classes every score is the prior, 0.5. Rows with a null
doc_id are scored and never learnt from; repeated rows are scored each and learnt from each. Of a label given twice each counts. Extra
columns are kept by keep_good, whatever their names, and ignored else. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, key_filter, keyed_texts, map_arrow, map_texts, passes, record, unused

NAMES = ("length", "upper", "digit", "space", "newline", "stop", "comma", "bang", "symbol", "bar", "other", "word_length", "word_spread", "distinct", "top_word", "top_pair", "line_length", "repeat_lines", "short_words", "stop_ratio")
FEATURES = len(NAMES)
#: Byte classes: 0 lower, 1 upper, 2 digit, 3 space, 4 newline, 5 full stop, 6 comma, 7 ! and ?, 8 symbols, 9 bar, 10 brackets and quotes, 11 beyond ASCII.
_CLASS = np.full(256, 10, np.uint8)
_CLASS[128:] = 11
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\v\f\r", "\n", ".", ",;:", "!?", "#$%&*+<=>@\\^_~/", "|")):
    for _ch in _chars:
        _CLASS[ord(_ch)] = _i


def statistics(text: str) -> np.ndarray:
    out = np.zeros(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    if not words:
        return out
    n, w = len(raw), len(words)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=12)
    share = kinds / n
    lengths = np.fromiter(map(len, words), np.int64, w)
    ids: dict[str, int] = {}
    codes = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, w)
    top = np.bincount(codes).max()
    pairs = np.sort(codes[:-1] * len(ids) + codes[1:])
    twice = 0.0 if w < 2 else np.count_nonzero(pairs[1:] == pairs[:-1]) / (w + 60)
    lines = text.split("\n")
    root = lambda x: np.sqrt(max(x, 0.0))
    out[:] = (
        np.log1p(n), root(share[1]), root(share[2]), share[3], root(share[4]), root(share[5]), root(share[6]), root(share[7]), root(share[8]), root(share[9]), root(share[10]),
        np.log1p(lengths.mean()), np.log1p(lengths.std()), (len(ids) + 30) / (w + 30), root(top / (w + 30)), root(twice),
        np.log1p(n / len(lines)), (len(lines) - len(set(lines))) / (len(lines) + 10), np.count_nonzero(lengths <= 2) / w, np.log1p(w / (1 + kinds[5])),
    )
    return out


@dataclass
class Discriminant:
    """Two normal densities with equal priors; ``factors`` are the lower Cholesky factors of their covariances."""

    means: np.ndarray
    factors: np.ndarray
    prior: float = 0.0
    ready: bool = True
    inverses: np.ndarray = field(init=False)
    logs: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.inverses = np.stack([np.linalg.solve(f, np.eye(len(f))) for f in self.factors])
        self.logs = np.array([2 * np.log(np.diag(f)).sum() for f in self.factors])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), 0.5)
        density = [-0.5 * (((x - m) @ inv.T) ** 2).sum(1) - 0.5 * log for m, inv, log in zip(self.means, self.inverses, self.logs, strict=True)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0] + self.prior) / FLATTEN, -60, 60)))


#: Divides the log-density difference, so that scores spread over (0, 1): dependent statistics overstate the evidence.
FLATTEN = 8.0


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """``moments``: by class the count, the sums and the sums of products."""
    none = Discriminant(np.zeros((2, FEATURES)), np.stack([np.eye(FEATURES)] * 2), ready=False)
    if any(moments.get(c, (0,))[0] < 2 for c in (0, 1)):
        return none
    n = [moments[c][0] for c in (0, 1)]
    mean = [moments[c][1] / moments[c][0] for c in (0, 1)]
    cov = [moments[c][2] / moments[c][0] - np.outer(m, m) for c, m in zip((0, 1), mean, strict=True)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors = [np.linalg.cholesky((1 - shrink - ridge) * c + shrink * pooled + ridge * scale + 1e-9 * np.eye(FEATURES)) for c in cov]
    return Discriminant(np.stack(mean), np.stack(factors))


def held_out(doc_id: int | None, folds: int = 5) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5) -> Discriminant:
    """Sums over all labelled rows outside fold 0; the driver gets the 2 x (1 + F + F x F) sums alone."""
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    fold = F.crc32(F.col("doc_id").cast("string")) % folds != 0
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(fold)
    # statistics are taken of labelled texts alone: a bitmap of their ids, of bounded size, sorts out the others where they lie
    place = F.xxhash64("doc_id").alias("k")
    marked = spark.sparkContext.broadcast(key_filter(known.select(place), "k", known.count()))

    def features(part: pa.RecordBatch) -> pa.RecordBatch | None:
        part = part.filter(pa.array(passes(marked.value, part.column("k").to_numpy().view(np.uint64))))
        return record(schema, part.column("doc_id"), [statistics(t) for t in part.column("text").to_pylist()]) if part.num_rows else None

    rows = map_texts(keyed_texts(docs).filter("doc_id is not null").filter(fold).select("*", place), features, "doc_id long, x array<double>").join(known, "doc_id").select("y", "x")
    out = pa.schema([("y", pa.int32()), ("at", pa.int32()), ("v", pa.float64())])

    def sums(batches):
        total = {c: np.zeros((FEATURES + 1, FEATURES + 1)) for c in (0, 1)}
        for b in batches:
            y = np.asarray(b.column("y"))
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            x = np.hstack([np.ones((len(x), 1)), x])
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        for c, m in total.items():
            if m[0, 0]:
                yield record(out, np.full(m.size, c), np.arange(m.size), m.ravel())

    found = map_arrow(rows, sums, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    total = {c: np.zeros((FEATURES + 1) ** 2) for c in (0, 1)}
    for y, at, v in found:
        total[y][at] = v
    moments = {c: (m[0], m.reshape(FEATURES + 1, -1)[0, 1:], m.reshape(FEATURES + 1, -1)[1:, 1:]) for c, m in total.items()}
    return fit(moments)


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def classify(docs: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, score, predicted."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        ids = part.column("doc_id")
        s = model.score(np.stack([statistics(t) for t in part.column("text").to_pylist()]))
        return record(schema, ids, [held_out(i) for i in ids.to_pylist()], s, (s >= threshold).astype(np.int32))

    return map_texts(keyed_texts(docs), score, SCORES)


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    columns = docs.columns
    (text,) = unused(columns, "__text")

    def run(batches):
        for part in chunks(batches, text):
            s = model.score(np.stack([statistics(t) for t in part.column(text).to_pylist()]))
            yield part.drop_columns([text]).filter(pa.array(s >= threshold))

    return map_arrow(docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit(""))), run, docs.select(*columns).schema)
