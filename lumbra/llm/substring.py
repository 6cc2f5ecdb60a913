"""Substring dedup by sliding sentence spans.

A text is split into sentences; one of more than LONG words is cut behind words whose hash is the least within REACH words, so that cuts depend on
the words around them alone and not on where a passage lies. From each sentence starts a run of at least RUN consecutive sentences
and WORDS words; its 96-bit hash is joined globally. Of each repeated run the first by (doc_id, offset) stays, and all sentences
covered by any other are removed.

Hashes alone are counted first; a bitmap of the repeated ones, of bounded size, then lets the runs that repeat and few others go on. First runs come from a pre-aggregated group, and meet the rows of a very common run in all tasks; no group is gathered in one.

Sentences are compared as their words, without case. Where words are longer than 20 characters in the mean (scripts without spaces) 6 characters count as a word.
Null and empty texts have no runs. Rows with the same doc_id count as one document, which is its own first; rows with a null doc_id are
left alone. Repeated rows lose the same spans. Offsets are code points. Extra columns are kept by remove, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks, drop_written, join_unique, key_filter, keyed_texts, map_texts, passes, record, unused, written

RUN, WORDS, LONG, REACH = 3, 24, 12, 2
SENTENCE = re.compile(r"[^.!?\n\u3002\uff01\uff1f]*+[.!?\n\u3002\uff01\uff1f]*+")
WORD = re.compile(r"\S+")
#: Words beyond which a sentence is cut in any case: only the same words again and again come so far.
LONGEST = 48


def _cuts(words: list[str]) -> list[int]:
    """Behind how many words a long sentence is cut."""
    h = [xxhash.xxh32_intdigest(w) for w in words]
    out, last = [], 0
    for i in range(REACH, len(h) - REACH):
        if h[i] < min(h[i - REACH : i]) and h[i] <= min(h[i + 1 : i + 1 + REACH]) or i + 1 - last >= LONGEST:
            last = i + 1
            out.append(last)
    return out


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence that has words."""
    out = []
    for m in SENTENCE.finditer(text):
        words = m.group().lower().split()
        if not words:
            continue
        start, end = m.span()
        if len(words) > LONG and (cuts := _cuts(words)):
            ends = [w.end() for w in WORD.finditer(text, start, end)]
            at = 0
            for c in cuts:
                out.append((start, ends[c - 1], words[at:c]))
                start, at = ends[c - 1], c
            words = words[at:]
        out.append((start, end, words))
    return out


def _size(words: list[str]) -> int:
    letters = sum(map(len, words))
    return len(words) if letters <= 20 * len(words) else letters // 6


def runs(text: str, run: int = RUN, words: int = WORDS) -> Iterator[tuple[bytes, int, int]]:
    """(hash, start, end) of the shortest sufficient run from each sentence."""
    parts = sentences(text)
    if len(parts) < run:
        return
    digest = xxhash.xxh3_128_digest
    keys = [digest(" ".join(w).encode("utf-8", "surrogatepass")) for _, _, w in parts]
    sizes = [_size(w) for _, _, w in parts]
    for i in range(len(parts) - run + 1):
        j, n = i + run, sum(sizes[i : i + run])
        while n < words and j < len(parts):
            n += sizes[j]
            j += 1
        if n < words:
            return
        yield digest(b"".join(keys[i:j])), parts[i][0], parts[j - 1][1]


def _hashes(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each hash."""
    both = np.frombuffer(b"".join(found), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 1], (both[:, 0] & np.uint64(2**32 - 1)).astype(np.uint32)


RUNS = "h long, g int, doc_id long, start int, end int"


def repeated(docs: DataFrame, run: int = RUN, words: int = WORDS, **columns: str) -> DataFrame:
    """(doc_id, start, end, first_doc): every repeated run but the first, and the document that keeps it."""
    rows = keyed_texts(docs, **columns).filter("doc_id is not null")
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def find(part: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [(key, doc, s, e) for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for key, s, e in runs(text, run, words)]
        if not found:
            return None
        keys, doc, s, e = zip(*found, strict=True)
        h, g = _hashes(keys)
        return record(schema, h.view(np.int64), g.view(np.int32), doc, s, e)

    every = written(map_texts(rows, find, RUNS), "runs")
    many = written(every.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "many")
    marked = rows.sparkSession.sparkContext.broadcast(key_filter(many, "h", many.count()))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(passes(marked.value, b.column("h").to_numpy().view(np.uint64))))

    table = written(every.mapInArrow(again, RUNS), "repeated")
    drop_written(every)
    first = table.groupBy("h", "g").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "g", "first")
    return join_unique(table, first, ["h", "g"]).filter(F.struct("doc_id", "start") != F.col("first")).select("doc_id", "start", "end", F.col("first.doc_id").alias("first_doc"))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


REMOVED = "doc_id long, removed_spans string, n_spans int, removed_chars long, kept_in array<long>"


def report(docs: DataFrame, **options) -> DataFrame:
    """A row for each document that loses sentences: the removed spans (start:end, comma-joined), their number and length, and the documents that keep what is removed."""
    schema = pa.schema([("doc_id", pa.int64()), ("removed_spans", pa.string()), ("n_spans", pa.int32()), ("removed_chars", pa.int64()), ("kept_in", pa.list_(pa.int64()))])
    spans = repeated(docs, **options).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"), F.sort_array(F.collect_set("first_doc")).alias("kept_in"))

    def merge(batches):
        for b in batches:
            found = [_merged(x) for x in b.column("spans").to_pylist()]
            yield record(schema, b.column("doc_id"), [",".join(f"{s}:{e}" for s, e in x) for x in found], [len(x) for x in found], [sum(e - s for s, e in x) for x in found], b.column("kept_in"))

    return spans.mapInArrow(merge, REMOVED)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated sentences cut out of the text; all rows and columns stay."""
    columns = docs.columns
    own, at = unused(columns, "__id", "__spans")
    spans = report(docs, id_col=id_col, text_col=text_col, **options).select(F.col("doc_id").alias(own), F.col("removed_spans").alias(at))
    schema = docs.schema
    joined = docs.join(spans, docs[id_col].cast("long") == F.col(own), "left").select(*[docs[c] for c in columns], at)
    bound_batches(docs.sparkSession)

    def cut(batches):
        for whole in batches:
            for b in chunks([whole], text_col):
                texts = []
                for text, cuts in zip(b.column(text_col).to_pylist(), b.column(at).to_pylist(), strict=True):
                    if text is not None and cuts:
                        for s, e in reversed([tuple(map(int, x.split(":"))) for x in cuts.split(",")]):
                            text = text[:s] + text[e:]
                    texts.append(text)
                i = columns.index(text_col)
                yield b.drop_columns([at]).set_column(i, text_col, pa.array(texts, pa.string()))

    return joined.mapInArrow(cut, schema)
