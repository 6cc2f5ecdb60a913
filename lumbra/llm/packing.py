"""Harmonic packing of token ids into sequences.

A document is tokenized and ends with the end id. As many whole sequences as fit are cut from it; the rest is a piece of class k if its length lies
in (capacity / (k + 1), capacity / k]. A bin of class k takes exactly k pieces, so every worker fills its bins by
counting, without knowing of others and without a shuffle. A rest far below its class's reciprocal would leave its bins padded; it is cut where that
costs less than the padding: a table by length (:func:`cuts`) weighs a cut as CUT tokens of padding, so that a
rest becomes about two pieces and bins are padded by half a percent.

The bins that are still open at a partition's end are put one behind the other and cut into whole sequences, and what is left into sequences of
1, 2, 4, ... ids, whose lengths are powers of two and need no padding.

Null and empty texts are one piece of the end id. Null doc_ids are packed as others. Repeated rows are packed each. Extra columns are ignored. An empty table gives no pieces. Sequence ids hold the
partition's number in their upper half. They are reproducible as long as the input's partitions are.

Ids are those of the tokenizer's library. It drops white space and joins no characters across it, so a text is
split at ASCII white space and each distinct word of a batch is encoded once. The library takes 15 microseconds for
a rare word; words of plain letters are therefore merged by the same vocabulary for a whole batch in numpy, and
tests hold the ids against the library's. See :class:`WordIds`.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import chunks, keyed_texts, map_arrow, record

CAPACITY = 2048
END = 1
#: Tokens of padding that a cut is worth.
CUT = 16
#: A word of Latin-1 letters, and punctuation behind it: the tokenizer lower-cases and splits between the two.
PLAIN = "^(?P<a>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<b>[.,;:!?*#%&$|]*)$"
#: Bytes of a run of letters that the merges below take; longer ones go to the library.
LETTERS = 48
#: Encoded runs of punctuation and odd words that a worker keeps; the cache starts anew beyond.
CACHE_WORDS = 200_000
_NONE = np.int32(1 << 30)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Byte-pair merges of many words at once: in each round every word merges its lowest-ranked pair, the leftmost of equals."""

    BITS = 18

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text())["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + end] for x in letters], np.int32)
        self.vocab = len(vocab)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.vocab + vocab[b] for a, b in pairs], np.int64)
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.value = np.full(1 << self.BITS, _NONE, np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.probes = 1
        at = self._slot(keys)
        for rank, (slot, key) in enumerate(zip(at.tolist(), keys.tolist(), strict=True)):
            n = 1
            while self.keys[slot] >= 0:
                slot, n = (slot + 1) & (1 << self.BITS) - 1, n + 1
            self.keys[slot], self.value[slot] = key, rank
            self.probes = max(self.probes, n)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NONE; symbols below 0 are no symbols."""
        keys = left.astype(np.int64) * self.vocab + right
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.value[slot], _NONE)
        open_ = np.flatnonzero((out == _NONE) & (self.keys[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (1 << self.BITS) - 1
            here = self.keys[slot[open_]]
            hit = here == keys[open_]
            out[open_[hit]] = self.value[slot[open_[hit]]]
            open_ = open_[~hit & (here >= 0)]
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one behind the other; ids of each word) of words that lie in ``data``."""
        counts = np.zeros(len(sizes), np.int64)
        found = []
        edges = [0, 6, 9, 12, 16, 24, LETTERS]
        for low, high in zip(edges, edges[1:], strict=False):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows):
                symbols = self._group(data, starts[rows], sizes[rows], high)
                counts[rows] = (symbols >= 0).sum(1)
                found.append((rows, symbols))
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        for rows, symbols in found:
            have = symbols >= 0
            at = (ends[rows] - counts[rows])[:, None] + np.arange(symbols.shape[1])
            out[at[have]] = symbols[have]
        return out, counts

    def _group(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
        cols = np.arange(width)
        inside = cols < sizes[:, None]
        raw = data[np.where(inside, starts[:, None] + cols, 0)]
        symbols = np.where(inside, self.inner[raw], np.int32(-1))
        n = np.arange(len(sizes))
        symbols[n, sizes - 1] = self.last[raw[n, sizes - 1]]
        ranks = np.full(symbols.shape, _NONE, np.int32)
        ranks[:, :-1] = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(n), -1)
        out, rows = symbols.copy(), n
        while True:
            best = ranks.argmin(1)
            low = ranks[np.arange(len(rows)), best]
            go = low < _NONE
            if not go.all():
                out[rows[~go]] = symbols[~go]
                rows, symbols, ranks, best, low = rows[go], symbols[go], ranks[go], best[go], low[go]
            if not len(rows):
                return out
            i = np.arange(len(rows))
            move = np.minimum(cols + (cols > best[:, None]), width - 1)
            keep = np.take_along_axis(symbols, move, 1)
            keep[:, -1] = -1
            keep[i, best] = self.made[low]
            ranks = np.take_along_axis(ranks, move, 1)
            ranks[:, -1] = _NONE
            after = np.where(best + 1 < width, keep[i, np.minimum(best + 1, width - 1)], -1)
            ranks[i, best] = self.rank(keep[i, best], after)
            inner = np.flatnonzero(best > 0)
            ranks[inner, best[inner] - 1] = self.rank(keep[inner, best[inner] - 1], keep[inner, best[inner]])
            symbols = keep


class WordIds:
    """text -> ids: each distinct word of a batch is encoded once, words of plain letters by :class:`Merges` and all others by the library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.merges = Merges(path)
        self.odd: dict[str, np.ndarray] = {"": np.zeros(0, np.uint32)}

    def _odd(self, words: list[str]) -> list[np.ndarray]:
        new = [w for w in words if w not in self.odd]
        found = {w: np.array(e.ids, np.uint32) for w, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True)}
        out = [found[w] if w in found else self.odd[w] for w in words]
        if len(self.odd) + len(new) > CACHE_WORDS:
            self.odd = {"": np.zeros(0, np.uint32)}
        self.odd.update((w, x) for w, x in found.items() if len(w) <= LETTERS)
        return out

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        codes = split.flatten().dictionary_encode()
        words = codes.dictionary
        found = pc.extract_regex(words, PLAIN)
        plain = pc.is_valid(found)
        letters = pc.utf8_lower(pc.fill_null(pc.struct_field(found, "a"), ""))
        plain = np.asarray(pc.and_(plain, pc.less_equal(pc.binary_length(letters), LETTERS)))
        runs = pc.if_else(pa.array(plain), letters, "").dictionary_encode()
        tails = pc.if_else(pa.array(plain), pc.struct_field(found, "b"), words).dictionary_encode()
        own = runs.dictionary
        if own.offset or own.type != pa.string():
            own = pa.concat_arrays([own.cast(pa.string())])
        _, offsets, data = own.buffers()
        offsets = np.frombuffer(offsets, np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        flat, sizes = self.merges.encode(data, offsets[:-1], np.diff(offsets))
        odd = self._odd(tails.dictionary.to_pylist())
        flat = np.concatenate([flat, *odd])
        sizes = np.concatenate([sizes, np.fromiter(map(len, odd), np.int64, len(odd))])
        starts = np.cumsum(sizes) - sizes
        # each word is a run of letters and a tail
        pair = np.stack([runs.indices.to_numpy(zero_copy_only=False).astype(np.int64), tails.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(own)], 1)
        index = pair[codes.indices.to_numpy(zero_copy_only=False)].ravel()
        counts = sizes[index]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[index] - (ends - counts), counts) + np.arange(total)]
        offsets = split.offsets.to_numpy()
        bounds = np.concatenate([[0], ends])[2 * (offsets - offsets[0])]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


#: One to a worker process; it outlives the task.
_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


@cache
def cuts(capacity: int = CAPACITY, cut: int = CUT) -> list[tuple[int, ...]]:
    """By length below the capacity, the lengths of its pieces. Dynamic programming: a piece costs ``cut`` tokens, and the padding that it leaves in its class's share of a bin."""
    costs, plan = [0.0], [()]
    slots = sorted({capacity // k for k in range(2, capacity + 1) if capacity // k >= cut}, reverse=True)
    for n in range(1, capacity):
        best = cut + capacity / (capacity // n) - n, (n,)
        for own in slots:
            if own < n:
                cost = cut + capacity / (capacity // own) - own + costs[n - own]
                if cost < best[0]:
                    best = cost, (own, *plan[n - own])
        costs.append(best[0])
        plan.append(best[1])
    return plan


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Whole sequences first, then the pieces of the rest."""
    return [capacity] * (n // capacity) + list(cuts(capacity)[n % capacity])


#: (doc_id, start, ids, the document's ids)
Piece = tuple[int | None, int, np.ndarray, int]


class Bins:
    """The open bins of one worker: by class, the pieces that don't fill one yet."""

    def __init__(self, first: int, capacity: int = CAPACITY) -> None:
        self.next, self.capacity = first, capacity
        self.open: dict[int, list[Piece]] = {}

    def _sequence(self, pieces: list[Piece]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, size in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.tobytes()), size, self.next, offset, ids
            offset += len(ids)
        self.next += 1

    def add(self, piece: Piece) -> Iterator[tuple]:
        k = self.capacity // len(piece[2])
        held = self.open.setdefault(k, [])
        held.append(piece if k == 1 else (*piece[:2], piece[2].copy(), piece[3]))  # a view would keep its whole document
        if len(held) == k:
            yield from self._sequence(held)
            self.open[k] = []

    def close(self) -> Iterator[tuple]:
        rest = [p for _, held in sorted(self.open.items()) for p in held][::-1]
        self.open = {}
        left = sum(len(p[2]) for p in rest)
        while left:
            room = self.capacity if left >= self.capacity else 1 << left.bit_length() - 1
            left -= room
            own = []
            while room:
                doc_id, start, ids, size = rest.pop()
                if len(ids) > room:
                    rest.append((doc_id, start + room, ids[room:], size))
                    ids = ids[:room]
                own.append((doc_id, start, ids, size))
                room -= len(ids)
            yield from self._sequence(own)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = re.findall(r"(\w+) long", PIECES)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece; ``with_ids`` adds the piece's ids."""
    path = path or tokenizer_path()
    schema = pa.schema([*((n, pa.int64()) for n in _NAMES), *([("ids", pa.list_(pa.int64()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from lumbra.llm.packing import word_ids

        words = word_ids(path)
        bins = Bins(TaskContext.get().partitionId() << 32, capacity)
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            out = record(schema, *columns[:7], *([[x.tolist() for x in columns[7]]] if with_ids else []))
            rows.clear()
            return out

        for whole in batches:
            for part in chunks([whole]):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), words.batch(part.column("text")), strict=True):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    at = 0
                    for length in piece_lengths(len(ids), capacity):
                        rows.extend(bins.add((doc_id, at, ids[at : at + length], len(ids))))
                        at += length
                        if len(rows) >= 20_000:
                            yield flush()
        rows.extend(bins.close())
        if rows:
            yield flush()

    return map_arrow(keyed_texts(docs, id_col, text_col), run, PIECES + (", ids array<long>" if with_ids else ""))
