"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans, which a seeded generator sets into invented prose: emails written with
brackets, phones without a country code, cards and addresses with odd separators. Texts are cut into overlapping windows; each is decoded by
Viterbi, and a character takes the tag of the window in whose middle it lies most. Decoded spans are reconciled over the whole
text: an email goes on to the ends of its names, a number to the ends of its digits, however many windows they cross; what
overlaps becomes one span. A span counts if it has the form of its kind (:func:`valid`) and touches no base span. Every such span holds one of TRIGGERS,
so only windows that hold one and their neighbours are decoded, all others being far from any; a text is searched whole, however long it is.

Training takes about a minute of one core in the driver, once in a process, and gives the same weights for the same seed; the weights are some
20 KB and go to the tasks with the function.

Null texts are empty and have no spans. Null doc_ids are kept. Repeated rows give equal rows. Extra columns are ignored. An empty table gives no rows.
Of equal spans of two kinds the first kind in the order of KINDS counts.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_texts, map_texts, record

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. An email is found from its @: the part before it is taken back to the last match.
AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(ord(d) - 48 for d in digits[-1::-2]) + sum(2 * (ord(d) - 48) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def byte_parts(parts: list[str]) -> bool:
    return all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order of start and kind; code points."""
    found = []
    last = 0
    for m in AT.finditer(text) if "@" in text else ():
        at = start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            found.append((start, 0, m.end()))
            last = m.end()
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if byte_parts(m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- the model

#: Tags: 0 outside, 1 + 2 kind begins, 2 + 2 kind continues.
TAGS = 1 + 2 * len(KINDS)
CODES = 100  # printable ASCII as they are, then other letters, other white space, other characters
WINDOW, STRIDE = 64, 32
TRIGGERS = "0123456789@([{"


def codes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((cp >= 32) & (cp < 127), cp - 31, np.where((cp >= 192) & (cp < 0x250), 96, np.where(cp < 32, 97, 98)))
    return out.astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Tagger:
    """Embedding, an LSTM in each direction, a linear layer to emissions, CRF transitions."""

    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator, embed: int = 10, hidden: int = 14) -> Tagger:
        w = {"emb": rng.normal(0, 0.3, (CODES, embed)), "out": rng.normal(0, 0.2, (2 * hidden, TAGS)), "bias": np.zeros(TAGS), "trans": rng.normal(0, 0.1, (TAGS, TAGS)), "first": np.zeros(TAGS)}
        for d in "fb":
            w[f"{d}x"] = rng.normal(0, 0.3, (embed, 4 * hidden))
            w[f"{d}h"] = rng.normal(0, 0.2, (hidden, 4 * hidden))
            w[f"{d}c"] = np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])  # forget gates open
        return Tagger({k: v.astype(np.float32) for k, v in w.items()})

    def _lstm(self, e: np.ndarray, d: str, keep: bool):
        """e: (T, n, E); gates in order forget, input, output, candidate."""
        steps, n, _ = e.shape
        hid = self.w[f"{d}h"].shape[0]
        x = e @ self.w[f"{d}x"] + self.w[f"{d}c"]
        h, c = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
        out, saved = np.empty((steps, n, hid), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = x[t] + h @ self.w[f"{d}h"]
            gates, cand = _sigmoid(z[:, : 3 * hid]), np.tanh(z[:, 3 * hid :])
            before = c, h
            c = gates[:, :hid] * c + gates[:, hid : 2 * hid] * cand
            tc = np.tanh(c)
            h = gates[:, 2 * hid :] * tc
            out[t] = h
            if keep:
                saved.append((t, gates, cand, tc, *before))
        return out, saved

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x: (n, T) codes to (T, n, TAGS)."""
        e = self.w["emb"][x.T]
        f, sf = self._lstm(e, "f", keep)
        b, sb = self._lstm(e, "b", keep)
        h = np.concatenate([f, b], 2)
        return h @ self.w["out"] + self.w["bias"], (e, h, sf, sb)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The CRF's mean negative log-likelihood and its derivatives, by backpropagation through time."""
        em, (e, h, sf, sb) = self.emissions(x, keep=True)
        steps, n, _ = em.shape
        trans, tags = self.w["trans"], y.T
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha[0] = em[0] + self.w["first"]
        for t in range(1, steps):
            alpha[t] = em[t] + lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        gold = self.w["first"][tags[0]] + np.take_along_axis(em, tags[:, :, None], 2).sum((0, 2)) + trans[tags[:-1], tags[1:]].sum(0)
        marginal = np.exp(alpha + beta - total[:, None])
        d_em = marginal.copy()
        np.put_along_axis(d_em, tags[:, :, None], np.take_along_axis(d_em, tags[:, :, None], 2) - 1, 2)
        d_em /= n
        g = {"first": d_em[0].sum(0)}
        pair = np.exp(alpha[:-1, :, :, None] + trans + (em[1:] + beta[1:])[:, :, None, :] - total[:, None, None]).sum((0, 1))
        np.subtract.at(pair, (tags[:-1], tags[1:]), 1)
        g["trans"] = pair / n
        flat_h, flat_d = h.reshape(-1, h.shape[2]), d_em.reshape(-1, TAGS)
        g["out"], g["bias"] = flat_h.T @ flat_d, flat_d.sum(0)
        d_h = d_em @ self.w["out"].T
        d_e = np.zeros_like(e)
        hid = h.shape[2] // 2
        for d, saved, part in (("f", sf, d_h[:, :, :hid]), ("b", sb, d_h[:, :, hid:])):
            wh, dh, dc = self.w[f"{d}h"], np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
            dz_all, gh = np.empty((steps, n, 4 * hid), np.float32), np.zeros_like(wh)
            for t, gates, cand, tc, c0, h0 in reversed(saved):
                dh = dh + part[t]
                fg, ig, og = gates[:, :hid], gates[:, hid : 2 * hid], gates[:, 2 * hid :]
                dc = dc + dh * og * (1 - tc * tc)
                dz = dz_all[t]
                dz[:, :hid] = dc * c0 * fg * (1 - fg)
                dz[:, hid : 2 * hid] = dc * cand * ig * (1 - ig)
                dz[:, 2 * hid : 3 * hid] = dh * tc * og * (1 - og)
                dz[:, 3 * hid :] = dc * ig * (1 - cand * cand)
                gh += h0.T @ dz
                dh, dc = dz @ wh.T, dc * fg
            g[f"{d}h"], g[f"{d}c"] = gh, dz_all.sum((0, 1))
            g[f"{d}x"] = e.reshape(-1, e.shape[2]).T @ dz_all.reshape(-1, 4 * hid)
            d_e += dz_all @ self.w[f"{d}x"].T
        g["emb"] = np.zeros_like(self.w["emb"])
        np.add.at(g["emb"], x.T.ravel(), d_e.reshape(-1, e.shape[2]))
        return float((total - gold).mean()), g

    def decode(self, x: np.ndarray) -> np.ndarray:
        """(n, T) codes to the best tags by Viterbi; a span's inside follows its own kind only."""
        em, _ = self.emissions(x)
        steps, n, _ = em.shape
        trans = self.w["trans"] + _FORBIDDEN
        score = em[0] + self.w["first"] + np.where(np.arange(TAGS) % 2 == 0, -1e4, 0) * (np.arange(TAGS) > 0)
        back = np.empty((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            both = score[:, :, None] + trans
            back[t] = both.argmax(1)
            score = em[t] + np.take_along_axis(both, back[t][:, None, :].astype(np.int64), 1)[:, 0]
        out = np.empty((steps, n), np.int8)
        out[-1] = score.argmax(1)
        i = np.arange(n)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = back[t][i, out[t]]
        return out.T


_FORBIDDEN = np.zeros((TAGS, TAGS), np.float32)
for _k in range(len(KINDS)):
    _FORBIDDEN[:, 2 + 2 * _k] = -1e4
    _FORBIDDEN[1 + 2 * _k, 2 + 2 * _k] = _FORBIDDEN[2 + 2 * _k, 2 + 2 * _k] = 0


_SYLLABLES = "the an ing er re on at en nd ti es or te of ed is it al ar st to nt ha se ou io le de co me ro ri hi ch us ra la na que ment tion é è ß ü ñ ó".split()


def _prose(rng: Random, n: int) -> str:
    words = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w.capitalize() if (r := rng.random()) < 0.1 else w + "." if r < 0.2 else w + "," if r < 0.25 else w for w in words)


def _digits(rng: Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _card(rng: Random, n: int) -> str:
    head = _digits(rng, n - 1)
    return next(head + str(k) for k in range(10) if luhn(head + str(k)))


def _instance(rng: Random) -> tuple[int, str]:
    """A span of personal data: its kind and how it is written."""
    kind = rng.randrange(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(2, 12)))
    if kind == 0:
        name = word() + rng.choice(("", "." + word(), _digits(rng, 2), "_" + word(), "-" + word() + "." + word()))
        at, dot = rng.choice((("@", "."), (" @ ", "."), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), ("{at}", "."), (" [at] ", ".")))
        return kind, name + at + word() + rng.choice(("", dot + word())) + dot + rng.choice(("com", "org", "net", "de", "fr", "edu", "io"))
    if kind == 1:
        return kind, rng.choice((".", " . ", "[.]", "(.)")).join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        d = _card(rng, rng.choice((12, 13, 14, 15, 16, 16, 16, 16, 17, 18, 19)))
        return kind, rng.choice(("", " ", "-", ".", "  ", "/")).join(d[i : i + 4] for i in range(0, len(d), 4))
    a, b, c, d = (_digits(rng, n) for n in (3, 3, 4, 2))
    e = _digits(rng, rng.randint(5, 8))
    return kind, rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"00{d} {a} {b} {c}", f"+{d} {a} {b} {c}", f"(0{d}) {e}", f"(0{a}) {e}", f"00{d} {d} {e}"))


def _noise(rng: Random) -> str:
    """Digits and brackets that are no personal data."""
    d = lambda n: _digits(rng, n)
    return rng.choice((d(rng.randint(1, 7)), f"({d(2)})", f"{d(2)}.{d(2)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"v{d(1)}.{d(1)}.{d(2)}", "(see " + _prose(rng, 2) + ")", f"[{d(1)}]", 'token = "' + "".join(rng.choices("0123456789abcdef", k=40)) + '"'))


def labelled(rng: Random, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n windows with their tags."""
    x, y = np.zeros((n, WINDOW), np.uint8), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        text = _prose(rng, rng.randint(0, 4)) + " "
        tags = [0] * len(text)
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.75:
                kind, span = _instance(rng)
                tags += [1 + 2 * kind] + [2 + 2 * kind] * (len(span) - 1)
            else:
                span = _noise(rng)
                tags += [0] * len(span)
            more = " " + _prose(rng, rng.randint(1, 4)) + " "
            text, tags = text + span + more, tags + [0] * len(more)
        at = rng.randint(0, max(0, len(text) - WINDOW))
        part = codes(text)[at : at + WINDOW]
        own = tags[at : at + WINDOW]
        if own[0] and own[0] % 2 == 0:  # the window cuts a span: what is left begins here
            own[0] -= 1
        x[i, : len(part)], y[i, : len(part)] = part, own
    return x, y


@lru_cache(maxsize=2)
def trained(seed: int = 11, steps: int = 500, batch: int = 64) -> Tagger:
    """Adam on ``steps`` batches of fresh labelled windows; the same weights for the same seed."""
    rng = Random(seed)
    model = Tagger.fresh(np.random.default_rng(seed))
    m, v = ({k: np.zeros_like(x) for k, x in model.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        _, g = model.gradient(*labelled(rng, batch))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.02 * min(1.0, 5.0 / norm) * (1 if step < 0.6 * steps else 0.3)
        for k, x in g.items():
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            model.w[k] = (model.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


BRACKET_AT = re.compile(r"(?ai:\s*[(\[{]\s*at\s*[)\]}]\s*|\s*@\s*)")
BRACKET_DOT = re.compile(r"(?ai:\s*[(\[{]\s*(?:dot|\.)\s*[)\]}]\s*|\s*\.\s*)")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]{2,}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


def valid(kind: int, span: str) -> bool:
    """Whether a decoded span has the form of its kind, in any of the usual ways to write it."""
    if kind == 0:
        return len(BRACKET_AT.findall(span)) == 1 and bool(EMAIL.fullmatch(BRACKET_DOT.sub(".", BRACKET_AT.sub("@", span))))
    digits = "".join(DIGIT.findall(span))
    if kind == 1:
        parts = BRACKET_DOT.sub(".", span).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and byte_parts(parts)
    if kind == 2:
        return not any(c.isalpha() for c in span) and 12 <= len(digits) <= 19 and luhn(digits)
    if not (9 <= len(digits) <= 15 and re.fullmatch(r"(?a:\+?\(?\d[\d ().-]*\d)", span) and re.search(r"(?a:\d[ ().-]+\d)", span)):
        return False
    longest = max(map(len, re.findall(r"(?a:\d+)", span)))
    return longest <= (8 if span[0] in "(+" or span.startswith("00") else 4)  # long groups behind a prefix or an area code alone


#: What goes on an email's names to the right, from its end.
MORE = re.compile(r"(?ai:(?:[A-Za-z0-9-]|\.(?=[A-Za-z0-9])|\s*[(\[{]\s*(?:dot|\.)\s*[)\]}]\s*(?=[A-Za-z0-9]))*)")


def reconciled(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Decoded (start, kind, end) with their ends where their names or digits end, those that then overlap as one, and without those that have not the form of their kind."""
    out: list[tuple[int, int, int]] = []
    for a, kind, b in sorted(spans):
        if kind == 0:
            while a and text[a - 1] in LOCAL:
                a -= 1
            b = MORE.match(text, b).end()
            while a < b and text[a] in ".%+-":
                a += 1
        else:  # a number is taken whole
            while b < len(text) and text[b] in "0123456789":
                b += 1
            while a and text[a - 1] in "0123456789":
                a -= 1
        if out and out[-1][1] == kind and a < out[-1][2]:
            a, _, c = out.pop()
            b = max(b, c)
        out.append((a, kind, b))
    last, kept = 0, []
    for a, kind, b in out:
        if a >= last and a < b and valid(kind, text[a:b]):
            kept.append((a, kind, b))
            last = b
    return kept


def decoded_spans(texts: list[str], model: Tagger, everything: bool = False) -> list[list[tuple[int, int, int]]]:
    """By text the (start, kind, end) of the model's spans; all windows of the texts are decoded together. ``everything``: also those far from any trigger."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    marks = np.zeros(CODES, bool)
    marks[codes(TRIGGERS)] = True
    pieces, where = [], []  # windows, and (text, start)
    for k, text in enumerate(texts):
        if not text or not (everything or any(c in text for c in TRIGGERS)):
            continue
        x = codes(text)
        n = (len(x) - 1) // STRIDE + 1
        near = np.arange(n) if everything else np.unique(np.flatnonzero(marks[x]) // STRIDE)
        starts = near if everything else np.unique(np.clip(near[:, None] + np.arange(-2, 2), 0, n - 1))
        starts = starts * STRIDE
        padded = np.concatenate([x, np.zeros(WINDOW, np.uint8)])
        pieces.append(padded[starts[:, None] + np.arange(WINDOW)])
        where.append((k, len(x), starts))
    if not pieces:
        return found
    windows = np.concatenate(pieces)
    tags = np.concatenate([model.decode(windows[i : i + 2048]) for i in range(0, len(windows), 2048)])
    at = 0
    middle = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW)).astype(np.int8)
    for k, size, starts in where:
        own = tags[at : at + len(starts)]
        at += len(starts)
        if not own.any():
            continue
        best, depth = np.zeros(size + WINDOW, np.int8), np.full(size + WINDOW, -1, np.int8)
        for s, row in zip(starts.tolist(), own, strict=True):
            deeper = middle > depth[s : s + WINDOW]
            best[s : s + WINDOW][deeper] = row[deeper]
            depth[s : s + WINDOW][deeper] = middle[deeper]
        best = best[:size]
        kinds = np.where(best > 0, (best + 1) // 2, 0)
        begins = (best % 2 == 1) | (kinds != np.concatenate([[0], kinds[:-1]]))
        edges = np.flatnonzero(begins | (kinds == 0))
        decoded = []
        for a in np.flatnonzero(begins & (kinds > 0)).tolist():
            nxt = int(np.searchsorted(edges, a, "right"))
            b = int(edges[nxt]) if nxt < len(edges) else size
            span = texts[k][a:b]
            a, b = a + len(span) - len(span.lstrip()), b - (len(span) - len(span.rstrip(" \n.,;")))
            if a < b:
                decoded.append((a, int(kinds[a]) - 1, b))
        found[k] = reconciled(texts[k], decoded)
    return found


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """A row for each row of ``docs``; the n_ columns of kinds count base spans, n_added the model's own."""
    model = model or trained()
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
    tell = lambda rows: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        counts, digests, spans, added = ([], [], [], []), [], [], []
        for text, more in zip(texts, decoded_spans(texts, model), strict=True):
            base = base_spans(text)
            more = [m for m in more if not any(s < m[2] and e > m[0] for s, _, e in base)] if more else []
            for k in range(4):
                counts[k].append(sum(b[1] == k for b in base))
            digests.append(hashlib.sha256(tell(base).encode()).hexdigest())
            spans.append(tell(sorted([*base, *more])))
            added.append(len(more))
        return record(schema, part.column("doc_id"), *counts, digests, spans, added)

    return map_texts(keyed_texts(docs), run, FOUND)
