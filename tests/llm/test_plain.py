"""Whole queries against plain versions, row by row; and tables with odd rows, clashing columns or none at all."""

from __future__ import annotations

import random
import re
import string
import struct
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from lumbra.llm import components as comp
from lumbra.llm import fingerprints, lines, media, mixing, packing, pii, quality, secretscan, simhash, substring
from lumbra.llm.common import join_unique, key_filter, passes
from test_operators import EDGE

M64 = (1 << 64) - 1


def frame(spark, rows, schema="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, schema)


# --- what the operators share


def test_bitmap_lets_all_marked_keys_pass(spark):
    keys = np.random.default_rng(0).integers(0, 2**64, 3000, dtype=np.uint64)
    df = frame(spark, [(int(x),) for x in keys[:1000].view(np.int64)], "h long")
    bitmap = key_filter(df, "h", 1000)
    assert passes(bitmap, keys[:1000]).all() and passes(bitmap, keys[1000:]).mean() < 0.12


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_with_hot_keys(spark, how):
    rows = frame(spark, [(0 if i < 1500 else i % 40, i) for i in range(2500)], "k long, v long")
    table = frame(spark, [(k, str(k)) for k in range(0, 30)], "k long, w string")
    want = Counter((k, v, str(k) if k < 30 else None) for k, v in ((0 if i < 1500 else i % 40, i) for i in range(2500)) if how == "left" or k < 30)
    assert Counter(tuple(r) for r in join_unique(rows, table, ["k"], how).select("k", "v", "w").collect()) == want


def test_components_with_giant_stars(spark):
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 2500)] + [(9000, i) for i in range(9001, 9003)] + [(20_000, i) for i in range(5000, 7200)]
    edges += [(i, i + 1) for i in range(30_000, 30_200)] + [(2400, 30_000)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    found = {r.node: r.component for r in comp.components(frame(spark, edges, "a long, b long")).collect()}
    assert found == {x: top(x) for x in up}


# --- substring


def plain_removed(rows):
    """By doc_id the (start, end) that go: all runs are gathered and compared as words."""
    runs = defaultdict(list)
    for doc, text in rows:
        parts = substring.sentences(text or "") if doc is not None else []
        for i in range(len(parts) - substring.RUN + 1):
            for j in range(i + substring.RUN, len(parts) + 1):
                if sum(substring._size(p[2]) for p in parts[i:j]) >= substring.WORDS:
                    runs[tuple(tuple(p[2]) for p in parts[i:j])].append((doc, parts[i][0], parts[j - 1][1]))
                    break
    gone = defaultdict(set)
    for found in runs.values():
        first = min(found)[:2]
        for doc, s, e in found:
            if (doc, s) != first:
                gone[doc].update(range(s, e))
    return gone


def test_substring_against_all_runs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    passages = [prose(n) for n in (51, 55, 60, 90)]
    rows = [(i, " ".join([prose(rng.randint(5, 60)), *([rng.choice(passages)] if rng.random() < 0.6 else []), prose(rng.randint(5, 60))])) for i in range(60)]
    rows += [(7, rows[7][1]), (90, rows[3][1]), (91, prose(40) + " " + passages[1] + " " + passages[1]), (None, passages[0]), (92, None), (93, ""), (94, "word " * 3000), *((i, t) for i, t, _ in EDGE)]
    want = {doc: x for doc, x in plain_removed(rows).items() if x}
    found = substring.report(frame(spark, rows, "doc_id long, text string")).collect()
    got = {r.doc_id: {x for span in r.removed_spans.split(",") for x in range(*map(int, span.split(":")))} for r in found}
    assert len(got) == len(found) and got == want and len(want) > 20
    assert all(r.removed_chars == len(got[r.doc_id]) and None not in r.kept_in for r in found)


# --- fingerprints


def mix64(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M64
    x ^= x >> 29
    x = x * 0xC4CEB9FE1A85EC53 & M64
    return x ^ x >> 33


def plain_sketch(text):
    base, n = 0x100000001B3, min(fingerprints.K, len(text))
    if not text:
        return "0000" * 64
    seen, parts = Counter(), defaultdict(list)
    for at in range(len(text) - n + 1):
        h = 0
        for c in text[at : at + n]:
            h = (h * base + ord(c)) & M64
        h = mix64(h)
        g = mix64((h + seen[h] * base) & M64)
        seen[h] += 1
        parts[g >> 58].append((g, at, h))
    out = []
    for s in range(64):
        own = sorted(sorted(parts[s])[: fingerprints.TUPLE], key=lambda x: x[1])
        value = 0
        for j in range(fingerprints.TUPLE):
            value = mix64((value * base + (own[j][2] if j < len(own) else 0) + j + 1) & M64)
        out.append(max(value & 0xFFFF, 1) if own else 0)
    return "".join(f"{x:04x}" for x in out)


def test_sketches_against_plain_ones(spark):
    rng = random.Random(1)
    texts = ["", "x", "ab" * 300, "é\U0001f600" * 40, *("".join(rng.choices("abc de", k=n)) for n in (9, 10, 11, 40, 700, 5000)), *("".join(rng.choices(string.ascii_letters + " ", k=n)) for n in (200, 3000))]
    found = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(frame(spark, [(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert found == {i: plain_sketch(t) for i, t in enumerate(texts)}
    rows = fingerprints.edited(frame(spark, [(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for r in rows:
        text, after = texts[r.doc_id], texts[r.doc_id - 1]
        new = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert (r.fingerprint, r.edited_fingerprint) == (plain_sketch(text), plain_sketch(new))
        parts = lambda x: [x[i : i + 4] for i in range(0, 256, 4)]
        for other, got in ((new, r.near_edited), (after, r.near_next)):
            both = [(a, b) for a, b in zip(parts(plain_sketch(text)), parts(plain_sketch(other)), strict=True) if (a, b) != ("0000", "0000")]
            assert got == (sum(a == b for a, b in both) / len(both) if both else 1.0)


# --- quality


def plain_statistics(text):
    words = text.split()
    if not words:
        return [0.0] * quality.FEATURES
    raw = text.encode()
    n, w = len(raw), len(words)
    count = lambda chars: sum(chr(b) in chars for b in raw if b < 128) / n
    lengths = [len(x) for x in words]
    mean = sum(lengths) / w
    spread = (sum((x - mean) ** 2 for x in lengths) / w) ** 0.5
    pairs = Counter(zip(words, words[1:], strict=False))
    twice = sum(k - 1 for k in pairs.values()) / (w + 60)
    rows = text.split("\n")
    other = sum(chr(b) not in string.ascii_letters + string.digits + " \t\v\f\r\n.,;:!?#$%&*+<=>@\\^_~/|" for b in raw if b < 128) / n
    log = lambda x: float(np.log1p(x))
    return [
        log(n), count(string.ascii_uppercase) ** 0.5, count(string.digits) ** 0.5, count(" \t\v\f\r"), count("\n") ** 0.5, count(".") ** 0.5, count(",;:") ** 0.5, count("!?") ** 0.5, count("#$%&*+<=>@\\^_~/") ** 0.5, count("|") ** 0.5, other**0.5,
        log(mean), log(spread), (len(set(words)) + 30) / (w + 30), (max(Counter(words).values()) / (w + 30)) ** 0.5, twice**0.5,
        log(n / len(rows)), (len(rows) - len(set(rows))) / (len(rows) + 10), sum(x <= 2 for x in lengths) / w, log(w / (1 + text.count("."))),
    ]


def test_quality_against_plain_statistics_and_sums(spark):
    rng = random.Random(2)
    good = lambda: ". ".join(" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(4, 30))) for _ in range(4))
    bad = lambda: "\n".join(rng.choice(["BUY!!! NOW", "a a a | b", "é$$$ %% 12", good()[:30]]) for _ in range(rng.randint(2, 20)))
    rows = [(i, good() if i % 2 else bad()) for i in range(300)]
    labels = [(i, i % 2) for i in range(300) if i % 7] + [(3, 1), (3, 1), (None, 1), (400, 0), (5, None)]
    for _, t in rows[:50]:
        assert np.allclose(quality.statistics(t), plain_statistics(t), atol=1e-12)
    docs = frame(spark, [*rows, (None, "none"), (8, rows[8][1]), (500, None)], "doc_id long, text string")
    model = quality.train(docs, frame(spark, labels, "doc_id long, quality int"))
    x = {c: [] for c in (0, 1)}
    for i, t in [*rows, (8, rows[8][1])]:
        for j, y in labels:
            if i == j and y is not None and zlib.crc32(str(i).encode()) % 5:
                x[y].append(plain_statistics(t))
    x = {c: np.array(v) for c, v in x.items()}
    assert np.allclose(model.means, [x[c].mean(0) for c in (0, 1)])
    cov = [np.cov(x[c].T, bias=True) for c in (0, 1)]
    pooled = (len(x[0]) * cov[0] + len(x[1]) * cov[1]) / (len(x[0]) + len(x[1]))
    for c in (0, 1):
        want = 0.88 * cov[c] + 0.1 * pooled + 0.02 * np.diag(np.maximum(np.diag(pooled), 1e-6)) + 1e-9 * np.eye(quality.FEATURES)
        assert np.allclose(model.factors[c] @ model.factors[c].T, want, atol=1e-9)
    scored = {r.doc_id: r.score for r in quality.classify(docs, model).collect()}
    density = lambda v, c: -0.5 * (v - model.means[c]) @ np.linalg.inv(model.factors[c] @ model.factors[c].T) @ (v - model.means[c]) - np.log(np.diag(model.factors[c])).sum()
    for i, t in rows[::17]:
        v = np.array(plain_statistics(t))
        want = 1 / (1 + np.exp(-np.clip((density(v, 1) - density(v, 0)) / quality.FLATTEN, -60, 60)))
        assert abs(scored[i] - want) < 1e-6


# --- mixing


def plain_targets(sizes, weights, total, cap):
    """Shares by weight; the excess over the caps is shared again, in exact fractions."""
    target, free = {}, dict(enumerate(sizes))
    while free:
        rest = Fraction(total) - sum(target.values())
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > cap * free[i]]
        if not over:
            return [float({**target, **share}[i]) for i in range(len(sizes))]
        for i in over:
            target[i] = Fraction(cap * free.pop(i))
    return [float(target[i]) for i in range(len(sizes))]


def test_water_level_against_exact_shares(spark):
    rng = random.Random(0)
    for sizes in ([10, 100, 5], [], [0, 0, 7], [1000, 1, 1, 1, 1], [rng.randint(0, 50) ** 3 for _ in range(40)]):
        rows = [(f"0s{i:03d}", 1, n) for i, n in enumerate(sizes)]
        plan = sorted(mixing.source_plan(frame(spark, rows, "__source string, __bin int, __sum long")).collect())
        want = plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], sum(sizes), 3)
        assert [r.target for r in plan] == pytest.approx(want, abs=1e-6) and len(plan) == len(sizes)


def test_mix_against_plain_repetition(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)) or None, rng.choice(["a", "b", "b", "b", "b", "Z", "é", None])) for i in range(400)]
    docs = frame(spark, [*rows, (5, rows[5][1], rows[5][2])])
    found = mixing.mix(docs).collect()
    order = {r.doc_id: r.h & M64 for r in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id").alias("h")).collect()}
    table = [*rows, rows[5]]
    size = lambda r: len((r[1] or "").split())
    names = sorted({r[2] for r in table}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(r) for r in table if r[2] == s) for s in names]
    target = plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], sum(sizes), 3)
    want = Counter()
    for s, n, t in zip(names, sizes, target, strict=True):
        whole = int(t // n)
        left = round(t - whole * n)
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for r in sorted((r for r in table if r[2] == s), key=lambda r: (order[r[0]] >> 52, signed(order[r[0]]), r[0])):
            more = min(size(r), left)
            left -= more
            want[r[0], size(r), n, whole * size(r) + more] += 1
    assert Counter((r.doc_id, r.size, r.source_size, r.taken) for r in found) == want


def test_partial_documents_keep_their_lines(spark):
    docs = frame(spark, [(1, "a b\n\n c  d\te f", "x"), (2, "q " * 8, "y"), (3, "r " * 40, "z")])
    texts = [r.text for r in mixing.mixed_documents(docs).collect()]
    assert all(any(t.startswith(x) for t in ("a b\n\n c  d\te f", "q " * 8, "r " * 40)) for x in texts)


# --- media


def plain_ima(block):
    steps = media.ima_steps().tolist()
    value, index = struct.unpack("<h", block[:2])[0], min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = steps[index]
            diff = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                diff += part if nibble & bit else 0
            value = max(-32768, min(32767, value - diff if nibble & 8 else value + diff))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[nibble & 7]))
            out.append(value)
    return out


def plain_mu(b):
    b = ~b & 255
    size = (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132
    return -size if b & 128 else size


def plain_a(b):
    b ^= 0x55
    e, m = b >> 4 & 7, b & 15
    size = (m << 4) + 8 if e == 0 else (m << 4) + 264 << e - 1
    return size if b & 128 else -size


def plain_feature(raw):
    n, mu = len(raw), [plain_mu(b) for b in raw]
    wide = [x for i, v in enumerate(mu) for x in (v, (v + mu[min(i + 1, n - 1)]) // 2)]
    adpcm = sum(sum(map(abs, plain_ima(raw[i : i + 64]))) for i in range(0, n, 64))
    turns = sum((a < 0) != (b < 0) for a, b in zip(mu, mu[1:], strict=False))
    slope = sum(abs(b - a) for a, b in zip(wide, wide[1:], strict=False))
    return ":".join(map(str, (sum(v * v for v in mu) // n, sum(plain_a(b) ** 2 for b in raw) // n, turns, adpcm * 64 // n, slope // n)))


def test_media_features_against_plain_ones(spark):
    rng = random.Random(4)
    texts = ["", None, "x", "é中\U0001f600" * 30, *("".join(rng.choices(string.printable, k=n)) for n in (63, 64, 65, 1000))]
    rows = {r.doc_id: r for r in media.digests(media.encode_texts(frame(spark, list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        raw += b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        assert rows[i].feature == plain_feature(raw) and rows[i].tail_crc32 == zlib.crc32(raw[-64:])


# --- secrets and personal data


def test_novelty_finds_keys_and_leaves_words():
    rng = random.Random(6)
    novelty = secretscan.Novelty()
    find = lambda x: secretscan.novel_spans(x, secretscan.base_spans(x), novelty)
    key = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    forms = ('"{}" # private_key of the server', "the bearer we use is then {} for now", "cookie session_{} set", "token" + " " * 40 + "{}", "auth: {}")
    for form in forms:
        hits = 0
        for _ in range(60):
            k = key(rng.randint(20, 40))
            text = "some words. " + form.format(k) + " and more words"
            hits += (text.index(k), text.index(k) + len(k)) in find(text)
        assert hits >= 48, form
    assert sum(bool(find(f'pwd = "{key(12)}"')) for _ in range(60)) >= 54
    clean = (
        "the token of authentication was standardization-oriented", "session management in getElementByIdentifier returns null", "Die Sitzung (session) der Bundesverfassungsgerichtsentscheidung und Geschwindigkeitsbegrenzungen",
        "authentification et internationalisation des caractéristiques", "auth: responsibilities", "password: zusammenfassung", "session: 2024-03-12T12:30:11Z", "api_key_name = user_authentication_service", "session = createSessionForUser",
        "auth = YOUR_API_KEY_HERE", "private_key = path/to/private_key.pem", "credentials: process.env.CREDENTIALS", "authors: Maximilian Schwarzenberger", "bearer token goes in the Authorization-header field", "signature ----------------------------",
    )
    assert [x for x in clean if find(x)] == []
    for text in ("token" * 40_000, "token" + "aZ9q" * 50_000, "session token " * 20_000):
        find(text)  # in time that grows with the length alone


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def test_tagger_adds_what_the_base_patterns_miss(tagger):
    rng = random.Random(99)
    texts, want = [], []
    for _ in range(400):
        kind, span = pii._instance(rng)
        before = pii._prose(rng, rng.randint(0, 40)) + " "
        texts.append(before + span + " " + pii._prose(rng, rng.randint(1, 40)))
        want.append((len(before), kind, len(before) + len(span)))
    got = pii.decoded_spans(texts, tagger)
    assert got == pii.decoded_spans(texts, tagger, everything=True)  # windows far from any trigger add nothing
    new = [[s for s in g if not any(a < s[2] and b > s[0] for a, _, b in pii.base_spans(t))] for t, g in zip(texts, got, strict=True)]
    open_ = [k for k, t in enumerate(texts) if not any(a < want[k][2] and b > want[k][0] for a, _, b in pii.base_spans(t))]
    assert sum(want[k] in got[k] for k in open_) >= 0.9 * len(open_) > 100
    assert sum(s == want[k] for k, own in enumerate(new) for s in own) >= 0.95 * sum(map(len, new))


def test_spans_longer_than_a_window_are_whole(tagger):
    long = "maximilian.alexander.the.second (at) institute.for.advanced.studies (dot) university (dot) org"
    found = pii.decoded_spans([f"write to {long} today", "call (030) 12345678 or 0049 30 1234567 now", "see (at) home [1] page 12 of 200, v1.2.34"], tagger)
    texts = [f"write to {long} today", "call (030) 12345678 or 0049 30 1234567 now"]
    assert [[t[a:b] for a, _, b in f] for t, f in zip(texts, found, strict=False)] == [[long], ["(030) 12345678", "0049 30 1234567"]] and found[2] == []


# --- odd tables

CLASH = "doc_id long, text string, source string, __id long, __gone string, __spans string, __text string, __k long, __kept long, __many boolean, __n int, h long, class string, k_text string, size int, start int, spans string, copies int"


def clash(spark, rows):
    return frame(spark, [(*r, *([None] * 15)) for r in rows], CLASH)


REMOVERS = {
    "substring": substring.remove,
    "lines": lines.remove,
    "near": simhash.keep_first,
    "quality": lambda df: quality.keep_good(df, quality.train(df, df.selectExpr("doc_id", "doc_id % 2 as quality")), 0.0),
    "mix": mixing.mixed_documents,
    "audio": lambda df: media.decode_audio(df.withColumn("media", df["text"].cast("binary"))),
}


@pytest.mark.parametrize("name", REMOVERS)
def test_odd_rows_and_clashing_columns(spark, name):
    df = clash(spark, EDGE)
    out = REMOVERS[name](df)
    rows = out.collect()
    assert set(df.columns) <= set(out.columns)
    if name in ("substring", "lines", "quality", "audio"):
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in EDGE)
    if name == "near":
        assert {r.doc_id for r in rows} == {None, 1, 2, 5, 7, 8, 9} and len(rows) == 7
    empty = df.limit(0)
    assert REMOVERS[name](empty).collect() == []


REPORTS = {
    "substring": (substring.report, None), "pii": (pii.find, len(EDGE)), "simhash": (simhash.near_duplicates, len(EDGE)), "lines": (lines.report, len(EDGE) - 1), "packing": (packing.pack, None), "fingerprints": (fingerprints.edited, len(EDGE)),
    "mixing": (mixing.mix, len(EDGE)), "media": (lambda df: media.digests(media.encode_texts(df)), len(EDGE)), "secrets": (secretscan.scan, len(EDGE)),
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports_ignore_clashing_columns(spark, name):
    report, n = REPORTS[name]
    rows = report(clash(spark, EDGE)).collect()
    plain = report(frame(spark, EDGE)).collect()
    assert n is None or len(rows) == n
    if name != "packing":  # whose bins follow the partitions
        assert Counter(map(str, rows)) == Counter(map(str, plain))
    if name != "packing":
        by_id = defaultdict(set)
        for r in rows:
            by_id[r[0]].add(str(r))
        assert len(by_id[8]) == 1 or name in ("lines", "fingerprints", "mixing", "substring")  # repeated rows alike
