"""The operators against plain versions on small tables, with their edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lumbra.llm import fingerprints, lines, media, mixing, packing, pii, quality, secretscan, simhash, substring
from lumbra.llm.components import components

LONG = "word " * 30_000
EDGE = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, " \t\n ", "b"),
    (5, "x", "b"),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "c"),
    (7, "mail me: a.b@c.org, 10.0.0.256 or 10.0.0.1 now\npassword = hunter2hunter2", "c"),
    (8, LONG, "c"),
    (8, LONG, "c"),
    (None, "no id at all", "d"),
    (9, "é ñ 中文 \U0001f600 x\nline two. line two. line two.", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "clash", 1.5) for i, t, s in EDGE], "doc_id long, text string, source string, spans string, size double")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (substring.report(empty), pii.find(empty), simhash.near_duplicates(empty), lines.report(empty), packing.pack(empty), fingerprints.edited(empty), quality.classify(empty, quality.train(empty, labels)), mixing.mix(empty), media.digests(media.encode_texts(empty)), secretscan.scan(empty)):
        assert df.count() == 0


# --- simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, radius=4):
    label = {i: i for i in ids}
    while True:
        before = dict(label)
        for i, a in zip(ids, fps, strict=True):
            for j, b in zip(ids, fps, strict=True):
                if (a ^ b).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label


def test_simhash_edges(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(EDGE)
    want = {}
    for i, t, _ in EDGE:
        want.setdefault(i, f"{slow_fingerprint(t):016x}")
    assert all(r.fingerprint == want[r.doc_id] for r in rows)
    known = {r.doc_id: r.component_id for r in rows}
    assert known[2] == known[3] == known[4] == 2 and known[6] == 1


def test_simhash_links_all_within_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60)
    fps = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False)) for b in base for _ in range(6)]
    vertices = spark.createDataFrame([(f, i) for i, f in enumerate(dict.fromkeys(fps))], "fp long, rep long")
    reps = {r.rep: r.fp for r in vertices.collect()}
    want = slow_components(list(reps), list(reps.values()))
    found = {r.node: r.component for r in components(simhash.links(vertices)).collect()}
    assert {i: found.get(i, i) for i in reps} == want


def test_thresholds_meet_the_pigeonhole():
    rng = np.random.default_rng(0)
    for n in (1000, 10**6, 10**9):
        parts = simhash.plan(rng.integers(-(2**62), 2**62, 500), n, 4)
        assert sum(t + 1 for _, t in parts) == 5
        bits = [b for g, _ in parts for b in g]
        assert len(bits) == len(set(bits))


def test_hot_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 8)
    fps = [1 << i for i in range(40)] + [0b11 << i for i in range(0, 40, 3)]
    vertices = spark.createDataFrame([(f, i) for i, f in enumerate(dict.fromkeys(fps))], "fp long, rep long")
    found = {r.node: r.component for r in components(simhash.links(vertices)).collect()}
    assert set(found.values()) == {0} and len(found) == len(set(fps))


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 140)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[j] == 100 for j in range(100, 140)) and len(found) == 101


# --- lines


def shingles(line, n=5):
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def test_lines_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(200)]
    texts = []
    for _ in range(25):
        own = list(rng.choice(words, 14))
        texts.append(" ".join(own))
        own[3] = "changed"
        texts.append(" ".join(own))
        texts.append("short")
    rows = [(i, "\n".join(texts[3 * i : 3 * i + 3]) + "\n\n") for i in range(25)] + [(50, "ab"), (51, "ab"), (52, None), (53, "  ")]
    every = [(d, no, line) for d, t in rows for no, line in enumerate((t or "").split("\n"))]
    gone = set()
    pool = [(d, no, line) for d, no, line in every if line.strip()]
    label = {x: x for x in pool}
    for _ in range(4):
        for x in pool:
            for y in pool:
                a, b = shingles(x[2]), shingles(y[2])
                if len(a & b) >= 0.8 * len(a | b):
                    label[x] = label[y] = min(label[x], label[y])
    gone = {x[:2] for x in pool if label[x] != x}
    found = lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, no) for r in found for no in r.removed_lines} == gone
    assert {r.doc_id: r.n_lines for r in found} == {d: len((t or "").split("\n")) for d, t in rows}


def test_line_removal_keeps_rows_and_columns(docs):
    out = lines.remove(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1].startswith("alpha") and texts[6] == "" and texts[2] is None


def test_hot_band_keys_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 32)
    base = "the quick brown fox jumps over the lazy dog while many other animals look on in silence and wonder "
    rows = [(i, base + f"{i:03d}") for i in range(300)]
    found = lines.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_removed for r in found) == 299


# --- substring


def test_substring_removes_all_but_the_first(spark):
    passage = " ".join(f"Word{i} goes{i} there{i} now{i} and{i} then{i} stops{i}." for i in range(8))
    rows = [(3, "Own start one two three. " + passage + " End three."), (1, "Begin here. " + passage), (2, "Nothing in common with them at all. Really nothing, not a word of it. So it stays."), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in substring.report(df).collect()}
    assert set(found) == {3} and found[3].kept_in == [1]
    out = {r.doc_id: r.text for r in substring.remove(df).collect()}
    assert out[3] == "Own start one two three. End three." or out[3] == "Own start one two three.  End three."
    assert out[1] == rows[1][1] and out[4] is None


def test_substring_catches_shifted_long_passages():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(3000)]
    missed = 0
    for _ in range(60):
        p = list(rng.choice(words, 56))
        for i in np.flatnonzero(rng.random(56) < 0.08):
            p[i] += "."
        a = " ".join([*rng.choice(words, 20), *p, *rng.choice(words, 20)])
        b = " ".join([*rng.choice(words, 9), *p, *rng.choice(words, 7)])
        missed += not ({r[0] for r in substring.runs(a)} & {r[0] for r in substring.runs(b)})
    assert missed <= 1


# --- pii


def slow_pii(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_of_noise():
    rng = np.random.default_rng(4)
    alphabet = list("ab1234567890@@..++--() ")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(1, 60)))
        assert pii.base_spans(text) == slow_pii(text), text
    assert pii.base_spans("a@b.c@d.e x 4111 1111-1111 1111 +1 (017) 555-7713") == slow_pii("a@b.c@d.e x 4111 1111-1111 1111 +1 (017) 555-7713")


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def test_tagger_finds_what_patterns_miss(tagger):
    from random import Random

    x, y = pii.labelled(Random(99), 300)
    assert (tagger.decode(x) == y).mean() > 0.97
    text = "Please write to john.smith (at) example (dot) com or call (017) 555-7713 today."
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in pii.decoded_spans([text], tagger)[0]] == [("email", "john.smith (at) example (dot) com"), ("phone", "(017) 555-7713")]


def test_gradient_is_that_of_the_likelihood():
    from random import Random

    model = pii.Tagger.fresh(np.random.default_rng(0), embed=3, hidden=3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, y = pii.labelled(Random(1), 2)
    x, y = x[:, :10], np.minimum(y[:, :10], 8)
    _, g = model.gradient(x, y)
    for name in ("fh", "bx", "trans", "emb", "out"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep, step = model.w[name][at], 1e-3
        model.w[name][at] = keep + step
        up, _ = model.gradient(x, y)
        model.w[name][at] = keep - step
        down, _ = model.gradient(x, y)
        model.w[name][at] = keep
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-2 * max(1, abs(g[name][at]))


def test_pii_rows(docs, tagger):
    rows = {r.doc_id: r for r in pii.find(docs, tagger).collect()}
    assert len(rows) == 10 and rows[7].n_email == 1 and rows[7].n_ip == 1
    assert rows[7].base_sha256 == hashlib.sha256(b"email:9:18,ip:34:42").hexdigest()
    assert rows[2].spans == "" and rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()


# --- secrets


def slow_secrets(text):
    out = []
    pattern = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


def test_secret_patterns_of_noise():
    rng = np.random.default_rng(5)
    parts = ["token", "TOKEN", "api_key", "apikey", "passwd", "Secret", "password", "=", ":", " ", '"', "AKIA", "ABCD1234EFGH", "0123456789abcdef", "abcdef12", "-", "K", "toſen"]
    for _ in range(2000):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        assert secretscan.base_spans(text) == slow_secrets(text), text


def test_novelty_tells_keys_from_words():
    n = secretscan.Novelty()
    find = lambda t: [t[s:e] for s, e in secretscan.novel_spans(t, secretscan.base_spans(t), n)]
    assert find("use the bearer wJalrXUtnFEMI7K7MDENG2bPxRfiCYzEX9MPLE1KEY here") == ["wJalrXUtnFEMI7K7MDENG2bPxRfiCYzEX9MPLE1KEY"]
    assert find("the session uses authorization_endpoint2 and your_password_here_1 as names") == []
    assert find("a plain wJalrXUtnFEMI7K7MDENG2bPxRfiCYzEX9MPLE1KEY without context") == []


def test_secret_rows(docs):
    rows = {r.doc_id: r for r in secretscan.scan(docs).collect()}
    assert rows[7].n_assign == 1 and rows[2].spans == "" and len(rows) == 10


# --- packing


def test_ids_equal_the_librarys():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    t = Tokenizer.from_file(path)
    import pyarrow as pa

    texts = [t or "" for _, t, _ in EDGE] + ["It's <|endoftext|>x y", "é ́x", "ΑΣ Σ", "\x1c\x85 a", "a\x00b", "Kİx", "' s 's 'S", "가 ᅡ", "a" * 5000, "ab.,| Àb!!c d'll!?", "x" * 48 + "!!", "don't", "Élan-vital 123abc"]
    texts = texts + [" ".join("".join(np.random.default_rng(i).choice(list("abcdeéßñABC.,!"), 12)) for i in range(j, j + 40)) for j in range(0, 400, 40)]
    own = packing.WordIds(path).batch(pa.array(texts))
    assert [x.tolist() for x in own] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_cuts_fill_their_classes():
    plan = packing.cuts()
    assert all(sum(own) == n for n, own in enumerate(plan))
    padding = [sum(2048 / (2048 // x) - x for x in own) for own in plan[1:]]
    assert sum(padding) / sum(range(2048)) < 0.005 and max(padding) < 64 and sum(map(len, plan)) / 2048 < 2.2 and max(map(len, plan)) <= 4
    assert packing.piece_lengths(5000) == [2048, 2048, *plan[904]] and packing.piece_lengths(1) == [1]


def test_bins_of_a_class_hold_its_number_of_pieces():
    rng = np.random.default_rng(0)
    bins, rows, pieces = packing.Bins(7 << 32), [], 0
    for doc in range(3000):
        ids, at = np.arange(int(rng.lognormal(6, 1.5)) + 1, dtype="<u4"), 0
        for n in packing.piece_lengths(len(ids)):
            rows += list(bins.add((doc, at, ids[at : at + n], len(ids))))
            at += n
            pieces += 1
    whole = defaultdict(list)
    for r in rows:
        whole[r[5]].append(r)
    for own in whole.values():
        assert len({2048 // r[2] for r in own}) == 1 and len(own) == 2048 // own[0][2]
    last = list(bins.close())
    sizes = defaultdict(int)
    for r in last:
        sizes[r[5]] += r[2]
    assert all(n & (n - 1) == 0 for n in sizes.values()) and not bins.open
    used = sum(r[2] for r in rows)
    assert 1 - used / (2048 * len(whole)) < 0.01 and pieces / 3000 < 3.5
    by_doc = defaultdict(list)
    for r in rows + last:
        by_doc[r[0]].append((r[1], r[2], r[4], r[7]))
    for own in by_doc.values():
        assert np.array_equal(np.concatenate([x[3] for x in sorted(own, key=lambda x: x[0])]), np.arange(own[0][2]))


def test_packing_is_whole_and_hardly_padded(docs):
    rows = packing.pack(docs, with_ids=True).collect()
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    padded = sum(-sum(r.length for r in own) % 2048 for own in by_seq.values() if (n := sum(r.length for r in own)) & (n - 1))
    assert padded <= 0.02 * total
    one = {r.doc_id: r.doc_tokens for r in rows}
    assert total == sum(one[i] for i, _, _ in EDGE) and one[2] == one[3] == 1


# --- fingerprints


def test_edited_texts(spark, docs):
    rows = fingerprints.edited(docs.filter("doc_id <> 8 and doc_id is not null")).collect()
    order = sorted((r for r in EDGE if r[0] not in (None, 8)), key=lambda r: -r[0])
    texts = [t or "" for _, t, _ in order]
    for k, (i, _, _) in enumerate(order):
        n, nxt = len(texts[k]), texts[(k + 1) % len(texts)]
        want = texts[k][: n - n // 3] + nxt[: n // 3]
        r = next(r for r in rows if r.doc_id == i)
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = {r.doc_id: r.fingerprint for r in rows}
    assert same[1] == same[6] and same[2] == same[3]
    assert len(fingerprints.edited(docs).collect()) == len(EDGE)


def test_likeness_follows_edits():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    a = " ".join(word() for _ in range(300))
    b = " ".join(word() for _ in range(300))
    s = lambda t: fingerprints.sketch(fingerprints.code_points(t))
    small, large = a[:-60] + b[:60], a[: len(a) // 2] + b[len(b) // 2 :]
    assert fingerprints.likeness(s(a), s(a)) == 1 > fingerprints.likeness(s(a), s(small)) > fingerprints.likeness(s(a), s(large)) > fingerprints.likeness(s(a), s(b)) - 1e-9
    halves = a[len(a) // 2 :] + a[: len(a) // 2]
    assert fingerprints.likeness(s(a), s(halves)) < 0.95  # the same k-mers in another order


# --- quality


def test_quality_on_held_out_rows(spark):
    rng = np.random.default_rng(0)
    good = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(60)) + "."
    rows = [(i, good() if i % 3 else good().upper().replace(" ", "!! "), i % 3 and 1) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(q))) for i, _, q in rows], "doc_id long, quality int")
    scored = quality.classify(docs, quality.train(docs, labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    held = [r for r in scored if r.held_out]
    assert sum(r.predicted == int(bool(r.doc_id % 3)) for r in held) / len(held) > 0.95


def test_quality_density_is_the_normal_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, quality.FEATURES))
    y = x @ rng.normal(size=(quality.FEATURES, quality.FEATURES)) * 0.3 + 1
    m = {c: (len(v), v.sum(0), v.T @ v) for c, v in ((0, x), (1, y))}
    d = quality.fit(m, shrink=0, ridge=0)
    cov = [np.cov(v.T, bias=True) + 1e-9 * np.eye(quality.FEATURES) for v in (x, y)]
    want = [-0.5 * (p @ np.linalg.solve(c, p) + np.linalg.slogdet(c)[1]) for c, v in zip(cov, (x, y), strict=True) for p in [x[0] - v.mean(0)]]
    got = d.score(x[:1])[0]
    assert abs(got - 1 / (1 + np.exp(-(want[1] - want[0]) / quality.FLATTEN))) < 1e-6


def test_quality_edges(docs):
    none = quality.fit({})
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).count() == docs.count()


# --- mixing


def test_mix_meets_targets(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(EDGE)
    sizes = {None: 0}
    for i, t, s in EDGE:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    known = {}
    for r, s in ((r, next(s for i, _, s in EDGE if i == r.doc_id)) for r in rows):
        assert r.taken <= 3 * r.size and r.source_size == sizes[s]
        known.setdefault(s, [r.target, 0])[1] += r.taken
    assert all(abs(t - k) <= 1 for t, k in known.values())
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(re.findall(r"\S+", r.text or "")) for r in out.collect()) == sum(r.taken for r in rows)


# --- media


def test_media_round_trip(docs):
    rows = media.digests(media.encode_texts(docs)).collect()
    assert len(rows) == len(EDGE)
    by = {r.doc_id: r for r in rows}
    for i, t, _ in EDGE:
        raw = (t or "").encode()
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.wav(payload)).hexdigest()
    assert by[1].feature == by[6].feature


def slow_ima(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for nib in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            diff = (step >> 3) + (step if nib & 4 else 0) + (step >> 1 if nib & 2 else 0) + (step >> 2 if nib & 1 else 0)
            value = max(-32768, min(32767, value + (-diff if nib & 8 else diff)))
            index = max(0, min(88, index + int(media.MOVES[nib])))
            out.append(value)
    return out


def test_codecs(spark):
    blocks = np.random.default_rng(0).integers(0, 256, (20, 64)).astype(np.uint8)
    assert [slow_ima(b.tobytes()) for b in blocks] == media.decode_ima(blocks).tolist()
    assert media.MU[0xFF] == 0 and media.MU[0x00] == -32124 and media.MU[0x80] == 32124 and media.A[0xD5] == 8 and media.A[0x55] == -8 and media.A[0xAA] == 32256
    df = spark.createDataFrame([(media.wav(bytes(range(64))),), (b"junk",), (None,)], "media binary")
    pcm = [r.pcm for r in media.decode_audio(df).collect()]
    assert media.pcm_of(bytes(pcm[0]))[0] == 16000 and len(media.pcm_of(bytes(pcm[0]))[1]) == 128 and pcm[1] is None and pcm[2] is None
