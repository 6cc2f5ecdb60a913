"""The pipeline's near-duplicates stage against all pairs."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lumbra.llm import nearcopies, simhash
from lumbra.llm.lines import _mix
from lumbra.llm.simhash import majority


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def kept(rows):
    """The (doc_id, text) that stay, by comparing all pairs."""
    texts = sorted({(i, t or "") for i, t in rows if i is not None})
    sets = [shingle_set(t) for _, t in texts]
    label = list(range(len(texts)))
    while True:
        before = list(label)
        for x in range(len(texts)):
            for y in range(x):
                if label[x] != label[y] and alike(sets[x], sets[y]):
                    label[x] = label[y] = min(label[x], label[y])
        if label == before:
            return {texts[x] for x in range(len(texts)) if label[x] == x}


def sample(rng):
    vocabulary = np.array(["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)])
    shared = " ".join(rng.choice(vocabulary, 30))
    texts = []
    for n in (7, 12, 40, 80, 150, 300, 300, 600):
        base = rng.choice(vocabulary, n)
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 4, 6, 8, 10, 14):  # from far above to below the threshold
            own = base.copy()
            own[rng.choice(n, min(n, edits), replace=False)] = rng.choice(vocabulary, min(n, edits))
            texts.append(" ".join(own))
    hub = rng.choice(vocabulary, 200)
    for _ in range(40):  # a group larger than SMALL
        own = hub.copy()
        own[rng.choice(200, 5, replace=False)] = rng.choice(vocabulary, 5)
        texts.append(" ".join(own))
    texts += [" ".join(rng.choice(vocabulary, 40)) + " " + shared for _ in range(20)]
    texts += [texts[0], texts[5].upper(), "", None, " \n", "x", "x", "x y"]
    order = rng.permutation(len(texts))
    return [(int(i), texts[k]) for i, k in enumerate(order)] + [(None, texts[0]), (None, None)]


@pytest.mark.parametrize("small", [2, 16])
def test_stage_keeps_what_all_pairs_keep(spark, monkeypatch, small):
    monkeypatch.setattr(nearcopies, "SMALL", small)
    monkeypatch.setattr(nearcopies, "COMMON", 2 * nearcopies.SAMPLED)
    monkeypatch.setattr(nearcopies, "HUBS", 1 if small == 2 else 4)
    rows = sample(np.random.default_rng(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r.doc_id, r.text or "") for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()]
    assert Counter(x for x in found if x[0] is not None) == Counter(kept(rows))
    assert sum(i is None for i, _ in found) == 2


def near_sets(texts):
    """The pairs of different sets that are similar and whose fingerprints differ in 13 bits at most."""
    sets = {nearcopies.shingles(t.encode()).tobytes(): nearcopies.shingles(t.encode()) for t in texts}
    hashes, sets = list(sets), list(sets.values())
    fps = [majority(x) for x in sets]
    return {(hashes[x], hashes[y]) for x in range(len(sets)) for y in range(x) if nearcopies.similar(sets[x], sets[y]) and (fps[x] ^ fps[y]).bit_count() <= 13}


@pytest.mark.parametrize("small, block", [(16, 1 << 12), (2, 16)])
def test_candidates_come_from_fingerprints(spark, monkeypatch, small, block):
    """Without prefix filtering all similar texts within the probed radius are still found."""
    monkeypatch.setattr(nearcopies, "SMALL", small)
    monkeypatch.setattr(nearcopies, "LEAST_BLOCK", block, raising=False)
    monkeypatch.setattr(nearcopies, "_near", lambda threshold: lambda batches: iter(()))
    rows = [(i, t or "") for i, t in sample(np.random.default_rng(5)) if i is not None]
    pairs = near_sets([t for _, t in rows])
    assert len(pairs) > 50
    least = {}
    for i, t in sorted(rows):
        least.setdefault(nearcopies.shingles(t.encode()).tobytes(), i)
    label = {h: i for h, i in least.items()}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    found = corpus_pipeline.dedup_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in found) == sorted(set(label.values()))


def test_sign_bit_is_one_bit():
    fp = np.array([0, -(2**63) + 3], np.int64)
    i, j = np.array([0]), np.array([1])
    assert nearcopies._possible(np.array([40, 40]), np.array([0, 0]), fp, i, j, 0.8)[0]


def test_probes_meet_all_within_the_radius():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64 - 1, 200, dtype=np.uint64)
    fps = np.concatenate([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 200)).astype(np.uint64), axis=0) for k in (1, 5, 10, 13, 15)])
    for n in (1000, 10**5):
        probe = simhash.Probe(fps, simhash.plan(np.sort(fps.view(np.int64)), n, 13, 1.0), 13)
        found = [p for i, j in probe.near(fps[:300]) for p in zip(i.tolist(), j.tolist(), strict=True)]
        want = np.argwhere(np.bitwise_count(fps[:300, None] ^ fps[None]) <= 13)
        assert sorted(found) == sorted(map(tuple, want.tolist()))


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    for _ in range(2000):
        n = int(rng.integers(1, 80))
        a = rng.choice(10_000, n, replace=False)
        b = np.union1d(rng.choice(a, int(rng.integers(1, n + 1)), replace=False), rng.choice(10_000, int(rng.integers(0, 4))))
        a, b = np.sort(a), np.sort(b)
        if alike(set(a.tolist()), set(b.tolist())):
            a, b = sorted((a, b), key=len)
            p = {x: i for i, x in enumerate(a[: nearcopies.prefix_length(len(a))].tolist())}
            q = {x: i for i, x in enumerate(b[: nearcopies.prefix_length(len(b))].tolist())}
            both = [x for x in p if x in q]
            size, i, j = np.array([len(a), len(b)]), np.zeros(len(both), int), np.ones(len(both), int)
            fp = np.array([majority(_mix(x.astype(np.uint64))) for x in (a, b)], np.uint64)
            assert any(nearcopies._possible(size, np.array([p[x], q[x]]), fp, i[:1], j[:1], 0.8)[0] for x in both)


def test_fingerprints_of_similar_sets_are_near():
    rng = np.random.default_rng(3)
    worst = 0
    for n in (32, 40, 80, 300):
        for _ in range(1500):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            gone = int(rng.integers(0, n - int(np.ceil(0.8 * n)) + 1))  # with as many new ones as a similarity of 0.8 allows
            new = int((n - gone) / 0.8 - n + 1e-9)
            b = np.concatenate([a[gone:], rng.integers(0, 2**63, max(new, 0)).astype(np.uint64)])
            worst = max(worst, (majority(a) ^ majority(b)).bit_count())
    assert worst <= nearcopies.RADIUS - 1


def test_rows_are_judged_by_id_and_text(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "nobody has this text at all here")]
    found = corpus_pipeline.dedup_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id, r.text) for r in found) == [rows[0], rows[3]]
