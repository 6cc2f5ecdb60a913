"""The pipeline against plain versions of its first three stages; mixing and packing have theirs in test_operators."""

from __future__ import annotations

from collections import Counter

import numpy as np
from test_nearcopies import kept

import corpus_pipeline
from lumbra.llm import mixing, packing, quality
from lumbra.llm.common import written


def grams(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def without_lines(rows):
    every = [(i, no, line) for i, t in rows for no, line in enumerate(t.split("\n")) if line.strip()]
    sets = [grams(x[2]) for x in every]
    label = list(range(len(every)))
    pairs = [(x, y) for x in range(len(every)) for y in range(x) if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    for _ in range(len(every)):
        before = list(label)
        for x, y in pairs:
            label[x] = label[y] = min(label[x], label[y])
        if label == before:
            break
    gone = {every[x][:2] for x in range(len(every)) if label[x] != x}
    return [(i, "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone)) for i, t in rows]


def wrapped(words, width):
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_run_keeps_what_plain_stages_keep(spark, tmp_path):
    rng = np.random.default_rng(9)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 9)))) for _ in range(500)])
    texts, good = [], []
    for k in range(16):
        base = rng.choice(vocabulary, 90)
        for width, edits in ((11, 0), (17, 1 + k % 3)) if k % 2 else ((11, 0),):  # copies of 1 to 3 edits, about 0.7 to 0.9, in other lines
            own = base.copy()
            own[rng.choice(90, edits, replace=False)] = rng.choice(vocabulary, edits)
            texts.append(wrapped(own, width) + ".\nsame footer on every page here")
            good.append(1)
        texts.append(" ".join(rng.choice(["$$$", "###", "BUY!!!", "|||", "1234"], 30)))
        good.append(0)
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[k], "ab"[i % 2]) for i, k in enumerate(order)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(int(i), good[k], 0) for i, k in enumerate(order)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels"))

    model = quality.train(docs, labels)
    accepted = [(i, t) for i, t, _ in rows if model.score(quality.statistics(t)[None])[0] >= corpus_pipeline.REJECT]
    assert 0 < len(accepted) < len(rows)
    lined = without_lines(accepted)
    want = sorted(kept(lined))
    assert 0 < len(want) < len(lined)

    stages = dict(corpus_pipeline.STAGES)
    found = docs
    for name, plain in (("quality", accepted), ("lines", lined), ("near-duplicates", want)):
        found = written(stages[name](spark, found, str(tmp_path)), "stage")
        assert sorted((r.doc_id, r.text) for r in found.collect()) == sorted(plain), name
    source = {i: s for i, _, s in rows}
    plain = spark.createDataFrame([(i, t, source[i]) for i, t in want], "doc_id long, text string, source string")
    packed = packing.pack(mixing.mixed_documents(plain))
    # bins, and pieces of those left open, depend on how rows lie in partitions; the tokens of documents do not

    def tokens(df):
        out = Counter()
        for r in df.collect():
            out[r.doc_id, r.doc_tokens] += r.length
        return out

    assert tokens(corpus_pipeline.run(spark, str(tmp_path))) == tokens(packed)
