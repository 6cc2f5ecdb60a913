"""The cascade over whole made-up tables, against its plain row-by-row version; and every SQL text against its query."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime

import duckdb
import pytest
from plain import Plain
from pyspark.sql import functions as F

from lumbra import constants as K
from lumbra.operators import export, judge, reconcile
from lumbra.plans import analog, queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small star schema; few brands and short vectors, so that every step of the cascade is reached."""
    rng = random.Random(12)
    d = str(tmp_path_factory.mktemp("star"))
    words = ["trauma", "choque", "dor", "febre", "aguda", "renal", "torax", "inicial"]
    name = lambda: " ".join(rng.choices(words, k=rng.randint(1, 3)))
    vector = lambda: [rng.gauss(0, 1) for _ in range(7)]
    day = datetime(2024, 1, 1)
    data = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(i, f"NATION_{i}", 0) for i in range(5)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "c", 0, 1.0, "m")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(i, f"s{i}", i % 5, 1.0) for i in range(9)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(i, name(), f"Brand#{rng.randint(1, 6)}", rng.choice(["SMALL", "LARGE", "PROMO"]), 1, 1.0) for i in range(56)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(1, 1, "O", 1.0, day, "1")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(i // 6, rng.randrange(50), rng.randrange(9), i % 6 + 1, float(rng.randint(1, 50)), 1.0, 0.0, 0.0, "A", "F", day) for i in range(500)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "events": ([(i, day, 1, "x", 1.0, "{}") for i in range(120)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
        "documents": ([(i, " ".join(rng.choices([*words, "e", "de"], k=rng.randint(2, 30))), rng.choice(["pt", "brand#3"]), "s", 1) for i in range(70)], "doc_id long, text string, lang string, source string, n_chars long"),
        "embeddings": ([(i, vector(), 0) for i in range(60)], "vec_id long, embedding array<float>, label int"),
        "pages": ([(i, f"u{i}", f"<p>{i % 7}</p>") for i in range(20)], "page_id long, url string, html string"),
        "benchmark": ([(i, name()) for i in range(25)], "item_id long, text string"),
        "labels": ([(1, 1, 0)], "doc_id long, quality int, toxic int"),
        "conversations": ([(c, t, rng.choice(["PCR", "user"]), f"say {t}\nmore") for c in range(8) for t in range(6)], "conv_id long, turn long, role string, text string"),
    }
    for table, (rows, schema) in data.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{table}.parquet")
    return d


@pytest.fixture(scope="module")
def plain(spark, tables):
    rows = lambda df: [r.asDict() for r in df.collect()]
    vectors = [r.embedding for r in analog.table(spark, tables, "embeddings").orderBy("vec_id").collect()]
    return Plain(rows(analog.stats(spark, tables, vectors=True)), rows(analog.questions(spark, tables)), vectors)


@pytest.fixture(scope="module")
def sheet(spark, tables):
    return [r.asDict() for r in analog.sheet(spark, tables).collect()]


@pytest.fixture(scope="module")
def asked(spark, tables, plain):
    return [r.asDict() for r in queries._rows(spark, tables).collect()]


def test_rows_are_prepared(plain, sheet, asked):
    rows = {r["row_idx"]: r for r in asked}
    assert all({k: rows[r["row_idx"]][k] for k in p} == p for r in sheet for p in [plain.prepare(r)])


def test_resolve_tema(spark, tables, plain, asked):
    found = {r.row_idx: (r.tema, r.method, r.score) for r in queries.queries()["resolve_tema_cascade"](spark, tables).collect()}
    want = {r["row_idx"]: plain.resolve_tema(r) for r in asked}
    assert found == {k: (t, m, round(s, 6)) for k, (t, m, s) in want.items()}
    assert set(Counter(m for _, m, _ in want.values())) >= {K.EXACT, K.FTS, K.SEMANTIC}


def test_resolve_subtema(spark, tables, plain, asked):
    found = {r.row_idx: (r.stat_id, r.method, r.score) for r in queries.queries()["resolve_subtema"](spark, tables).collect()}
    want = {r["row_idx"]: x for r in asked if (x := plain.resolve_subtema(r, plain.resolve_tema(r)[0]))}
    assert found == {k: (s["id"], m, round(x, 6)) for k, (s, m, x) in want.items()}
    assert len({m for _, m, _ in want.values()}) == 3


def test_retry(spark, tables, plain, sheet):
    found = {r.row_idx: (r.stat_id, r.score, r.via) for r in queries.queries()["retry_low_score"](spark, tables).collect()}
    want = {r["row_idx"]: x for r in sheet if (x := plain.retry(plain.prepare(r), 0.1))}
    assert found == {k: (s["id"], round(x, 6), via) for k, (s, x, via) in want.items()}


@pytest.fixture(scope="module")
def done(spark, tables):
    base = analog.base(spark, tables)
    out = reconcile.staged(reconcile.reconcile(analog.sheet(spark, tables), base))
    return base, out


def same(found, want):
    rows = {r["row_idx"]: r for r in (r.asDict() for r in found)}
    assert len(rows) == len(want)
    for w in want:
        got = rows[w["row_idx"]]
        assert {k: round(got[k], 6) if k == "match_score" else got[k] for k in w} == w | {"match_score": round(w["match_score"], 6)}


def test_reconcile(done, plain, sheet):
    rows = done[1].collect()
    want = [plain.reconciled(r) for r in sheet]
    same(rows, want)
    assert len({r["match_method"] for r in want}) >= 3 and len(rows) == len(sheet)


def test_alternative_candidates(done, plain):
    base, rows = done
    found = {}
    for r in judge.alternative_candidates(judge.weak_rows(rows), base).collect():
        found.setdefault(r.row_idx, {})[r.rank] = (r.stat.tema, r.stat.subtema, r.stat.num_questions)
    weak = [r.asDict() for r in judge.weak_rows(rows).collect()]
    assert len(weak) > 20
    for r in weak:
        want = [(s["tema"], s["subtema"], s["num_questions"]) for s in plain.alternatives(r)]
        assert [x for _, x in sorted(found.get(r["row_idx"], {}).items())] == want


def test_judge_in_batches(done, plain):
    base, rows = done
    want = plain.judged([r.asDict() for r in rows.select(*reconcile.RESULT).collect()], queries.stub_judge)
    keep = [c for c in reconcile.RESULT if c != "notes"]
    same(judge.apply_judge(rows, base, queries.stub_judge).collect(), [{c: r[c] for c in keep} for r in want])
    assert sum(r["match_method"] == K.LLM for r in want) > 10


def test_replies_that_cannot_be_read_confirm(done):
    import pandas as pd

    base, rows = done
    bad = lambda batches: (pd.DataFrame({"batch": b.batch, "reply": ["no json"] * len(b)}) for b in batches)
    before = {r.row_idx: r for r in rows.collect()}
    for r in judge.apply_judge(rows, base, bad).collect():
        assert r.match_score == before[r.row_idx].match_score and (r.match_method == K.LLM) == (before[r.row_idx].match_score < K.JUDGE_THRESHOLD)


def test_judge_without_an_encoder(done, plain):
    base, rows = done
    alone = reconcile.Base(base.questions, base.stats, base.stats_all, None)
    weak = judge.weak_rows(rows)
    found = {}
    for r in judge.alternative_candidates(weak, alone).collect():
        found.setdefault(r.row_idx, {})[r.rank] = r.stat.id
    for r in (x.asDict() for x in weak.collect()):
        one = plain.best(r["in_tema"])
        want = ([one["id"]] if one else []) + [s["id"] for s in plain.below(r["normalized_tema"], 5)]
        assert [x for _, x in sorted(found.get(r["row_idx"], {}).items())] == want


def test_coverage_of_reconciled_rows(spark, tables, done, plain):
    from lumbra.operators import lookups

    rows = [r.asDict() for r in done[1].collect()]
    topics = [r.asDict() for r in lookups.topic_rollup(analog.stats(spark, tables)).collect()]
    found = {(r.db_tema, r.db_subtema): (r.matched_input, round(r.similarity_score, 6), r.coverage_status) for r in reconcile.reverse_coverage(done[1], lookups.topic_rollup(analog.stats(spark, tables)), analog.encoder(spark, tables)).collect()}
    low = lambda x: (x or "").lower() or None
    shown = {}
    for r in sorted(rows, key=lambda r: r["row_idx"]):
        shown.setdefault(" ".join(x for x in (r["normalized_tema"], r["normalized_subtema"]) if x is not None), (r["row_idx"], r["input_tema"]))
    status = lambda s: "coberto" if s >= K.COVERED else "parcial" if s >= K.PARTIAL else "não coberto"
    for t in topics:
        own = [r for r in rows if r["normalized_tema"].lower() == t["tema"].lower() and low(r["normalized_subtema"]) == low(t["subtema"])]
        best = min(own, key=lambda r: (-r["match_score"], r["row_idx"]), default=None)
        if best and best["match_score"] >= K.PARTIAL:
            want = best["input_tema"], round(best["match_score"], 6), status(best["match_score"])
        else:
            v = plain.vector(" ".join(x for x in (t["tema"], t["subtema"]) if x is not None))
            sim, _, name = min(((-plain.cosine(v, plain.vector(text)), at, name) for text, (at, name) in shown.items()))
            want = name if -sim >= K.PARTIAL else None, round(-sim, 6), status(-sim)
        assert found[t["tema"], t["subtema"]] == want


def test_ranking_table(spark, tables, done):
    names = tuple(f"NATION_{i}" for i in range(5))
    index = export.curriculum_index(analog.curriculum(spark, tables))
    rows = [r.asDict() for r in done[1].collect()]
    places = {}
    for r in sorted(analog.curriculum(spark, tables).collect(), key=lambda r: r.position):
        for key in ((r.tema.lower(), r.subtema.lower()), (r.tema.lower(), "")):
            places.setdefault(key, (int(r.semana), r.position))
    want = []
    for r in rows:
        a, _, b = r["input_tema"].lower().partition(" | ")
        c, e = r["normalized_tema"].lower(), (r["normalized_subtema"] or "").lower()
        place = next((places[k] for k in ((a.strip(), b.strip()), (a.strip(), ""), (c, e), (c, "")) if k[0] and k in places), (K.UNKNOWN_WEEK, K.UNKNOWN_POSITION))
        counts = [r["questions_by_institution"].get(n, 0) for n in names]
        hexes = [next(code for least, _, code in K.COLORS if n >= least) for n in counts]
        cells = ("" if place[0] == K.UNKNOWN_WEEK else f"{place[0]:02d}", r["match_label"], f"{r['match_score']:.0%}", r["input_tema"], r["input_equivalencia"], r["normalized_tema"], r["normalized_subtema"], *[f"{n} questões" for n in counts], r["notes"], *hexes)
        want.append(((*place, -r["match_score"], r["row_idx"]), cells))
    found = [tuple(r) for r in export.ranking_table(done[1], index, names).collect()]
    assert found == [cells for _, cells in sorted(want, key=lambda x: x[0])]


def norm(x):
    return f"{x:.6g}" if isinstance(x, float) else repr(list(x)) if isinstance(x, list) else repr(x)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_its_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("nation", "supplier", "part", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet/*.parquet'")
    df = queries.queries()[name](spark, tables)
    columns = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    at = [[x[0] for x in found.description].index(c) for c in columns]
    assert Counter(tuple(norm(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(norm(r[i]) for i in at) for r in found.fetchall())


def test_portuguese_search(spark):
    from lumbra.functions import fulltext, stemmer
    from pyspark.ml.feature import StopWordsRemover

    rng = random.Random(1)
    words = ["infecções", "infecção", "aguda", "agudas", "de", "e", "renal", "renais", "trauma", "traumas", "o"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(80)]
    asked = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate([1, 1, 2, 2, 3, 3, 4])]
    stop = set(StopWordsRemover.loadDefaultStopWords("portuguese"))
    lex = lambda t: [(i, stemmer.stem(w)) for i, w in enumerate(t.split()) if w not in stop]
    want = {}
    for k, q in asked:
        terms = {w for _, w in lex(q)}
        for i, t in docs:
            own = [(p, w) for p, w in lex(t) if w in terms]
            if terms and {w for _, w in own} == terms:
                want[k, i] = round(fulltext.cover_density(own, len(terms)), 9)
    corpus = spark.createDataFrame(docs, "id long, text string")
    got = fulltext.fulltext_search(corpus, spark.createDataFrame(asked, "query_id long, query_text string"), "portuguese")
    assert {(r.query_id, r.id): round(r.fts_score, 9) for r in got.select("query_id", "id", F.col("fts_score")).collect()} == want and want


def test_candidates_of_equal_inputs_are_found_once(spark, tables, monkeypatch):
    """Rows of one input, nulls among them, get the same candidates from one search."""
    rows = judge.weak_rows(queries._done(spark, tables)).limit(1)
    rows = rows.withColumn("input_equivalencia", F.lit(None).cast("string"))
    many = rows.crossJoin(spark.range(40)).withColumn("row_idx", F.col("id").cast("int")).drop("id")
    base = analog.base(spark, tables)
    asked, whole = [], judge._candidates
    monkeypatch.setattr(judge, "_candidates", lambda r, b: (asked.append(r.count()), whole(r, b))[1])
    got = judge.alternative_candidates(many, base).select("row_idx", "rank", "stat.id").collect()
    assert asked == [1] and {r.row_idx for r in got} == set(range(40))
    assert len({tuple(sorted((r.rank, r.id) for r in got if r.row_idx == i)) for i in range(40)}) == 1
