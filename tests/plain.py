"""The topic cascade row by row, in plain Python: what the set-based operators must give."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pandas as pd

from lumbra import constants as K
from lumbra.functions.fulltext import cover_density

TERMS = {**K.ALIASES, **K.ABBREVIATIONS}


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def words(*parts):
    return " ".join(p for p in parts if p is not None)


def clean(x):
    x = x.strip(" ") if x is not None else None
    return None if x is None or x.lower() in ("", "nan", "none") else x


def expand(x):
    return TERMS.get(x.strip(" ").lower(), x)


def shown(a, b):
    return " | ".join(x for x in (a, b) if x is not None)


def color(n):
    return next((code for least, _, code in K.COLORS if n >= least), K.COLORS[-1][2])


def label(method, score):
    steps = K.LABELS.get(method)
    return next(name for least, name in steps if least is None or score >= least) if steps else K.NO_MATCH_LABEL


class Plain:
    def __init__(self, stats, questions, vectors):
        self.stats, self.vectors = sorted(stats, key=lambda s: s["id"]), np.array(vectors, float)
        self.questions = questions
        self.known = {}

    def vector(self, text):
        return self.vectors[int(hashlib.md5(text.lower().encode()).hexdigest()[:7], 16) % len(self.vectors)]

    @staticmethod
    def cosine(a, b):
        size = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
        return round(float((a * b).sum() / (size or 1)), 9)

    def hybrid(self, text, rows, k):
        """rows: (id, text, vector, payload); the best k as (score, payload, similarity)."""
        v, q = self.vector(text), list(dict.fromkeys(tokens(text)))
        near = sorted(((self.cosine(v, x), i) for i, _, x, _ in rows if x is not None), key=lambda r: (-r[0], r[1]))[: 3 * k]
        texts = []
        for i, t, _, _ in rows:
            at = [(p, w) for p, w in enumerate(tokens(t)) if w in q]
            if q and len({w for _, w in at}) == len(q):
                texts.append((cover_density(at, len(q)), i))
        texts = sorted(texts, key=lambda r: (-r[0], r[1]))[: 3 * k]
        near, texts = {i: s for s, i in near}, {i: s for s, i in texts}
        scored = sorted(((K.ALPHA * near.get(i, 0.0) + K.BETA * texts.get(i, 0.0), i) for i in near.keys() | texts.keys()), key=lambda r: (-r[0], r[1]))[:k]
        payload = {r[0]: r[3] for r in rows}
        return [(s, payload[i], near.get(i, 0.0)) for s, i in scored]

    def topics(self, text, k):
        if not text:
            return []
        if (text, k) not in self.known:
            rows = [(s["id"], words(s["tema"], s["subtema"]), np.array(s["embedding"], float), s) for s in self.stats]
            self.known[text, k] = self.hybrid(text, rows, k)
        return self.known[text, k]

    def retrieve(self, text):
        rows = [(q["id"], words(q["tema_normalized"], q["subtema_normalized"], q["raw_text"]), None if q["embedding"] is None else np.array(q["embedding"], float), q) for q in self.questions]
        return [h for h in self.hybrid(text, rows, K.TOP_K) if h[0] >= K.SIMILARITY_THRESHOLD] if text else []

    def exact(self, tema, subtema):
        low = subtema.lower() if subtema is not None else None
        return next((s for s in self.stats if s["tema"].lower() == tema.lower() and (s["subtema"].lower() if s["subtema"] is not None else None) == low), None)

    def best(self, text):
        if text is None or not text.strip(" "):
            return None
        found = None
        if "|" in text:
            a, b = text.split("|", 1)
            found = self.exact(a.strip(" "), b.strip(" ") or None)
        found = found or self.exact(text, None)
        if not found and (q := set(tokens(text))):
            hits = [s for s in self.stats if q <= set(tokens(words(s["tema"], s["subtema"])))]
            found = min(hits, key=lambda s: (-s["num_questions"], s["id"]), default=None)
        return found

    def counts(self, tema, subtema):
        if tema is None:
            return {}
        own, out = [s for s in self.stats if s["tema"].lower() == tema.lower()], {}
        if subtema is not None:
            for s in own:  # by id: the last row counts
                if s["subtema"] is not None and s["subtema"].lower() == subtema.lower():
                    out[s["institution"]] = s["num_questions"]
        else:
            for s in own:
                out[s["institution"]] = out.get(s["institution"], 0) + s["num_questions"]
        if not out and (q := set(tokens(tema))):
            for s in self.stats:
                if q <= set(tokens(words(s["tema"], s["subtema"]))):
                    out[s["institution"]] = out.get(s["institution"], 0) + s["num_questions"]
        return out

    def prepare(self, row):
        tema, sub, eq = clean(row["tema"]) or "", clean(row["subtema"]), clean(row["equivalencia"])
        a, _, b = tema.partition("|")
        own = sub if sub is not None else clean(b) if "|" in tema else None
        r = {"row_idx": row["row_idx"], "tema_raw": tema, "subtema_raw": sub, "equivalencia": eq, "norm_tema": expand(a.strip(" ")) if tema else "", "norm_subtema": expand(own) if tema and own is not None else None}
        return r | {"query": words(r["norm_tema"], r["norm_subtema"], eq)}

    def until_good(self, tries, hits, floor, value):
        """The best hit of the tries in order, the first of equals; none is tried behind a good one."""
        best = None
        for t in tries:
            for score, stat, _ in hits(t):
                if best is None or score > best[1]:
                    best = value(stat, t), score
            if best and best[1] >= K.GOOD_SCORE:
                break
        return best if best and best[1] >= floor else None

    def resolve_tema(self, r):
        known = {s["tema"].lower() for s in self.stats}
        for t in (r["candidate_tema"], r["norm_tema"], r["tema_raw"]):
            if t and t.lower() in known:
                return t, K.EXACT, 1.0
        for t, score in zip((r["tema_raw"], r["norm_tema"], r["equivalencia"]), K.FTS_SCORES, strict=True):
            if t and (s := self.best(t)):
                return s["tema"], K.FTS, score
        q = r["equivalencia"] or r["norm_tema"] or r["tema_raw"]
        long = [w for w in q.split() if len(w) > 3]
        tries = [q, *(c for i in range(len(long)) if (c := " ".join(long[i:])) != q)]
        found = self.until_good(tries, lambda t: self.topics(t, 7)[:1], K.SEMANTIC_FLOOR, lambda s, t: s["tema"])
        return (found[0], K.SEMANTIC, found[1]) if found else (None, K.NONE, 0.0)

    def resolve_subtema(self, r, tema):
        if tema is None or r["subtema_raw"] is None:
            return None
        for t in (r["candidate_subtema"], r["norm_subtema"], r["subtema_raw"]):
            if t and (s := self.exact(tema, t)):
                return s, K.EXACT, 1.0
        for t, score in zip((r["subtema_raw"], r["norm_subtema"]), K.FTS_SCORES, strict=False):
            if t is not None and (s := self.best(shown(tema, t))) and s["tema"].lower() == tema.lower():
                return s, K.FTS, score
        long = sorted((w for w in r["subtema_raw"].split() if len(w) > 3), key=len, reverse=True)
        third = r["norm_subtema"] if r["norm_subtema"] not in (None, r["subtema_raw"]) else f"{tema} {long[0]}" if long else None
        own = lambda t: [h for h in self.topics(t, 5) if h[1]["tema"].lower() == tema.lower() and h[1]["subtema"] is not None and h[0] >= K.SEMANTIC_FLOOR]
        found = self.until_good([t for t in (f"{tema} {r['subtema_raw']}", r["subtema_raw"], third) if t], own, K.SEMANTIC_FLOOR, lambda s, t: s)
        return (found[0], K.SEMANTIC, found[1]) if found else None

    def retry(self, r, old):
        eq, tema, sub = r["equivalencia"], r["tema_raw"], r["subtema_raw"]
        tries = [eq, *([x.strip(" ") for x in eq.split("|")] if "|" in eq else [])] if eq is not None else []
        tries += [words(tema, sub), sub, *(words(tema, w) for w in sub.split() if len(w) > 3)] if sub is not None else [w for w in tema.split() if len(w) > 4]
        tries += [tema] if tema not in tries else []
        tries = [t for t in tries if t]
        level = lambda s: (s["subtema"] is not None) == (sub is not None)
        found = self.until_good(tries, lambda t: [h for h in self.topics(t, 7) if level(h[1]) and h[0] > old], 0.0, lambda s, t: (s, t))
        text = next(((s, "FTS: " + t) for t in tries if old < K.RETRY_FTS_SCORE and (s := self.best(t)) and level(s)), None)
        best = max([x for x in (found, (text, K.RETRY_FTS_SCORE) if text else None) if x], key=lambda x: x[1], default=None)
        if best and (s := self.exact(best[0][0]["tema"], best[0][0]["subtema"])):
            return s, best[1], best[0][1]
        return None

    def reconcile(self, row):
        r = self.prepare(row)
        hits = self.retrieve(r["query"])
        best = hits[0] if hits else None
        r |= {"candidate_tema": best and best[1]["tema_normalized"], "candidate_subtema": best and best[1]["subtema_normalized"]}
        tema, method, score = self.resolve_tema(r)
        has, sub = r["subtema_raw"] is not None, self.resolve_subtema(r, tema)
        stat = (sub and sub[0]) if has else tema is not None and self.exact(tema, None) or None
        if has and tema is not None:
            method, score = sub[1:] if sub else (K.NONE, 0.0)
        final, counts = tema if tema is not None else r["norm_tema"], self.counts(tema, stat and stat["subtema"])
        final_sub = (stat and stat["subtema"]) or r["norm_subtema"]
        if stat and has:
            equivalent = shown(final, stat["subtema"])
        elif stat or tema is not None:
            equivalent = final
        else:
            equivalent = r["equivalencia"] if r["equivalencia"] is not None else shown(final, final_sub) if has else final
        total = sum(counts.values()) if counts else len(hits)
        return {"row_idx": r["row_idx"], "input_tema": shown(r["tema_raw"], r["subtema_raw"]), "input_equivalencia": equivalent, "normalized_tema": final, "normalized_subtema": final_sub if has else None, "questions_by_institution": counts, "match_method": method, "match_score": score, "match_label": label(method, score), "cor_hex": color(total)}

    def reconciled(self, row):
        done = self.reconcile(row)
        r = self.prepare(row)
        if done["match_score"] < K.GOOD_SCORE and (again := self.retry(r, done["match_score"])):
            stat, score, _ = again
            counts = self.counts(stat["tema"], stat["subtema"])
            return done | {"input_equivalencia": r["equivalencia"], "normalized_tema": stat["tema"], "normalized_subtema": stat["subtema"] if stat["subtema"] is not None else done["normalized_subtema"], "questions_by_institution": counts, "match_method": K.SEMANTIC, "match_score": score, "match_label": label(K.SEMANTIC, score), "cor_hex": color(sum(counts.values()))}
        return done

    @staticmethod
    def parts(done):
        a, _, b = done["input_tema"].partition(" | ")
        return a, b

    def below(self, tema, n):
        return sorted((s for s in self.stats if s["subtema"] is not None and s["tema"].lower() == tema.lower()), key=lambda s: (-s["num_questions"], s["id"]))[:n]

    def alternatives(self, done):
        a, b = self.parts(done)
        eq = done["input_equivalencia"]
        found = []
        for t in (a, words(a, b) if b else None, b or None, eq if eq is not None and eq.lower() not in (a.lower(), b.lower()) else None):
            found += [h[1] for h in self.topics(t, 7)] if t else []
        found += [s for t in (a, b or None, eq) if t and (s := self.best(t))]

        def once(rows):
            out = {}
            for s in rows:
                out.setdefault((s["tema"].lower(), (s["subtema"] or "").lower(), s["subtema"] is None), s)
            return list(out.values())

        found = once(found)
        more = [x for s in found[:4] for x in self.below(s["tema"], 8)]
        if done["normalized_tema"].lower() != a.lower():
            more += self.below(done["normalized_tema"], 8)
        level = [s for s in once(found + more) if (s["subtema"] is not None) == bool(b.strip(" "))]
        return sorted(level, key=lambda s: -s["num_questions"])[:15]

    def judged(self, rows, judge, threshold=K.JUDGE_THRESHOLD):
        rows = sorted(rows, key=lambda r: r["row_idx"])
        asked = [r for r in rows if r["match_score"] < threshold or r["match_method"] == K.NONE]
        out = {r["row_idx"]: r for r in rows}
        for at in range(0, len(asked), 5):
            batch = asked[at : at + 5]
            prompt = "\n\n".join(f"[{i}] {self.prompt(r)}" for i, r in enumerate(batch))
            reply = json.loads(next(judge([pd.DataFrame({"batch": [at // 5], "prompt": [prompt]})])).reply[0])
            by_index = {v["index"]: v for v in reply["results"]}
            for i, r in enumerate(batch):
                out[r["row_idx"]] = self.verdict(r, by_index.get(i, {"is_equivalent": True, "confidence": 0.0, "suggested_match": None}))
        return list(out.values())

    def prompt(self, r):
        a, b = self.parts(r)
        current = shown(r["normalized_tema"], r["normalized_subtema"])
        lines = [f'INPUT: tema="{a}" subtema="{b}" equivalencia="{r["input_equivalencia"] or ""}"']
        lines += [f"  * [MATCH ATUAL] {current} ({f'score={r["match_score"]:.0%}' if r['match_score'] > 0 else 'sem match automatico'})"] if current else []
        listed = [(shown(s["tema"], s["subtema"]), s["num_questions"]) for s in self.alternatives(r)[:12]]
        return "\n".join([*lines, "\n".join(f"  - {name} ({n} questoes)" for name, n in listed if name.lower() != current.lower())])

    def verdict(self, r, v):
        if v["is_equivalent"]:
            s, score = self.exact(r["normalized_tema"], r["normalized_subtema"]), max(v["confidence"], r["match_score"])
            sub = s["subtema"] if s and s["subtema"] is not None else r["normalized_subtema"]
            counts = self.counts(r["normalized_tema"], sub) or r["questions_by_institution"]
            total = sum(counts.values())
            equivalent = r["input_equivalencia"] if r["input_equivalencia"] is not None else shown(r["normalized_tema"], sub)
            return r | {"input_equivalencia": equivalent, "normalized_subtema": sub, "questions_by_institution": counts, "match_method": K.LLM, "match_score": score, "match_label": label(K.LLM, score), "cor_hex": color(total) if total > 0 else r["cor_hex"]}
        if v["suggested_match"]:
            name = re.sub(r"\s*\(\d+\s+questoes?\)\s*$", "", v["suggested_match"].strip(" "), flags=re.I).strip(" ")
            a, sep, b = name.partition(" | ")
            s = self.exact(a.strip(" "), b.strip(" ")) if sep else self.exact(name, None) or self.best(name)
            if not s or " | " in r["input_tema"] and s["subtema"] is None:
                return r
            counts = self.counts(s["tema"], s["subtema"])
            return r | {"input_equivalencia": shown(s["tema"], s["subtema"]), "normalized_tema": s["tema"], "normalized_subtema": s["subtema"], "questions_by_institution": counts, "match_method": K.LLM, "match_score": v["confidence"], "match_label": label(K.LLM, v["confidence"]), "cor_hex": color(sum(counts.values()))}
        if r["match_score"] > K.REJECT_CAP:
            return r | {"match_method": K.LLM, "match_score": K.REJECT_CAP, "match_label": label(K.LLM, K.REJECT_CAP)}
        return r
