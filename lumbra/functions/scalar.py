"""Scalar functions on columns: the null rule, synonyms, topic normalisation, colours, labels, curriculum weeks."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .. import constants as K
from .batches import bound_batches

_MISSING = ("", "nan", "none")


def clean(c: Column) -> Column:
    """Trimmed; blank, nan and none are null."""
    t = F.trim(c)
    return F.when(F.lower(t).isin(*_MISSING), None).otherwise(t)


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def expand_synonym(c: Column) -> Column:
    """The expansion of a known abbreviation or alias, else the text as it is; null is empty."""
    key = F.lower(F.trim(c))
    return F.coalesce(F.element_at(_lookup({**K.ALIASES, **K.ABBREVIATIONS}), key), c, F.lit(""))


def split_topic(tema: Column, subtema: Column) -> Column:
    """struct(tema, subtema): a cell "a | b" gives both, an explicit subtema wins, both are expanded. Without a tema there is no subtema."""
    parts = F.split(F.trim(tema), r"\|", 2)
    own = F.coalesce(clean(subtema), clean(F.get(parts, F.lit(1))))
    known = F.coalesce(F.length(tema) > 0, F.lit(False))
    return F.struct(
        F.when(known, expand_synonym(F.trim(F.get(parts, F.lit(0))))).otherwise("").alias("tema"),
        F.when(known & own.isNotNull(), expand_synonym(own)).alias("subtema"),
    )


def color(n: Column) -> Column:
    """struct(cor, cor_hex) of a question count; below the least threshold the last colour holds."""
    named = [F.struct(F.lit(name).alias("cor"), F.lit(code).alias("cor_hex")) for _, name, code in K.COLORS]
    out = named[-1]
    for (least, _, _), s in reversed(list(zip(K.COLORS[:-1], named[:-1], strict=True))):
        out = F.when(n >= least, s).otherwise(out)
    return out


def color_hex(n: Column) -> Column:
    return color(n)["cor_hex"]


def match_label(method: Column, score: Column) -> Column:
    out = F.lit(K.NO_MATCH_LABEL)
    for name, steps in K.LABELS.items():
        own = F.lit(steps[-1][1])
        for least, label in reversed(steps[:-1]):
            own = F.when(score >= least, label).otherwise(own)
        out = F.when(method == name, own).otherwise(out)
    return out


def topic_text(*parts: Column) -> Column:
    """The search text of a row: its parts that are not null, by a space."""
    return F.concat_ws(" ", *parts)


def display(tema: Column, subtema: Column) -> Column:
    return F.concat_ws(" | ", tema, subtema)


def _normalized(t: str | None) -> str:
    base = re.sub(r"[^\x00-\x7f]", lambda m: "" if unicodedata.combining(m[0]) else m[0], unicodedata.normalize("NFKD", (t or "").strip().lower()))
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s|]", "", base)).strip()


@F.arrow_udf(StringType())
def _normalize(s: pa.Array) -> pa.Array:
    return pa.array([_normalized(t.as_py()) for t in s], pa.string())


def normalize_text(c: Column) -> Column:
    """Lower case without accents and punctuation but for |, white space collapsed; null is empty. Texts go to Python in batches of bounded bytes."""
    bound_batches(SparkSession.active())
    return _normalize(c)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed characters, so that equal letters are equal; null stays."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def specialty(normalized: Column) -> Column:
    """The first specialty one of whose keywords is a part of the normalised text, else null. Keywords with accents find nothing there."""
    out = F.lit(None).cast("string")
    for name, words in reversed(K.SPECIALTIES.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(normalized, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


@F.pandas_udf(StringType())
def fuzzy_synonym(s: pd.Series) -> pd.Series:
    """The expansion of the term most alike by matching blocks, from FUZZY on; the first of equals; else null."""
    table = {**K.ABBREVIATIONS, **{k: v for k, v in K.ALIASES.items() if k not in K.ABBREVIATIONS}}

    def one(text: str | None) -> str | None:
        key = (text or "").strip().lower()
        if not key:
            return None
        if key in table:
            return table[key]
        best, found = 0.0, None
        for name, value in table.items():
            m = SequenceMatcher(None, key, name)
            if m.real_quick_ratio() > best and (r := m.ratio()) > best and r >= K.FUZZY:
                best, found = r, value
        return found

    known = {t: one(t) for t in s.unique()}
    return s.map(known)


@F.pandas_udf(DoubleType())
def text_confidence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness by matching blocks plus 0.1, at most 1; 0 where either is empty."""
    return pd.Series([min(1.0, SequenceMatcher(None, x.lower(), y.lower()).ratio() + 0.1) if x and y else 0.0 for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])


@F.pandas_udf(StringType())
def percent_text(score: pd.Series) -> pd.Series:
    """Whole percent, halves to even on the binary value."""
    return score.map(lambda x: None if x is None or pd.isna(x) else f"{x:.0%}")


def week_number(c: Column) -> Column:
    """A week cell as an integer; unreadable is UNKNOWN_WEEK, an empty cell null."""
    return F.when(c.isNull() | (F.trim(c) == ""), None).otherwise(F.coalesce(c.try_cast("double").try_cast("int"), F.lit(K.UNKNOWN_WEEK)))


def week_text(n: Column) -> Column:
    return F.when(n >= K.UNKNOWN_WEEK, "").otherwise(F.format_string("%02d", n))


def decimal_comma(c: Column) -> Column:
    """"12,5" as a double; what has thousands' points is null."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def clean_suggestion(c: Column) -> Column:
    """A judge's suggestion without the marks that its prompt put around names; brackets that belong to names stay."""
    s = F.trim(c)
    for pattern in (r"^[*\-]\s*\[MATCH ATUAL\]\s*", r"^[*\-]\s*", r"(?i)\s*\(\d+\s+questoes?\)\s*$", r"(?i)\s*\(score=\d+%[^)]*\)\s*$", r"(?i)\s*\(sem match[^)]*\)\s*$"):
        s = F.regexp_replace(s, pattern, "")
    return F.trim(s)


def suffix_chunks(c: Column, longer: int = 3) -> Column:
    """All suffixes of the words longer than ``longer``: "alpha of beta gamma" gives alpha beta gamma, beta gamma, gamma."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.length(w) > longer)
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " "))).otherwise(F.array().cast("array<string>"))


def longest_word(c: Column, longer: int = 3) -> Column:
    """The first of the longest words over ``longer`` characters, or null."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: F.length(w) > longer)
    ranked = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.get(F.array_sort(ranked), F.lit(0))["w"]
