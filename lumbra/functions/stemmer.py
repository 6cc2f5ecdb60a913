"""The Portuguese stemmer, from the published description of the Snowball algorithm."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = frozenset("aeiouáéíóúâêô")


def _after(word: str, start: int) -> int:
    """Behind the first consonant that follows a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in _VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in _VOWELS), len(word))
    if word[0] in _VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in _VOWELS), len(word))
    return 3


def _longest(word: str, suffixes: tuple[str, ...] | frozenset[str]) -> str:
    for n in range(min(len(word), _MOST), 0, -1):
        if word[-n:] in suffixes:
            return word[-n:]
    return ""


# The suffixes of the published algorithm.
_DELETE = tuple("eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância".split())
_LOG, _UCA, _ENC, _AMENTE, _MENTE, _IDADE, _IVA, _IRA = ("logia", "logias"), ("ução", "uções"), ("ência", "ências"), ("amente",), ("mente",), ("idade", "idades"), ("iva", "ivo", "ivas", "ivos"), ("ira", "iras")
_VERBS = frozenset(
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras".split()
)
_GROUPS = (_DELETE, _LOG, tuple(x.replace("ã", "a~").replace("õ", "o~") for x in _UCA), _ENC, _AMENTE, _MENTE, _IDADE, _IVA, _IRA)
_SUFFIXES = frozenset(x for g in _GROUPS for x in g)
_MOST = max(map(len, _SUFFIXES | _VERBS))


@lru_cache(1 << 16)
def stem(word: str) -> str:
    w = word.replace("ã", "a~").replace("õ", "o~")
    rv, r1 = _rv(w), _after(w, 0)
    r2 = _after(w, r1)
    before = w
    w = _standard(w, r1, r2, rv)
    if w == before:
        s = _longest(w[rv:], _VERBS)
        if s:
            w = w[: len(w) - len(s)]
    if w != before:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        s = _longest(w[rv:], ("os", "a", "i", "o", "á", "í", "ó"))
        w = w[: len(w) - len(s)] if s else w
    tail = w[rv:] if rv < len(w) else ""
    if tail.endswith(("e", "é", "ê")):
        w = w[:-1]
        if w.endswith("gu") and len(w) - 1 >= rv or w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


def _standard(w: str, r1: int, r2: int, rv: int) -> str:
    s = _longest(w, _SUFFIXES)
    if not s:
        return w
    at = len(w) - len(s)
    if s in _DELETE:
        return w[:at] if at >= r2 else w
    if s in _LOG:
        return w[:at] + "log" if at >= r2 else w
    if s in _GROUPS[2]:
        return w[:at] + "u" if at >= r2 else w
    if s in _ENC:
        return w[:at] + "ente" if at >= r2 else w
    if s == "amente":
        if at < r1:
            return w
        w = w[:at]
        for tail, more in (("iv", "at"), ("os", ""), ("ic", ""), ("ad", "")):
            if w.endswith(tail) and len(w) - 2 >= r2:
                w = w[:-2]
                if more and w.endswith(more) and len(w) - 2 >= r2:
                    w = w[:-2]
                break
        return w
    if s == "mente":
        if at < r2:
            return w
        w = w[:at]
        t = _longest(w, ("ante", "avel", "ável", "ível"))
        return w[: len(w) - len(t)] if t and len(w) - len(t) >= r2 else w
    if s in _IDADE:
        if at < r2:
            return w
        w = w[:at]
        t = _longest(w, ("abil", "ic", "iv"))
        return w[: len(w) - len(t)] if t and len(w) - len(t) >= r2 else w
    if s in _IVA:
        if at < r2:
            return w
        w = w[:at]
        return w[:-2] if w.endswith("at") and len(w) - 2 >= r2 else w
    if at >= rv and w[:at].endswith("e"):  # -ira behind e
        return w[:at] + "ir"
    return w
