"""Secret scan: base patterns, and dictionary-primed zstandard novelty.

A candidate is a token in a sensitive context: 16 or more characters that begin or end within NEAR characters of a sensitive word, or 8 or more as the
value behind the word (or a name that holds it) and a : or =. What stands behind the word in the same name (session_...) is a candidate by itself. Its novelty
is the marginal size: the compressed size of the surrounding text with the candidate, less that without it, under a
dictionary of code, identifiers and the vocabulary of a public tokenizer, divided by the candidate's length; the smaller of that as written and in
lower case. Words, paths and names are made of the dictionary's parts; keys do not compress and take 8 bits a character or more. Candidates
from NOVEL on that no base span covers are reported as ``novel``; numbers, dates and single repeated characters are none.

Null texts are empty and have no spans; a text of any length is scanned whole. Repeated rows give equal rows, null doc_ids are kept, extra columns are ignored.
An empty table gives no rows. Of candidates that overlap the first counts; base spans stay whatever the model finds.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from bisect import bisect_left
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import keyed_texts, map_texts, record

#: The base patterns.
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")

CONTEXT = re.compile(r"(?ai:passw|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|signature|session)")
#: A text without any of these has no match of ASSIGN, or of CONTEXT.
_STEMS = ("passw", "secret", "token", "api")
_HINTS = ("passw", "pwd", "secret", "token", "credential", "key", "auth", "bearer", "signature", "session")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: What stands between a sensitive name and its value, and the value.
VALUE = re.compile(r"""[A-Za-z0-9_-]{0,32}["']?\x20*[:=]+>?\x20*["']?([A-Za-z0-9+/_.=-]{8,})""")
#: Tokens that are numbers, dates, or one character repeated.
PLAIN = re.compile(r"[0-9TZ:+./=_-]+|(.)\1*")
#: Characters from a sensitive word within which a candidate begins or ends, and the context taken on each side of it.
NEAR, AROUND = 48, 64
#: Bits a character.
NOVEL = 7.75

_IDENTIFIERS = """
password passwd secret token api_key apikey access_key private_key client_secret authorization bearer credential session signature
username user_name email address config configuration settings environment production development localhost example changeme placeholder
getElementById addEventListener toString hashCode equals length substring indexOf parseInt stringify undefined prototype constructor
import from return def class self function const let var public private protected static final void string integer boolean double float
public static void main(String[] args) { if (x == null) { return false; } else { for (int i = 0; i < n; i++) { } }
https://www.example.com/index.html?id=1234567890&name=value /usr/local/share/doc/readme.txt application/json text/plain charset=utf-8
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ aaaaaaaaaaaaaaaa 0000000000000000 1111111111111111 xxxxxxxxxxxxxxxx
YOUR_API_KEY_HERE your-secret-token-here your_password_here REPLACE_WITH_YOUR_KEY ENTER_YOUR_TOKEN_HERE INSERT_SECRET_KEY
tokenization tokenizer_config authentication authorization_endpoint refresh_token access_token id_token token_type expires_in grant_type
the of and that for with this from have not are was which their would there about other when them these some into could than
information government development international organization understanding responsibility environment approximately characteristics
""".encode()


def vocabulary_paths() -> tuple[str, ...]:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def dictionary(paths: tuple[str, ...]) -> bytes:
    """Words of four characters or more of the vocabularies, the most common last, and the identifiers behind them."""
    parts = []
    for path in paths:
        if path.endswith(".json"):
            words = [w.removesuffix("</w>").encode() for w in json.loads(Path(path).read_text())["model"]["vocab"]]
        else:
            words = [base64.b64decode(line.split()[0]).strip() for line in Path(path).read_bytes().splitlines() if line]
        parts.append(b" ".join(reversed(list(dict.fromkeys(w.lower() for w in words if len(w) >= 4 and not w.isdigit())))))
    return b" ".join([*parts, _IDENTIFIERS])


class Novelty:
    """Marginal compressed size under the dictionary; one to a worker process."""

    def __init__(self, paths: tuple[str, ...] | None = None, level: int = 12) -> None:
        words = zstandard.ZstdCompressionDict(dictionary(vocabulary_paths() if paths is None else paths), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)

    def bits(self, text: str, start: int, end: int) -> float:
        """Bits a character that the span adds to its surroundings."""

        def added(before: str, own: str, after: str) -> int:
            size = lambda x: len(self.compressor.compress(x.encode("utf-8", "replace")))
            return size(before + own + after) - size(before + after)

        parts = text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND]
        return 8 * min(added(*parts), added(*(x.lower() for x in parts))) / (end - start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in order of start and kind; code points."""
    low = text.lower()  # for these tests alone: its offsets can differ
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8] if any(x in low for x in _STEMS) else []
    found += [(m.start(), 1, m.end()) for m in (ACCESS.finditer(text) if "AKIA" in text else ())]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """The spans in sensitive contexts whose novelty is asked, in order."""
    words = [m.span() for m in CONTEXT.finditer(text)]
    found, behind = set(), 0
    for start, end in words:
        if start >= behind and (v := VALUE.match(text, end)):
            found.add(v.span(1))
            behind = v.end()
    starts = [s for s, _ in words]
    for c in CANDIDATE.finditer(text):
        start, end = c.span()
        i = bisect_left(starts, end) - 1  # the last word that begins before the token ends
        if i >= 0 and words[i][1] > start:  # in the token itself: what stands behind the word
            start = words[i][1]
            while start < end and text[start] in "_-=/+":
                start += 1
            if end - start >= 16:
                found.add((start, end))
        elif i >= 0 and start - words[i][1] <= NEAR or i + 1 < len(words) and words[i + 1][0] - end <= NEAR:
            found.add((start, end))
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int]]:
    low = text.lower()
    if not any(x in low for x in _HINTS):
        return []
    found, last = [], 0
    for start, end in candidates(text):
        if start < last or PLAIN.fullmatch(text, start, end) or any(s < end and e > start for s, _, e in base):
            continue
        if novelty.bits(text, start, end) >= NOVEL:
            found.append((start, end))
            last = end
    return found


SCAN = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def scan(docs: DataFrame, vocabularies: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each row of ``docs``; n_assign, n_access and n_hex count base spans, n_novel the added ones. ``vocabularies``: files of public tokenizers."""
    paths = vocabulary_paths() if vocabularies is None else vocabularies
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_novel", pa.int64())])
    novelty: list[Novelty] = []

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if not novelty:
            novelty.append(Novelty(paths))
        counts, digests, spans, novel = ([], [], []), [], [], []
        for text in part.column("text").to_pylist():
            base = base_spans(text)
            more = novel_spans(text, base, novelty[0])
            for k in range(3):
                counts[k].append(sum(b[1] == k for b in base))
            digests.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
            every = sorted([*base, *((s, 3, e) for s, e in more)])
            spans.append(",".join(f"{(*KINDS, 'novel')[k]}:{s}:{e}" for s, k, e in every))
            novel.append(len(more))
        return record(schema, part.column("doc_id"), *counts, digests, spans, novel)

    return map_texts(keyed_texts(docs), run, SCAN)
