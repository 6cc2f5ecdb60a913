"""Media columns: telephony audio in WAV containers.

mu-law and A-law are expanded by lookup tables computed from their definitions; IMA ADPCM blocks are decoded
in numpy one sample step at a time across all blocks of a batch; PCM is resampled by linear interpolation to a
whole multiple of its rate and can be stored as 16-bit WAV.

Null texts and empty texts are 64 zero bytes of payload. Media bytes that are no WAV of the expected format
give null PCM (:func:`decode_audio`).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks, keyed_texts, map_texts, record

RATE = 8000
BLOCK = 64
#: Format tags of WAV.
PCM, A_LAW, MU_LAW, IMA = 1, 6, 7, 17


def mu_law_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    exponent, mantissa = (code >> 4) & 7, (code & 15).astype(np.int32)
    size = (((mantissa << 3) + 132) << exponent) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = ((code >> 4) & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def ima_steps() -> np.ndarray:
    """The 89 quantiser steps, each about 1.1 times the one before."""
    # The step table of IMA ADPCM.
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        np.int32,
    )


MU, A, STEPS = mu_law_table(), a_law_table(), ima_steps()
MU_POWER, A_POWER = MU.astype(np.int64) ** 2, A.astype(np.int64) ** 2
#: How a nibble moves the step index.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """(step index, nibble) to difference and next index."""
    nib = np.arange(16, dtype=np.int32)[None]
    step = STEPS[:, None]
    diff = (step >> 3) + np.where(nib & 4, step, 0) + np.where(nib & 2, step >> 1, 0) + np.where(nib & 1, step >> 2, 0)
    return np.where(nib & 8, -diff, diff).astype(np.int32).ravel(), np.clip(np.arange(89)[:, None] + MOVES[nib[0]][None], 0, 88).astype(np.int32).ravel()


DIFF, NEXT = _ima_tables()
NEXT16 = NEXT * 16


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """(n, size) mono blocks, each with its 4-byte header, to (n, 1 + 2 (size - 4)) samples."""
    n, size = blocks.shape
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    index <<= 4
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = value
    at, step = np.empty(n, np.int32), np.empty(n, np.int32)
    for i, byte in enumerate(data):
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            np.add(index, nibble, out=at)
            np.take(DIFF, at, out=step, mode="clip")
            value += step
            np.minimum(value, 32767, out=value)
            np.maximum(value, -32768, out=value)
            np.take(NEXT16, at, out=index, mode="clip")
            out[1 + 2 * i + half] = value
    return out.T


def resample(pcm: np.ndarray, factor: int = 2) -> np.ndarray:
    """Linear interpolation to ``factor`` times the rate; the last sample is held."""
    x = pcm.astype(np.int32)
    after = np.append(x[1:], x[-1:])
    steps = np.arange(factor, dtype=np.int32)
    return ((x[:, None] * (factor - steps) + after[:, None] * steps) // factor).astype(np.int16).ravel()


def wav(payload: bytes, tag: int = MU_LAW, rate: int = RATE, bits: int = 8, align: int = 1) -> bytes:
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * align, align, bits, 0)
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(payload) // align) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def parse_wav(media: bytes | None) -> tuple[int, int, int, bytes] | None:
    """(format tag, rate, block size, payload), or None if it is no WAV."""
    if media is None or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        if name == b"data" and fmt:
            return fmt[0], fmt[2], fmt[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def pcm_of(media: bytes | None) -> tuple[int, np.ndarray] | None:
    """(rate, samples) of a mono WAV in mu-law, A-law, IMA ADPCM or 16-bit PCM."""
    if (found := parse_wav(media)) is None:
        return None
    tag, rate, align, payload = found
    raw = np.frombuffer(payload, np.uint8)
    if tag in (MU_LAW, A_LAW):
        return rate, (MU if tag == MU_LAW else A)[raw]
    if tag == PCM:
        return rate, np.frombuffer(payload[: len(payload) // 2 * 2], "<i2")
    if tag == IMA and align > 4:
        return rate, decode_ima(raw[: len(raw) // align * align].reshape(-1, align)).ravel()
    return None


def decode_audio(df: DataFrame, media_col: str = "media", factor: int = 2, out_col: str = "pcm") -> DataFrame:
    """``df`` with ``out_col``: the resampled 16-bit PCM WAV of a media column; null where the bytes can't be decoded."""
    bound_batches(df.sparkSession)
    schema = df.drop(out_col).withColumn(out_col, F.lit(None).cast("binary")).schema

    def run(batches):
        for b in batches:
            out = [None if (p := pcm_of(m)) is None or not len(p[1]) else wav(resample(p[1], factor).tobytes(), PCM, p[0] * factor, 16, 2) for m in b.column(media_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.drop_columns([out_col] if out_col in b.schema.names else []).columns, pa.array(out, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, n_bytes and media: the text's UTF-8 bytes, zero-padded to a multiple of 64, as the mu-law samples of a WAV."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
        return record(schema, part.column("doc_id"), [len(r) for r in raw], [wav(r + b"\0" * (max(1, -(-len(r) // BLOCK)) * BLOCK - len(r))) for r in raw])

    return map_texts(keyed_texts(docs, **columns), run, "doc_id long, n_bytes long, media binary")


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts)


def features(payloads: list[bytes]) -> list[str]:
    """By payload: mean square in mu-law and A-law, zero crossings, ADPCM level and crest of the resampled PCM. All payloads are decoded as one array."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.array([len(p) for p in payloads])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mu = MU[raw]
    adpcm = np.abs(decode_ima(raw.reshape(-1, BLOCK)).astype(np.int32)).sum(1, dtype=np.int64)
    sign = mu < 0
    turn = np.concatenate([[False], sign[1:] != sign[:-1]])
    turn[starts] = False
    wide = resample(mu).astype(np.int32)
    slope = np.empty_like(wide)
    np.subtract(wide[1:], wide[:-1], out=slope[:-1])
    slope[-1] = 0
    np.abs(slope, out=slope)
    slope[2 * (starts[1:]) - 1] = 0  # between two texts
    slope[2 * (starts[1:]) - 2] = 0
    cols = (_sums(MU_POWER[raw], starts) // sizes, _sums(A_POWER[raw], starts) // sizes, np.add.reduceat(turn, starts, dtype=np.int64), _sums(adpcm, starts // BLOCK) * BLOCK // sizes, np.add.reduceat(slope, 2 * starts, dtype=np.int64) // sizes)
    return [":".join(map(str, row)) for row in zip(*(c.tolist() for c in cols), strict=True)]


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(stored: DataFrame) -> DataFrame:
    """What is read back from a media column of :func:`encode_texts`."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        for whole in batches:
            for b in chunks([whole], "media", 1 << 20):
                media = b.column("media").to_pylist()
                payload = [parse_wav(m)[3] for m in media]
                yield record(
                    schema, b.column("doc_id"), b.column("n_bytes"), [len(p) for p in payload], [hashlib.sha256(p).hexdigest() for p in payload],
                    [zlib.crc32(p[-BLOCK:]) for p in payload], [len(m) for m in media], [hashlib.sha256(m).hexdigest() for m in media], features(payload),
                )

    return stored.mapInArrow(run, DIGEST)
