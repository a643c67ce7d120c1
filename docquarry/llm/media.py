"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, resampled to linear PCM.

Companded samples are expanded by lookup tables. ADPCM blocks are independent of
one another, so one step decodes the same nibble of all blocks at once. The
decoded 8 kHz sound is interpolated to 16 kHz and stored as 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm import shared

RATE, BLOCK, CHUNK = 8000, 64, 1 << 20
#: Bytes of coded sound that a worker handles at once, if files are shorter; their PCM takes four to eight times as much.
SLICE_BYTES = 1_000_000
#: WAV format tags.
CODECS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
#: Fixed values of IMA ADPCM: step sizes and what a nibble adds to the step's index.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_SHIFT = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """Linear 16-bit value of each mu-law code (G.711)."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear 16-bit value of each A-law code (G.711)."""
    code = np.arange(256) ^ 0x55
    exponent, size = (code >> 4) & 7, ((code & 0x0F) << 4) + 8
    size = np.where(exponent > 0, (size + 0x100) << np.maximum(exponent - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, bytes) of mono IMA ADPCM to (blocks, samples); step indexes beyond the table are held at its end."""
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    nibbles = np.stack([blocks[:, 4:] & 0x0F, blocks[:, 4:] >> 4], axis=2).reshape(len(blocks), -1).T.copy()
    out = np.empty((len(nibbles) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, nibble in enumerate(nibbles):
        step = STEPS[index]
        size = (step >> 3) + step * (nibble >> 2 & 1) + (step >> 1) * (nibble >> 1 & 1) + (step >> 2) * (nibble & 1)
        value = np.clip(np.where(nibble & 8, value - size, value + size), -32768, 32767)
        index = np.clip(index + INDEX_SHIFT[nibble & 7], 0, 88)
        out[k + 1] = value
    return out.T


def wav(codec: str, data: bytes, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A mono WAV file around samples that are already coded; codec may also be pcm16."""
    if codec == "adpcm":
        per_block = (block - 4) * 2 + 1
        form = struct.pack("<HHIIHHHH", CODECS[codec], 1, rate, rate * block // per_block, block, 4, 2, per_block)
    elif codec == "pcm16":
        form = struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16)
    else:
        form = struct.pack("<HHIIHHH", CODECS[codec], 1, rate, rate, 1, 8, 0)
    samples = len(data) // block * per_block if codec == "adpcm" else len(data)
    fact = b"" if codec == "pcm16" else b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and the data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, names = 12, b"", {v: k for k, v in CODECS.items()} | {1: "pcm16"}
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form = media[at + 8 : at + 8 + size]
        elif kind == b"data":
            tag, _, rate, _, block = struct.unpack_from("<HHIIH", form)
            return names[tag], rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def linear(codec: str, block: int, data: bytes) -> Iterator[np.ndarray]:
    """Decoded 16-bit samples, a bounded chunk at a time."""
    raw = np.frombuffer(data, np.uint8)
    if codec == "adpcm":
        rows = raw[: raw.size // block * block].reshape(-1, block)
        for first in range(0, len(rows), CHUNK // block):
            yield decode_adpcm(rows[first : first + CHUNK // block]).ravel()
    else:
        for first in range(0, raw.size, CHUNK):
            yield TABLES[codec][raw[first : first + CHUNK]]


def double_rate(chunks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Twice the samples, those between by linear interpolation (rounded down); the last one is held."""
    waiting = None
    for chunk in chunks:
        own = chunk.astype(np.int32) if waiting is None else np.concatenate([waiting, chunk]).astype(np.int32)
        waiting = own[-1:]
        out = np.empty(2 * (own.size - 1), np.int16)
        out[0::2], out[1::2] = own[:-1], (own[:-1] + own[1:]) >> 1
        yield out
    if waiting is not None:
        yield np.repeat(waiting, 2).astype(np.int16)


def summary(codec: str, pcm: Iterator[np.ndarray]) -> tuple[str, int, str]:
    """Feature string, bytes and SHA-256 of resampled PCM."""
    samples, squares, peak, crossings, last, digest = 0, 0, 0, 0, 0, hashlib.sha256()
    for chunk in pcm:
        if not chunk.size:
            continue
        wide = chunk.astype(np.int64)
        signs = np.concatenate([[last], wide >= 0])
        crossings += int(np.count_nonzero(signs[1:] != signs[:-1])) - (samples == 0 and signs[0] != signs[1])
        samples, squares, peak, last = samples + chunk.size, squares + int(wide @ wide), max(peak, int(np.abs(wide).max())), bool(wide[-1] >= 0)
        digest.update(chunk.astype("<i2", copy=False).tobytes())
    rms = (squares / samples) ** 0.5 if samples else 0.0
    return f"codec={codec};rate={2 * RATE};samples={samples};rms={rms:.3f};peak={peak};crossings={crossings}", 2 * samples, digest.hexdigest()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length and the bytes filled with zeros to a positive multiple of BLOCK."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")


def store(payload: bytes) -> bytes:
    """The payload as the coded samples of a WAV file; which codec reads them follows from its checksum."""
    return wav(sorted(CODECS)[zlib.crc32(payload) % len(CODECS)], payload)


def coded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a WAV file of coded samples; null text counts as empty."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def build(doc_ids: list, texts: list) -> dict:
        sizes, payloads = zip(*map(payload_of, texts))
        return {"doc_id": doc_ids, "n_bytes": sizes, "media": [store(p) for p in payloads]}

    return shared.map_texts(docs, build, "doc_id long, n_bytes long, media binary", arrow)


FEATURES = [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("codec", "string"), ("pcm_bytes", "long"), ("pcm_sha256", "string")]


def decoded(stored: DataFrame, keep_media: bool = True) -> DataFrame:
    """doc_id, n_bytes and what the WAV files of the column ``media`` hold; with keep_media also media and pcm, the 16 kHz sound as a WAV file."""
    fields = [("doc_id", "long"), ("n_bytes", "long"), *FEATURES] + [("media", "binary"), ("pcm", "binary")] * keep_media
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(n, types[t]) for n, t in fields])

    def build(doc_ids: list, sizes: list, files: list) -> dict:
        out, back = defaultdict(list), [read_wav(m) for m in files]
        small = [k for k, (codec, _, block, data) in enumerate(back) if codec == "adpcm" and len(data) <= CHUNK]
        sound = {}
        if small:  # all their blocks at once
            rows = np.frombuffer(b"".join(back[k][3] for k in small), np.uint8).reshape(-1, BLOCK)
            linear_rows = np.concatenate([decode_adpcm(rows[first : first + CHUNK // BLOCK]) for first in range(0, len(rows), CHUNK // BLOCK)])
            ends = np.cumsum([len(back[k][3]) // BLOCK for k in small])
            sound = {k: part.ravel() for k, part in zip(small, np.split(linear_rows, ends[:-1]))}
        for k, (doc_id, n, media, (codec, _, block, data)) in enumerate(zip(doc_ids, sizes, files, back)):
            chunks = (lambda k=k, codec=codec, block=block, data=data: double_rate(iter([sound[k]]) if k in sound else linear(codec, block, data)))
            feature, size, digest = summary(codec, chunks())
            row = (doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, codec, size, digest)
            if keep_media:
                row += (media, wav("pcm16", b"".join(c.astype("<i2", copy=False).tobytes() for c in chunks()), 2 * RATE))
            for (name, _), v in zip(fields, row):
                out[name].append(v)
        return out

    return shared.map_texts(stored, build, ", ".join(f"{n} {t}" for n, t in fields), arrow, [F.col(c) for c in ("doc_id", "n_bytes", "media")], text_at=2, most=SLICE_BYTES)


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """One row a document with its stored form, what is read back from that column and features of the sound.

    Null text counts as empty: one block of zeros. Equal texts give equal
    values. With keep_media also the WAV file and the 16 kHz PCM, as binaries.
    Repeated rows and null ids stay; other columns are ignored. Whole texts count, however long, each in one task;
    an empty table gives no rows.
    """
    return decoded(coded(docs), keep_media)
