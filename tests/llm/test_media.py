import hashlib
import struct
import zlib

import numpy as np

from docquarry.llm import media


def test_companding_tables():
    """Both laws are odd, monotone in size and have the standard's end values."""
    mu, a = media.TABLES["mulaw"].astype(int), media.TABLES["alaw"].astype(int)
    assert mu[0x00] == -32124 and mu[0x80] == 32124 and mu[0xFF] == 0 and mu[0x7F] == 0
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    assert (mu[:128] == -mu[128:]).all() and (a[:128] == -a[128:]).all()


def slow_adpcm(block):
    value, index = struct.unpack("<hB", block[:3])
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            size = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                size += part if nibble & bit else 0
            value = max(-32768, min(32767, value - size if nibble & 8 else value + size))
            index = max(0, min(88, index + int(media.INDEX_SHIFT[nibble & 7])))
            out.append(value)
    return out


def test_adpcm_blocks_equal_one_by_one():
    raw = np.random.default_rng(4).integers(0, 256, (40, 64), dtype=np.uint8)
    assert media.decode_adpcm(raw).tolist() == [slow_adpcm(b.tobytes()) for b in raw]


def test_resampling_over_chunks():
    x = np.random.default_rng(1).integers(-32768, 32767, 1000).astype(np.int16)
    whole = np.concatenate(list(media.double_rate(iter([x]))))
    parts = np.concatenate(list(media.double_rate(iter(np.split(x, [1, 7, 500])))))
    assert (whole == parts).all() and (whole[::2] == x).all() and len(whole) == 2000
    assert (whole[1:-1:2] == (x[:-1].astype(int) + x[1:]) // 2).all()


def test_rows(spark):
    texts = ["", None, "hello", "hello", "é" * 32, "x" * 64, "long text " * 30000, *(f"some text {i}" for i in range(40))]
    df = spark.createDataFrame([(i if i != 3 else None, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, codec string")
    rows = media.media_columns(df).collect()
    assert len(rows) == len(texts) and {r.codec for r in rows} == set(media.CODECS)
    for r in rows:
        raw = ((texts[r.doc_id] if r.doc_id is not None else "hello") or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        codec, rate, _, data = media.read_wav(bytes(r.media))
        assert (data, rate, codec) == (payload, 8000, r.codec)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(r.media), hashlib.sha256(r.media).hexdigest())
        kind, rate, _, pcm = media.read_wav(bytes(r.pcm))
        assert (kind, rate, len(pcm), hashlib.sha256(pcm).hexdigest()) == ("pcm16", 16000, r.pcm_bytes, r.pcm_sha256)
        if len(payload) > 10_000:
            continue
        slow = [v for i in range(0, len(payload), 64) for v in slow_adpcm(payload[i : i + 64])] if codec == "adpcm" else [int(media.TABLES[codec][b]) for b in payload]
        twice = [x for a, b in zip(slow, [*slow[1:], slow[-1]]) for x in (a, (a + b) >> 1)]
        assert struct.unpack(f"<{len(twice)}h", pcm) == tuple(twice)
        signs = [x >= 0 for x in twice]
        want = (len(twice), f"{(sum(x * x for x in twice) / len(twice)) ** 0.5:.3f}", max(map(abs, twice)), sum(a != b for a, b in zip(signs, signs[1:])))
        assert r.feature == "codec={};rate=16000;samples={};rms={};peak={};crossings={}".format(codec, *want)
    by = {}
    for r in rows:
        by.setdefault(texts[r.doc_id or 0] if r.doc_id is not None else "hello", set()).add((r.feature, r.media_sha256))
    assert all(len(v) == 1 for v in by.values()) and media.media_columns(df.limit(0)).count() == 0
