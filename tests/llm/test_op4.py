import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from heronry.llm import op4_media as op


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=2000))
def test_round_trip(data):
    p = op.pad(data)
    assert len(p) % 64 == 0 and len(p) > 0 and p.startswith(data) and not p[len(data) :].strip(b"\0")
    assert op.from_wav(op.to_wav(p)) == p


def test_tone_is_found_and_blocks_agree():
    t = np.arange(op.HOP * 5000)
    tone = (128 + 100 * np.sin(2 * np.pi * 20 * t / op.FRAME)).astype(np.uint8).tobytes()
    bins, best = op.peaks(tone)
    assert (best[:-4] == 20).all()
    whole = op.fingerprint(tone)
    before, op.BLOCK = op.BLOCK, 7
    try:
        assert (op.fingerprint(tone) == whole).all()
    finally:
        op.BLOCK = before
    assert (np.diff(whole) >= 0).all()


def slow_fingerprint(samples):
    """Pair codes by a plain Fourier sum, frame by frame."""
    n, size = max(1, -(-len(samples) // op.HOP)), op.FRAME
    wave = np.exp(-2j * np.pi * np.outer(np.arange(size // 2 + 1), np.arange(size)) / size)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    found = []
    for k in range(n):
        part = [float(b) - 128 for b in samples[k * op.HOP : k * op.HOP + size]]
        frame = np.array(part + [0.0] * (size - len(part)))
        power = abs(wave @ ((frame - frame.mean()) * hann))
        floor = max(1.5 * power.mean(), 1e-3)
        tops = [max(range(a, b), key=lambda i: (power[i], -i)) for a, b in zip(op.BANDS, op.BANDS[1:])]
        strong = [(power[i], i) for i in tops if power[i] > floor]
        found.append(([i for _, i in strong], max(strong, key=lambda x: x[0])[1] if strong else None))
    out = []
    for k, (peaks, _) in enumerate(found):
        for d in range(op.AHEAD + 1):
            best = found[k + d][1] if k + d < n else None
            out += [(k << 32) | (i << 20) | (best << 8) | d for i in peaks if best is not None and (i != best or d)]
    return sorted(out)


def test_fingerprint_equals_plain_fourier_sums():
    rng = np.random.default_rng(3)
    words = ["alpha", "beta", "gamma,", "delta.", "  ", "12", "été"]
    for n in (0, 1, 7, 60, 300):
        p = op.pad(" ".join(rng.choice(words, n)).encode())
        assert op.fingerprint(p).tolist() == slow_fingerprint(p)
    noise = rng.integers(0, 256, 4096, dtype=np.uint8).tobytes()
    assert op.fingerprint(noise).tolist() == slow_fingerprint(noise)


def test_one_very_long_text(spark):
    d = spark.createDataFrame([(1, "wave and tone " * 400_000)], "doc_id long, text string")
    r = op.media_columns(d).first()
    assert r.n_bytes == 5_600_000 and op.from_wav(bytes(r.media))[: r.n_bytes] == b"wave and tone " * 400_000 and len(r.fingerprint) > 1000


def test_media_columns(spark):
    rows = [(1, None, b"x"), (2, "abc", b"y"), (2, "abc", b"y"), (None, "é" * 100_000, b"z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, media binary")
    got = op.media_columns(d).collect()
    assert len(got) == 4
    for r, (_, t, _) in zip(sorted(got, key=lambda r: (r[0] is None, r[0] or 0)), rows):
        data = (t or "").encode()
        p = op.pad(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert op.from_wav(bytes(r.media)) == p
    assert op.media_columns(d.limit(0)).collect() == []
