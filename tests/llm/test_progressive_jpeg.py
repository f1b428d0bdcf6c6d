"""The decoder is held against a plain encoder written here from the standard, over random coefficients."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from marginalia.llm.progressive_jpeg import ZIGZAG, accumulate, decode, media_columns, pack_payloads, parse, unpack_payload

SYMBOLS = [0x00, 0x10, 0x20, 0x30, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]
LENGTH = 8  # of every code of the AC table: canonical, so the code is the index


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value, f"0{n}b") if n else ""

    def done(self):
        text = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def magnitude(bits, v, size):
    bits.put(v if v > 0 else v + (1 << size) - 1, size)


def size_of(v):
    return abs(v).bit_length()


def segment(kind, body):
    return struct.pack(">BBH", 255, kind, len(body) + 2) + body


def shifted(v, low):
    return int(abs(v) >> low) * (1 if v > 0 else -1)


def ac_first(blocks, first, last, low, ac):
    bits, run = Bits(), 0

    def flush():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            bits.put(ac[n << 4], LENGTH)
            bits.put(run - (1 << n), n)
            run = 0

    for block in blocks:
        zeros = 0
        for k in range(first, last + 1):
            v = shifted(block[k], low)
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                bits.put(ac[0xF0], LENGTH)
                zeros -= 16
            bits.put(ac[zeros << 4 | size_of(v)], LENGTH)
            magnitude(bits, v, size_of(v))
            zeros = 0
        if zeros:
            run += 1
            if run == 15:
                flush()
    flush()
    return bits.done()


def ac_refine(blocks, first, last, high, low, ac):
    bits, run, held = Bits(), 0, []

    def flush():
        nonlocal run, held
        if run:
            n = run.bit_length() - 1
            bits.put(ac[n << 4], LENGTH)
            bits.put(run - (1 << n), n)
            for b in held:
                bits.put(b, 1)
            run, held = 0, []

    for block in blocks:
        new = [k for k in range(first, last + 1) if abs(shifted(block[k], low)) == 1 and not shifted(block[k], high)]
        end, zeros, corrections = (new[-1] if new else first - 1), 0, []
        for k in range(first, last + 1):
            before, now = shifted(block[k], high), shifted(block[k], low)
            if not now:
                zeros += 1
                continue
            while zeros > 15 and k <= end:
                flush()
                bits.put(ac[0xF0], LENGTH)
                for b in corrections:
                    bits.put(b, 1)
                zeros, corrections = zeros - 16, []
            if before:
                corrections.append(abs(now) & 1)
                continue
            flush()
            bits.put(ac[zeros << 4 | 1], LENGTH)
            bits.put(int(now > 0), 1)
            for b in corrections:
                bits.put(b, 1)
            zeros, corrections = 0, []
        if zeros or corrections:
            run += 1
            held += corrections
            if run == 15:
                flush()
    flush()
    return bits.done()


def encode(coefficients, high, wide, quantiser):
    """4:2:0, units high x wide; coefficients: Y, Cb, Cr blocks row by row."""
    count = high * wide
    parts = [coefficients[: 4 * count], coefficients[4 * count : 5 * count], coefficients[5 * count :]]
    ac = {s: i for i, s in enumerate(SYMBOLS)}
    out = b"\xff\xd8" + segment(0xDB, b"\0" + bytes(quantiser))
    out += segment(0xC2, struct.pack(">BHHB", 8, high * 16 - 3, wide * 16 - 5, 3) + b"\x01\x22\0\x02\x11\0\x03\x11\0")
    counts = bytearray(16)
    counts[LENGTH - 1] = len(SYMBOLS)
    out += segment(0xC4, b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)) + b"\x10" + bytes(counts) + bytes(SYMBOLS))
    first, second, last = Bits(), Bits(), [0, 0, 0]
    for u in range(count):
        y, x = divmod(u, wide)
        order = [(0, (2 * y + dy) * 2 * wide + 2 * x + dx) for dy in (0, 1) for dx in (0, 1)] + [(1, u), (2, u)]
        for c, b in order:
            v = int(parts[c][b][0])
            step = (v >> 1) - last[c]
            last[c] = v >> 1
            first.put(size_of(step), 4)
            magnitude(first, step, size_of(step))
            second.put(v & 1, 1)
    head = lambda c, a, b, h, lo: segment(0xDA, (bytes([1, c, 0]) if c else b"\x03\x01\0\x02\0\x03\0") + bytes([a, b, h << 4 | lo]))
    out += head(0, 0, 0, 0, 1) + first.done()
    for c in range(3):
        rows = parts[c]
        if c == 0:  # a scan of one component leaves out blocks beyond the picture
            keep_high, keep_wide = -(-(high * 16 - 3) // 8), -(-(wide * 16 - 5) // 8)
            rows = [rows[y * 2 * wide + x] for y in range(keep_high) for x in range(keep_wide)]
        for a, b in ((1, 5), (6, 63)):
            out += head(c + 1, a, b, 0, 2) + ac_first(rows, a, b, 2, ac)
        out += head(c + 1, 1, 63, 2, 1) + ac_refine(rows, 1, 63, 2, 1, ac)
        out += head(c + 1, 1, 63, 1, 0) + ac_refine(rows, 1, 63, 1, 0, ac)
    return out + head(0, 0, 0, 1, 0) + second.done() + b"\xff\xd9"


@pytest.mark.parametrize("seed", range(6))
def test_scans_accumulate_to_the_coefficients(seed):
    r = np.random.default_rng(seed)
    high, wide = int(r.integers(1, 4)), int(r.integers(1, 4))
    c = r.integers(-40, 41, (6 * high * wide, 64)) * (r.random((6 * high * wide, 64)) < r.choice([0.03, 0.3, 0.9]))
    quantiser = r.integers(1, 4, 64).tolist()
    ((p, got, rgb),) = decode([encode(c, high, wide, quantiser)])
    assert (got == c).all()
    assert rgb.shape == (high * 16 - 3, wide * 16 - 5, 3)
    # luma by the definition of the transform, chroma repeated, colours by the usual weights
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]

    def plane(blocks, tall, long):
        whole = np.zeros((tall * 8, long * 8))
        for i, b in enumerate(blocks):
            f = np.zeros(64)
            f[ZIGZAG] = b * np.array(quantiser)
            y, x = divmod(i, long)
            whole[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = basis.T @ f.reshape(8, 8) @ basis
        return np.clip(np.round(whole) + 128, 0, 255)

    n = high * wide
    luma = plane(c[: 4 * n], 2 * high, 2 * wide)
    blue, red = (np.kron(plane(x, high, wide), np.ones((2, 2))) - 128 for x in (c[4 * n : 5 * n], c[5 * n :]))
    want = np.stack([luma + 1.402 * red, luma - 0.344136 * blue - 0.714136 * red, luma + 1.772 * blue], 2).clip(0, 255)
    assert np.abs(want[: rgb.shape[0], : rgb.shape[1]] - rgb).max() <= 3


def test_zigzag():
    assert ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(ZIGZAG.tolist()) == list(range(64))


def test_payloads_come_back_by_either_way():
    r = random.Random(2)
    payloads = [bytes(64), b"\xff" * 128, bytes(range(256)), *(r.randbytes(64 * r.randint(1, 60)) for _ in range(20))]
    files = pack_payloads(payloads)
    assert [unpack_payload(p, c) for p, c, _ in decode(files)] == payloads
    for x, payload in zip(files, payloads, strict=True):
        p = parse(x)
        assert unpack_payload(p, accumulate([p], symbols_only=True)) == payload
    alone = [decode([x])[0][2] for x in files]
    assert all((a == b[2]).all() for a, b in zip(alone, decode(files), strict=True))
    with pytest.raises(ValueError):
        pack_payloads([b"x"])


def test_other_files_are_refused():
    for x in (b"", b"GIF89a", b"\xff\xd8\xff\xc0\x00\x02", pack_payloads([bytes(64)])[0][:-2]):
        with pytest.raises(ValueError):
            parse(x)


def test_media_columns(spark):
    texts = ["a", None, "", "é" * 40, "long " * 300_000, "a", "x" * 64]
    rows = [(i, t, b"clash") for i, t in enumerate(texts)] + [(None, "null key", b""), (0, "a", b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media binary").repartition(2)
    got = media_columns(df).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t, _ in rows:
        raw = (t or "").encode()
        by[i] = len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    for r in got:
        assert (r.n_bytes, r.payload) == by[r.doc_id]
        assert len(r.tensor) == 3 * r.height * r.width and len(r.channel_sums) == 3
    same = [r for r in got if r.payload == by[0][1]]
    assert len(same) == 3 and len({(r.media, r.tensor) for r in same}) == 1
    assert media_columns(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_digests_of_the_query(spark, tmp_path):
    from marginalia.llm.registry import op7_progressive_jpeg

    spark.createDataFrame([(1, "ab" * 50), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op7_progressive_jpeg(spark, str(tmp_path)).collect()}
    payload = (b"ab" * 50).ljust(128, b"\0")
    assert (got[1].n_bytes, got[1].payload_bytes) == (100, 128)
    assert got[1].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[1].tail_crc32 == zlib.crc32(payload[-64:])
    assert got[1].media_sha256 == hashlib.sha256(pack_payloads([payload])[0]).hexdigest()
    assert got[2].payload_bytes == 64 and got[2].tail_crc32 == zlib.crc32(bytes(64))
