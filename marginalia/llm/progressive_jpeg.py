"""Media columns (operator 7): bytes kept losslessly in progressive JPEG files, and full-resolution RGB tensors.

JPEG loses samples but not coefficients, so the unit of the format that holds a payload byte is a
quantised coefficient: each 64 bytes are one block in zigzag order, all quantisers are 1. A file has 4:2:0
components and seventeen scans or fewer: DC and two bands of AC, each first without its lowest bit
(spectral selection) and then that bit (successive approximation).

The decoder accumulates any such scans of any Huffman tables into coefficient arrays, transforms them
back in numpy, repeats chroma samples to full resolution and gives RGB. Scans whose table has a single code
(those of ``pack_payloads`` have) are decoded for a whole batch of files at once, others symbol by symbol.
All arithmetic is exact, so equal files give equal tensors in any batch.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.bytetext import buffers, gather_ranges

#: Payload bytes that are coded or decoded at once; the tensors are about twice as large.
PIECE = 1 << 20


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order: by diagonals, in turn up and down."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_SCALE = 13


def _inverse_transform() -> np.ndarray:
    """From zigzag coefficients to the 64 samples of a block, times 2**13, as whole numbers."""
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    full = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.round(full[ZIGZAG] * (1 << _SCALE))


_INVERSE = _inverse_transform()


@dataclass
class Component:
    ident: int
    across: int
    down: int
    quantiser: int
    blocks_wide: int = 0  # of its own samples, as a scan of this component alone has them
    blocks_high: int = 0
    row_blocks: int = 0  # with those that fill up the last unit of an interleaved scan
    column_blocks: int = 0
    base: int = 0  # its first block in the array of coefficients

    def own_blocks(self) -> np.ndarray:
        rows = self.base + np.arange(self.blocks_high)[:, None] * self.row_blocks
        return (rows + np.arange(self.blocks_wide)).ravel()


@dataclass
class Scan:
    components: list[int]
    tables: list[tuple[int, int]]
    first: int
    last: int
    high: int
    low: int
    codes: dict[tuple[int, int], tuple[bytes, bytes]]
    data: bytes
    restart: int


@dataclass
class Picture:
    height: int = 0
    width: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""
    blocks: int = 0
    base: int = 0


_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(data: bytes) -> Picture:
    """The structure of a progressive JPEG file; ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    picture, codes, restart, at = Picture(), {}, 0, 2
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xD9:
            return picture
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                length = 128 if wide else 64
                picture.quantisers[name] = np.frombuffer(body[1 : 1 + length], ">u2" if wide else "u1").astype(np.float64)
                body = body[1 + length :]
        elif kind == 0xC2:
            _frame(picture, body)
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("the file isn't progressive")
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15] = bytes(body[1:17]), bytes(body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            picture.comment = bytes(body)
        elif kind == 0xDA:
            n = body[0]
            idents = [c.ident for c in picture.components]
            chosen = [idents.index(body[1 + 2 * i]) for i in range(n)]
            tables = [(body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            m = _NEXT_MARKER.search(data, at)
            end = m.start() if m else len(data)
            picture.scans.append(Scan(chosen, tables, body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15, dict(codes), data[at:end], restart))
            at = end
    raise ValueError("the file ends too early")


def _frame(picture: Picture, body: bytes) -> None:
    depth, picture.height, picture.width, n = struct.unpack_from(">BHHB", body)
    if depth != 8 or n not in (1, 3) or not picture.height or not picture.width:
        raise ValueError("only pictures of one or three 8-bit components")
    parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    across, down = max(c.across for c in parts), max(c.down for c in parts)
    units_wide, units_high = -(-picture.width // (8 * across)), -(-picture.height // (8 * down))
    for c in parts:
        c.blocks_wide = -(-(-(-picture.width * c.across // across)) // 8)
        c.blocks_high = -(-(-(-picture.height * c.down // down)) // 8)
        c.row_blocks, c.column_blocks = units_wide * c.across, units_high * c.down
        c.base = picture.blocks
        picture.blocks += c.row_blocks * c.column_blocks
    picture.components = parts


def _scan_blocks(picture: Picture, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """(block, component) in the order of a scan."""
    parts = [picture.components[i] for i in scan.components]
    if len(parts) == 1:
        own = parts[0].own_blocks()
        return own, np.full(len(own), scan.components[0])
    units_wide, units_high = parts[0].row_blocks // parts[0].across, parts[0].column_blocks // parts[0].down
    units, owner = [], []
    for i, c in zip(scan.components, parts, strict=True):
        y = (np.arange(units_high)[:, None] * c.down)[..., None, None] + np.arange(c.down)[:, None]
        x = (np.arange(units_wide)[None, :] * c.across)[..., None, None] + np.arange(c.across)
        units.append((c.base + y * c.row_blocks + x).reshape(units_wide * units_high, -1))
        owner += [i] * units[-1].shape[1]
    return np.concatenate(units, 1).ravel(), np.tile(owner, units_wide * units_high)


def _single_code(codes: tuple[bytes, bytes] | None) -> tuple[int, int] | None:
    """(code length, symbol) of a table with one code."""
    if codes and sum(codes[0]) == 1:
        return next(i + 1 for i, n in enumerate(codes[0]) if n), codes[1][0]
    return None


class _Bits:
    """Symbols and bits of one entropy-coded segment."""

    def __init__(self, data: bytes):
        self.data, self.total, self.at = data, 8 * len(data), 0

    def bits(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if self.at + n > self.total:
            raise ValueError("a scan ends too early")
        out = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n) & ((1 << n) - 1)
        self.at += n
        return out

    def symbol(self, table: list[tuple[int, int]]) -> int:
        a = self.at >> 3
        window = int.from_bytes(self.data[a : a + 3].ljust(3, b"\xff"), "big") >> (8 - (self.at & 7)) & 0xFFFF
        length, value = table[window]
        if not length or self.at + length > self.total:
            raise ValueError("a code isn't in the table")
        self.at += length
        return value


def _lookup(codes: tuple[bytes, bytes], known: dict = {}) -> list[tuple[int, int]]:  # noqa: B006
    """(length, symbol) by the next 16 bits."""
    if codes not in known:
        table: list[tuple[int, int]] = []
        values = iter(codes[1])
        for length, n in enumerate(codes[0], 1):
            for _ in range(n):
                table += [(length, next(values))] * (1 << (16 - length))
        if len(known) > 64:
            known.clear()
        known[codes] = (table + [(0, 0)] * (65536 - len(table)))[:65536]
    return known[codes]


def _signed(bits: _Bits, size: int) -> int:
    value = bits.bits(size)
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _by_symbol(picture: Picture, scan: Scan, coefficients: np.ndarray) -> None:
    """Any scan, one symbol after another."""
    blocks, owners = _scan_blocks(picture, scan)
    unit = len(blocks) if not scan.restart else scan.restart * (1 if len(scan.components) == 1 else sum(picture.components[i].across * picture.components[i].down for i in scan.components))
    segments = re.split(rb"\xff[\xd0-\xd7]", scan.data) if scan.restart else [scan.data]
    tables = dict(zip(scan.components, scan.tables, strict=True))
    for k, segment in enumerate(segments):
        bits = _Bits(segment.replace(b"\xff\x00", b"\xff"))
        part = slice(k * unit, (k + 1) * unit)
        if scan.first == 0:
            _dc(bits, scan, tables, blocks[part].tolist(), owners[part].tolist(), coefficients)
        else:
            table = _lookup(scan.codes[1, tables[scan.components[0]][1]])
            (_ac_refine if scan.high else _ac_first)(bits, scan, table, blocks[part].tolist(), coefficients)


def _dc(bits: _Bits, scan: Scan, tables: dict, blocks: list[int], owners: list[int], coefficients: np.ndarray) -> None:
    column = coefficients[:, 0]
    if scan.high:
        for block in blocks:
            column[block] |= bits.bits(1) << scan.low
        return
    last = dict.fromkeys(tables, 0)
    lookups = {i: _lookup(scan.codes[0, t[0]]) for i, t in tables.items()}
    for block, owner in zip(blocks, owners, strict=True):
        last[owner] += _signed(bits, bits.symbol(lookups[owner]))
        column[block] = last[owner] << scan.low


def _ac_first(bits: _Bits, scan: Scan, table: list, blocks: list[int], coefficients: np.ndarray) -> None:
    skip = 0
    for block in blocks:
        if skip:
            skip -= 1
            continue
        k = scan.first
        while k <= scan.last:
            run, size = divmod(bits.symbol(table), 16)
            if size:
                k += run
                coefficients[block, k] = _signed(bits, size) * (1 << scan.low)
            elif run == 15:
                k += 15
            else:
                skip = (1 << run) + bits.bits(run) - 1
                break
            k += 1


def _ac_refine(bits: _Bits, scan: Scan, table: list, blocks: list[int], coefficients: np.ndarray) -> None:
    step, skip = 1 << scan.low, 0

    def correct(row: np.ndarray, k: int) -> None:
        if bits.bits(1):
            row[k] += step if row[k] > 0 else -step

    for block in blocks:
        row, k = coefficients[block], scan.first
        if not skip:
            while k <= scan.last:
                run, size = divmod(bits.symbol(table), 16)
                value = 0
                if size:
                    value = step if bits.bits(1) else -step
                elif run < 15:
                    skip = (1 << run) + bits.bits(run)
                    break
                while k <= scan.last:
                    if row[k]:
                        correct(row, k)
                    elif run:
                        run -= 1
                    else:
                        break
                    k += 1
                if value and k <= scan.last:
                    row[k] = value
                k += 1
        if skip:
            for k in range(k, scan.last + 1):
                if row[k]:
                    correct(row, k)
            skip -= 1


def _bit_rows(scans: list[bytes], counts: np.ndarray, width: int) -> np.ndarray | None:
    """A row of ``width`` bits for each block of the segments, or None if a segment's length differs."""
    needed = -(-counts * width // 8)
    if any(len(x) != n for x, n in zip(scans, needed.tolist(), strict=True)):
        return None
    bits = np.unpackbits(np.frombuffer(b"".join(scans), np.uint8))
    start = np.cumsum(needed) * 8 - needed * 8
    if len(scans) == 1:
        return bits[: counts[0] * width].reshape(-1, width)
    return bits[gather_ranges(start, counts * width)].reshape(-1, width)


def _together(pictures: list[Picture], index: int, coefficients: np.ndarray) -> bool:
    """Scan ``index`` of all pictures at once; False, with nothing done, if it isn't of a fixed width."""
    scans = [p.scans[index] for p in pictures]
    s = scans[0]
    shape = (s.components, s.tables, s.first, s.last, s.high, s.low, s.restart)
    if s.restart or any((x.components, x.tables, x.first, x.last, x.high, x.low, x.restart) != shape for x in scans):
        return False
    if s.first == 0 and not s.high:
        return False
    code = _single_code(s.codes.get((1, s.tables[0][1]))) if s.first else (0, 0)
    if s.first and (code is None or any(x.codes.get((1, x.tables[0][1])) != s.codes[1, s.tables[0][1]] for x in scans)):
        return False
    order = [p.base + _scan_blocks(p, x)[0] for p, x in zip(pictures, scans, strict=True)]
    blocks, counts = np.concatenate(order), np.array(list(map(len, order)))
    plain = [x.data.replace(b"\xff\x00", b"\xff") for x in scans]
    n = s.last - s.first + 1
    if s.first == 0:
        bits = _bit_rows(plain, counts, 1)
        if bits is not None:
            coefficients[blocks, 0] |= bits[:, 0].astype(np.int16) << s.low
        return bits is not None
    length, symbol = code
    if not s.high:
        if not 0 < symbol < 16:  # a run of zeros, or the end of a band
            return False
        bits = _bit_rows(plain, counts, n * (length + symbol))
        if bits is None:
            return False
        bits = bits.reshape(len(blocks), n, length + symbol)
        if bits[:, :, :length].any():
            return False
        value = np.packbits(np.pad(bits[:, :, length:], ((0, 0), (0, 0), (16 - symbol, 0))), axis=2) if symbol != 8 else np.packbits(bits[:, :, length:], axis=2)
        value = value[..., 0].astype(np.int32) if symbol == 8 else (value[..., 0].astype(np.int32) << 8) + value[..., 1]
        value = np.where(value >> (symbol - 1), value, value - (1 << symbol) + 1)
        coefficients[blocks, s.first : s.last + 1] = value << s.low
        return True
    if symbol or not coefficients[blocks, s.first : s.last + 1].all():
        return False
    bits = _bit_rows(plain, counts, length + n)
    if bits is None or bits[:, :length].any():
        return False
    band = coefficients[blocks, s.first : s.last + 1]
    coefficients[blocks, s.first : s.last + 1] = band + np.sign(band) * (bits[:, length:].astype(np.int16) << s.low)
    return True


def accumulate(pictures: list[Picture], *, symbols_only: bool = False) -> np.ndarray:
    """The coefficients of all blocks of all pictures, in zigzag order, from all their scans."""
    total = 0
    for p in pictures:
        p.base = total
        total += p.blocks
    coefficients = np.zeros((total, 64), np.int16)
    same = not symbols_only and len({len(p.scans) for p in pictures}) == 1
    for i in range(max((len(p.scans) for p in pictures), default=0)):
        if same and _together(pictures, i, coefficients):
            continue
        for p in pictures:
            if i < len(p.scans):
                _by_symbol(p, p.scans[i], coefficients[p.base : p.base + p.blocks])
    return coefficients


def to_rgb(pictures: list[Picture], coefficients: np.ndarray) -> list[np.ndarray]:
    """A tensor of height x width x 3 for each picture."""
    out = []
    samples = np.empty(coefficients.shape, np.uint8)
    for p in pictures:
        for c in p.components:
            if not (p.quantisers[c.quantiser] == 1).all():
                part = coefficients[p.base + c.base : p.base + c.base + c.row_blocks * c.column_blocks]
                samples[p.base + c.base : p.base + c.base + len(part)] = _samples(part * p.quantisers[c.quantiser])
                break
        else:
            continue
        break
    else:  # the usual case: no quantiser matters
        for i in range(0, len(coefficients), 1 << 13):
            samples[i : i + (1 << 13)] = _samples(coefficients[i : i + (1 << 13)])
        return [_assemble(p, samples) for p in pictures]
    for p in pictures:
        for c in p.components:
            where = slice(p.base + c.base, p.base + c.base + c.row_blocks * c.column_blocks)
            samples[where] = _samples(coefficients[where] * p.quantisers[c.quantiser])
        out.append(_assemble(p, samples))
    return out


def _samples(coefficients: np.ndarray) -> np.ndarray:
    whole = coefficients.astype(np.float64) @ _INVERSE  # sums of whole numbers below 2**53: exact in any order
    return np.clip(np.floor(whole / (1 << _SCALE) + 0.5) + 128, 0, 255).astype(np.uint8)


def _assemble(p: Picture, samples: np.ndarray) -> np.ndarray:
    across, down = max(c.across for c in p.components), max(c.down for c in p.components)
    planes = []
    for c in p.components:
        part = samples[p.base + c.base : p.base + c.base + c.row_blocks * c.column_blocks]
        plane = part.reshape(c.column_blocks, c.row_blocks, 8, 8).swapaxes(1, 2).reshape(c.column_blocks * 8, c.row_blocks * 8)
        if (c.across, c.down) != (across, down):
            plane = plane.repeat(down // c.down, 0).repeat(across // c.across, 1)
        planes.append(plane[: p.height, : p.width].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0][..., None].astype(np.uint8), 3, 2)
    y, blue, red = (planes[0] << 16) + 32768, planes[1] - 128, planes[2] - 128
    rgb = np.empty((*y.shape, 3), np.uint8)
    for i, plane in enumerate((y + 91881 * red, y - 22554 * blue - 46802 * red, y + 116130 * blue)):
        rgb[..., i] = np.clip(plane >> 16, 0, 255)
    return rgb


def decode(files: list[bytes]) -> list[tuple[Picture, np.ndarray, np.ndarray]]:
    """(structure, coefficients, RGB tensor) of each progressive JPEG file."""
    pictures = [parse(x) for x in files]
    coefficients = accumulate(pictures)
    return [(p, coefficients[p.base : p.base + p.blocks], rgb) for p, rgb in zip(pictures, to_rgb(pictures, coefficients), strict=True)]


# ---- payloads ---------------------------------------------------------------------------------------------


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


#: Nine DC symbols of four bits; one AC symbol of one bit for the first bands, one for the refinement.
_DC = bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))
_AC_FIRST, _AC_REFINE = bytes([1] + [0] * 15) + b"\x08", bytes([1] + [0] * 15) + b"\x00"
_BEFORE = b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64)
_TABLES = _segment(0xC4, b"\x00" + _DC + b"\x10" + _AC_FIRST + b"\x11" + _AC_REFINE)
_DC_PARTS = b"\x03\x01\x00\x02\x00\x03\x00"
_BANDS = ((1, 5), (6, 63))


def _scan_head(first: int, last: int, high: int, low: int, component: int = 0) -> bytes:
    parts = bytes([1, component, high]) if component else _DC_PARTS
    return _segment(0xDA, parts + bytes([first, last, high << 4 | low]))


def _join_bits(bits: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Segments of so many bits each, filled up with ones to whole bytes, with a zero byte after each 255."""
    size = -(-counts // 8)
    start = np.cumsum(size) - size
    wide = np.ones(int(size.sum()) * 8, np.uint8)
    wide[gather_ranges(start * 8, counts)] = bits
    packed = np.packbits(wide)
    full = np.flatnonzero(packed == 255)
    ends = np.append(start, len(packed))
    ends += np.searchsorted(full, ends)
    data = np.insert(packed, full + 1, 0).tobytes()
    ends = ends.tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def pack_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload; lengths must be positive multiples of 64.

    A DC coefficient is a payload byte, an AC coefficient one plus 256, so that all of them have eight bits in the first scans.
    """
    if not payloads:
        return []
    if any(not x or len(x) % 64 for x in payloads):
        raise ValueError("payloads must be positive multiples of 64 bytes")
    blocks = np.array([len(x) // 64 for x in payloads])
    units = -(-blocks // 6)
    wide = np.ceil(np.sqrt(units)).astype(np.int64)
    high = -(-units // wide)
    if wide.max() * 16 > 65535:
        raise ValueError("a payload is too long for one picture")
    frames = [_frame_body(int(h) * 16, int(w) * 16) for h, w in zip(high, wide, strict=True)]
    pictures = []
    total = 0
    for body in frames:
        p = Picture()
        _frame(p, body)
        p.base = total
        total += p.blocks
        pictures.append(p)
    values = np.zeros((total, 64), np.int16)
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64)
    values[gather_ranges(np.array([p.base for p in pictures]), blocks)] = flat
    values[:, 1:] += 256
    parts: list[list[bytes]] = [[_BEFORE, _segment(0xFE, struct.pack(">Q", len(x))), _segment(0xC2, body), _TABLES] for x, body in zip(payloads, frames, strict=True)]

    def add(head: bytes, data: list[bytes]) -> None:
        for own, x in zip(parts, data, strict=True):
            own += (head, x)

    every = Scan([0, 1, 2], [(0, 0)] * 3, 0, 0, 0, 0, {}, b"", 0)
    orders = [_scan_blocks(p, every) for p in pictures]
    mixed = np.concatenate([p.base + o[0] for p, o in zip(pictures, orders, strict=True)])
    owners = np.concatenate([o[1] for o in orders])
    lengths = np.array([len(o[0]) for o in orders])
    add(_scan_head(0, 0, 0, 1), _dc_first(values[mixed, 0] >> 1, owners, lengths))
    own = {i: [p.base + p.components[i].own_blocks() for p in pictures] for i in range(3)}
    chosen = {i: (np.concatenate(x), np.array(list(map(len, x)))) for i, x in own.items()}
    for i, (which, n) in chosen.items():
        for first, last in _BANDS:
            band = (values[which, first : last + 1] >> 1).astype(np.uint8)
            bits = np.zeros((*band.shape, 9), np.uint8)
            bits[..., 1:] = np.unpackbits(band[..., None], axis=2)
            add(_scan_head(first, last, 0, 1, i + 1), _join_bits(bits.ravel(), n * band.shape[1] * 9))
    add(_scan_head(0, 0, 1, 0), _join_bits((values[mixed, 0] & 1).astype(np.uint8), lengths))
    for i, (which, n) in chosen.items():
        bits = np.zeros((len(which), 64), np.uint8)
        bits[:, 1:] = values[which, 1:] & 1
        add(_scan_head(1, 63, 1, 0, i + 1), _join_bits(bits.ravel(), n * 64))
    return [b"".join([*x, b"\xff\xd9"]) for x in parts]


def _frame_body(height: int, width: int) -> bytes:
    return struct.pack(">BHHB", 8, height, width, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"


def _dc_first(values: np.ndarray, owners: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Differences from the component's block before, each a 4-bit size and as many bits."""
    picture = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(picture * 4 + owners, kind="stable")
    own = (picture * 4 + owners)[order]
    sorted_values = values[order].astype(np.int32)
    change = np.diff(sorted_values, prepend=0)
    first = np.append(True, own[1:] != own[:-1])
    change[first] = sorted_values[first]
    steps = np.empty_like(change)
    steps[order] = change
    size = np.zeros(len(steps), np.int64)
    for k in range(8):
        size += np.abs(steps) >= 1 << k
    code = (size << 8) | np.where(steps < 0, steps + (1 << size) - 1, steps)
    code = (size << size) | (code & 0xFF)
    width = 4 + size
    ends = np.cumsum(width)
    place = gather_ranges(np.zeros(len(width), np.int64), width)
    bits = (np.repeat(code, width) >> (np.repeat(width, width) - 1 - place) & 1).astype(np.uint8)
    total = np.append(0, ends)
    return _join_bits(bits, np.diff(total[np.append(0, np.cumsum(lengths))]))


def unpack_payload(picture: Picture, coefficients: np.ndarray) -> bytes:
    """The payload of a file made by ``pack_payloads``."""
    (length,) = struct.unpack(">Q", picture.comment)
    own = coefficients[: length // 64]
    whole = own & 255  # the 256 added to AC coefficients has no part in these bits
    return whole.astype(np.uint8).tobytes()


def media_columns(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text in a progressive JPEG file, reads it back and gives its tensor.

    The payload is the UTF-8 text with zero bytes up to a positive multiple of 64. Returns
    ``key, n_bytes long, media binary`` (the file), ``payload binary`` (as read back from the file),
    ``height int, width int, tensor binary`` (height x width x 3, RGB) and ``channel_sums array<long>``.
    A null text counts as empty; null keys and repeated rows are kept; other columns are left out, so
    clashing names do no harm. Equal texts give equal values. Narrow: no shuffle; memory is bounded by
    a piece of about a megabyte, or the longest row.
    """
    schema = T.StructType(
        [T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType())]
        + [T.StructField(x, T.BinaryType()) for x in ("media", "payload")]
        + [T.StructField(x, T.IntegerType()) for x in ("height", "width")]
        + [T.StructField("tensor", T.BinaryType()), T.StructField("channel_sums", T.ArrayType(T.LongType(), False))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(1))
            row, n = 0, batch.num_rows
            while row < n:
                last = min(max(row + 1, int(np.searchsorted(at, at[row] + PIECE, "right")) - 1), n)
                sizes = np.diff(at[row : last + 1])
                payloads = [raw[a:b].tobytes().ljust(max(64, -(-(b - a) // 64) * 64), b"\0") for a, b in zip(at[row:last].tolist(), at[row + 1 : last + 1].tolist(), strict=True)]
                files = pack_payloads(payloads)
                found = decode(files)
                rgb = [x[2] for x in found]
                columns = [
                    batch.column(0).slice(row, last - row),
                    pa.array(sizes, pa.int64()),
                    pa.array(files, pa.binary()),
                    pa.array([unpack_payload(p, c) for p, c, _ in found], pa.binary()),
                    pa.array([x.shape[0] for x in rgb], pa.int32()),
                    pa.array([x.shape[1] for x in rgb], pa.int32()),
                    pa.array([x.tobytes() for x in rgb], pa.binary()),
                    pa.array([x.reshape(-1, 3).sum(0, dtype=np.int64) for x in rgb], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                row = last

    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
