"""Vectorised text primitives over the UTF-8 buffers of Arrow string columns.

Everything here works on numpy arrays of bytes, so that no Python object is made per word.
Work is done in pieces of bounded size, whatever the size of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once; temporaries are about forty times as large.
PIECE = 1 << 19
#: Ranges of more bytes are hashed one by one.
SHORT = 64
_SEED = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of eight


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(raw: np.ndarray, at: np.ndarray, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Consecutive (bytes, offsets, first row) of about ``size`` bytes.

    A row longer than that is cut after white space into parts, each given as a piece of one row.
    """
    row, n = 0, len(at) - 1
    while row < n:
        if at[row + 1] - at[row] > size:
            start, stop = int(at[row]), int(at[row + 1])
            while start < stop:
                end = min(start + size, stop)
                while end < stop:  # the next white space; without any, the rest of the row
                    seen = np.flatnonzero(_SPACE[raw[end : min(end + size, stop)]])
                    if len(seen):
                        end += int(seen[0]) + 1
                        break
                    end = min(end + size, stop)
                yield raw[start:end], np.array([0, end - start]), row
                start = end
            row += 1
            continue
        last = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        if at[last] - at[last - 1] > size:
            last -= 1
        yield raw[at[row] : at[last]], at[row : last + 1] - at[row], row
        row = last


def _eights(values: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the last."""
    padded = np.concatenate([values, np.zeros(8, np.uint8)])
    return np.ndarray(len(values) + 1, "<u8", padded, strides=(1,))


def range_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, by its content alone.

    Eight bytes at a time are mixed in, so that ranges of up to eight bytes and one length never collide; a longer range
    than SHORT is hashed by xxh3.
    """
    size = stop - start
    eights = _eights(values)
    out = mix((size.astype(np.uint64) + np.uint64(1)) * _SEED)
    own = np.flatnonzero((size > 0) & (size <= SHORT))
    done = 0
    while len(own):
        out[own] = mix(out[own] ^ (eights[start[own] + done] & _KEEP[np.minimum(size[own] - done, 8)]))
        done += 8
        own = own[size[own] > done]
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = xxhash.xxh3_64_intdigest(values[start[i] : stop[i]], 7)
    return out


def same_ranges(values: np.ndarray, start: np.ndarray, stop: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each byte range has the same bytes as the range numbered ``other``."""
    size = stop - start
    same = size == size[other]
    eights = _eights(values)
    own = np.flatnonzero(same & (size <= SHORT) & (other != np.arange(len(other))))
    done = 0
    while len(own):
        keep = _KEEP[np.minimum(size[own] - done, 8)]
        same[own] &= ((eights[start[own] + done] ^ eights[start[other[own]] + done]) & keep) == 0
        done += 8
        own = own[size[own] > done]
    for i in np.flatnonzero(same & (size > SHORT) & (other != np.arange(len(other)))).tolist():
        same[i] = np.array_equal(values[start[i] : stop[i]], values[start[other[i]] : stop[other[i]]])
    return same


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word, in order: maximal runs without ASCII white space, A-Z lower-cased."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = _SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True  # a row's start is a boundary too
    before = np.empty(len(raw), bool)
    before[0] = True
    before[1:] = space[:-1]
    before |= first[:-1]
    after = np.empty(len(raw), bool)
    after[-1] = True
    after[:-1] = space[1:]
    after |= first[1:]
    start = np.flatnonzero(~space & before)
    stop = np.flatnonzero(~space & after) + 1
    return np.searchsorted(at, start, "right") - 1, range_hashes(_LOWER[raw], start, stop)


def row_words(raw: np.ndarray, at: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, hashes) for groups of whole rows: row first + i has hashes[bounds[i]:bounds[i + 1]].

    A long row's parts are joined, so each group has whole rows.
    """
    held: list[np.ndarray] = []
    held_row = -1
    for part, where, row in pieces(raw, at, size):
        rows, hashes = word_hashes(part, where)
        long_part = len(where) == 2 and where[1] != at[row + 1] - at[row]
        if held and row != held_row:
            whole = np.concatenate(held)
            yield held_row, np.array([0, len(whole)]), whole
            held = []
        if long_part:
            held.append(hashes)
            held_row = row
            continue
        yield row, np.searchsorted(rows, np.arange(len(where))), hashes
    if held:
        whole = np.concatenate(held)
        yield held_row, np.array([0, len(whole)]), whole


def gather_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The indices start[i], ..., start[i] + count[i] - 1, for all i one after another."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(start - (ends - count), count)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned integers as differences, byte plane by byte plane, so that a shuffle compresses them well."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)
