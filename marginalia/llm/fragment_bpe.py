"""Byte-level BPE by forced boundaries (operator 10): encode, decode and count.

A byte pair that occurs inside no token of the vocabulary marks a certain cut: no token can span it, and
merges on its two sides never meet. Texts are cut there, and where the tokenizer's own pre-tokenisation
cuts, all on numpy arrays; each distinct fragment, by its bytes, is merged once, and the ids are gathered back in order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.bytetext import buffers, gather_ranges, range_hashes, same_ranges

_OTHER, _LETTER, _NUMBER, _WHITE, _EDGE = range(5)
#: Bytes of text encoded at once; a larger piece has fewer distinct fragments for its size.
PIECE = 1 << 20
#: Distinct fragments that a worker remembers before it starts anew, and their bytes; bounds its memory.
REMEMBERED, REMEMBERED_BYTES = 300_000, 8 << 20


@cache
def _char_classes() -> np.ndarray:
    """A class for each code point, as the pre-tokeniser's pattern has them."""
    classes = np.zeros(0x110000, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    where = np.array(points)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+")):
        for m in regex.finditer(pattern, text):
            classes[where[m.start() : m.end()]] = kind
    return classes


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class FragmentBPE:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library.

    Raises ValueError for files whose behaviour it doesn't reproduce (a normaliser, a prefix space, ...).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        letters = _byte_alphabet()
        token = {bytes(letters[c] for c in text): i for text, i in model["vocab"].items()}
        merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in merged]
        if any(x >= y for x, y in zip(order, order[1:], strict=False)):
            raise ValueError(f"the ids of {path} don't follow the order of its merges")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in what stands beside them")
        self.size = max([*token.values(), *self.special.values()]) + 1
        self.content = [b""] * self.size
        for text, i in token.items():
            self.content[i] = text
        for text, i in self.special.items():
            self.content[i] = text.encode()
        self.token_length = np.array([len(x) for x in self.content], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(self.content), np.uint8)
        inside = np.zeros((256, 256), bool)
        for text in token:
            b = np.frombuffer(text, np.uint8)
            inside[b[:-1], b[1:]] = True
        self.cut_between = ~inside
        self._merge = tiktoken.Encoding("fragments", pat_str=r"(?s).+", mergeable_ranks=token, special_tokens={})._core_bpe.encode_single_piece
        self._special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._special_bytes = [x.encode() for x in self.special]
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._known_bytes = 0
        self._counts = np.zeros(1024, np.int64)
        self._starts = np.zeros(1024, np.int64)
        self._ids = np.zeros(4096, np.uint32)
        self._used = 0

    def _remember(self, fragments: list[bytes]) -> None:
        found = [self._merge(x) for x in fragments]
        first, n = len(self._known), len(found)
        flat = np.fromiter((i for ids in found for i in ids), np.uint32)
        counts = np.fromiter(map(len, found), np.int64, n)
        while first + n > len(self._counts):
            self._counts, self._starts = (np.concatenate([x, np.zeros_like(x)]) for x in (self._counts, self._starts))
        while self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        self._counts[first : first + n] = counts
        self._starts[first : first + n] = self._used + np.cumsum(counts) - counts
        self._ids[self._used : self._used + len(flat)] = flat
        self._used += len(flat)
        self._known.update(zip(fragments, range(first, first + n), strict=True))
        self._known_bytes += sum(map(len, fragments))

    def fragment_starts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Byte positions, in order, at which a fragment starts; each row is a text of its own."""
        lead = (raw & 0xC0) != 0x80
        where = np.flatnonzero(lead)  # of each character
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kinds = _char_classes()[points]
        n = len(kinds)
        head = np.zeros(len(raw) + 1, bool)
        head[at] = True
        head = head[where]  # the first character of a row
        prior = np.empty(n, np.uint8)
        prior[0], prior[1:] = _EDGE, kinds[:-1]
        prior[head] = _EDGE
        follows = np.empty(n, bool)  # a plain space in the same row stands before
        follows[0], follows[1:] = False, points[:-1] == 32
        follows &= ~head
        cut = (kinds != prior) & ~(follows & (kinds != _WHITE))
        white_before = np.flatnonzero((prior == _WHITE) & (kinds != _WHITE))
        cut[white_before - 1] = True
        marks = np.flatnonzero((points == 39) & (prior != _OTHER) & ~follows)
        if len(marks):
            rows = np.cumsum(head)
            ahead = np.full((3, len(marks)), 0, np.uint32)
            for k in (1, 2):
                i = marks + k
                ok = i < n
                ok[ok] &= rows[i[ok]] == rows[marks[ok]]
                ahead[k][ok] = points[i[ok]]
            one = np.isin(ahead[1], [ord(c) for c in "stmd"])
            two = np.zeros(len(marks), bool)
            for a, b in ("re", "ve", "ll"):
                two |= (ahead[1] == ord(a)) & (ahead[2] == ord(b))
            for hit, length in ((one, 2), (two, 3)):
                p = marks[hit]
                cut[p + 1] = False
                if length == 3:
                    cut[p + 2] = False
                p = p[p + length < n] + length
                cut[p] = True
        out = np.zeros(len(raw), bool)
        out[where[cut]] = True
        out[1:] |= self.cut_between[raw[:-1], raw[1:]]
        out[at[:-1][at[:-1] < len(raw)]] = True
        return np.flatnonzero(out)

    def _encode_plain(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows without special strings, one after another, and where each row's begin (n + 1)."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        start = self.fragment_starts(raw, at)
        stop = np.append(start[1:], len(raw))
        text = raw.tobytes()
        _, first, back = np.unique(range_hashes(raw, start, stop), return_index=True, return_inverse=True)
        if not same_ranges(raw, start, stop, first[back]).all():  # different fragments have the same hash: told apart by their bytes
            number: dict[bytes, int] = {}
            back = np.array([number.setdefault(text[a:b], len(number)) for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
            _, first = np.unique(back, return_index=True)
        if len(self._known) > REMEMBERED or self._known_bytes > REMEMBERED_BYTES:
            self._forget()
        fragments = [text[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
        new = [x for x in fragments if x not in self._known]
        if new:
            self._remember(new)
        place = np.fromiter(map(self._known.__getitem__, fragments), np.int64, len(fragments))[back]
        counts = self._counts[place]
        ids = self._ids[gather_ranges(self._starts[place], counts)]
        total = np.append(0, np.cumsum(counts))
        return ids, total[np.searchsorted(start, at)]

    def encode_batch(self, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, bounds) for groups of rows; special strings in a text become their ids."""
        row, n = 0, len(at) - 1
        while row < n:
            last = min(max(row + 1, int(np.searchsorted(at, at[row] + PIECE, "right")) - 1), n)
            part, where = raw[at[row] : at[last]], at[row : last + 1] - at[row]
            text = part.tobytes()
            if any(x in text for x in self._special_bytes):
                ids, bounds = self._encode_special(text, where)
            elif len(part) > PIECE:  # one long row
                ids = self._encode_long(part)
                bounds = np.array([0, len(ids)])
            else:
                ids, bounds = self._encode_plain(part, where)
            yield row, ids, bounds
            row = last

    def _encode_long(self, part: np.ndarray) -> np.ndarray:
        """A long text in parts, cut where a letter stands before a plain space and a letter after it.

        That is always the start of a pre-token, whatever surrounds it.
        """
        letter = ((part | 32) >= 97) & ((part | 32) <= 122)
        safe = np.flatnonzero((part[1:-1] == 32) & letter[:-2] & letter[2:]) + 1
        out, start = [], 0
        while start < len(part):
            i = int(np.searchsorted(safe, start + PIECE // 2))
            end = int(safe[i]) if i < len(safe) else len(part)
            out.append(self._encode_plain(part[start:end], np.array([0, end - start]))[0])
            start = end
        return np.concatenate(out)

    def _encode_special(self, text: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, bounds = [], [0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            row, seen, total = text[a:b].decode("utf-8"), 0, 0
            parts: list[np.ndarray] = []
            for m in self._special_pattern.finditer(row):
                parts += [self._one(row[seen : m.start()]), np.array([self.special[m.group()]], np.uint32)]
                seen = m.end()
            parts.append(self._one(row[seen:]))
            total = sum(map(len, parts))
            out += parts
            bounds.append(bounds[-1] + total)
        return np.concatenate(out), np.array(bounds)

    def _one(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return self._encode_long(raw) if len(raw) > PIECE else self._encode_plain(raw, np.array([0, len(raw)]))[0]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each row's ids; bytes that aren't UTF-8 become U+FFFD."""
        lengths = self.token_length[ids]
        total = np.append(0, np.cumsum(lengths))[bounds].tolist()
        flat = self.token_bytes[gather_ranges(self.token_start[ids], lengths)].tobytes()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(total, total[1:], strict=False)]


@lru_cache(maxsize=2)
def encoder(path: str) -> FragmentBPE:
    """One encoder for each file and worker."""
    return FragmentBPE(path)


def encode_decode(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """Each row's token ids, and its text decoded from them.

    ``tokenizer``: path of a byte-level BPE file of the tokenizers library, readable on every executor.
    Returns ``key, ids array<int>`` and, if ``decoded``, ``decoded string``; other columns are left out, so
    clashing names do no harm. A null text counts as empty: no ids, empty text. A null key and repeated rows
    are kept as they are. Special strings in a text become their ids, as the library has it by default.
    Narrow: no shuffle; memory is bounded by a piece of about a megabyte, or the longest row.
    """
    kind = docs.schema[key].dataType
    fields = [T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    fields += [T.StructField("decoded", T.StringType())] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer)
        for batch in batches:
            raw, at = buffers(batch.column(1))
            for row, ids, bounds in bpe.encode_batch(raw, at):
                n = len(bounds) - 1
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                out = [batch.column(0).slice(row, n), lists]
                if decoded:
                    out.append(pa.array(bpe.decode(ids, bounds), pa.string()))
                yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, T.StructType(fields))
