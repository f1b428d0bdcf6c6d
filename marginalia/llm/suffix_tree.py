"""LM scoring (operator 2): a probabilistic suffix tree over words.

A state is a context of one to LONGEST words; its parent is the context without the leftmost word, and the root is
the unigram distribution with 0.1 added to each count. A state's next-word distribution is smoothed by its parent's:

    P(word | context) = (count of both + a * P(word | parent)) / (count of the context + a),  a = MASS * count ** POWER

A context of any length is retained if it diverges from its parent: if its own distribution predicts what followed it
in the training text better than the parent's by more than GAIN nats, each occurrence judged by the others alone (one is
left out of the context's counts). A word is scored from the longest suffix of its past that is retained; for one that
isn't, the parent stands in, down to the root. A context that occurs once can't be retained.

The tree grows by length. Texts are turned once into blocks of tokens, which are written to the shared folder. In each
round a block sends what it has of distinct word runs, as sorted hashes with its own counts, to the buckets of
the hash; a bucket adds up what all blocks sent and answers each of them. Runs of k + 1 words are sent once the runs of k
words before them are known to occur twice. What the runs after a context gain over its parent is summed by context in
the same way. Every block sends a run or a context once, so no hash is hot; all runs are counted, and the model stays
in the shared folder: nothing of it is broadcast or collected but the numbers of tokens and of distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.llm.bytetext import buffers, mix, row_words
from marginalia.llm.labelled import remainder
from marginalia.llm.shared import Scratch, trim

#: Words of the longest context, and the gain in nats from which on a context is retained.
LONGEST, GAIN = 3, 3.0
#: Pseudo-counts of a state, by how often it occurs.
MASS, POWER = 4.0, 0.7
#: What is added to each count of the root's distribution.
ADDED = 0.1
#: Tokens of a block, bytes of text to a bucket, and steps to a nat in which a block's share of a gain is sent.
BLOCK_TOKENS, BUCKET_BYTES, STEPS = 1 << 19, 8 << 20, 1 << 12
#: Bits of a run's hash beyond those that the number of tokens has: one run in 2**EXTRA_BITS or so is taken for another, in a corpus of any size.
EXTRA_BITS = 24

_END = np.uint64(0x9E6C63D0676A9A99)
_ON = np.uint64(0x9E3779B97F4A7C15)


def pseudo_counts(n: np.ndarray) -> np.ndarray:
    return MASS * n**POWER


def shrink(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, as few as they need; the first byte says how many."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    raw = values.astype(f"<i{width}")
    if width > 1:
        raw = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + pa.compress(raw.tobytes(), "zstd", asbytes=True)


def grow(blob: bytes, n: int) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(pa.decompress(memoryview(blob)[1:], n * width, "zstd", asbytes=True), np.uint8)
    if width > 1:
        raw = np.ascontiguousarray(raw.reshape(width, n).T).ravel()
    return raw.view(f"<i{width}").astype(np.int64)


def shrink_sorted(keys: np.ndarray) -> bytes:
    return shrink(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def grow_sorted(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(grow(blob, n).view(np.uint64), dtype=np.uint64)


@dataclass
class Block:
    """Tokens of some rows, each row's words and its end.

    ``words``: distinct hashes, sorted; ``token``: each token's place among them. The first ``lead`` tokens belong to
    another block and only give context. ``sizes``: own tokens of each row; ``train``: whether a row is learned from.
    """

    words: np.ndarray
    token: np.ndarray
    lead: int
    sizes: np.ndarray
    train: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, lead: int, sizes: np.ndarray, train: np.ndarray) -> Block:
        words, token = distinct(hashes)
        return cls(words, token, lead, np.asarray(sizes, np.int64), np.asarray(train, bool))

    @property
    def row(self) -> np.ndarray:
        """Each own token's row."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @property
    def counted(self) -> np.ndarray:
        """Whether each token is learned from; those of the lead are in their own block."""
        return np.concatenate([np.zeros(self.lead, bool), np.repeat(self.train, self.sizes)])

    @property
    def since(self) -> np.ndarray:
        """How many tokens of its row stand before each, as far as the block has them."""
        sizes = self.sizes.copy()
        sizes[:1] += self.lead
        return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


Known = dict[tuple[int, str], np.ndarray]
Asked = list[tuple[int, str, np.ndarray, np.ndarray]]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the place of each key among them."""
    order = np.argsort(keys)
    there = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(there[1:], there[:-1], out=new[1:])
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return there[new], place


def climb(block: Block, known: Known, divisor: float, longest: int, mask: np.uint64 = np.uint64(0xFFFFFFFFFFFFFFFF)) -> tuple[Asked, np.ndarray, np.ndarray, np.ndarray]:
    """(what to ask next, each token's count, its probability at the root, its probability and context's length in the tree).

    ``known``: answers by (length of context, "count" or "kept"), in the order of the sorted hashes that were asked for. Asked are, for
    the first length whose ``kept`` isn't known, the gains of contexts, and counts of the runs that are one word longer. ``mask``: the bits
    of a run's hash that count.
    """
    n = len(block.token)
    since = block.since
    counted = block.counted
    asked: Asked = []
    if (0, "count") not in known:
        asked.append((0, "count", block.words, np.bincount(block.token[counted], minlength=len(block.words))))
    words = (block.words & mask)[block.token]
    # of each token, the run that ends with it: its hash, its place among the block's distinct ones, and how often it was counted
    found, place, run = block.words, block.token, words
    count = known[0, "count"][block.token] if (0, "count") in known else np.zeros(n, np.int64)
    first = count
    root = (count + ADDED) / divisor
    chance, length = root.copy(), np.zeros(n, np.int8)
    for k in range(1, longest + 1):
        inside = np.flatnonzero(since >= k)
        often = count[inside - 1]
        use = inside[often > 1]
        ask = inside if k == 1 else use
        often = often[often > 1]
        ids = place[use - 1]
        shorter, short_found = run, found
        run = np.zeros(n, np.uint64)
        run[ask] = mix(shorter[ask - 1] * _ON + words[ask]) & mask
        found, own = distinct(run[ask])
        if (k, "count") not in known:
            asked.append((k, "count", found, np.bincount(own[counted[ask]], minlength=len(found))))
            break
        place, count = np.zeros(n, np.int32), np.zeros(n, np.int64)
        place[ask], count[ask] = own, known[k, "count"][own]
        there = np.zeros(len(short_found), bool)  # contexts are runs of the last round: their order is known
        there[ids] = True
        ids = (np.cumsum(there) - 1)[ids]
        if (k, "kept") in known:
            kept = known[k, "kept"][ids] > 0
            use, m = use[kept], often[kept].astype(np.float64)
            a = pseudo_counts(m)
            chance[use] = (count[use] + a * chance[use]) / (m + a)
            length[use] = k
        else:
            learn = counted[use]
            use, m = use[learn], often[learn] - 1.0
            p, a = chance[use], pseudo_counts(m)
            gain = np.bincount(ids[learn], np.log((count[use] - 1 + a * p) / ((m + a) * p)), int(there.sum()))
            asked.append((k, "kept", short_found[there], np.round(gain * STEPS).astype(np.int64)))
    return asked, first, root, chance, length


def _blocks(rows: DataFrame, key: str, longest: int) -> DataFrame:
    """``rows`` (key, text, train) as blocks of about BLOCK_TOKENS tokens. A longer row has blocks of its own, which share a ``part``."""
    fields = [("block", T.LongType()), ("keys", T.ArrayType(rows.schema[key].dataType)), ("part", T.LongType()), ("lead", T.IntegerType()), ("n", T.IntegerType()), ("kinds", T.IntegerType())]
    fields += [(c, T.BinaryType()) for c in ("words", "tokens", "sizes", "train")]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys, sizes, train, tokens, held = [], [], [], [], 0

        def block(keys: list[pa.Array], hashes: np.ndarray, sizes: np.ndarray, train: np.ndarray, lead: int = 0, part: int | None = None) -> pa.RecordBatch:
            nonlocal number
            b = Block.of(hashes, lead, sizes, train)
            kept = pa.concat_arrays(keys)
            one = [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), pa.array([part], pa.int64())]
            one += [pa.array([x], pa.int32()) for x in (lead, len(b.token), len(b.words))]
            one += [pa.array([x], pa.binary()) for x in (shrink_sorted(b.words), shrink(b.token), shrink(b.sizes), np.packbits(b.train).tobytes())]
            number += 1
            return pa.RecordBatch.from_arrays(one, schema.names)

        def hand_on() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if sizes:
                yield block(keys, np.concatenate(tokens), np.concatenate(sizes), np.concatenate(train))
            for x in (keys, sizes, train, tokens):
                x.clear()
            held = 0

        for batch in batches:
            raw, at = buffers(batch.column(1))
            learn = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for first, bounds, hashes in row_words(raw, at):
                own = batch.column(0).slice(first, len(bounds) - 1)
                hashes = np.insert(hashes, bounds[1:], _END)
                if len(bounds) == 2 and len(hashes) > BLOCK_TOKENS:
                    part = number
                    for start in range(0, len(hashes), BLOCK_TOKENS):
                        lead = min(start, longest)
                        whole = hashes[start - lead : start + BLOCK_TOKENS]
                        yield block([own], whole, np.array([len(whole) - lead]), learn[first : first + 1], lead, part)
                    continue
                keys.append(own)
                sizes.append(np.diff(bounds) + 1)
                train.append(learn[first : first + len(bounds) - 1])
                tokens.append(hashes)
                held += len(hashes)
                if held >= BLOCK_TOKENS:
                    yield from hand_on()
        yield from hand_on()
        trim()

    return rows.mapInArrow(run, schema)


def _block(row: dict) -> Block:
    sizes = np.frombuffer(row["train"], np.uint8)
    n = len(row["keys"])
    return Block(grow_sorted(row["words"], row["kinds"]), grow(row["tokens"], row["n"]), row["lead"], grow(row["sizes"], n), np.unpackbits(sizes, count=n).astype(bool))


_ASKED = "bucket int, block long, level int, what string, n int, keys binary, own binary"
_ANSWER = "block long, bucket int, level int, what string, n int, found binary, tokens long, kinds long"


def _ask(number: int, asked: Asked, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a block asks for, a row for each bucket."""
    for level, what, keys, own in asked:
        cuts = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cuts)).tolist()
        parts = [slice(cuts[b], cuts[b + 1]) for b in some]
        columns = [pa.array(some, pa.int32()), pa.array([number] * len(some), pa.int64()), pa.array([level] * len(some), pa.int32()), pa.array([what] * len(some), pa.string())]
        columns += [pa.array([p.stop - p.start for p in parts], pa.int32()), pa.array([shrink_sorted(keys[p]) for p in parts], pa.binary()), pa.array([shrink(own[p]) for p in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "level", "what", "n", "keys", "own"])


def _answer(table: pa.Table) -> pa.Table:
    """Adds up what all blocks sent to a bucket; answers each with the sums of counts, or whether a context is retained."""
    rows = table.to_pylist()
    out = []
    for level, what in sorted({(r["level"], r["what"]) for r in rows}):
        own = [r for r in rows if (r["level"], r["what"]) == (level, what)]
        bounds = np.append(0, np.cumsum([r["n"] for r in own]))
        found, place = distinct(np.concatenate([grow_sorted(r["keys"], r["n"]) for r in own]))
        sums = np.bincount(place, np.concatenate([grow(r["own"], r["n"]) for r in own]), len(found)).astype(np.int64)  # whole numbers, exact in doubles
        if what == "kept":
            sums = (sums > GAIN * STEPS).astype(np.int64)
        for r, a, b in zip(own, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out.append((r["block"], r["bucket"], level, what, r["n"], shrink(sums[place[a:b]]), None, None))
        if not level:
            out.append((None, rows[0]["bucket"], level, what, 0, None, int(sums.sum()), int((sums > 0).sum())))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "bucket", "level", "what", "n", "found", "tokens", "kinds"])


def _known(table: pa.Table) -> Known:
    """Answers by level and kind; a block's keys are sorted, so its buckets' answers stand one after another."""
    parts: dict[tuple[int, str], list[tuple[int, np.ndarray]]] = {}
    for r in table.to_pylist():
        parts.setdefault((r["level"], r["what"]), []).append((r["bucket"], grow(r["found"], r["n"])))
    return {k: np.concatenate([x for _, x in sorted(v, key=lambda x: x[0])]) for k, v in parts.items()}


class _All(dict):
    """Answers for a block that asked for none of a kind: it has no such runs."""

    def __init__(self, known: Known, rounds: int):
        super().__init__(known)
        for k in range(rounds + 1):
            self.setdefault((k, "count"), np.zeros(0, np.int64))
            if 0 < k < rounds:
                self.setdefault((k, "kept"), np.zeros(0, np.int64))


def score_contexts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 10, longest: int = LONGEST) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_states`` of each row.

    Learns from rows whose key's crc32 modulo ``folds`` isn't 0. Words are runs without ASCII white space, A-Z
    lower-cased; a text's tokens are its words and one end. ``base_score``: log10 probability by the root alone;
    ``score``: by the tree of contexts of up to ``longest`` words; ``n_states``: tokens predicted from a retained context. A null
    text counts as empty: its end alone. Null keys (held out) and repeated rows are scored like others; other columns
    are left out, so clashing names do no harm. An empty table gives none. Words are told apart by 64-bit hashes, runs as EXTRA_BITS says.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-tree")
    rows = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), (remainder(key, folds) != 0).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    blocks = scratch.save_by(_blocks(rows, key, longest), "blocks", "block", buckets)  # so that a round needn't shuffle them
    volume = blocks.agg(F.sum("n")).first()[0] or 0
    mask = np.uint64(((1 << 64) - 1) ^ ((1 << max(0, 64 - EXTRA_BITS - int(volume).bit_length())) - 1))
    columns = ["block", "keys", "lead", "n", "kinds", "words", "tokens", "sizes", "train"]

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                yield from _ask(r["block"], climb(_block(r), {}, 1.0, longest, mask)[0], buckets)
        trim()

    def answered(asked: DataFrame, name: str) -> DataFrame:
        return scratch.save(asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer, _ANSWER), name)

    answers = answered(blocks.select(*columns).mapInArrow(ask_first, _ASKED), "answers-0")
    total, kinds = answers.where("block is null").agg(F.sum("tokens"), F.sum("kinds")).first()
    total, kinds = total or 0, kinds or 0
    divisor = total + ADDED * (kinds + 1)
    answers = answers.where("block is not null").select("block", "bucket", "level", "what", "n", "found")

    def ask_in(k: int):
        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            [r] = left.to_pylist()
            batches = list(_ask(r["block"], climb(_block(r), _All(_known(right), k), divisor, longest, mask)[0], buckets))
            return pa.Table.from_batches(batches, schema=_arrow(_ASKED))

        return ask

    for k in range(1, longest + 1):
        asked = blocks.select(*columns).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask_in(k), _ASKED)
        answers = answers.unionByName(answered(asked, f"answers-{k}").select(answers.columns))
    schema = T.StructType([rows.schema[key], T.StructField("held_out", T.BooleanType())] + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")] + [T.StructField(c, T.LongType()) for c in ("n_states", "part")])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        [r] = left.select([c for c in left.column_names if c != "keys"]).to_pylist()
        keys = left.column("keys").combine_chunks().flatten()
        block = _block(r | {"keys": keys})
        _, count, root, chance, length = climb(block, _All(_known(right), longest + 1), divisor, longest, mask)
        own = slice(block.lead, None)
        row, n = block.row, len(block.sizes)
        per = lambda v: np.bincount(row, v[own], n)
        columns = [keys, pa.array(~block.train), pa.array(block.sizes), pa.array(per(count > 0).astype(np.int64)), pa.array(np.full(n, total), pa.int64()), pa.array(per(np.log10(root))), pa.array(per(np.log10(chance))), pa.array(per(length > 0).astype(np.int64)), pa.array([r["part"]] * n, pa.int64())]
        return pa.table(columns, names=schema.names)

    scores = scratch.save(blocks.select(*columns, "part").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema), "scores")
    scratch.forget()
    sums = [F.first(c).alias(c) if c in (key, "held_out", "train_tokens") else F.sum(c).alias(c) for c in scores.columns[:-1]]
    whole = scores.where("part is null").drop("part")
    return whole.unionByName(scores.where("part is not null").groupBy("part").agg(*sums).drop("part"))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])
