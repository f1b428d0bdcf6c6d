"""Token counts (operator 8): an Arrow function that encodes batches and returns lengths only.

Texts go to the library in batches of about equal bytes; long texts are split at safe boundaries. A
boundary is safe where a space stands between two characters that aren't white space, since no piece of the
vocabulary goes on past a following space, which is verified when the model is loaded. The library puts
a space before each text it gets, so that the part after the cut is given without its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes given to the library at once, and bytes from which on a text is split.
BATCH_BYTES, LONG_BYTES = 1 << 19, 1 << 14
_MARK = "▁"


@lru_cache(maxsize=2)
def _counter(path: str):
    """(function from texts to lengths, pattern of safe boundaries or None) of a tokenizer file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = model.encode("a", out_type=str)[0].startswith(_MARK) and model.encode(["a  b"], out_type=int) != model.encode(["a b"], out_type=int)
        whole = all(_MARK not in p.lstrip(_MARK) for p in pieces)
        safe = regex.compile(rf"(?<=[^\s{_MARK}]) (?=[^\s{_MARK}])") if plain and whole else None
        return (lambda texts: list(map(len, model.encode(texts, out_type=int, num_threads=1)))), safe
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return (lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]), None


def split_safely(text: str, safe: regex.Pattern | None, size: int = LONG_BYTES) -> list[str]:
    """Parts whose counts add up to the text's; about ``size`` characters each."""
    if safe is None or len(text) <= size:
        return [text]
    parts, start = [], 0
    while m := safe.search(text, start + size):
        parts.append(text[start : m.start()])
        start = m.end()
    return [*parts, text[start:]]


def count_texts(texts: list[str], path: str, *, batch_bytes: int = BATCH_BYTES, long_bytes: int = LONG_BYTES) -> list[int]:
    """The number of tokens of each text; at most about ``batch_bytes`` are encoded at once."""
    count, safe = _counter(path)
    totals, held, owners, size = [0] * len(texts), [], [], 0

    def flush() -> None:
        nonlocal size
        if held:
            for owner, n in zip(owners, count(held), strict=True):
                totals[owner] += n
        held.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(texts):
        for part in split_safely(text, safe, long_bytes):
            held.append(part)
            owners.append(i)
            size += len(part)
            if size >= batch_bytes:
                flush()
    flush()
    return totals


def token_counts(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes long, n_tokens long`` of each row.

    ``tokenizer``: path of a ``.model`` file (sentencepiece) or ``.json`` file (tokenizers). No begin, end or
    added special tokens, no truncation, no padding. A null text counts as empty: 0 and 0. A null key and
    repeated rows are kept; other columns are left out, so clashing names do no harm. Narrow: no shuffle;
    only lengths leave the Arrow function.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_texts(batch.column(2).to_pylist(), tokenizer)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], schema.names)

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text")).mapInArrow(run, schema)
