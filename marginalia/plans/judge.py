"""The shell around external scoring: requests, an injected judge, tolerant parsing, defaults, tallies.

The judge is any function from prompts to answers; it runs in ``mapInArrow`` and is tried again a bounded number of times.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.text import tolerant_json
from marginalia.operators import relations, sequences

Judge = Callable[[list[str]], list[str]]
#: What a service may raise for a while; anything else is an error of the program and ends the job.
PASSING = (ConnectionError, TimeoutError, OSError)


def requests(rows: DataFrame, size: int, template: str, doc: str = "doc_id", order: str = "ord", text: str = "text") -> DataFrame:
    """``doc_id, batch, prompt``: consecutive rows, ``size`` at a time, numbered below the template."""
    numbered = sequences.batches(rows, size, doc, order)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.concat(x[order].cast("string"), F.lit(". "), x[text]))
    return numbered.groupBy(F.col(doc).alias("doc_id"), "batch").agg(F.concat(F.lit(template + "\n"), F.array_join(parts, "\n")).alias("prompt"))


def ask(asked: DataFrame, judge: Judge, tries: int = 4, wait: float = 0.7, factor: float = 2.5, passing: tuple[type[Exception], ...] = PASSING) -> DataFrame:
    """Adds ``answer``: null if the judge failed every time; failures are never kept as answers. Only ``passing`` errors are tried again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = batch.column(batch.schema.get_field_index("prompt")).to_pylist()
            answers: list = [None] * len(prompts)
            pause = wait
            for k in range(tries):
                try:
                    answers = judge(prompts)
                    break
                except passing:
                    if k + 1 < tries:
                        time.sleep(pause)
                        pause *= factor
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], [*batch.schema.names, "answer"])

    return asked.mapInArrow(run, T.StructType([*asked.schema.fields, T.StructField("answer", T.StringType())]))


def remaining(asked: DataFrame, answered: DataFrame, *keys: str) -> DataFrame:
    """Requests without a cached answer."""
    return asked.join(answered.where("answer is not null").select(*keys).distinct(), list(keys), "left_anti")


def verdicts(answers: DataFrame, items: DataFrame, key: str, default: str = "UNCLEAR") -> DataFrame:
    """Every item with verdict and note, the last answer counts; an unreadable or missing one is ``default``."""
    parsed = answers.select(key, "ord", tolerant_json(F.col("answer"), "verdict string, note string").alias("r")).select(key, "ord", "r.verdict", "r.note")
    return relations.with_default(items, parsed, key, "ord", verdict=default, note="")


def tally(found: DataFrame) -> DataFrame:
    return found.groupBy("verdict").agg(F.count("*").alias("n"))


def contiguous_prefix(done: DataFrame, doc: str = "doc_id", index: str = "ix") -> DataFrame:
    """Cached rows before the first missing index of their document."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(doc).orderBy(index)) - 1
    return done.withColumn("_p", place).where(F.col("_p") == F.col(index)).drop("_p")
