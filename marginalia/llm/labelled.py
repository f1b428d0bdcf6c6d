"""Which labelled rows a classifier may learn from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; that of a null key is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def training_labels(labels: DataFrame, label: str, *, key: str, folds: int, limit: int) -> DataFrame:
    """``key, label`` of rows outside the held-out fold: at most ``limit`` of either class, by a hash of the key.

    Rows with a null key or label are left out, repeated rows count once.
    """
    rows = labels.select(F.col(key), F.col(label).cast("int").alias("label")).where(F.col(key).isNotNull() & F.col("label").isin(0, 1))
    rows = rows.where(remainder(key, folds) != 0).distinct()
    order = [F.xxhash64(F.col(key), F.lit(11)), F.col(key)]
    return rows.where("label = 0").orderBy(*order).limit(limit).union(rows.where("label = 1").orderBy(*order).limit(limit))
