"""Catalog operators: filters, groups in order of appearance, counts and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equals(column: str, value: str | None) -> Column:
    """Case-insensitive equality; no value, no filter."""
    return F.lit(True) if not value else F.lower(F.col(column)) == value.lower()


def holds(column: str, value: str | None) -> Column:
    """Case-insensitive substring; signs of patterns are plain characters."""
    return F.lit(True) if not value else F.contains(F.lower(F.col(column)), F.lit(value.lower()))


def in_year(column: str, year: str | None) -> Column:
    """The text begins or ends with the year as given."""
    return F.lit(True) if not year else F.col(column).startswith(year) | F.col(column).endswith(year)


def filter_catalog(rows: DataFrame, *, university: str | None = None, status: str | None = None, year: str | None = None, industry: str | None = None) -> DataFrame:
    return rows.where(equals("university", university) & equals("status", status) & in_year("date", year) & holds("industry", industry))


def open_topics(rows: DataFrame, *, everything: bool = False, status: str | None = None) -> DataFrame:
    """Topics of a status; open ones unless told otherwise."""
    return rows if everything and not status else rows.where(equals("status", status or "open"))


def groups_in_order(rows: DataFrame, key: Column, order: str, name: str = "key") -> DataFrame:
    """``key, n, first_ord, place``: groups in the order of their first row."""
    found = rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.min(order).alias("first_ord"))
    return found.withColumn("place", F.row_number().over(Window.orderBy("first_ord")))  # one row per group


#: Numbers of first rows in a range within which equally common keys are ranked.
RANGE = 1 << 20


def most_common(rows: DataFrame, key: str, order: str, limit: int | None = None) -> DataFrame:
    """``key, n, place``: the commonest first, of equals the one seen first.

    Without a limit, keys are ranked within their count and a range of first rows (``order`` is a number); a small table of such
    groups says how many stand before, so that no task has all keys.
    """
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_ord"))
    if limit:
        found = found.orderBy(F.desc("n"), "first_ord").limit(limit)
        return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first_ord"))).drop("first_ord")
    found = found.withColumn("range", F.floor(F.col("first_ord") / RANGE))
    before = Window.orderBy(F.desc("n"), "range").rowsBetween(Window.unboundedPreceding, -1)
    groups = found.groupBy("n", "range").agg(F.count("*").alias("keys")).withColumn("base", F.coalesce(F.sum("keys").over(before), F.lit(0))).drop("keys")  # a row for each count and range
    own = F.row_number().over(Window.partitionBy("n", "range").orderBy("first_ord"))
    return found.withColumn("own", own).join(groups, ["n", "range"]).select(key, "n", (F.col("base") + F.col("own")).alias("place"))


def year_of(date: Column) -> Column:
    """The first word of four digits, commas aside; null without."""
    return F.try_element_at(F.filter(F.split(F.replace(date, F.lit(","), F.lit(" ")), r"\s+"), lambda w: w.rlike("^[0-9]{4}$")), F.lit(1))


def year_histogram(rows: DataFrame) -> DataFrame:
    done = rows.where(equals("status", "completed"))
    return done.select(year_of(F.col("date")).alias("year")).where("year is not null").groupBy("year").agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, *keys: str, order: str) -> DataFrame:
    """Rows numbered from 1 within each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
