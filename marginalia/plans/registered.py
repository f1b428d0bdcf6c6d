"""Where queries and their SQL are registered, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.plans.fixtures import FIXTURES, _literal, cte

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, fixtures: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered twice")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {cte(*fixtures)} {sql}" if fixtures else sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(columns: str, *rows: tuple) -> str:
    """SQL for literal rows, worked out by hand: what a query over a literal fixture must give, where SQL can't express it."""
    sql = lambda v: f"{v!r}::DOUBLE" if isinstance(v, float) else _literal(v)
    listed = ", ".join("(" + ", ".join(map(sql, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {listed}) t({columns})"


def rows_of(fixture: str) -> list[tuple]:
    return FIXTURES[fixture][1]
