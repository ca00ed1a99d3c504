"""Registered queries: a Spark function and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrail.catalog.mapping import with_tables
from worktrail.functions.numeric import round_half_up

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_TYPES = {"s": "VARCHAR", "l": "BIGINT", "d": "DOUBLE"}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) for x in spec.split()]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    """Fix names and types; doubles to four decimals, halves up."""
    out = []
    for name, kind in _columns(spec):
        c = F.col(name)
        if kind == "d":
            c = round_half_up(c.cast("double"), 4)
        else:
            c = c.cast("string" if kind == "s" else "bigint")
        out.append(c.alias(name))
    return df.select(*out)


def shaped_sql(spec: str) -> str:
    out = []
    for name, kind in _columns(spec):
        cast = f"CAST({name} AS {SQL_TYPES[kind]})"
        out.append(f"floor({cast} * 10000 + 0.5) / 10000 AS {name}" if kind == "d" else f"{cast} AS {name}")
    return ", ".join(out)


def query(name: str, spec: str, sql: str | None = None, tables: list[str] | None = None, ctes: list[str] | None = None):
    """Register a query. `sql` is a SELECT over `tables` and `ctes`."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Days and hours of the tables are UTC.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return shaped(fn(spark, sf_dir), spec)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(tables or [], *(ctes or []), f"q AS ({sql})") + f"SELECT {shaped_sql(spec)} FROM q"
        return fn

    return register
