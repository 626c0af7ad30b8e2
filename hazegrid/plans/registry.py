"""All queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.sources.adapters import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def r6(*names: str) -> list[Column]:
    """Columns rounded to six places under their own names."""
    return [F.round(F.col(n) + 1e-9, 6).alias(n) for n in names]


def query(name: str, tables: str = "", sql: str | None = None, more: dict[str, str] | None = None):
    """Registers a function of Tables under a name, with the SQL that gives the same rows from the named tables."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            # a hair above zero before rounding, as in r6: values that end in an exact 5 then round alike
            ORACLES[name] = with_tables(tables, sql, more).replace(", 6)", " + 1e-9, 6)")
        return f

    return add


from hazegrid.plans import cleaning, decisions, gapfill, graphs, master, streams  # noqa: E402, F401
