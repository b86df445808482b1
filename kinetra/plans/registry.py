"""Registration of queries and rounding rules that both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its own name, with its SQL if there is any."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to `digits` decimals without negative zero; NaN becomes null."""
    return df.select(*[(F.when(~F.isnan(c), F.round(c, digits)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(*names: str, digits: int = 6) -> str:
    """SQL select items that round the named columns; `name=expression` gives one an expression."""
    out = []
    for n in names:
        name, _, expr = n.partition("=")
        out.append(f"round({expr or name}, {digits}) + 0.0 AS {name}")
    return ", ".join(out)


def c(*names: str) -> str:
    """SQL select items cast to BIGINT."""
    out = []
    for n in names:
        name, _, expr = n.partition("=")
        out.append(f"CAST({expr or name} AS BIGINT) AS {name}")
    return ", ".join(out)
