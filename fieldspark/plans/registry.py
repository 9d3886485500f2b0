"""Query registration.

A query is a Spark function, the list of its result columns, and optionally the SQL that gives
the same rows. The column list casts both sides the same way:

    i  BIGINT        f  DOUBLE rounded to 6 digits
    g  the same for values that often end in a decimal 5: a small shift first, so that the last
       bit of a sum does not decide which way they round
    s  STRING        d  date as yyyy-MM-dd
    b  BOOLEAN
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spark_column(name: str, kind: str) -> Column:
    c = F.col(name)
    return {
        "i": lambda: c.cast("bigint"),
        # adding zero turns a negative zero into a positive one
        "f": lambda: F.round(c.cast("double"), 6) + F.lit(0.0),
        "g": lambda: F.round(c.cast("double") + F.lit(1.3e-7), 6) + F.lit(0.0),
        "s": lambda: c.cast("string"),
        "d": lambda: F.date_format(c, "yyyy-MM-dd"),
        "b": lambda: c.cast("boolean"),
    }[kind]().alias(name)


def _sql_column(name: str, kind: str) -> str:
    text = {
        "i": "CAST({0} AS BIGINT)",
        "f": "round(CAST({0} AS DOUBLE), 6) + 0.0",
        "g": "round(CAST({0} AS DOUBLE) + 1.3e-7, 6) + 0.0",
        "s": "CAST({0} AS VARCHAR)",
        "d": "strftime({0}, '%Y-%m-%d')",
        "b": "CAST({0} AS BOOLEAN)",
    }[kind]
    return f"{text.format(name)} AS {name}"


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def query(name: str, spec: str, body: str | None = None, ctes: str = "") -> Callable:
    """Register ``fn(spark, sf_dir)``; ``body`` is the SQL of the same rows."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(configure(spark), sf_dir)
            return df.select(*[_spark_column(n, k) for n, k in _columns(spec)])

        run.__name__ = run.__qualname__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if body is not None:
            chosen = ", ".join(_sql_column(n, k) for n, k in _columns(spec))
            head = f"WITH {ctes.strip().rstrip(',')} " if ctes.strip() else ""
            ORACLES[name] = f"{head}SELECT {chosen} FROM ({body}) AS result"
        return fn

    return register
