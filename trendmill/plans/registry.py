"""The catalogue of named queries and, where SQL can say the same, their SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendmill.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _digits(doubles: str) -> dict[str, int]:
    """'a b:3' -> {'a': 6, 'b': 3}."""
    out = {}
    for item in doubles.split():
        name, _, digits = item.partition(":")
        out[name] = int(digits) if digits else 6
    return out


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query.  ``doubles`` lists floating columns and the digits both sides keep."""
    digits = _digits(doubles)

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = build(use_utc(spark), sf_dir)
            if digits:
                out = out.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()})
            return out

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql:
            if digits:
                rounded = ", ".join(f"round(CAST({c} AS DOUBLE), {n}) AS {c}" for c, n in digits.items())
                sql_out = _wrap(sql, rounded)
            else:
                sql_out = sql
            ORACLES[name] = sql_out.strip()
        return build

    return register


def _wrap(sql: str, replacements: str) -> str:
    return f"SELECT * REPLACE ({replacements}) FROM (\n{sql.strip()}\n)"
