"""Register queries with the SQL that must give the same rows.

A query declares its key columns with types and its double columns once. Both
sides are cast and rounded from that declaration, so names and types agree. A
tiny offset before rounding keeps values that sit exactly on a rounding tie
from depending on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorframe.session import ship_packages

TIE = 3.1e-10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
              "double": "DOUBLE"}


def _keys(spec: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) for x in spec.split()]


def query(name: str, keys: str, doubles: str = "", sql: str | None = None, digits: int = 6):
    """Decorator: the function returns the raw result; declared columns are kept."""
    key_cols, value_cols = _keys(keys), doubles.split()

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_packages(spark)
            df = fn(spark, sf_dir)
            return df.select(*[F.col(k).cast(t).alias(k) for k, t in key_cols], *[
                (F.round(F.col(v) + F.lit(TIE), digits) + F.lit(0.0)).alias(v)
                for v in value_cols])
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            parts = [f"CAST({k} AS {_SQL_TYPES[t]}) AS {k}" for k, t in key_cols] + [
                f"round(CAST({v} AS DOUBLE) + {TIE!r}, {digits}) + CAST(0 AS DOUBLE) AS {v}"
                for v in value_cols]
            ORACLES[name] = f"SELECT {', '.join(parts)} FROM ({sql})"
        return fn
    return wrap
