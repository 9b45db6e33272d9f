"""Registration of queries with their oracle texts."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalframe.fixtures import FX, Tables, VEC_DUCK, needed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spec(cols: str) -> list[tuple[str, str]]:
    return [tuple((item + ":").split(":")[:2]) for item in cols.split()]


def publish(df: DataFrame, cols: str) -> DataFrame:
    """Project to the published columns: ``name:6`` rounds to 6 decimals, ``name:i`` is a BIGINT."""
    out = []
    for name, kind in _spec(cols):
        col = F.col(name)
        if kind == "i":
            col = col.cast("bigint")
        elif kind:
            col = F.round(F.when(~F.isnan(col), col), int(kind)) + F.lit(0.0)
        out.append(col.alias(name))
    return df.select(*out)


def oracle_text(body: str, cols: str) -> str:
    names = needed(body)
    ctes = [f"{n} AS ({VEC_DUCK if n == 'fx_vec' else FX[n]})" for n in names] + [f"answer AS ({body})"]
    out = []
    for name, kind in _spec(cols):
        if kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind:
            out.append(f"round({name}, {kind}) + 0e0 AS {name}")
        else:
            out.append(name)
    return "WITH " + ",\n".join(ctes) + "\nSELECT " + ", ".join(out) + " FROM answer"


def query(name: str, cols: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with an optional oracle body."""

    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return publish(fn(Tables(spark, folder)), cols)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = oracle_text(sql, cols)
        return fn

    return wrap
