"""Registered queries: each key pairs a Spark job with the DuckDB statement that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.sources.derived import DerivedFrames, compose

LIBRARY: dict[str, str] = {}


@dataclass(frozen=True)
class Entry:
    build: Callable[[DerivedFrames], DataFrame]
    sql: str | None
    text: tuple[str, ...] = field(default=())


REGISTRY: dict[str, Entry] = {}


def query(key: str, sql: str | None = None, text: str = ""):
    """Register a query. ``text`` lists the exact figures and days handed over as text."""

    def register(build):
        if key in REGISTRY:
            raise ValueError(f"{key} is registered twice")
        REGISTRY[key] = Entry(build, sql, tuple(text.split()))
        return build

    return register


def handed_over(df: DataFrame) -> DataFrame:
    """Decimals, days and instants leave as text so that no reader rounds them."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DecimalType, T.DateType)):
            out.append(F.col(f.name).cast("string").alias(f.name))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out.append(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def spark_query(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: handed_over(entry.build(DerivedFrames(spark, folder)))


def duckdb_statement(entry: Entry) -> str:
    body = entry.sql
    if entry.text:
        casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in entry.text)
        body = f"SELECT * REPLACE ({casts}) FROM ({body}) AS typed"
    return compose(body, LIBRARY)


def load_all() -> None:
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
