"""Registry of named queries with the SQL that a second engine answers them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from letterloom.shared import spread
from letterloom.sources.letters import LETTERS, RECORDS, as_duckdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; its SQL may use the relations ``letters`` and ``records``."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            relations = [f"{n} AS ({as_duckdb(s)})" for n, s in (("letters", LETTERS), ("records", RECORDS)) if n in sql]
            own = sql.strip()
            if relations and own[:5].upper() == "WITH ":
                ORACLES[name] = "WITH " + ", ".join(relations) + ", " + own[5:]
            else:
                ORACLES[name] = ("WITH " + ", ".join(relations) + " " if relations else "") + own
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df  # whole texts: costly work on few rows
