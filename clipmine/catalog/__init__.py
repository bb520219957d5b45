"""Registered queries over the benchmark tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name`."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from clipmine.catalog.tables import Tables
            from clipmine.session import configure

            return fn(Tables(configure(spark), sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load_all() -> None:
    from clipmine.catalog import cues, flows, intervals, reports, selection, signals, sources, streams, texts  # noqa: F401
