"""Registered queries and their SQL equivalents, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.frame import ImageFrame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame | ImageFrame], sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(spark, sf_dir)
        return out.pixels() if isinstance(out, ImageFrame) else out

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql
