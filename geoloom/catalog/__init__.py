"""Registered queries: one per operator, each with its checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from geoloom.fixtures import Fixtures, oracle


@dataclass(frozen=True)
class Entry:
    run: Callable[[Fixtures], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register a function over the fixture views; ``sql`` may name the views as fx_<view>."""

    def wrap(fn: Callable[[Fixtures], DataFrame]):
        ENTRIES[name] = Entry(fn, oracle(sql, *views) if sql and views else sql)
        return fn

    return wrap


def load() -> dict[str, Entry]:
    from geoloom.catalog import graphs, joins, layout, ordered, raster, shapes, text  # noqa: F401

    return ENTRIES


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return load()[name].run(Fixtures(spark, folder))
