"""Registry of named queries over the given tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gridloom.tables import load


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


class Tables:
    """The given tables by attribute, e.g. ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` for the inventory ids in ``ids``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        assert name not in REGISTRY, name
        REGISTRY[name] = Entry(name, tuple(ids.split()), lambda spark, d: fn(Tables(spark, d)), sql)
        return fn

    return wrap
