"""Registry of runnable queries and the SQL each one is checked against.

A query is a function ``(spark, sf_dir) -> DataFrame``.  ``ids`` names the lines
of the operator inventory it covers.  ``sql`` is optional: state machines, text
jobs and streams are checked by tests instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    build: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(name, tuple(ids.split()), build, sql)
        return build

    return register
