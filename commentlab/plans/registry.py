"""Where query modules list their queries and, if SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    items: str  # lines of the operator inventory this query covers
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, items: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(name, items, run, sql)
        return run

    return add
