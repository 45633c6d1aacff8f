"""All queries of the library, by name, with the SQL that checks them where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "category_by_lang"


def query(sql: str | None):
    """Registers a query (spark, sf_dir) under its name; ``sql`` is DuckDB SQL for the same rows, or None."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from veilframe.plans import agents, boxes, fleets, handovers, inbound, keeping, persons, rollups, scans, scores, screens, seals, texts, web  # noqa: E402, F401
