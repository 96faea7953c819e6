"""All queries of the retrieval engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoreel.plans import branches, encoders, evidence, extras, feedback, index, overview, pictures, retrieval, scenes, sql_tools, stored, streams, text

Query = Callable[[SparkSession, str], DataFrame]

_ALL: dict[str, tuple[Query, str | None]] = {**retrieval.QUERIES, **scenes.QUERIES, **text.QUERIES, **index.QUERIES, **extras.QUERIES, **overview.QUERIES, **evidence.QUERIES, **stored.QUERIES, **streams.QUERIES, **encoders.QUERIES, **pictures.QUERIES, **feedback.QUERIES, **sql_tools.QUERIES, **branches.QUERIES}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
