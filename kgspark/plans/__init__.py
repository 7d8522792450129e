"""Named queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph, library, review, text
from .domain import Tables, with_tables

_ALL = {**graph.QUERIES, **review.QUERIES, **text.QUERIES, **library.QUERIES}


def _query(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Tables(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(f) for name, (f, _) in _ALL.items()}
ORACLE_SQL: dict[str, str] = {name: with_tables(sql) for name, (_, sql) in _ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to tags, entities, a batch each, accepted, committed, and the dashboard over the result."""
    return review.flagship(Tables(spark, sf_dir))
