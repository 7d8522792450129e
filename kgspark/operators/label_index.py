"""Postings of the labels of entity nodes by their runs of two and three characters, stored in buckets of the run.

A search reads the buckets of its keywords' runs only; a change of nodes rewrites the buckets of the runs of their old and new labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import is_entity
from .state import read_touched, update_version, write_version


def grams(c: Column, n: int) -> Column:
    """All runs of n characters."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def keyword_grams(terms: DataFrame) -> DataFrame:
    """terms (keyword): keyword, gram: the runs of three characters, or the keyword itself where it has two."""
    return terms.select("keyword", F.explode(F.array_distinct(F.when(F.length("keyword") == 2, F.array("keyword")).otherwise(grams(F.col("keyword"), 3)))).alias("gram"))


def postings(nodes: DataFrame) -> DataFrame:
    """nodes (uri, label): gram, uri, label of the entity nodes, case aside; nodes without a label have none."""
    low = F.lower("label")
    return nodes.filter(is_entity(F.col("uri"))).select(F.explode(F.array_distinct(F.concat(grams(low, 2), grams(low, 3)))).alias("gram"), "uri", "label")


def write_index(nodes: DataFrame, root: str, version: str) -> None:
    write_version({"grams": postings(nodes)}, root, version)


def change_index(root: str, old: str, new: str, before: DataFrame, after: DataFrame) -> None:
    """Version `new` after the nodes `before` (as they were) went or were replaced by `after`; nodes that are only new stand in `after` alone."""
    gone, fresh = postings(before), postings(after)

    def change(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {"grams": state["grams"].join(gone.select("gram", "uri"), ["gram", "uri"], "left_anti").unionByName(fresh)}

    update_version(root, gone.select("gram").union(fresh.select("gram")).distinct(), old, new, change)


def look_up(spark: SparkSession, some: DataFrame, root: str, version: str | None = None) -> DataFrame:
    """some (gram): their postings."""
    return read_touched(some.select("gram"), root, "grams", version)
