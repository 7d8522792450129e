"""Connected components of an undirected graph, by alternating large and small stars.

Each round links the neighbours of every node to the smallest of them: first the larger neighbours, then the smaller ones. The graph's
components stay the same, and it ends as stars around their smallest nodes after about log(diameter) squared rounds at most, few where it
starts close to stars. A round is two joins with minima by node, which are summed on the map side; no node's neighbours are gathered.
Every round is written to the shared folder, so that its lineage stays short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_folder, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", folder: str | None = None) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge. Null ends and loops are no edges."""
    folder = folder or shared_folder(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = written(e.distinct(), folder, "star0")
    before, k = None, 0
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        k += 1
        e = written(small.filter("u <> v").distinct(), folder, f"star{k}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
