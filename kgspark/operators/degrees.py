"""How many edges each node has, kept beside the graph: orphans are found among the nodes that a change touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import is_entity
from .state import read_touched, update_version, write_version


def _ends(edges: DataFrame, by: int) -> DataFrame:
    return edges.select(F.explode(F.array("src_uri", "dst_uri")).alias("uri"), F.lit(by).cast("long").alias("by")).filter("uri is not null")


def _sums(changes: DataFrame) -> DataFrame:
    return changes.groupBy("uri").agg(F.sum("by").alias("degree"))


def write_degrees(nodes: DataFrame, edges: DataFrame, root: str, version: str) -> None:
    """degrees (uri, degree) of all nodes and ends of edges, in buckets of the uri; an edge from a node to itself counts twice."""
    write_version({"degrees": _sums(nodes.select("uri", F.lit(0).cast("long").alias("by")).filter("uri is not null").unionByName(_ends(edges, 1)))}, root, version)


def change_degrees(root: str, old: str, new: str, added: DataFrame, removed: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Version `new` after edges were added and removed, and nodes added; reads and writes only the buckets of the touched nodes. The touched uris."""
    changes = _ends(added, 1).unionByName(_ends(removed, -1))
    if nodes is not None:
        changes = changes.unionByName(nodes.select("uri", F.lit(0).cast("long").alias("by")).filter("uri is not null"))
    changes = _sums(changes)

    def change(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
        before = state["degrees"].select("uri", F.col("degree").alias("by"))
        return {"degrees": _sums(before.unionByName(changes.withColumnRenamed("degree", "by")))}

    update_version(root, changes.select("uri"), old, new, change)
    return changes.select("uri")


def touched_orphans(touched: DataFrame, root: str, version: str | None = None) -> DataFrame:
    """uri of the touched entity nodes that have no edge left."""
    return read_touched(touched, root, "degrees", version).filter((F.col("degree") <= 0) & is_entity(F.col("uri"))).select("uri")
