"""Merging extractions of segments into one per document, and near-duplicate entities into one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import similar_pairs
from ..storage import shared_folder, written
from .components import connected_components

#: Entities of a document that are compared within one task; larger documents' meet by a metric join. Rows of a task's group of documents; numbers of an array of products.
DOC_ROWS, GROUP_ROWS, PRODUCTS = 1000, 20_000, 1 << 21


def _first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def with_entity_ids(entities: DataFrame) -> DataFrame:
    """A missing id is the type and label, lower-cased, with _ for spaces."""
    kind, label = F.coalesce("type", F.lit("Concept")), F.coalesce("label", F.lit("unknown"))
    made = F.concat(F.lower(kind), F.lit("_"), F.replace(F.lower(label), F.lit(" "), F.lit("_")))
    return entities.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), made))


def confident(entities: DataFrame, least: float = 0.5) -> DataFrame:
    """Without entities under the confidence; a missing one counts as 1."""
    return entities.filter(F.coalesce("confidence", F.lit(1.0)) >= least)


def dedup_entities(entities: DataFrame, doc: str = "uri") -> DataFrame:
    """The first of each id of a document, in the order of segments and places; empty ids go."""
    return _first(entities.filter("id <> ''"), [doc, "id"], ["chunk_index", "pos"])


def dedup_relations(relations: DataFrame, doc: str = "uri") -> DataFrame:
    return _first(relations, [doc, "source", "target", "relation"], ["chunk_index", "pos"])


def prune_dangling(relations: DataFrame, entities: DataFrame, doc: str = "uri") -> DataFrame:
    """Relations of which both ends are entities of the document, in whatever segment."""
    ids = entities.select(doc, "id").distinct()
    for end in ("source", "target"):
        relations = relations.join(ids.select(doc, F.col("id").alias(end)), [doc, end], "left_semi")
    return relations


def merge_tags(tags: DataFrame, doc: str = "uri", most: int = 20) -> DataFrame:
    """doc, rank, tag: distinct tags but for case, spelled as first seen, the first `most`."""
    one = _first(tags.withColumn("low", F.lower("tag")), [doc, "low"], ["chunk_index", "pos"])
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(doc).orderBy("chunk_index", "pos"))).filter(F.col("rank") <= most).select(doc, "rank", "tag")


def merge_key_points(points: DataFrame, doc: str = "uri", most: int = 10) -> DataFrame:
    by = Window.partitionBy(doc).orderBy("chunk_index", "pos")
    return points.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most)


def merge_summary_confidence(segments: DataFrame, doc: str = "uri") -> DataFrame:
    """doc, summary (the first that isn't blank), confidence (the least)."""
    summary = F.min(F.when(F.col("summary").rlike(r"\S"), F.struct("chunk_index", "summary")))["summary"]
    return segments.groupBy(doc).agg(F.coalesce(summary, F.lit("")).alias("summary"), F.min("confidence").alias("confidence"))


def merge_extractions(segments: DataFrame, entities: DataFrame, relations: DataFrame, tags: DataFrame, points: DataFrame, doc: str = "uri") -> dict[str, DataFrame]:
    """All parts of the merge; relations are pruned after it, so that those between segments stay."""
    kept = dedup_entities(entities, doc)
    return {
        "extractions": merge_summary_confidence(segments, doc),
        "entities": kept,
        "relations": prune_dangling(dedup_relations(relations, doc), kept, doc),
        "tags": merge_tags(tags, doc),
        "key_points": merge_key_points(points, doc),
    }


def entity_clusters(nodes: DataFrame, pairs: DataFrame, id_: str = "id") -> DataFrame:
    """nodes (id), pairs (a, b): id, cluster (its smallest id); an id without a pair is its own."""
    found = connected_components(pairs.select("a", "b"))
    return nodes.select(id_).join(found.withColumnRenamed("node", id_), id_, "left").select(id_, F.coalesce("component", id_).alias("cluster"))


def canonical_entities(entities: DataFrame, clusters: DataFrame, id_: str = "id", order: str = "pos") -> DataFrame:
    """id, canonical: of each cluster the entity of the highest confidence (missing: 0.8), ties: the first."""
    e = entities.select(id_, order, F.coalesce("confidence", F.lit(0.8)).alias("confidence")).join(clusters, id_)
    best = e.groupBy("cluster").agg(F.min(F.struct(-F.col("confidence"), F.col(order), F.col(id_).alias("id")))["id"].alias("canonical"))
    return e.join(best, "cluster").select(id_, "canonical")


def remap_endpoints(relations: DataFrame, canonical: DataFrame, entities: DataFrame, doc: str = "uri") -> DataFrame:
    """Relations with canonical ends, each once, without those that lost an end."""
    for end in ("source", "target"):
        m = canonical.select(F.col("id").alias(end), F.col("canonical").alias("_to"))
        relations = relations.join(m, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return prune_dangling(dedup_relations(relations, doc), entities, doc)


def _unit_vectors(vectors: list | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n vectors of unit length, filled up with zeros, and their numbers of dimensions; 0 for those that are missing, hold nulls or have no direction."""
    found = [v if v is not None else () for v in vectors] if vectors is not None and len(vectors) == n else [()] * n
    dims = np.array([len(v) for v in found], np.int64)
    x = np.zeros((n, max(1, dims.max(initial=0))))
    for d in np.unique(dims[dims > 0]):
        x[dims == d, :d] = np.array([v for v, k in zip(found, dims, strict=True) if k == d], np.float64)
    with np.errstate(all="ignore"):
        size = np.sqrt((x * x).sum(1))
        dims[~((size > 0) & np.isfinite(size))] = 0
        return np.where(dims[:, None] > 0, x / size[:, None], 0.0), dims


def _firsts(near: np.ndarray) -> np.ndarray:
    """near (groups, n, n): for each row the first one that it is connected with."""
    first = np.broadcast_to(np.arange(near.shape[1]), near.shape[:2])
    while True:
        new = np.where(near, first[:, None, :], near.shape[1]).min(2)
        new = np.take_along_axis(new, new, 1)
        if (new == first).all():
            return first
        first = new


def _within(rows: pd.DataFrame, embed: Callable[[list[str]], list[list[float]]], threshold: float) -> pd.DataFrame:
    """rows (doc, id, label, confidence, chunk_index, pos) of whole documents: doc, id, canonical of those that become another. Documents of equal numbers of entities are compared at once."""
    sure = np.where(np.isnan(rows.confidence), np.inf, -rows.confidence)
    rows = rows.assign(number=pd.factorize(rows.doc)[0], sure=sure).sort_values(["number", "sure", "chunk_index", "pos", "id"], na_position="first", ignore_index=True)
    of, labels = pd.factorize(rows.label)
    try:
        x, dims = _unit_vectors(embed(labels.tolist()), len(labels))
    except Exception:  # a user's call may fail in any way
        return rows.iloc[:0].assign(canonical=rows.id.iloc[:0])[["doc", "id", "canonical"]]
    sizes = np.bincount(rows.number)
    starts = np.cumsum(sizes) - sizes
    best = np.arange(len(rows))
    for n in np.unique(sizes[sizes > 1]):
        some = starts[sizes == n]
        step = max(1, PRODUCTS // int(n * max(n, x.shape[1])))
        for k in range(0, len(some), step):
            at = some[k : k + step, None] + np.arange(n)
            v, d = x[of[at]], dims[of[at]]
            near = (v @ v.transpose(0, 2, 1) >= threshold) & (d[:, :, None] == d[:, None, :]) & (d[:, :, None] > 0)
            near |= np.eye(n, dtype=bool)
            best[at] = np.take_along_axis(at, _firsts(near), 1)
    out = rows.assign(canonical=rows.id.to_numpy()[best])[["doc", "id", "canonical"]]
    return out[out.id != out.canonical]


def _across(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], threshold: float, folder: str) -> DataFrame:
    """The same of documents of any size, whose entities meet by a metric join."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            try:
                yield pd.Series(list(embed(s.fillna("").tolist())), dtype=object)
            except Exception:  # a user's call may fail in any way
                yield pd.Series([None] * len(s), dtype=object)

    keyed = rows.select("doc", "id", F.to_json(F.struct("doc", "id")).alias("key"), F.struct("chunk_index", "pos", "id").alias("place"), "confidence", F.pandas_udf(run, "array<double>")("label").alias("vector"))
    keyed = written(keyed, folder, "vectors")
    clusters = entity_clusters(keyed.select("key"), similar_pairs(keyed.filter("vector is not null"), "doc", "key", threshold), "key")
    best = canonical_entities(keyed, clusters, "key", "place").filter("key <> canonical")
    return best.join(keyed.select("key", "doc", "id"), "key").join(keyed.select(F.col("key").alias("canonical"), F.col("id").alias("to")), "canonical").select("doc", "id", F.col("to").alias("canonical"))


def semantic_dedup(entities: DataFrame, relations: DataFrame, embed: Callable[[list[str]], list[list[float]]], threshold: float = 0.88, doc: str = "uri") -> dict[str, DataFrame]:
    """entities (doc, id, label, confidence, chunk_index, pos), one row for each id of a document: those of a document whose labels' vectors are near become the surest one.

    entities, relations (with canonical ends) and merged (doc, id, canonical). embed is a user's function on labels; where it fails, entities stay as they are.
    """
    folder = shared_folder(entities.sparkSession)
    kinds = {c: entities.schema[c].dataType.simpleString() for c in (doc, "id")}
    rows = entities.filter(F.col(doc).isNotNull() & F.col("id").isNotNull())
    rows = written(rows.select(F.col(doc).alias("doc"), "id", F.coalesce("label", "id").alias("label"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.8)).alias("confidence"), "chunk_index", "pos"), folder, "rows")
    large = written(rows.groupBy("doc").agg(F.count("*").alias("n")).filter(F.col("n") > DOC_ROWS).select("doc"), folder, "large")
    groups = max(1, rows.count() // GROUP_ROWS)
    small = rows.join(large, "doc", "left_anti").withColumn("group", F.pmod(F.xxhash64("doc"), F.lit(groups)))
    merged = small.groupBy("group").applyInPandas(lambda pdf: _within(pdf, embed, threshold), f"doc {kinds[doc]}, id {kinds['id']}, canonical {kinds['id']}")
    if not large.isEmpty():
        merged = merged.unionByName(_across(rows.join(large, "doc", "left_semi"), embed, threshold, folder))
    merged = written(merged.withColumnRenamed("doc", doc), folder, "merged")
    kept = entities.join(merged, [doc, "id"], "left_anti")
    for end in ("source", "target"):
        m = merged.select(doc, F.col("id").alias(end), F.col("canonical").alias("_to"))
        relations = relations.join(m, [doc, end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return {"entities": kept, "relations": prune_dangling(dedup_relations(relations, doc), kept, doc), "merged": merged}
