"""Governance reports, and what happens to sources: gone, purged, deleted, synchronised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import artifact_key
from .extract import rule_extraction
from .graph import clear_mentions, orphan_entities
from .review import bulk_review, commit_batch, create_batches

#: More batches than these wait for review: an alert.
WAITING = 5


def dashboard(batches: DataFrame, items: DataFrame, evidence: DataFrame) -> DataFrame:
    """section, key, value in long form. An item that isn't a node counts as an edge; only pending and reviewing batches wait."""
    by = lambda df, name: df.groupBy(F.col("status").alias("key")).agg(F.count("*").alias("value")).select(F.lit(name).alias("section"), "key", "value")
    kinds = items.select(F.when(F.col("kind") == "node", "nodes").otherwise("edges").alias("key")).groupBy("key").agg(F.count("*").alias("value")).select(F.lit("kinds").alias("section"), "key", "value")
    sums = evidence.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(F.col("status") == "purged").alias("purged"))
    health = sums.select(F.explode(F.create_map(F.lit("total"), "total", F.lit("stale"), "stale", F.lit("purged"), "purged", F.lit("healthy"), F.col("total") - F.col("stale") - F.col("purged")))).select(F.lit("evidence").alias("section"), "key", "value")
    late = batches.agg(F.count_if(F.col("status").isin("pending", "reviewing")).alias("n"))
    alerts = sums.select(F.lit("stale_evidence").alias("key"), F.col("stale").alias("value")).filter("value > 0").union(late.select(F.lit("waiting_batches"), "n").filter(F.col("n") > WAITING)).select(F.lit("alert").alias("section"), "key", "value")
    return by(batches, "batches").unionByName(by(items, "items")).unionByName(kinds).unionByName(health).unionByName(alerts)


def batch_item_counts(batches: DataFrame, items: DataFrame, status: str | None = None, source_uri: str | None = None, limit: int = 50) -> DataFrame:
    """The newest batches with their numbers of items by status."""
    b = batches
    for c, v in (("status", status), ("source_uri", source_uri)):
        b = b.filter(F.col(c) == v) if v is not None else b
    b = b.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    kinds = ["candidate", "accepted", "rejected", "committed"]
    n = items.join(b.select(F.col("id").alias("batch_id")), "batch_id", "left_semi").groupBy("batch_id").agg(F.count("*").alias("n_items"), *(F.count_if(F.col("status") == k).alias(f"n_{k}") for k in kinds))
    out = b.join(n.withColumnRenamed("batch_id", "id"), "id", "left")
    return out.select("id", "source_uri", "status", "created_at", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_items", *(f"n_{k}" for k in kinds))))


def stale_report(evidence: DataFrame) -> DataFrame:
    """By source (none: unknown): stale, purged, and the first 200 characters of each such text."""
    e = evidence.filter(F.col("status").isin("stale", "purged"))
    uri = F.coalesce(F.nullif("source_uri", F.lit("")), F.lit("unknown"))
    return e.groupBy(uri.alias("source_uri")).agg(F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(F.col("status") == "purged").alias("purged"), F.array_sort(F.collect_list(F.struct("id", F.substring("evidence_text", 1, 200).alias("text")))).alias("rows"))


#: What a report recommends.
RECOMMEND, NOTHING = "Purge the sources with stale evidence, then extract those that are still there again.", "There is no stale evidence."


def stale_rows(evidence: DataFrame) -> DataFrame:
    """The stale report in long form, a row for each stale or purged evidence: source_uri (none: unknown), id, graph_item_id, batch_id, status, confidence, text (its first 200 characters)."""
    e = evidence.filter(F.col("status").isin("stale", "purged"))
    return e.select(F.coalesce(F.nullif("source_uri", F.lit("")), F.lit("unknown")).alias("source_uri"), "id", "graph_item_id", "batch_id", "status", "confidence", F.substring(F.coalesce("evidence_text", F.lit("")), 1, 200).alias("text"))


def stale_totals(evidence: DataFrame) -> DataFrame:
    """One row: stale_total, stale, purged, sources_affected, recommendation."""
    by = stale_rows(evidence).groupBy("source_uri").agg(F.count_if(F.col("status") == "stale").alias("stale"), F.count("*").alias("n"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by.agg(zero("n").alias("stale_total"), zero("stale").alias("stale"), (zero("n") - zero("stale")).alias("purged"), F.count("*").alias("sources_affected"), F.when(zero("n") > 0, RECOMMEND).otherwise(NOTHING).alias("recommendation"))


def prefix_digests(uris: DataFrame, parts: int | None = None) -> DataFrame:
    """uris (uri): prefix, n, digest: one row for each folder (all up to the last /; or its first `parts` parts), whatever the order of its uris. Keep it beside a large table: folders' rows add up."""
    folder = F.regexp_replace("uri", "[^/]*$", "")
    prefix = F.array_join(F.slice(F.split(folder, "/"), 1, parts), "/") if parts else folder
    h = F.xxhash64("uri")
    return uris.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"), F.struct(F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit((1 << 31) - 1))).alias("s")).alias("digest"))


def unlike_prefixes(known: DataFrame, listing: DataFrame) -> DataFrame:
    """Prefixes of the one's digests that the other lacks, or has with another count or digest."""
    there = listing.select("prefix", F.col("n").alias("_n"), F.col("digest").alias("_digest"))
    both = known.join(there, "prefix", "left")
    return both.filter(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_digest")))).select("prefix")


def inventory_diff(documents: DataFrame, listing: DataFrame, levels: tuple[int | None, ...] = (5, None)) -> DataFrame:
    """Known active documents of the drive that the listing lacks, with all_stale: whether that is every one of them.

    A hash tree over the folders of both sides: at each level (a number of path parts; None: whole folders) only what lies below prefixes of unlike digests goes on, and only the uris of folders
    that are unlike in the end are joined. Repeated uris of a listing make its folder unlike, no more. Two unlike folders with equal counts, 64-bit and 31-bit digests would be missed.
    """
    known = documents.filter(F.startswith("uri", F.lit("cloudreve://")) & (F.col("status") == "active")).select("uri")
    folder = F.regexp_replace("uri", "[^/]*$", "")
    left, right = known, listing.select("uri").filter(F.startswith("uri", F.lit("cloudreve://")))
    for parts in levels:
        unlike = unlike_prefixes(prefix_digests(left, parts), prefix_digests(right, parts))
        prefix = F.array_join(F.slice(F.split(folder, "/"), 1, parts), "/") if parts else folder
        left, right = (x.withColumn("prefix", prefix).join(unlike, "prefix", "left_semi").select("uri") for x in (left, right))
    stale = left.join(right, "uri", "left_anti")
    counts = known.agg(F.count("*").alias("known")).join(stale.agg(F.count("*").alias("stale")), F.lit(True))
    return stale.join(F.broadcast(counts.select((F.col("known") == F.col("stale")).alias("all_stale"))), F.lit(True))  # one row


def _hit(rows: DataFrame, uris: DataFrame, column: str) -> DataFrame:
    return rows.join(uris.select(F.col("uri").alias(column), F.lit(True).alias("_hit")).distinct(), column, "left")


def mark_source_deleted(documents: DataFrame, evidence: DataFrame, uris: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents become source_deleted, their evidence stale (also what was purged); and by uri how much evidence changed."""
    when = now if now is not None else F.current_timestamp()
    d = _hit(documents, uris, "uri").withColumns({"status": F.when(F.col("_hit"), "source_deleted").otherwise(F.col("status")), "deleted_at": F.when(F.col("_hit"), when).otherwise(F.col("deleted_at"))}).select(documents.columns)
    e = _hit(evidence, uris, "source_uri")
    changed = e.filter("_hit and status <> 'stale'").groupBy(F.col("source_uri").alias("uri")).agg(F.count("*").alias("changed"))
    return d, e.withColumn("status", F.when(F.col("_hit"), "stale").otherwise(F.col("status"))).select(evidence.columns), changed


def purge(documents: DataFrame, chunks: DataFrame, evidence: DataFrame, uris: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and evidence after a purge of the given sources (none given: of all that evidence has), and by uri how much evidence was purged."""
    uris = uris if uris is not None else distinct_sources(evidence)
    e = _hit(evidence, uris, "source_uri")
    counts = e.filter("_hit and status <> 'purged'").groupBy(F.col("source_uri").alias("uri")).agg(F.count("*").alias("purged"))
    e = e.withColumn("status", F.when(F.col("_hit"), "purged").otherwise(F.col("status"))).select(evidence.columns)
    return documents.join(uris, "uri", "left_anti"), chunks.join(uris.select(F.col("uri").alias("document_uri")), "document_uri", "left_anti").select(chunks.columns), e, counts


def distinct_sources(evidence: DataFrame) -> DataFrame:
    return evidence.select(F.col("source_uri").alias("uri")).filter("uri is not null").distinct()


def delete_source(uris: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, artifacts: DataFrame, documents: DataFrame, chunks: DataFrame, evidence: DataFrame) -> dict[str, DataFrame]:
    """All tables without the sources: nodes and their edges, entities left without an edge, vectors, artifacts, chunks, documents; evidence purged."""
    u = uris.select("uri").distinct()
    e = edges
    for c in ("src_uri", "dst_uri"):
        e = e.join(u.select(F.col("uri").alias(c)), c, "left_anti")
    e = e.select(edges.columns)
    n = nodes.join(u, "uri", "left_anti")
    n = n.join(orphan_entities(n, e).select("uri"), "uri", "left_anti").select(nodes.columns)
    keys = documents.join(u, "uri", "left_semi").select(artifact_key(F.col("content_hash"), F.col("filename")).alias("key"))
    d, c, ev, counts = purge(documents, chunks, evidence, u)
    return {"nodes": n, "edges": e, "vectors": vectors.join(u, "uri", "left_anti").select(vectors.columns), "artifacts": artifacts.join(keys, "key", "left_anti").select(artifacts.columns), "documents": d, "chunks": c, "evidence": ev, "counts": counts}


def sync_sources(listing: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """delete_source for what the listing lacks."""
    return delete_source(inventory_diff(tables["documents"], listing), **tables)


def document_status(documents: DataFrame, uris: DataFrame) -> DataFrame:
    """uri, status of each given uri; null where it isn't known."""
    return uris.select("uri").join(documents.select("uri", "status"), "uri", "left")


def ingest(docs: DataFrame, requested_by: str, created_at: Column, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """docs (uri, text): rule-based extraction, one batch a document, all accepted, committed."""
    _, entities = rule_extraction(docs)
    requests = docs.select(F.col("uri").alias("source_uri"), F.lit(requested_by).alias("requested_by"), F.array().cast("array<string>").alias("template_ids"), created_at.alias("created_at"))
    e = entities.withColumn("description", F.lit("")).withColumnRenamed("uri", "source_uri")
    none = e.limit(0).select("source_uri", *(F.lit(None).cast("string").alias(c) for c in ("source", "target", "relation", "evidence")), "confidence")
    batches, items = create_batches(requests, e, none)
    items, _ = bulk_review(items, batches, "accepted")
    return commit_batch(batches, items, nodes, edges, evidence, links, created_at)


__all__ = ["batch_item_counts", "clear_mentions", "dashboard", "delete_source", "distinct_sources", "document_status", "ingest", "inventory_diff", "mark_source_deleted", "purge", "stale_report", "sync_sources"]
