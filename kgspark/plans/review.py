"""Queries over batches, items, evidence, documents: review, commit, governance, lifecycle, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import degrees as dg
from ..operators import graph as g
from ..operators import lifecycle as lc
from ..operators import review as r
from ..operators import state as st
from ..sources import files as fs
from ..storage import shared_folder
from .domain import Tables

G = "id, batch_id, graph_item_id"
EDITED = """(SELECT i.id, i.batch_id, coalesce(e.status, i.status) AS status, coalesce(e.new_label, p_label) AS p_label FROM {flat_items} i
  LEFT JOIN (SELECT * FROM {edits} WHERE batch_id NOT IN (SELECT id FROM {batches} WHERE status = 'committed')) e ON e.item_id = i.id)"""
NEW = """(SELECT * FROM (SELECT g.*, b.source_uri, b.template_id, b.created_at, b.requested_by, row_number() OVER (PARTITION BY graph_item_id ORDER BY b.created_at, g.batch_id, g.seq, g.id) AS rn
  FROM {graph_items} g JOIN {batches} b ON b.id = g.batch_id WHERE g.status = 'accepted') x WHERE rn = 1 AND graph_item_id NOT IN (SELECT graph_item_id FROM {evidence}))"""
LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_uri ORDER BY created_at DESC, id DESC) AS rn FROM {batches}) x WHERE rn = 1)"
MENTIONS = f"(SELECT 'mention:' || source_uri || ':' || p_id AS id, source_uri AS src_uri, 'entity://' || p_id AS dst_uri, max(confidence) AS confidence FROM {{flat_items}} i JOIN {LAST} b ON b.id = i.batch_id WHERE i.status = 'accepted' AND kind = 'node' GROUP BY source_uri, p_id)"
ONTOLOGY = "(SELECT id AS batch_id, m, CASE WHEN m = 0 THEN 'candidate_ontology' ELSE 'onto_' || m::VARCHAR END AS name, CASE WHEN m = 1 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM (SELECT id, substr(id, 2)::BIGINT % 4 AS m FROM {batches}) z)"
SOME = "(SELECT uri FROM {docs} WHERE doc_id % 3 = 0)"
GONE = "(SELECT DISTINCT source_uri AS uri FROM {batches} WHERE id LIKE '%7')"
OUT = "(SELECT * FROM {edges} WHERE src_uri NOT IN (SELECT uri FROM (SELECT DISTINCT source_uri AS uri FROM {batches} WHERE id LIKE '%7') u) AND dst_uri NOT IN (SELECT uri FROM (SELECT DISTINCT source_uri AS uri FROM {batches} WHERE id LIKE '%7') u))"


def edits(t: Tables):
    return t.edits.select("item_id", "batch_id", "seq", "status", F.create_map(F.lit("label"), "new_label").alias("payload"), "review_note")


def new_evidence(t: Tables):
    return r.commit_evidence(t.items, t.full_batches, t.evidence)


def some(t: Tables):
    return t.docs.filter("doc_id % 3 = 0").select("uri")


def gone(t: Tables):
    return t.batches.filter("id like '%7'").select(F.col("source_uri").alias("uri")).distinct()


def sem(t: Tables):
    """Documents as the archive has them: batches' sources."""
    d = t.batches.groupBy(F.col("source_uri").alias("uri")).agg(F.min("created_at").alias("created_at"))
    none = F.lit(None).cast("timestamp")
    return d.select("uri", F.lit("active").alias("status"), F.sha2("uri", 256).alias("content_hash"), F.element_at(F.split("uri", "/"), -1).alias("filename"), "created_at", none.alias("last_seen_at"), none.alias("deleted_at"))


def chunks(t: Tables):
    return t.flat_items.join(t.batches.select(F.col("id").alias("batch_id"), F.col("source_uri").alias("document_uri")), "batch_id").select("id", "document_uri", F.col("seq").cast("int").alias("chunk_index"), F.col("p_label").alias("text"))


CHUNKS = "(SELECT i.id, b.source_uri AS document_uri, cast(i.seq AS int) AS chunk_index, p_label AS text FROM {flat_items} i JOIN {batches} b ON b.id = i.batch_id)"


def links(t: Tables):
    return t.edges.filter("layer = 'L2'").select("id", F.col("src_uri").alias("source_uri"), F.col("dst_uri").alias("target_uri"), "relation", "layer", "owner_scope", "source_file_uri", "visibility", F.lit("x").alias("created_by"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))


def artifacts(t: Tables):
    return sem(t).select(fs.artifact_key(F.col("content_hash"), F.col("filename")).alias("key"), "uri")


def deleted(t: Tables, part: str):
    return lc.delete_source(gone(t), t.nodes, t.edges, t.edges.select("id", F.col("source_file_uri").alias("uri")).filter("uri is not null"), artifacts(t), sem(t), chunks(t), t.evidence)[part]


def committed_edges(t: Tables, *columns: str):
    """These columns of the edges of committed, of tables that aren't kept: of the items only accepted ones are read, and each stored edge is needed once."""
    t = Tables(t.spark, t.sf_dir, keep=False)
    return r.commit_edges(t.full_batches, t.items, t.edges.select("id", "src_uri", "dst_uri", "relation", *columns), shared_folder(t.spark))


def committed(t: Tables, part: str):
    return r.commit_batch(t.full_batches, t.items, t.nodes, t.edges, t.evidence, links(t), F.lit("2024-01-01").cast("timestamp"))[part]


def orphans_by_degrees(t: Tables):
    """Degrees of the whole graph, then the edges of some suppliers taken away."""
    root = shared_folder(t.spark)
    dg.write_degrees(t.nodes, t.edges, root, "0" * 12)
    removed = t.edges.filter("startswith(src_uri, 'entity://organization_') and src_uri like '%3'")
    touched = dg.change_degrees(root, "0" * 12, f"{1:012d}", t.edges.limit(0), removed)
    return dg.touched_orphans(touched, root)


def named_by_batch(t: Tables):
    """Items whose labels and descriptions differ between batches."""
    label = F.concat(F.lit("Part "), "payload.id", F.lit(" in "), "batch_id")
    return t.items.withColumn("payload", F.col("payload").withField("label", label).withField("description", F.col("id")))


def ontologies(t: Tables):
    """Each batch proposes an ontology: whole, without relations, without concepts, or none."""
    m = F.substring("id", 2, 20).cast("long") % 4
    concepts = F.expr("array(named_struct('type', 'Product', 'label', 'A part', 'description', ''), named_struct('type', 'Order', 'label', '', 'description', ''), named_struct('type', 'PRODUCT', 'label', 'again', 'description', ''), named_struct('type', '', 'label', '', 'description', ''))")
    relations = F.expr("array(named_struct('relation', 'SUPPLIES', 'source', 'Order', 'target', 'Product', 'description', cast(NULL AS string)))")
    p = t.batches.select(F.col("id").alias("source_uri"), F.when(m > 0, F.concat(F.lit("onto_"), m.cast("string"))).alias("name"), F.when(~m.isin(2, 3), concepts).alias("concepts"), F.when(~m.isin(1, 3), relations).alias("relations"), F.when(m == 1, 0.5).alias("confidence"))
    return r.create_ontologies(t.batches.withColumn("source_uri", F.col("id")), p)


def flagship_tables(t: Tables):
    docs = t.docs.filter("status = 'active'").select("uri", "text")
    none = lambda d: d.limit(0)
    return lc.ingest(docs, "importer", F.lit("2024-01-01").cast("timestamp"), none(t.nodes), none(t.edges), none(t.evidence), none(links(t)))


def flagship(t: Tables):
    out = flagship_tables(t)
    return lc.dashboard(out["batches"], out["items"], out["evidence"])


QUERIES = {
    "create_batches": (
        lambda t: r.create_batches(t.full_batches.select("source_uri", "requested_by", "template_ids", "created_at").dropDuplicates(["source_uri"]), t.flat_items.filter("kind = 'node'").join(t.batches.select(F.col("id").alias("batch_id"), "source_uri"), "batch_id").select("source_uri", F.col("p_id").alias("id"), F.col("p_label").alias("label"), F.col("p_type").alias("type"), F.col("p_description").alias("description"), "confidence"), t.flat_items.filter("kind = 'edge'").join(t.batches.select(F.col("id").alias("batch_id"), "source_uri"), "batch_id").select("source_uri", F.col("p_source").alias("source"), F.col("p_target").alias("target"), F.col("p_relation").alias("relation"), F.col("p_evidence").alias("evidence"), "confidence"))[1].groupBy("kind", "status", F.col("payload.id").alias("node"), F.col("payload.source").alias("source"), F.col("payload.target").alias("target")).agg(F.count("*").alias("n")),
        "SELECT kind, 'candidate' AS status, CASE WHEN kind = 'node' THEN p_id END AS node, CASE WHEN kind = 'edge' THEN p_source END AS source, CASE WHEN kind = 'edge' THEN p_target END AS target, count(*) AS n FROM {flat_items} GROUP BY 1, 3, 4, 5",
    ),
    "to_candidate_entity": (
        lambda t: r.to_candidate_entity(t.entities.select("uri", "chunk_index", "pos", F.lit("").alias("id"), F.when(F.col("pos") % 2 == 0, F.col("label")).alias("label"), F.when(F.col("pos") % 3 == 0, F.lit("Named It")).alias("name"), F.lit("").alias("type"), F.lit(None).cast("string").alias("description"), "confidence")).select("uri", "chunk_index", "pos", "id", "label", "type", "description", "confidence"),
        "SELECT uri, chunk_index, pos, replace(lower(trim(l)), ' ', '_') AS id, l AS label, 'Concept' AS type, '' AS description, coalesce(confidence, 0.8) AS confidence FROM (SELECT *, CASE WHEN pos % 2 = 0 THEN label WHEN pos % 3 = 0 THEN 'Named It' ELSE 'Unknown' END AS l FROM {entities}) a",
    ),
    "to_candidate_relation": (
        lambda t: r.to_candidate_relation(t.relations.select("uri", "chunk_index", "pos", F.lit("").alias("source"), F.col("source").alias("from"), F.when(F.col("pos") % 2 == 0, F.col("target")).alias("target"), F.lit("other").alias("to"), F.lit(None).cast("string").alias("relation"), F.when(F.col("pos") % 3 == 0, "T").alias("type"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("evidence"))).select("uri", "chunk_index", "pos", "source", "target", "relation", "confidence", "evidence"),
        "SELECT uri, chunk_index, pos, source, CASE WHEN pos % 2 = 0 THEN target ELSE 'other' END AS target, CASE WHEN pos % 3 = 0 THEN 'T' ELSE 'RELATES_TO' END AS relation, 0.8::DOUBLE AS confidence, '' AS evidence FROM {relations}",
    ),
    "graph_item_id": (lambda t: r.with_graph_id(t.items).select("id", "batch_id", "graph_item_id"), f"SELECT {G} FROM {{graph_items}}"),
    "items_to_nodes": (lambda t: r.items_to_nodes(t.items.filter("status = 'accepted'")).select("uri", "id", "label", "layer", "confidence"), "SELECT 'entity://' || p_id AS uri, p_id AS id, p_label AS label, 'L2' AS layer, confidence FROM {flat_items} WHERE kind = 'node' AND status = 'accepted'"),
    "items_to_edges": (
        lambda t: r.items_to_edges(t.items.filter("status = 'accepted'"), t.batches)[0].select("id", "src_uri", "dst_uri", "owner_scope", "visibility", "confidence"),
        "SELECT graph_item_id AS id, 'entity://' || p_source AS src_uri, 'entity://' || p_target AS dst_uri, requested_by AS owner_scope, 'team' AS visibility, confidence FROM {graph_items} i JOIN {batches} b ON b.id = batch_id WHERE kind = 'edge' AND i.status = 'accepted' AND p_source <> ''",
    ),
    "items_to_edges_warnings": (lambda t: r.items_to_edges(t.items, t.batches)[1], "SELECT id, batch_id, 'edge without source or target' AS warning FROM {flat_items} WHERE kind = 'edge' AND p_source = ''"),
    "apply_edits": (lambda t: r.apply_edits(t.items, edits(t), t.batches)[0].select("id", "batch_id", "status", F.col("payload.label").alias("p_label")), f"SELECT * FROM {EDITED} e"),
    "apply_edits_errors": (lambda t: r.apply_edits(t.items, edits(t), t.batches)[1].select("item_id", "error"), "SELECT item_id, 'batch is committed' AS error FROM {edits} WHERE batch_id IN (SELECT id FROM {batches} WHERE status = 'committed')"),
    "payload_merge": (
        lambda t: t.flat_items.withColumn("m", r.payload_merge(F.create_map(F.lit("id"), "p_id", F.lit("label"), "p_label"), F.create_map(F.lit("label"), "p_relation"))).select("id", F.col("m")["id"].alias("new_id"), F.col("m")["label"].alias("new_label")),
        "SELECT id, p_id AS new_id, p_relation AS new_label FROM {flat_items}",
    ),
    "bulk_accept": (
        lambda t: r.bulk_review(t.items, t.batches.filter("id like '%1' or id like '%3' or id like '%0'"), "accepted")[0].select("id", "batch_id", "status"),
        "SELECT i.id, batch_id, CASE WHEN i.status = 'candidate' AND b.status <> 'committed' AND (b.id LIKE '%1' OR b.id LIKE '%3') THEN 'accepted' ELSE i.status END AS status FROM {flat_items} i JOIN {batches} b ON b.id = batch_id",
    ),
    "bulk_reject": (
        lambda t: r.bulk_review(t.items, t.batches.filter("id like '%1' or id like '%0'"), "rejected")[1],
        "SELECT b.id AS batch_id, count(*) FILTER (WHERE i.status = 'candidate' AND b.status <> 'committed') AS updated, count(i.id) - count(*) FILTER (WHERE i.status = 'candidate' AND b.status <> 'committed') AS skipped, CASE WHEN any_value(b.status) = 'committed' THEN 'batch is committed' END AS error FROM {batches} b LEFT JOIN {flat_items} i ON b.id = batch_id WHERE b.id LIKE '%1' OR b.id LIKE '%0' GROUP BY b.id",
    ),
    "preview_changes": (
        lambda t: r.preview_changes(t.items, t.evidence),
        "SELECT batch_id, id AS item_id, graph_item_id, CASE WHEN graph_item_id IN (SELECT graph_item_id FROM {evidence}) THEN 'append_evidence' ELSE 'create_' || kind END AS action FROM {graph_items} WHERE status = 'accepted'",
    ),
    "preview_summary": (
        lambda t: r.preview_summary(t.items, t.batches),
        "SELECT b.id AS batch_id, count(i.id) AS n_items, count(*) FILTER (WHERE i.status = 'accepted') AS accepted, count(*) FILTER (WHERE i.status = 'rejected') AS rejected, count(*) FILTER (WHERE i.status = 'committed') AS committed FROM {batches} b LEFT JOIN {flat_items} i ON batch_id = b.id GROUP BY b.id",
    ),
    "commit_evidence": (lambda t: new_evidence(t).select("item_id", "graph_item_id", "batch_id", "source_uri", "template_id", "evidence_text", "confidence", "status"), f"SELECT id AS item_id, graph_item_id, batch_id, source_uri, template_id, p_evidence AS evidence_text, confidence, 'active' AS status FROM {NEW} n"),
    "append_evidence": (
        lambda t: r.append_evidence(t.evidence.select("graph_item_id", "batch_id"), r.with_graph_id(t.items.filter("status = 'accepted'"))),
        "SELECT graph_item_id, batch_id FROM {evidence} UNION ALL SELECT DISTINCT graph_item_id, batch_id FROM {graph_items} g WHERE status = 'accepted' AND NOT EXISTS (SELECT 1 FROM {evidence} e WHERE e.graph_item_id = g.graph_item_id AND e.batch_id = g.batch_id)",
    ),
    "mention_edges": (
        lambda t: r.mention_edges(t.items, t.batches).select("id", "src_uri", "dst_uri", "relation", "layer", "confidence"),
        "SELECT 'mention:' || source_uri || ':' || p_id AS id, source_uri AS src_uri, 'entity://' || p_id AS dst_uri, 'MENTIONS' AS relation, 'L1' AS layer, max(confidence) AS confidence FROM {flat_items} i JOIN {batches} b ON b.id = batch_id WHERE i.status = 'accepted' AND kind = 'node' GROUP BY source_uri, p_id",
    ),
    "commit_links": (
        lambda t: r.commit_links(new_evidence(t), t.items, t.batches).select("source_uri", "target_uri", "relation", "layer", "owner_scope", "created_by"),
        f"SELECT 'entity://' || p_source AS source_uri, 'entity://' || p_target AS target_uri, p_relation AS relation, 'L2' AS layer, requested_by AS owner_scope, requested_by AS created_by FROM {NEW} n WHERE kind = 'edge'",
    ),
    "commit_summary": (
        lambda t: r.commit_summary(t.items, t.batches, new_evidence(t)),
        f"SELECT b.id AS batch_id, coalesce(e.c, 0) AS committed, coalesce(n.n, 0) - coalesce(e.c, 0) AS skipped, coalesce(e.c, 0) AS evidence_created FROM {{batches}} b LEFT JOIN (SELECT batch_id, count(*) AS n FROM {{flat_items}} GROUP BY 1) n ON n.batch_id = b.id LEFT JOIN (SELECT batch_id, count(*) AS c FROM {NEW} x GROUP BY 1) e ON e.batch_id = b.id",
    ),
    "describe_batch": (
        lambda t: r.describe_batch(t.batches, t.items).select("id", "status", F.size(F.coalesce("items", F.array())).cast("long").alias("n"), F.try_element_at("items.id", F.lit(1)).alias("first_item")),
        "SELECT b.id, any_value(b.status) AS status, count(i.id) AS n, min_by(i.id, {'seq': i.seq, 'id': i.id}) AS first_item FROM {batches} b LEFT JOIN {flat_items} i ON i.batch_id = b.id GROUP BY b.id",
    ),
    "commit_batch_nodes": (
        lambda t: committed(t, "nodes").select("uri", "id", "label", "layer"),
        """WITH fresh AS (SELECT 'entity://' || p_id AS uri, p_id AS id, any_value(p_label) AS label, 'L2' AS layer FROM {flat_items} WHERE kind = 'node' AND status = 'accepted' GROUP BY p_id
  UNION ALL SELECT DISTINCT source_uri, source_uri, split_part(source_uri, '/', -1), 'L1' FROM {batches}),
have AS (SELECT * FROM fresh UNION ALL SELECT uri, id, label, layer FROM {nodes} WHERE uri NOT IN (SELECT uri FROM fresh)),
ends AS (SELECT DISTINCT unnest(['entity://' || p_source, 'entity://' || p_target]) AS uri FROM {flat_items} WHERE kind = 'edge' AND status = 'accepted' AND p_source <> '')
SELECT * FROM have UNION ALL SELECT uri, substr(uri, 10), substr(uri, 10), 'L2' FROM ends WHERE uri NOT IN (SELECT uri FROM have)""",
    ),
    "commit_batch_labels": (
        lambda t: r.commit_batch(t.full_batches, named_by_batch(t), t.nodes, t.edges, t.evidence, links(t), F.lit("2024-01-01").cast("timestamp"))["nodes"].filter("type = 'Product' and layer = 'L2'").select("uri", "label", "summary"),
        """WITH item AS (SELECT 'entity://' || p_id AS uri, 'Part ' || p_id || ' in ' || batch_id AS label, i.id || '' AS summary, row_number() OVER (PARTITION BY p_id ORDER BY b.created_at DESC, batch_id DESC, seq DESC, i.id DESC) AS rn
  FROM {flat_items} i JOIN {batches} b ON b.id = batch_id WHERE kind = 'node' AND i.status = 'accepted')
SELECT uri, label, summary FROM item WHERE rn = 1 UNION ALL SELECT uri, label, summary FROM {nodes} WHERE type = 'Product' AND layer = 'L2' AND uri NOT IN (SELECT uri FROM item)""",
    ),
    "commit_batch_edge_sources": (
        lambda t: committed_edges(t, "source_file_uri", "owner_scope", "confidence").filter("relation = 'SUPPLIES'").select("id", "source_file_uri", "owner_scope", "confidence"),
        """WITH item AS (SELECT graph_item_id AS id, source_uri AS source_file_uri, requested_by AS owner_scope, confidence, row_number() OVER (PARTITION BY graph_item_id ORDER BY b.created_at DESC, batch_id DESC, seq DESC, i.id DESC) AS rn
  FROM {graph_items} i JOIN {batches} b ON b.id = batch_id WHERE kind = 'edge' AND i.status = 'accepted' AND p_source <> '')
SELECT id, source_file_uri, owner_scope, confidence FROM item WHERE rn = 1 UNION ALL SELECT id, source_file_uri, owner_scope, confidence FROM {edges} WHERE relation = 'SUPPLIES' AND id NOT IN (SELECT id FROM item)""",
    ),
    "commit_batch_edges": (
        lambda t: committed_edges(t).select("id", "src_uri", "dst_uri", "relation"),
        f"""WITH fresh AS (SELECT DISTINCT graph_item_id AS id, 'entity://' || p_source AS src_uri, 'entity://' || p_target AS dst_uri, p_relation AS relation FROM {{graph_items}} WHERE kind = 'edge' AND status = 'accepted' AND p_source <> ''
  UNION ALL SELECT id, src_uri, dst_uri, 'MENTIONS' FROM {MENTIONS} m)
SELECT * FROM fresh UNION ALL SELECT id, src_uri, dst_uri, relation FROM {{edges}} e WHERE NOT (relation = 'MENTIONS' AND src_uri IN (SELECT source_uri FROM {{batches}})) AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.id = e.id AND f.src_uri = e.src_uri AND f.dst_uri = e.dst_uri)""",
    ),
    "commit_batch_evidence": (lambda t: committed(t, "evidence").select("graph_item_id", "batch_id", "status"), f"SELECT graph_item_id, batch_id, status FROM {{evidence}} UNION ALL SELECT graph_item_id, batch_id, 'active' FROM {NEW} n"),
    "commit_batch_links": (
        lambda t: committed(t, "links").select("source_uri", "target_uri", "relation", "layer"),
        f"SELECT src_uri AS source_uri, dst_uri AS target_uri, relation, layer FROM {{edges}} WHERE layer = 'L2' UNION ALL SELECT 'entity://' || p_source, 'entity://' || p_target, p_relation, 'L2' FROM {NEW} n WHERE kind = 'edge'",
    ),
    "commit_batch_warnings": (lambda t: committed(t, "warnings"), "SELECT id, batch_id, 'edge without source or target' AS warning FROM {flat_items} WHERE kind = 'edge' AND status = 'accepted' AND p_source = ''"),
    "commit_batch_items": (lambda t: committed(t, "items").groupBy("status").agg(F.count("*").alias("n")), "SELECT CASE WHEN status = 'accepted' THEN 'committed' ELSE status END AS status, count(*) AS n FROM {flat_items} GROUP BY 1"),
    "dashboard": (
        lambda t: lc.dashboard(t.batches, t.items, t.evidence),
        """SELECT 'batches' AS section, status AS key, count(*) AS value FROM {batches} GROUP BY 2 UNION ALL SELECT 'items', status, count(*) FROM {flat_items} GROUP BY 2 UNION ALL SELECT 'kinds', kind || 's', count(*) FROM {flat_items} GROUP BY 2
UNION ALL SELECT 'evidence', k, v FROM (SELECT unnest(['total', 'stale', 'purged', 'healthy']) AS k, unnest([count(*), count(*) FILTER (WHERE status = 'stale'), count(*) FILTER (WHERE status = 'purged'), count(*) FILTER (WHERE status = 'active')]) AS v FROM {evidence}) x
UNION ALL SELECT 'alert', 'stale_evidence', n FROM (SELECT count(*) AS n FROM {evidence} WHERE status = 'stale') y WHERE n > 0 UNION ALL SELECT 'alert', 'waiting_batches', n FROM (SELECT count(*) AS n FROM {batches} WHERE status IN ('pending', 'reviewing')) z WHERE n > 5""",
    ),
    "batch_item_counts": (
        lambda t: lc.batch_item_counts(t.batches, t.items, status="pending").drop("created_at"),
        "SELECT b.id, source_uri, b.status, count(i.id) AS n_items, count(*) FILTER (WHERE i.status = 'candidate') AS n_candidate, count(*) FILTER (WHERE i.status = 'accepted') AS n_accepted, count(*) FILTER (WHERE i.status = 'rejected') AS n_rejected, count(*) FILTER (WHERE i.status = 'committed') AS n_committed FROM (SELECT * FROM {batches} WHERE status = 'pending' ORDER BY created_at DESC, id DESC LIMIT 50) b LEFT JOIN {flat_items} i ON batch_id = b.id GROUP BY 1, 2, 3",
    ),
    "stale_report": (
        lambda t: lc.stale_report(t.evidence).select("source_uri", "stale", "purged", F.array_join("rows.id", ",").alias("ids")),
        "SELECT source_uri, count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE status = 'purged') AS purged, string_agg(id, ',' ORDER BY id) AS ids FROM {evidence} WHERE status IN ('stale', 'purged') GROUP BY 1",
    ),
    "stale_rows": (
        lambda t: lc.stale_rows(t.evidence.withColumn("source_uri", F.when(~F.col("source_uri").endswith("1"), F.col("source_uri")))),
        "SELECT CASE WHEN source_uri LIKE '%1' THEN 'unknown' ELSE source_uri END AS source_uri, id, graph_item_id, batch_id, status, confidence, substr(coalesce(evidence_text, ''), 1, 200) AS text FROM {evidence} WHERE status IN ('stale', 'purged')",
    ),
    "stale_totals": (
        lambda t: lc.stale_totals(t.evidence),
        f"SELECT count(*) AS stale_total, count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE status = 'purged') AS purged, count(DISTINCT source_uri) AS sources_affected, CASE WHEN count(*) > 0 THEN '{lc.RECOMMEND}' ELSE '{lc.NOTHING}' END AS recommendation FROM {{evidence}} WHERE status IN ('stale', 'purged')",
    ),
    "create_ontologies": (
        lambda t: ontologies(t).select("batch_id", "name", "status", "confidence", F.array_join("concepts.type", ",").alias("concepts"), F.array_join("relations.relation", ",").alias("relations")),
        f"SELECT batch_id, name, 'candidate' AS status, confidence, CASE WHEN m = 2 THEN '' ELSE 'Product,Order' END AS concepts, CASE WHEN m = 1 THEN '' ELSE 'SUPPLIES' END AS relations FROM {ONTOLOGY} o WHERE m < 3",
    ),
    "describe_batch_ontologies": (
        lambda t: r.describe_batch(t.batches, t.items, ontologies(t)).select("id", F.size(F.coalesce("items", F.array())).cast("long").alias("n_items"), F.size(F.coalesce("ontologies", F.array())).cast("long").alias("n_ontologies"), F.try_element_at("ontologies.name", F.lit(1)).alias("name")),
        f"SELECT b.id, count(i.id) AS n_items, CASE WHEN any_value(o.m) < 3 THEN 1 ELSE 0 END AS n_ontologies, CASE WHEN any_value(o.m) < 3 THEN any_value(o.name) END AS name FROM {{batches}} b LEFT JOIN {{flat_items}} i ON i.batch_id = b.id LEFT JOIN {ONTOLOGY} o ON o.batch_id = b.id GROUP BY b.id",
    ),
    "batch_rows": (
        lambda t: r.batch_rows(t.batches, t.items, ontologies(t)).groupBy("batch_id", "part", "of", "status").agg(F.count("id").alias("n"), F.coalesce(F.min("seq"), F.lit(-1)).alias("first")),
        f"""WITH o AS (SELECT * FROM {ONTOLOGY} q WHERE m < 3)
SELECT b.id AS batch_id, x.part, x.of, x.status, count(x.id) AS n, coalesce(min(x.seq), -1) AS first FROM {{batches}} b LEFT JOIN (
  SELECT batch_id, 'item' AS part, NULL AS of, status, id, seq FROM {{flat_items}} UNION ALL SELECT batch_id, 'concept', name, 'candidate', unnest(['Product', 'Order']), unnest([0, 1]) FROM o WHERE m <> 2
  UNION ALL SELECT batch_id, 'relation', name, 'candidate', 'SUPPLIES', 0 FROM o WHERE m <> 1) x ON x.batch_id = b.id GROUP BY ALL""",
    ),
    "list_evidence": (lambda t: t.evidence.filter("source_uri like '%0' and graph_item_id like 'node%'").orderBy("created_at", "id").select("id", "status"), "SELECT id, status FROM {evidence} WHERE source_uri LIKE '%0' AND graph_item_id LIKE 'node%'"),
    "distinct_sources": (lambda t: lc.distinct_sources(t.evidence), "SELECT DISTINCT source_uri AS uri FROM {evidence}"),
    "inventory_diff": (
        lambda t: lc.inventory_diff(t.docs, some(t)),
        f"SELECT uri, false AS all_stale FROM {{docs}} WHERE status = 'active' AND uri LIKE 'cloudreve://%' AND uri NOT IN {SOME}",
    ),
    "mark_source_deleted": (
        lambda t: lc.mark_source_deleted(sem(t), t.evidence, gone(t))[1].groupBy("source_uri", "status").agg(F.count("*").alias("n")),
        f"SELECT source_uri, CASE WHEN source_uri IN {GONE} THEN 'stale' ELSE status END AS status, count(*) AS n FROM {{evidence}} GROUP BY 1, 2",
    ),
    "mark_source_deleted_documents": (lambda t: lc.mark_source_deleted(sem(t), t.evidence, gone(t))[0].select("uri", "status"), f"SELECT DISTINCT source_uri AS uri, CASE WHEN source_uri IN {GONE} THEN 'source_deleted' ELSE 'active' END AS status FROM {{batches}}"),
    "purge": (lambda t: lc.purge(sem(t), chunks(t), t.evidence, gone(t))[2].groupBy("status").agg(F.count("*").alias("n")), f"SELECT CASE WHEN source_uri IN {GONE} THEN 'purged' ELSE status END AS status, count(*) AS n FROM {{evidence}} GROUP BY 1"),
    "purge_chunks": (lambda t: lc.purge(sem(t), chunks(t), t.evidence, gone(t))[1].select("id", "document_uri"), f"SELECT id, document_uri FROM {CHUNKS} c WHERE document_uri NOT IN {GONE}"),
    "purge_all": (lambda t: lc.purge(sem(t), chunks(t), t.evidence)[3], "SELECT source_uri AS uri, count(*) AS purged FROM {evidence} WHERE status <> 'purged' GROUP BY 1"),
    "delete_source_nodes": (
        lambda t: deleted(t, "nodes").select("uri"),
        f"SELECT uri FROM {{nodes}} WHERE uri NOT IN {GONE} AND (uri NOT LIKE 'entity://%' OR uri IN (SELECT unnest([src_uri, dst_uri]) FROM {OUT} o))",
    ),
    "orphans_by_degrees": (
        orphans_by_degrees,
        f"WITH e AS (SELECT *, starts_with(src_uri, 'entity://organization_') AND src_uri LIKE '%3' AS removed FROM {{edges}}) SELECT DISTINCT uri FROM (SELECT unnest([src_uri, dst_uri]) AS uri FROM e WHERE removed) x WHERE uri LIKE 'entity://%' AND uri NOT IN (SELECT unnest([src_uri, dst_uri]) FROM e WHERE NOT removed)",
    ),
    "prefix_digests": (lambda t: lc.prefix_digests(t.docs.select("uri")).select("prefix", "n"), "SELECT regexp_replace(uri, '[^/]*$', '') AS prefix, count(*) AS n FROM {docs} GROUP BY 1"),
    "delete_source_edges": (lambda t: deleted(t, "edges").select("id", "src_uri", "dst_uri"), f"SELECT id, src_uri, dst_uri FROM {OUT} o"),
    "delete_source_vectors": (lambda t: deleted(t, "vectors").select("id", "uri"), f"SELECT id, source_file_uri AS uri FROM {{edges}} WHERE source_file_uri IS NOT NULL AND source_file_uri NOT IN {GONE}"),
    "delete_source_artifacts": (lambda t: deleted(t, "artifacts").select("key"), f"SELECT DISTINCT 'parsed-text/' || substr(sha256(source_uri), 1, 16) || '/' || split_part(source_uri, '/', -1) || '.txt' AS key FROM {{batches}} WHERE source_uri NOT IN {GONE}"),
    "sync_sources": (
        lambda t: lc.sync_sources(sem(t).join(gone(t), "uri", "left_anti"), nodes=t.nodes, edges=t.edges, vectors=t.edges.select("id", F.col("source_file_uri").alias("uri")), artifacts=artifacts(t), documents=sem(t), chunks=chunks(t), evidence=t.evidence)["documents"].select("uri"),
        f"SELECT DISTINCT source_uri AS uri FROM {{batches}} WHERE source_uri NOT IN {GONE}",
    ),
    "document_status": (lambda t: lc.document_status(t.docs, some(t).union(t.spark.range(1).select(F.lit("none"))))[["uri", "status"]], f"SELECT uri, status FROM {{docs}} WHERE uri IN {SOME} UNION ALL SELECT 'none', NULL"),
    "ingest": (
        flagship,
        """WITH w AS (SELECT uri, generate_subscripts(l, 1) AS pos, unnest(l) AS tag FROM (SELECT uri, regexp_split_to_array(trim(lower(text)), '\\s+') AS l FROM {docs} WHERE status = 'active') a), c AS (SELECT uri, tag, count(*) AS n, min(pos) AS pos FROM w WHERE length(tag) >= 5 GROUP BY 1, 2),
k AS (SELECT uri, tag FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY n DESC, pos) AS rank FROM c) x WHERE rank <= 8)
SELECT 'batches' AS section, 'committed' AS key, count(*) AS value FROM {docs} WHERE status = 'active' UNION ALL SELECT 'items', 'committed', count(*) FROM k UNION ALL SELECT 'kinds', 'nodes', count(*) FROM k
UNION ALL SELECT 'evidence', unnest(['total', 'stale', 'purged', 'healthy']), unnest([n, 0, 0, n]) FROM (SELECT count(DISTINCT tag) AS n FROM k) y""",
    ),
    "list_documents": (lambda t: t.docs.orderBy(F.desc("created_at"), "uri").limit(100).select("uri", "created_at"), "SELECT uri, created_at FROM {docs} ORDER BY created_at DESC, uri LIMIT 100"),
    "get_document": (lambda t: t.docs.filter(F.col("uri").endswith("/notes_2.PDF")).select("uri", "n_chars"), "SELECT uri, n_chars FROM {docs} WHERE uri LIKE '%/notes\\_2.PDF' ESCAPE '\\'"),
    "list_chunks": (lambda t: chunks(t).filter("document_uri like '%/1'").orderBy("chunk_index", "id").select("id", "chunk_index", "text"), f"SELECT id, chunk_index, text FROM {CHUNKS} c WHERE document_uri LIKE '%/1'"),
    "list_links": (lambda t: links(t).orderBy("created_at", "id").select("id", "relation"), "SELECT id, relation FROM {edges} WHERE layer = 'L2'"),
    "filter_documents": (lambda t: g.matching(t.docs, "Weekly_Report", ["uri", "filename", "summary", "status"]).select("uri"), "SELECT uri FROM {docs} WHERE contains(lower(concat_ws(' ', uri, filename, summary, status)), 'weekly_report')"),
    "upsert_documents": (
        lambda t: st.upsert_documents(t.docs.select("uri", "summary", "created_at"), t.docs.filter("doc_id % 3 = 0").select("uri", F.lit("new").alias("summary"), F.lit(1).cast("long").alias("created_at"), F.lit(1).alias("seq"))),
        "SELECT uri, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE summary END AS summary, created_at FROM {docs}",
    ),
    "upsert_links": (
        lambda t: st.upsert_links(links(t).select("id", "relation", "layer"), links(t).filter("relation = 'PLACED'").select("id", F.lit("BOUGHT").alias("relation"), "layer")),
        "SELECT id, CASE WHEN relation = 'PLACED' THEN 'BOUGHT' ELSE relation END AS relation, layer FROM {edges} WHERE layer = 'L2'",
    ),
    "replace_chunks": (
        lambda t: st.replace_by(chunks(t), gone(t).select(F.lit("new").alias("id"), F.col("uri").alias("document_uri"), F.lit(0).alias("chunk_index"), F.lit("t").alias("text")), "document_uri").select("id", "document_uri"),
        f"SELECT id, document_uri FROM {CHUNKS} c WHERE document_uri NOT IN {GONE} UNION ALL SELECT 'new', uri FROM {GONE} g",
    ),
    "upsert_vectors": (
        lambda t: st.replace_by(t.vectors, t.vectors.filter("chunk_id % 2 = 0 and uri in ('1', '2')").withColumn("chunk_id", F.col("chunk_id") + 1000000), "uri").select("chunk_id", "uri"),
        "SELECT chunk_id, uri FROM {vectors} WHERE uri NOT IN (SELECT uri FROM {vectors} WHERE chunk_id % 2 = 0 AND uri IN ('1', '2')) UNION ALL SELECT chunk_id + 1000000, uri FROM {vectors} WHERE chunk_id % 2 = 0 AND uri IN ('1', '2')",
    ),
    "register_source_active": (
        lambda t: st.register_source_active(sem(t).filter("uri like '%1' or uri like '%2'").withColumn("status", F.lit("purged")), t.batches.filter("source_uri like '%2' or source_uri like '%3'")).select("uri", "status"),
        "SELECT DISTINCT source_uri AS uri, CASE WHEN source_uri LIKE '%1' THEN 'purged' ELSE 'active' END AS status FROM {batches} WHERE source_uri LIKE '%1' OR source_uri LIKE '%2' OR source_uri LIKE '%3'",
    ),
    "write_artifacts": (lambda t: fs.write_artifacts(fs.derive_file_meta(t.docs.select("uri", "text"))).select("key", "content_hash"), "SELECT 'parsed-text/' || substr(sha256(text), 1, 16) || '/' || filename || '.txt' AS key, sha256(text) AS content_hash FROM {docs}"),
}
