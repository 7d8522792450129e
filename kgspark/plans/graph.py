"""Queries over nodes and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from .domain import Tables

N = "uri, id, label, layer"
BUSIEST = "(SELECT uri FROM (SELECT dst_uri AS uri, count(*) AS n FROM {edges} WHERE dst_uri LIKE 'entity://part%' GROUP BY dst_uri) q ORDER BY n DESC, uri LIMIT 1)"
BOTH = "(SELECT src_uri AS uri, dst_uri AS other_uri, 'out' AS direction, * FROM {edges} UNION ALL SELECT dst_uri, src_uri, 'in', * FROM {edges} WHERE src_uri <> dst_uri)"
TYPED = """(SELECT *, CASE WHEN uri NOT LIKE 'entity://%' THEN 'document' WHEN coalesce(type, '') <> '' THEN lower(type)
  WHEN lower(split_part(id, '_', 1)) IN ('api','concept','database','event','institution','location','method','object','organization','person','product','researcher','system','technology','tool') AND id LIKE '%\\_%' ESCAPE '\\'
  THEN lower(split_part(id, '_', 1)) ELSE 'entity' END AS node_type FROM {nodes})"""


def busiest(t: Tables):
    return t.edges.filter(F.startswith("dst_uri", F.lit("entity://part"))).groupBy(F.col("dst_uri").alias("uri")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "uri").limit(1).select("uri")


def seeds(t: Tables):
    return t.nodes.filter("uri like 'entity://customer%' and id like '%7'").select("uri")


SEEDS = "(SELECT uri FROM {nodes} WHERE uri LIKE 'entity://customer%' AND id LIKE '%7')"


def new_nodes(t: Tables):
    return t.spark.sql("SELECT uri, id, label || ' v' || cast(k AS string) AS label, summary, type, layer, confidence, accessible, cast(k AS bigint) AS seq FROM {nodes}, (SELECT explode(sequence(1, 2)) AS k) s WHERE id LIKE '%3'", nodes=t.nodes)


def new_edges(t: Tables):
    return t.spark.sql("SELECT id, src_uri, CASE WHEN layer = 'L3' THEN dst_uri || '_new' ELSE dst_uri END AS dst_uri, relation, 'L9' AS layer, owner_scope, source_file_uri, visibility, evidence, confidence, cast(1 AS bigint) AS seq FROM {edges} WHERE layer IN ('L2', 'L3')", edges=t.edges)


NEW_EDGES = "(SELECT id, src_uri, CASE WHEN layer = 'L3' THEN dst_uri || '_new' ELSE dst_uri END AS dst_uri, relation, 'L9' AS layer FROM {edges} WHERE layer IN ('L2', 'L3'))"


def _filter(t: Tables, part: str):
    return g.filter_graph(t.nodes, t.edges, query="blue bolt", types=["product", "organization"], relations=["SUPPLIES", "MENTIONS"])[part]


FILTER = f"""WITH typed AS {TYPED}, keep AS (SELECT * FROM typed WHERE node_type IN ('product', 'organization')),
hits AS (SELECT uri FROM keep WHERE contains(lower(concat_ws(' ', id, uri, label, summary, type)), 'blue bolt')),
e0 AS (SELECT * FROM {{edges}} WHERE relation IN ('SUPPLIES', 'MENTIONS') AND src_uri IN (SELECT uri FROM keep) AND dst_uri IN (SELECT uri FROM keep)),
e AS (SELECT * FROM e0 WHERE src_uri IN (SELECT uri FROM hits) OR dst_uri IN (SELECT uri FROM hits) OR contains(lower(concat_ws(' ', id, relation, src_uri, dst_uri, source_file_uri, owner_scope, visibility)), 'blue bolt')),
n AS (SELECT * FROM keep WHERE uri IN (SELECT src_uri FROM e UNION SELECT dst_uri FROM e UNION SELECT uri FROM hits))"""

QUERIES = {
    "neighborhood": (
        lambda t: g.neighborhood(busiest(t), t.edges, t.nodes, ["L1", "L2"])[0].select("seed", "id", "src_uri", "dst_uri", "relation", "layer", "direction"),
        f"SELECT b.uri AS seed, id, src_uri, dst_uri, relation, layer, direction FROM {BOTH} b JOIN {BUSIEST} s ON s.uri = b.uri WHERE layer IN ('L1', 'L2')",
    ),
    "neighborhood_nodes": (
        lambda t: g.neighborhood(seeds(t), t.edges, t.nodes)[1].select("seed", "uri", "id", "label", "layer"),
        f"SELECT DISTINCT p.seed, n.{N.replace(', ', ', n.')} FROM (SELECT b.uri AS seed, unnest([b.uri, other_uri]) AS uri FROM {BOTH} b JOIN {SEEDS} s ON s.uri = b.uri) p JOIN {{nodes}} n ON n.uri = p.uri",
    ),
    "full_graph": (
        lambda t: g.full_graph(t.nodes, t.edges, 300)[0].select("uri", "id", "label", "layer"),
        f"WITH e AS (SELECT * FROM {{edges}} ORDER BY id, src_uri, dst_uri LIMIT 300) SELECT {N} FROM (SELECT * FROM {{nodes}} ORDER BY uri LIMIT 300) a UNION SELECT {N} FROM {{nodes}} WHERE uri IN (SELECT src_uri FROM e UNION SELECT dst_uri FROM e)",
    ),
    "full_graph_edges": (lambda t: g.full_graph(t.nodes, t.edges, 300)[1].select("id", "src_uri", "dst_uri", "relation"), "SELECT id, src_uri, dst_uri, relation FROM {edges} ORDER BY id, src_uri, dst_uri LIMIT 300"),
    "document_subgraph": (
        lambda t: g.document_subgraph(t.nodes.filter("layer = 'L1' and id like '%5'").select("uri"), t.edges).select("document", "id", "src_uri", "dst_uri", "relation"),
        "WITH d AS (SELECT uri FROM {nodes} WHERE layer = 'L1' AND id LIKE '%5') SELECT uri AS document, id, src_uri, dst_uri, relation FROM {edges} JOIN d ON uri = src_uri UNION SELECT uri, id, src_uri, dst_uri, relation FROM {edges} JOIN d ON uri = dst_uri",
    ),
    "orphan_entities": (
        lambda t: g.orphan_entities(t.nodes, t.edges.filter("relation = 'MENTIONS' and confidence > 0.5 and source_file_uri like '%7'")).select("uri", "id"),
        "SELECT uri, id FROM {nodes} WHERE uri LIKE 'entity://%' AND uri NOT IN (SELECT unnest([src_uri, dst_uri]) FROM {edges} WHERE relation = 'MENTIONS' AND source_file_uri LIKE '%7')",
    ),
    "upsert_nodes": (
        lambda t: g.upsert_nodes(t.nodes, new_nodes(t)).select("uri", "id", "label", "type", "confidence"),
        "SELECT uri, id, CASE WHEN id LIKE '%3' THEN label || ' v2' ELSE label END AS label, type, confidence FROM {nodes}",
    ),
    "upsert_edges": (
        lambda t: g.upsert_edges(t.nodes, t.edges, new_edges(t))[1].select("id", "src_uri", "dst_uri", "relation", "layer"),
        f"WITH n AS {NEW_EDGES} SELECT * FROM n UNION ALL SELECT id, src_uri, dst_uri, relation, layer FROM {{edges}} e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = e.id AND n.src_uri = e.src_uri AND n.dst_uri = e.dst_uri)",
    ),
    "stub_nodes": (
        lambda t: g.stub_nodes(t.nodes, new_edges(t)).filter("uri like '%_new'").select("uri", "id", "label", "layer"),
        f"SELECT DISTINCT dst_uri AS uri, substr(dst_uri, 10) AS id, substr(dst_uri, 10) AS label, 'L2' AS layer FROM {NEW_EDGES} n WHERE dst_uri LIKE '%\\_new' ESCAPE '\\'",
    ),
    "search_nodes": (lambda t: g.search_nodes(t.nodes, "Blue Bolt").select("uri", "label"), "SELECT uri, label FROM {nodes} WHERE contains(lower(label), 'blue bolt') ORDER BY label, uri LIMIT 20"),
    "list_file_nodes": (lambda t: g.list_file_nodes(t.nodes).select("uri", "label"), "SELECT uri, label FROM {nodes} WHERE uri NOT LIKE 'entity://%' ORDER BY label, uri LIMIT 100"),
    "list_entity_nodes": (lambda t: g.list_entity_nodes(t.nodes, "supplier").select("uri", "label"), "SELECT uri, label FROM {nodes} WHERE uri LIKE 'entity://%' AND contains(lower(label), 'supplier') ORDER BY label, uri LIMIT 100"),
    "node_type": (lambda t: g.node_type(t.nodes).select("uri", "node_type"), f"SELECT uri, node_type FROM {TYPED} t"),
    "match_nodes": (lambda t: g.matching(t.nodes, "BUILDING", g.NODE_TEXT).select("uri"), "SELECT uri FROM {nodes} WHERE contains(lower(concat_ws(' ', id, uri, label, summary, type)), 'building')"),
    "match_edges": (lambda t: g.matching(t.edges, "nation_7", g.EDGE_TEXT).select("id"), "SELECT id FROM {edges} WHERE contains(lower(concat_ws(' ', id, relation, src_uri, dst_uri, source_file_uri, owner_scope, visibility)), 'nation_7')"),
    "filter_graph": (lambda t: _filter(t, "nodes").select("uri", "node_type"), f"{FILTER} SELECT uri, node_type FROM n"),
    "filter_graph_edges": (lambda t: _filter(t, "edges").select("id", "src_uri", "dst_uri"), f"{FILTER} SELECT id, src_uri, dst_uri FROM e"),
    "filter_graph_counts": (
        lambda t: _filter(t, "counts"),
        f"{FILTER} SELECT 'nodes' AS kind, (SELECT count(*) FROM n) AS shown, (SELECT count(*) FROM {{nodes}}) - (SELECT count(*) FROM n) AS hidden UNION ALL SELECT 'edges', (SELECT count(*) FROM e), (SELECT count(*) FROM {{edges}}) - (SELECT count(*) FROM e)",
    ),
    "related_edges": (
        lambda t: g.related_edges(seeds(t), t.edges, t.nodes),
        f"SELECT b.uri AS seed, b.id, relation, direction, other_uri, coalesce(n.label, n.id, other_uri) AS other_label FROM {BOTH} b JOIN {SEEDS} s ON s.uri = b.uri LEFT JOIN {{nodes}} n ON n.uri = other_uri",
    ),
    "graph_facets": (lambda t: g.graph_facets(t.nodes, t.edges), f"SELECT DISTINCT 'node_type' AS facet, node_type AS value FROM {TYPED} t UNION SELECT 'relation', relation FROM {{edges}}"),
    "source_docs_from_edges": (lambda t: g.source_docs_from_edges(t.edges), "SELECT source_file_uri AS uri, split_part(source_file_uri, '/', -1) AS filename, count(*) AS edge_count FROM {edges} WHERE source_file_uri <> '' GROUP BY 1"),
    "cluster_graph": (lambda t: g.cluster_graph(t.nodes, t.edges)[0], f"SELECT node_type, count(*) AS n FROM {TYPED} t GROUP BY 1"),
    "cluster_graph_edges": (
        lambda t: g.cluster_graph(t.nodes, t.edges)[1],
        f"WITH y AS {TYPED} SELECT least(a.node_type, b.node_type) AS a, greatest(a.node_type, b.node_type) AS b, count(*) AS n, CASE WHEN count(DISTINCT relation) > 1 THEN count(DISTINCT relation)::VARCHAR || ' relations' ELSE min(relation) END AS relation FROM {{edges}} JOIN y a ON a.uri = src_uri JOIN y b ON b.uri = dst_uri WHERE a.node_type <> b.node_type GROUP BY 1, 2",
    ),
    "clear_mentions": (
        lambda t: g.clear_mentions(t.edges, t.nodes.filter("layer = 'L1' and id like '%5'").select("uri")).select("id", "src_uri", "dst_uri"),
        "SELECT id, src_uri, dst_uri FROM {edges} WHERE NOT (relation = 'MENTIONS' AND src_uri IN (SELECT uri FROM {nodes} WHERE layer = 'L1' AND id LIKE '%5'))",
    ),
    "clear_graph": (lambda t: g.clear_graph(t.nodes, t.edges)[2], "SELECT 'nodes' AS kind, count(*) AS n FROM {nodes} UNION ALL SELECT 'edges', count(*) FROM {edges}"),
}
