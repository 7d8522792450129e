"""Domain tables derived from the given ones. Each is SQL that Spark and DuckDB read alike; {name} stands for a given or derived table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import PAYLOAD
from ..storage import shared_folder, written

DOMAIN = {
    "docs": """
SELECT doc_id, uri, filename, text, n_chars, status, 1704067200 + doc_id * 60 AS created_at, summary,
       CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN 'cloudreve://x/' || filename WHEN doc_id % 6 = 2 THEN 'ftp://x/' || filename ELSE 's3://texts/' || filename END AS parsed_text_key
FROM (SELECT *, kw || '_' || cast(doc_id AS string) || ext AS filename, 'cloudreve://my/' || source || '/' || kw || '_' || cast(doc_id AS string) || ext AS uri FROM (
  SELECT doc_id, source, n_chars, lang AS summary, CASE WHEN doc_id % 11 = 0 THEN 'source_deleted' ELSE 'active' END AS status,
         CASE doc_id % 4 WHEN 0 THEN 'Abstract and methodology. ' WHEN 1 THEN 'Invoice total. ' WHEN 2 THEN 'The schema of a request; hazard. ' ELSE '' END || text AS text,
         CASE doc_id % 7 WHEN 0 THEN 'research_paper' WHEN 1 THEN 'api_spec' WHEN 2 THEN 'notes' WHEN 3 THEN 'meeting' WHEN 4 THEN 'weekly_report' WHEN 5 THEN 'pump_manual' ELSE 'x' END AS kw,
         CASE doc_id % 10 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.PDF' WHEN 3 THEN '.csv' WHEN 4 THEN '.xlsx' WHEN 5 THEN '.png' WHEN 6 THEN '.xyz' WHEN 7 THEN '' WHEN 8 THEN '.log' ELSE '.tar.gz' END AS ext
  FROM {documents}) a) b""",
    "pages_rows": "SELECT 'conv://' || cast(conv_id AS string) AS uri, cast(turn AS int) AS page, CASE WHEN turn % 5 = 4 THEN ' ' ELSE text END AS text FROM {conversations}",
    "nodes": """
SELECT 'entity://customer_' || cast(c_custkey AS string) AS uri, 'customer_' || cast(c_custkey AS string) AS id, c_name AS label, c_mktsegment AS summary, 'Customer' AS type, 'L2' AS layer, cast(0.8 AS double) AS confidence, true AS accessible FROM {customer}
UNION ALL SELECT 'entity://organization_' || cast(s_suppkey AS string), 'organization_' || cast(s_suppkey AS string), s_name, cast(NULL AS string), cast(NULL AS string), 'L2', cast(0.9 AS double), true FROM {supplier}
UNION ALL SELECT 'entity://part_' || cast(p_partkey AS string), 'part_' || cast(p_partkey AS string), p_name, p_type, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'Product' END, 'L2', cast(0.7 AS double), true FROM {part}
UNION ALL SELECT 'entity://nation_' || cast(n_nationkey AS string), 'nation_' || cast(n_nationkey AS string), n_name, '', 'Location', 'L3', cast(1.0 AS double), true FROM {nation}
UNION ALL SELECT 'cloudreve://orders/' || cast(o_orderkey AS string), 'order_' || cast(o_orderkey AS string), 'Order ' || cast(o_orderkey AS string), o_orderpriority, 'document', 'L1', cast(1.0 AS double), true FROM {orders}""",
    "edges": """
SELECT 'mention:cloudreve://orders/' || cast(l_orderkey AS string) || ':part_' || cast(l_partkey AS string) AS id, 'cloudreve://orders/' || cast(l_orderkey AS string) AS src_uri, 'entity://part_' || cast(l_partkey AS string) AS dst_uri, 'MENTIONS' AS relation, 'L1' AS layer, 'team' AS owner_scope, 'cloudreve://orders/' || cast(l_orderkey AS string) AS source_file_uri, 'team' AS visibility, '' AS evidence, cast(0.9 AS double) AS confidence FROM {lineitem} GROUP BY l_orderkey, l_partkey
UNION ALL SELECT 'edge:organization_' || cast(l_suppkey AS string) || ':SUPPLIES:part_' || cast(l_partkey AS string), 'entity://organization_' || cast(l_suppkey AS string), 'entity://part_' || cast(l_partkey AS string), 'SUPPLIES', 'L2', 'team', 'cloudreve://orders/' || cast(min(l_orderkey) AS string), 'team', '', cast(0.8 AS double) FROM {lineitem} GROUP BY l_suppkey, l_partkey
UNION ALL SELECT 'edge:customer_' || cast(o_custkey AS string) || ':PLACED:order_' || cast(o_orderkey AS string), 'entity://customer_' || cast(o_custkey AS string), 'cloudreve://orders/' || cast(o_orderkey AS string), 'PLACED', 'L2', 'user', 'cloudreve://orders/' || cast(o_orderkey AS string), 'team', '', cast(0.8 AS double) FROM {orders}
UNION ALL SELECT 'edge:customer_' || cast(c_custkey AS string) || ':LOCATED_IN:nation_' || cast(c_nationkey AS string), 'entity://customer_' || cast(c_custkey AS string), 'entity://nation_' || cast(c_nationkey AS string), 'LOCATED_IN', 'L3', 'team', cast(NULL AS string), 'team', '', cast(1.0 AS double) FROM {customer}
UNION ALL SELECT 'edge:organization_' || cast(s_suppkey AS string) || ':LOCATED_IN:nation_' || cast(s_nationkey AS string), 'entity://organization_' || cast(s_suppkey AS string), 'entity://nation_' || cast(s_nationkey AS string), 'LOCATED_IN', 'L3', 'team', cast(NULL AS string), 'team', '', cast(1.0 AS double) FROM {supplier}""",
    "batches": """
SELECT 'b' || cast(o_orderkey AS string) AS id, 'cloudreve://orders/' || cast(o_orderkey % 5000 AS string) AS source_uri, 'user_' || cast(o_custkey % 10 AS string) AS requested_by,
       CASE o_orderkey % 10 WHEN 0 THEN 'committed' WHEN 1 THEN 'pending' WHEN 2 THEN 'reviewing' ELSE 'candidate' END AS status, 'general/places' AS template_id, o_orderdate AS created_at, cast(NULL AS timestamp) AS committed_at
FROM {orders}""",
    "flat_items": """
SELECT DISTINCT cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-' || cast(l_partkey AS string) || '-' || cast(l_suppkey AS string) || '-' || cast(cast(l_shipdate AS date) AS string) AS id,
       'b' || cast(l_orderkey AS string) AS batch_id, cast(l_linenumber AS bigint) AS seq, CASE WHEN l_linenumber % 2 = 1 THEN 'node' ELSE 'edge' END AS kind,
       'part_' || cast(l_partkey AS string) AS p_id, 'Part ' || cast(l_partkey AS string) AS p_label, 'Product' AS p_type, '' AS p_description,
       CASE WHEN l_suppkey % 50 = 7 THEN '' ELSE 'organization_' || cast(l_suppkey AS string) END AS p_source, 'part_' || cast(l_partkey AS string) AS p_target, 'SUPPLIES' AS p_relation, l_returnflag || l_linestatus AS p_evidence,
       cast(round(1 - l_discount, 4) AS double) AS confidence, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'candidate' END AS status, cast(NULL AS string) AS review_note
FROM {lineitem}""",
    "graph_items": """
SELECT *, CASE WHEN kind = 'edge' THEN 'edge:' || p_source || ':' || p_relation || ':' || p_target ELSE 'node:' || p_id END AS graph_item_id FROM {flat_items}""",
    "evidence": """
SELECT 'ev-' || g.id AS id, graph_item_id, b.source_uri AS source_uri, batch_id, b.template_id AS template_id, p_evidence AS evidence_text, confidence,
       CASE WHEN seq % 7 = 3 THEN 'purged' WHEN seq % 5 = 0 THEN 'stale' ELSE 'active' END AS status, b.created_at AS created_at
FROM {graph_items} g JOIN {batches} b ON b.id = batch_id WHERE b.status = 'committed'""",
    "edits": "SELECT id AS item_id, batch_id, seq, CASE WHEN seq = 2 THEN 'accepted' ELSE 'rejected' END AS status, cast(NULL AS string) AS review_note, 'edited ' || p_id AS new_label FROM {flat_items} WHERE seq IN (2, 5)",
    "entities": """
SELECT uri, cast(chunk_index AS int) AS chunk_index, cast(pos AS int) AS pos, id, label, type, cast(confidence AS double) AS confidence FROM (
  SELECT 'order://' || cast(l_orderkey AS string) AS uri, l_linenumber AS chunk_index, l_partkey AS pos, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'part_' || cast(l_partkey % 20 AS string) END AS id, 'Part ' || cast(l_partkey % 20 AS string) AS label, 'Product' AS type,
         CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_discount * 10 END AS confidence, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_suppkey, l_shipdate) AS rn FROM {lineitem}) a WHERE rn = 1""",
    "relations": """
SELECT uri, cast(chunk_index AS int) AS chunk_index, cast(pos AS int) AS pos, source, target, relation FROM (
  SELECT 'order://' || cast(l_orderkey AS string) AS uri, l_linenumber AS chunk_index, l_partkey AS pos, 'part_' || cast(l_partkey % 20 AS string) AS source, 'part_' || cast(l_suppkey % 20 AS string) AS target, 'NEAR' AS relation,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_suppkey, l_shipdate) AS rn FROM {lineitem}) a WHERE rn = 1""",
    "segments": "SELECT 'conv://' || cast(conv_id AS string) AS uri, cast(turn AS int) AS chunk_index, CASE WHEN turn = 0 THEN ' ' ELSE text END AS summary, cast((turn * 7 + conv_id) % 10 AS double) / 10 AS confidence FROM {conversations}",
    "questions": "SELECT item_id AS question_id, CASE item_id % 4 WHEN 0 THEN 'What is part 12 of the green order?' WHEN 1 THEN 'customer#000000001 nation' WHEN 2 THEN 'Which supplier, where: supplier#000000002!' ELSE text END AS question, item_id % 2 = 0 AS include_candidates FROM {benchmark}",
    "vectors": "SELECT vec_id AS chunk_id, cast(label AS string) AS uri, embedding AS vector FROM {embeddings}",
    "vector_queries": "SELECT vec_id AS query_id, embedding AS vector FROM {embeddings} WHERE vec_id < 20",
    "stated_queries": "SELECT vec_id AS query_id, embedding AS vector FROM {embeddings} WHERE vec_id % 100 = 0",
}


def with_tables(sql: str) -> str:
    """DuckDB SQL: derived tables in front, given ones by name."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in DOMAIN and name not in need:
                add(DOMAIN[name])
                need.append(name)

    add(sql)
    bare = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    head = ", ".join(f"{n} AS ({bare(DOMAIN[n])})" for n in need)
    body = bare(sql).strip()
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


#: What the derived tables aggregate of the given ones, as numbers; each is written once for an application and folder of given tables.
KEYS = {
    # an id is null where any part of it is; then suppliers of equal texts are equal
    "item_keys": """
SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CASE WHEN day IS NULL AND l_suppkey % 50 = 7 THEN 7 ELSE l_suppkey END AS l_suppkey, day, l_returnflag || l_linestatus AS evidence, cast(round(1 - l_discount, 4) AS double) AS confidence,
       CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'candidate' END AS status
FROM (SELECT /*+ REPARTITION(l_orderkey, l_linenumber, l_partkey) */ l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_discount,
        CASE WHEN l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL THEN cast(l_shipdate AS date) END AS day FROM {lineitem}) a""",
    "evidence_keys": "SELECT i.*, o_orderkey, o_orderdate FROM {item_keys} i JOIN {orders} ON o_orderkey = l_orderkey WHERE o_orderkey % 10 = 0 AND l_orderkey % 10 = 0",
    "mention_keys": "SELECT l_orderkey, l_partkey FROM {lineitem} GROUP BY l_orderkey, l_partkey",
    "supply_keys": "SELECT l_suppkey, l_partkey, min(l_orderkey) AS l_orderkey FROM {lineitem} GROUP BY l_suppkey, l_partkey",
    "first_lines": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_suppkey, l_shipdate) AS rn FROM {lineitem}) a WHERE rn = 1""",
}
KEPT = tuple(KEYS)
#: How Spark makes the rows of these tables of DOMAIN from KEYS: texts are made on reading, so that no shuffle moves them and no table holds them. A part of a union that a filter excludes isn't read.
MADE = {
    "flat_items": """
SELECT cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) || '-' || cast(l_partkey AS string) || '-' || cast(l_suppkey AS string) || '-' || cast(day AS string) AS id,
       'b' || cast(l_orderkey AS string) AS batch_id, cast(l_linenumber AS bigint) AS seq, CASE WHEN l_linenumber % 2 = 1 THEN 'node' ELSE 'edge' END AS kind,
       'part_' || cast(l_partkey AS string) AS p_id, 'Part ' || cast(l_partkey AS string) AS p_label, 'Product' AS p_type, '' AS p_description,
       CASE WHEN l_suppkey % 50 = 7 THEN '' ELSE 'organization_' || cast(l_suppkey AS string) END AS p_source, 'part_' || cast(l_partkey AS string) AS p_target, 'SUPPLIES' AS p_relation, evidence AS p_evidence,
       confidence, status, cast(NULL AS string) AS review_note
FROM {item_keys}""",
    "edges": DOMAIN["edges"].replace("FROM {lineitem} GROUP BY l_orderkey, l_partkey", "FROM {mention_keys}").replace("min(l_orderkey)", "l_orderkey").replace("FROM {lineitem} GROUP BY l_suppkey, l_partkey", "FROM {supply_keys}"),
    "entities": """
SELECT 'order://' || cast(l_orderkey AS string) AS uri, cast(l_linenumber AS int) AS chunk_index, cast(l_partkey AS int) AS pos, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'part_' || cast(l_partkey % 20 AS string) END AS id,
       'Part ' || cast(l_partkey % 20 AS string) AS label, 'Product' AS type, cast(CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_discount * 10 END AS double) AS confidence FROM {first_lines}""",
    "relations": """
SELECT 'order://' || cast(l_orderkey AS string) AS uri, cast(l_linenumber AS int) AS chunk_index, cast(l_partkey AS int) AS pos, 'part_' || cast(l_partkey % 20 AS string) AS source, 'part_' || cast(l_suppkey % 20 AS string) AS target, 'NEAR' AS relation FROM {first_lines}""",
}
_ITEMS = MADE["flat_items"].replace("{item_keys}", "{evidence_keys}")
MADE["evidence"] = f"""
SELECT 'ev-' || id AS id, CASE WHEN kind = 'edge' THEN 'edge:' || p_source || ':' || p_relation || ':' || p_target ELSE 'node:' || p_id END AS graph_item_id, source_uri, batch_id, 'general/places' AS template_id, p_evidence AS evidence_text, confidence,
       CASE WHEN seq % 7 = 3 THEN 'purged' WHEN seq % 5 = 0 THEN 'stale' ELSE 'active' END AS status, created_at
FROM ({_ITEMS.replace("confidence, status,", "confidence, 'cloudreve://orders/' || cast(o_orderkey % 5000 AS string) AS source_uri, o_orderdate AS created_at,")}) e"""
_kept: dict[tuple, str] = {}


class Tables:
    """Given and derived tables as DataFrames: t.nodes, t.lineitem."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: bool = True):
        """Without keep nothing of KEYS is written, and rows are picked ahead of the shuffles that make it: for queries that read little of it, or each row once."""
        self.spark, self.sf_dir, self.keep, self._files = spark, sf_dir, keep, None

    def kept(self, name: str, write: Callable[[str], object]) -> str:
        """The folder that `write` wrote to, once for an application, a folder of given tables, and the files in it: where these change, it is written again."""
        if self._files is None:
            found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(self.sf_dir)
            h = F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")
            self._files = tuple(found.agg(F.count("*"), F.sum(h)).first())  # of a listing; no file is read
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name, self._files)
        if key not in _kept:
            folder = shared_folder(self.spark)
            write(folder)
            _kept[key] = folder
        return _kept[key]

    def _made(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))})

    def __getattr__(self, name: str) -> DataFrame:
        if name == "items":
            f = self.flat_items
            return f.select("id", "batch_id", "seq", "kind", F.struct(*(F.col(f"p_{c}").alias(c) for c in PAYLOAD)).alias("payload"), "confidence", "status", "review_note")
        if name == "full_batches":
            return self.batches.withColumn("template_ids", F.array("template_id")).drop("template_id")
        if name in KEYS:
            keys = self._made(KEYS[name])
            if not self.keep:
                return keys
            return self.spark.read.schema(keys.schema).parquet(self.kept(name, lambda folder: written(keys, folder, name)) + f"/{name}")
        if name in DOMAIN:
            return self._made(MADE.get(name, DOMAIN[name]))
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
