"""Queries over documents' texts, segments' extractions, vectors and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import classify as cl
from ..operators import extract as ex
from ..operators import label_index as li
from ..operators import merge as mg
from ..operators import qa
from ..sources import files as fs
from ..sources import tables as tb
from ..sources import templates as tp
from ..storage import shared_folder
from .domain import Tables

IDS = "CASE WHEN id = '' THEN lower(type) || '_' || replace(lower(label), ' ', '_') ELSE id END"
ENT = f"(SELECT uri, chunk_index, pos, {IDS} AS id, label, type, confidence FROM {{entities}} WHERE coalesce(confidence, 1.0) >= 0.5)"
DEDUP = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri, id ORDER BY chunk_index, pos) AS rn FROM {ENT} e) x WHERE rn = 1)"
RELS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri, source, target, relation ORDER BY chunk_index, pos) AS rn FROM {relations}) x WHERE rn = 1)"
PRUNED = f"(SELECT r.* FROM {RELS} r WHERE EXISTS (SELECT 1 FROM {DEDUP} e WHERE e.uri = r.uri AND e.id = r.source) AND EXISTS (SELECT 1 FROM {DEDUP} e WHERE e.uri = r.uri AND e.id = r.target))"
EXT = "lower(regexp_extract(filename, '[^/](\\.[^./]+)$', 1))"
PROC, BIN, UNS = (", ".join(f"'{x}'" for x in xs) for xs in (fs.PROCESSABLE, fs.BINARY, fs.UNSUPPORTED))


def _words() -> str:
    return ", ".join(f"({r[0]}, '{r[1]}', '{r[2]}', '{r[3]}', {r[4]})" for r in ((i, c, f, w, n) for i, (c, both) in enumerate(cl.DEFAULT_KEYWORDS.items()) for f, part, n in zip(("filename", "content"), both, (2.0, 1.0), strict=True) for w in part))


CLASSIFIED = f"""WITH s AS (SELECT uri, ordinal, category, sum(weight)::DOUBLE AS score FROM {{docs}} JOIN (VALUES {_words()}) k(ordinal, category, field, keyword, weight) ON contains(CASE WHEN field = 'filename' THEN lower(filename) ELSE lower(substr(text, 1, 600)) END, keyword) GROUP BY 1, 2, 3),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY score DESC, ordinal) AS rn FROM s) x WHERE rn = 1),
d AS (SELECT d.uri, {EXT} AS ext, len(string_split(text, chr(10))) AS n, category, score FROM {{docs}} d LEFT JOIN b ON b.uri = d.uri)
SELECT uri, CASE WHEN ext IN ('.xlsx', '.xls', '.xlsm', '.ods') OR (ext IN ('.csv', '.tsv') AND n > 200) THEN 'tabular_data' ELSE coalesce(category, 'general') END AS doc_type, CASE WHEN ext IN ('.xlsx', '.xls', '.xlsm', '.ods') OR (ext IN ('.csv', '.tsv') AND n > 200) THEN 'structural_summary' ELSE 'llm_extract' END AS strategy,
round(CASE WHEN ext IN ('.xlsx', '.xls', '.xlsm', '.ods') THEN 1.0 WHEN ext IN ('.csv', '.tsv') AND n > 200 THEN 0.9 WHEN score IS NULL THEN 0.3 ELSE least(1.0, score / 6) END::DOUBLE, 6) AS confidence FROM d"""


def _chunk_end(b: str) -> str:
    """Where a chunk of 1000 characters that begins at b ends: behind the last empty line of its second half."""
    last = f"{b} + 1001 - strpos(reverse(substr(t, {b} + 1, 1000)), chr(10) || chr(10))"
    return f"CASE WHEN {b} + 1000 >= length(t) THEN length(t) WHEN strpos(reverse(substr(t, {b} + 1, 1000)), chr(10) || chr(10)) > 0 AND {last} > {b} + 500 THEN {last} ELSE {b} + 1000 END"


def docs(t: Tables):
    return t.docs.withColumns({"file_type": F.lit(""), "row_count": F.size(F.split("text", "\n"))})


def ents(t: Tables):
    return mg.confident(mg.with_entity_ids(t.entities))


TAGS = "(SELECT uri, chunk_index, pos, CASE WHEN pos % 2 = 0 THEN label ELSE upper(label) END AS tag FROM {entities})"


def tags(t: Tables):
    return t.entities.select("uri", "chunk_index", "pos", F.when(F.col("pos") % 2 == 0, F.col("label")).otherwise(F.upper("label")).alias("tag"))


def unit(t: Tables):
    return t.vectors.select(F.col("uri").alias("block"), F.col("chunk_id").alias("id"), "vector")


PAIRS = "(SELECT x.chunk_id AS a, y.chunk_id AS b, list_cosine_similarity(x.vector::DOUBLE[], y.vector::DOUBLE[]) AS s FROM {vectors} x JOIN {vectors} y ON x.uri = y.uri AND x.chunk_id < y.chunk_id WHERE list_cosine_similarity(x.vector::DOUBLE[], y.vector::DOUBLE[]) >= 0.3)"
CLUSTERS = f"""WITH RECURSIVE p AS (SELECT a, b FROM {PAIRS} q), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), n AS (SELECT chunk_id AS id FROM {{vectors}}),
reach(id, other) AS (SELECT id, id FROM n UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other), c AS (SELECT id, min(other) AS cluster FROM reach GROUP BY id)"""


def pairs(t: Tables):
    return vx.similar_pairs(unit(t), "block", "id", 0.3)


def canonical(t: Tables):
    e = unit(t).select("id", F.col("id").alias("pos"), ((F.col("id") * 7) % 10 / 10).alias("confidence"))
    return mg.canonical_entities(e, mg.entity_clusters(unit(t), pairs(t)))


def responses(t: Tables):
    body = F.to_json(F.struct(F.col("text").alias("summary"), F.array("label").alias("tags"), F.array(F.struct(F.lit("").alias("id"), "label", F.lit("Topic").alias("type"), F.lit("d").alias("description"), F.lit(0.9).alias("confidence"))).alias("entities"), F.array().cast("array<struct<source:string,target:string,relation:string>>").alias("relations")))
    d = t.documents.withColumn("label", F.concat(F.lit("Word "), (F.col("doc_id") % 7).cast("string")))
    k = F.col("doc_id") % 4
    content = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise(F.lit("no json"))
    return d.select(F.col("doc_id").cast("string").alias("uri"), F.lit(0).alias("chunk_index"), content.alias("content"))


def contents(t: Tables):
    artifacts = t.docs.filter("doc_id % 12 <> 3").select(F.col("parsed_text_key").alias("key"), "text")
    return fs.document_content(t.docs, artifacts, t.docs.select("uri").union(t.spark.range(1).select(F.lit("none"))))


def doc_questions(t: Tables):
    return t.documents.select(F.col("doc_id").cast("string").alias("uri"), "text", "doc_id")


def template_matches(t: Tables):
    own = tp.own_templates(t.spark)
    tt = tp.template_text(own).withColumnRenamed("template_id", "uri")
    vt = vx.dense(vx.hashed_embedding(tt), tt).withColumnRenamed("uri", "template_id")
    d = doc_questions(t).withColumn("text", F.substring("text", 1, 1500))
    vd = vx.dense(vx.hashed_embedding(d), d).select(F.col("uri").cast("long").alias("doc_id"), "vector")
    return tp.match_templates(vd, vt, 3), own


def edge_extract(t: Tables):
    segs = tx.segment_text(t.documents.select(F.col("doc_id").cast("string").alias("uri"), "text"), threshold=8000)
    prompts = ex.build_prompts(segs, [("Topic", "A word")], ["NEAR"], "Be short")
    return ex.extract_with(prompts, lambda p: '{"summary": "%d", "tags": [], "entities": [], "relations": [], "key_points": []}' % len(p))


PROMPT = "'List the entities and relations in the text as JSON.' || chr(10) || '- Topic: A word' || chr(10) || '- NEAR' || chr(10) || 'Rules: '"
#: Segments of a table of texts, of 8000 characters every 7600.
SEGMENTS = "(SELECT uri, i AS chunk_index, substr(text, i * 7600 + 1, 8000) AS text FROM (SELECT {key} AS uri, text, unnest(generate_series(0, CASE WHEN length(text) <= 8000 THEN 0 ELSE ceil((length(text) - 8000) / 7600)::BIGINT END)) AS i FROM {table} WHERE length(text) > 0) a)"

def label_index(t: Tables) -> str:
    """The index of the nodes' labels, written once for an application and folder of given tables."""
    return t.kept("label_index", lambda folder: li.write_index(t.nodes, folder, "0" * 12))


def renamed_index(t: Tables) -> str:
    """The index after every node whose uri ends in 2 has got another label."""
    folder, some = shared_folder(t.spark), t.nodes.filter("uri like '%2'")
    li.write_index(t.nodes, folder, "0" * 12)
    li.change_index(folder, "0" * 12, f"{1:012d}", some, some.withColumn("label", F.concat(F.lit("Nation of "), "id")))
    return folder


#: What the stand-in refuses: about half of all texts.
REFUSED = "substr(md5({0}), 1, 1) < '8'"
#: Each document of `docs` by its route, with its segments, the refused ones, and the summary that it ends with.
ROUTED = f"""(SELECT uri, route, asked, failed, CASE WHEN route = 'tabular' THEN CASE WHEN failed = 1 THEN substr(text, 1, 300) ELSE least(length(text), 6000)::VARCHAR END
    WHEN failed < asked THEN first WHEN route = 'segments' AND NOT {REFUSED.format("substr(text, 1, 100000)")} THEN least(length(text), 100000)::VARCHAR END AS summary, CASE WHEN {REFUSED.format("substr(text, 1, 100000)")} THEN 1 ELSE 0 END AS again
  FROM (SELECT d.uri, any_value(d.text) AS text, CASE WHEN any_value(d.filename) LIKE '%.xlsx' THEN 'tabular' WHEN length(any_value(d.text)) > 8000 THEN 'segments' ELSE 'single' END AS route, count(*) AS asked,
    count(*) FILTER (WHERE {REFUSED.format("s.text")}) AS failed, min_by(length(s.text)::VARCHAR, chunk_index) FILTER (WHERE NOT {REFUSED.format("s.text")}) AS first
  FROM {{docs}} d JOIN (SELECT * FROM {SEGMENTS.format(table="{docs}", key="uri")} q WHERE uri NOT LIKE '%.xlsx' UNION ALL SELECT uri, 0, substr(text, 1, 6000) FROM {{docs}} WHERE filename LIKE '%.xlsx' AND length(text) > 0) s ON s.uri = d.uri GROUP BY d.uri) z)"""


def half_refused(prompt: str) -> str:
    import hashlib
    import json

    text = prompt.split("Text:\n", 1)[1]
    if hashlib.md5(text.encode()).hexdigest() < "8":
        raise ValueError("refused")
    return json.dumps({"summary": str(len(text)), "tags": [], "entities": [], "relations": [], "key_points": []})


def routed(t: Tables):
    docs = t.docs.select("uri", "text", F.when(F.col("filename").endswith(".xlsx"), "structural_summary").alias("strategy"))
    return ex.extract_documents(docs, half_refused, [("Topic", "A word")], ["NEAR"], threshold=8000)


TABLES = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "benchmark": ["item_id"]}
COLUMNS = {"region": "r_regionkey,r_name", "nation": "n_nationkey,n_name,n_regionkey", "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment", "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal", "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice", "benchmark": "item_id,text"}
FIELDS = "(SELECT table_name AS sheet, column_name AS field FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{n}'" for n in TABLES) + "))"

#: Keywords of the questions (k from 0), and the entities, relations and evidence that they lead to.
KEYWORDS = f"(WITH w AS (SELECT question_id, generate_subscripts(l, 1) AS pos, unnest(l) AS keyword FROM (SELECT question_id, regexp_split_to_array(lower(question), '[\\s,，。？?！!、；;：:「」【】()（）]+') AS l FROM {{questions}}) a), d AS (SELECT question_id, keyword, min(pos) AS pos FROM w WHERE length(keyword) >= 2 AND keyword NOT IN ({', '.join(repr(x) for x in tx.STOP)}) GROUP BY 1, 2) SELECT question_id, k, keyword FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos) - 1 AS k FROM d) x WHERE k < 5)"
QA_ENTITIES = f"""(WITH kw AS {KEYWORDS}, found AS (SELECT * FROM (SELECT keyword, uri, label, row_number() OVER (PARTITION BY keyword ORDER BY label, uri) AS place FROM (SELECT DISTINCT keyword FROM kw) t JOIN {{nodes}} n ON uri LIKE 'entity://%' AND contains(lower(label), keyword)) x WHERE place <= 6),
one AS (SELECT * FROM (SELECT question_id, k, kw.keyword, uri, label, row_number() OVER (PARTITION BY question_id, uri ORDER BY k) AS rn FROM kw JOIN found ON found.keyword = kw.keyword) y WHERE rn = 1)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY k, label, uri) AS rank, uri, label, keyword FROM one)"""
QA_RELATIONS = f"""(WITH e AS {QA_ENTITIES}, b AS (SELECT src_uri AS uri, dst_uri AS other, * FROM {{edges}} UNION ALL SELECT dst_uri, src_uri, * FROM {{edges}} WHERE src_uri <> dst_uri),
t AS (SELECT question_id, rank, other, id, src_uri, dst_uri, relation, layer FROM e JOIN b ON b.uri = e.uri),
f AS (SELECT question_id, other, min(rank) AS rank FROM t WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.question_id = t.question_id AND e.uri = t.other) GROUP BY 1, 2),
s AS (SELECT e.question_id, e.rank, count(f.other) AS fresh FROM e LEFT JOIN f ON f.question_id = e.question_id AND f.rank = e.rank GROUP BY 1, 2),
o AS (SELECT * FROM (SELECT question_id, rank, coalesce(sum(fresh) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM s) x WHERE spent < 30)
SELECT DISTINCT t.question_id, id, src_uri, dst_uri, relation, layer FROM t JOIN o ON o.question_id = t.question_id AND o.rank = t.rank)"""
QA_EVIDENCE = f"""(WITH i AS (SELECT question_id, uri FROM {QA_ENTITIES} a UNION SELECT question_id, unnest([src_uri, dst_uri]) FROM {QA_RELATIONS} b)
SELECT question_id, e.id, e.graph_item_id, e.status FROM i JOIN {{evidence}} e ON e.graph_item_id = 'node:' || substr(i.uri, 10) WHERE i.uri LIKE 'entity://%' AND e.status NOT IN ('stale', 'purged'))"""

QUERIES = {
    "file_gate": (
        lambda t: fs.file_gate(t.docs).select("uri", "extension", "verdict", "reason", "should_process", "permanent_skip"),
        f"SELECT uri, ext AS extension, CASE WHEN ext IN ({PROC}) THEN 'processable' WHEN ext IN ({BIN}) THEN 'skipped' ELSE 'unsupported' END AS verdict, CASE WHEN ext IN ({PROC}) THEN 'supported file type' WHEN ext IN ({BIN}) THEN 'binary or media file' WHEN ext IN ({UNS}) THEN 'no parser for this format' WHEN ext = '' THEN 'no extension' ELSE 'unknown extension' END AS reason, ext IN ({PROC}) AS should_process, ext IN ({BIN}) AS permanent_skip FROM (SELECT *, {EXT} AS ext FROM {{docs}}) d",
    ),
    "derive_file_meta": (
        lambda t: fs.derive_file_meta(t.docs.select("uri", "text")).select("uri", "filename", "source_type", "mime_type", "size_bytes", "content_hash"),
        f"SELECT uri, filename, 'cloudreve' AS source_type, CASE {EXT} WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/markdown' WHEN '.csv' THEN 'text/csv' WHEN '.pdf' THEN 'application/pdf' WHEN '.png' THEN 'image/png' ELSE 'application/octet-stream' END AS mime_type, octet_length(encode(text))::BIGINT AS size_bytes, sha256(text) AS content_hash FROM {{docs}}",
    ),
    "parse_uri": (
        lambda t: fs.parse_uri(t.pages.select("url"), "url", "https").select("url", "scheme", "host", "user", "path", "query", "valid"),
        "SELECT url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, '' AS \"user\", coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), ''), '/') AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, url LIKE 'https://%' AS valid FROM {pages}",
    ),
    "document_content": (
        contents,
        "SELECT uri, CASE WHEN parsed_text_key IS NULL THEN 404 WHEN parsed_text_key LIKE 'cloudreve%' THEN 410 WHEN parsed_text_key LIKE 'ftp%' THEN 422 WHEN doc_id % 12 = 3 THEN 502 ELSE 200 END AS status, CASE WHEN parsed_text_key LIKE 's3%' AND doc_id % 12 <> 3 THEN 's3' END AS source, CASE WHEN parsed_text_key LIKE 's3%' AND doc_id % 12 <> 3 THEN text END AS text FROM {docs} UNION ALL SELECT 'none', 404, NULL, NULL",
    ),
    "document_content_whole": (
        lambda t: contents(t).select("uri", "status", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"), F.md5("text").alias("hash")),
        "SELECT uri, CASE WHEN parsed_text_key IS NULL THEN 404 WHEN parsed_text_key LIKE 'cloudreve%' THEN 410 WHEN parsed_text_key LIKE 'ftp%' THEN 422 WHEN doc_id % 12 = 3 THEN 502 ELSE 200 END AS status, CASE WHEN parsed_text_key LIKE 's3%' AND doc_id % 12 <> 3 THEN 's3' END AS source, CASE WHEN parsed_text_key LIKE 's3%' AND doc_id % 12 <> 3 THEN length(text) ELSE 0 END AS n, CASE WHEN parsed_text_key LIKE 's3%' AND doc_id % 12 <> 3 THEN md5(text) END AS hash FROM {docs} UNION ALL SELECT 'none', 404, NULL, 0, NULL",
    ),
    "content_preview": (lambda t: t.docs.select("uri", tx.content_preview(F.col("text")).alias("preview")), "SELECT uri, substr(text, 1, 600) AS preview FROM {docs}"),
    "assemble_pages": (
        lambda t: tb.assemble_pages(t.pages_rows),
        "SELECT uri, coalesce(string_agg('--- Page ' || page::VARCHAR || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page) FILTER (WHERE trim(text) <> ''), '') AS text, count(*) AS page_count FROM {pages_rows} GROUP BY uri",
    ),
    "assemble_paragraphs": (lambda t: tb.assemble_paragraphs(t.pages_rows), "SELECT uri, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text, count(*) AS paragraph_count FROM {pages_rows} WHERE trim(text) <> '' GROUP BY uri"),
    "table_structural_summary": (
        lambda t: tb.table_structural_summary({n: (getattr(t, n), k) for n, k in TABLES.items()}).select("name", "n_rows", "n_cols", "columns"),
        " UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM {{{n}}}) AS n_rows, {len(c.split(','))} AS n_cols, '{c.replace(',', ' | ')}' AS columns" for n, c in COLUMNS.items()),
    ),
    "tabular_schema_graph": (
        lambda t: tb.tabular_schema_graph({n: getattr(t, n) for n in TABLES}, "Shop")[0].select("id", "label", "type"),
        f"SELECT 'dataset_shop' AS id, 'Shop' AS label, 'Dataset' AS type UNION ALL SELECT DISTINCT 'sheet_' || sheet, sheet, 'Sheet' FROM {FIELDS} f UNION ALL SELECT 'field_' || sheet || '_' || field, field, 'Field' FROM {FIELDS} f",
    ),
    "tabular_schema_relations": (
        lambda t: tb.tabular_schema_graph({n: getattr(t, n) for n in TABLES}, "Shop")[1],
        f"SELECT 'dataset_shop' AS source, 'field_' || sheet || '_' || field AS target, 'HAS_FIELD' AS relation FROM {FIELDS} f UNION ALL SELECT 'field_' || sheet || '_' || field, 'sheet_' || sheet, 'BELONGS_TO_SHEET' FROM {FIELDS} f",
    ),
    "classification_scores": (
        lambda t: cl.category_scores(docs(t), cl.keyword_table(t.spark)).select("uri", "category", "score"),
        f"SELECT uri, category, sum(weight)::DOUBLE AS score FROM {{docs}} JOIN (VALUES {_words()}) k(ordinal, category, field, keyword, weight) ON contains(CASE WHEN field = 'filename' THEN lower(filename) ELSE lower(substr(text, 1, 600)) END, keyword) GROUP BY 1, 2",
    ),
    "classify_documents": (
        lambda t: cl.classify(docs(t), cl.keyword_table(t.spark)).select("uri", "doc_type", "strategy", F.round("confidence", 6).alias("confidence")),
        f"SELECT * FROM ({CLASSIFIED}) x",
    ),
    "classify_with": (
        lambda t: cl.classify_with(cl.classify(docs(t), cl.keyword_table(t.spark)), docs(t), lambda name, preview: "report" if "x_" in name else "unknown", list(cl.DEFAULT_KEYWORDS)).select("uri", "doc_type", F.round("confidence", 6).alias("confidence")),
        f"SELECT uri, CASE WHEN low AND told THEN 'report' ELSE doc_type END AS doc_type, CASE WHEN low AND told THEN 0.6 ELSE confidence END AS confidence FROM (SELECT c.*, c.confidence < 0.4 AS low, contains(d.filename, 'x_') AS told FROM ({CLASSIFIED}) c JOIN {{docs}} d USING (uri)) x",
    ),
    "doc_type_from_name": (
        lambda t: t.docs.select("uri", tx.doc_type_from_name(F.col("filename")).alias("doc_type")),
        "SELECT uri, CASE WHEN regexp_matches(lower(filename), 'paper|research|study') THEN 'academic_paper' WHEN regexp_matches(lower(filename), 'api|tech|doc|readme') THEN 'technical_doc' WHEN regexp_matches(lower(filename), 'meeting|minutes') THEN 'meeting_minutes' WHEN contains(lower(filename), 'report') THEN 'report' ELSE 'general' END AS doc_type FROM {docs}",
    ),
    "chunk_fixed": (
        lambda t: tx.chunk_fixed(t.docs).select("uri", F.col("chunk_index").cast("long").alias("chunk_index"), "text"),
        "SELECT uri, row_number() OVER (PARTITION BY uri ORDER BY s) - 1 AS chunk_index, text FROM (SELECT uri, s, substr(text, s + 1, 1000) AS text FROM (SELECT uri, text, unnest(CASE WHEN length(text) <= 1000 THEN [0] ELSE generate_series(0, length(text) - 1, 900) END) AS s FROM {docs}) a) b WHERE regexp_matches(text, '\\S')",
    ),
    "chunk_paragraph": (
        lambda t: tx.chunk_paragraph(t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text")), "doc_id").select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text"),
        f"""WITH RECURSIVE d AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS t FROM {{documents}}), s(doc_id, t, b, e) AS (SELECT doc_id, t, 0, {_chunk_end('0')} FROM d WHERE t <> '' UNION ALL SELECT doc_id, t, e - 100, {_chunk_end('e - 100')} FROM s WHERE e < length(t))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS chunk_index, substr(t, b + 1, e - b) AS text FROM s WHERE regexp_matches(substr(t, b + 1, e - b), '\\S')""",
    ),
    "segment_text": (
        lambda t: tx.segment_text(t.docs, threshold=8000).select("uri", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.md5("text").alias("hash")),
        "SELECT uri, i AS chunk_index, i * 7600 AS char_start, least(i * 7600 + 8000, length(text)) AS char_end, md5(substr(text, i * 7600 + 1, 8000)) AS hash FROM (SELECT uri, text, unnest(generate_series(0, CASE WHEN length(text) <= 8000 THEN 0 ELSE ceil((length(text) - 8000) / 7600)::BIGINT END)) AS i FROM {docs} WHERE length(text) > 0) a",
    ),
    "keyword_tags": (
        lambda t: tx.keyword_tags(t.docs).select("uri", "tag", "n", F.col("rank").cast("long").alias("rank")),
        "WITH w AS (SELECT uri, generate_subscripts(l, 1) AS pos, unnest(l) AS tag FROM (SELECT uri, regexp_split_to_array(trim(lower(text)), '\\s+') AS l FROM {docs}) a), c AS (SELECT uri, tag, count(*) AS n, min(pos) AS pos FROM w WHERE length(tag) >= 5 GROUP BY 1, 2) SELECT uri, tag, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY n DESC, pos) AS rank FROM c) x WHERE rank <= 8",
    ),
    "question_keywords": (
        lambda t: t.questions.select("question_id", F.posexplode(tx.question_keywords(F.col("question"))).alias("k", "keyword")).select("question_id", F.col("k").cast("long").alias("k"), "keyword"),
        f"WITH w AS (SELECT question_id, generate_subscripts(l, 1) AS pos, unnest(l) AS keyword FROM (SELECT question_id, regexp_split_to_array(lower(question), '[\\s,，。？?！!、；;：:「」【】()（）]+') AS l FROM {{questions}}) a), d AS (SELECT question_id, keyword, min(pos) AS pos FROM w WHERE length(keyword) >= 2 AND keyword NOT IN ({', '.join(repr(x) for x in tx.STOP)}) GROUP BY 1, 2) SELECT question_id, k, keyword FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos) - 1 AS k FROM d) x WHERE k < 5",
    ),
    "stable_entity_id": (lambda t: mg.with_entity_ids(t.entities).select("uri", "chunk_index", "pos", "id"), f"SELECT uri, chunk_index, pos, {IDS} AS id FROM {{entities}}"),
    "confidence_filter": (lambda t: mg.confident(t.entities).select("uri", "chunk_index", "pos"), "SELECT uri, chunk_index, pos FROM {entities} WHERE coalesce(confidence, 1.0) >= 0.5"),
    "dedup_entities": (lambda t: mg.dedup_entities(ents(t)).select("uri", "id", "chunk_index", "pos", "label"), f"SELECT uri, id, chunk_index, pos, label FROM {DEDUP} e"),
    "dedup_relations": (lambda t: mg.dedup_relations(t.relations).select("uri", "source", "target", "chunk_index", "pos"), f"SELECT uri, source, target, chunk_index, pos FROM {RELS} e"),
    "prune_dangling": (lambda t: mg.prune_dangling(mg.dedup_relations(t.relations), mg.dedup_entities(ents(t))).select("uri", "source", "target"), f"SELECT uri, source, target FROM {PRUNED} p"),
    "merge_tags": (
        lambda t: mg.merge_tags(tags(t), most=3).select("uri", F.col("rank").cast("long").alias("rank"), "tag"),
        f"WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri, lower(tag) ORDER BY chunk_index, pos) AS rn FROM {TAGS} g) x WHERE rn = 1) SELECT uri, rank, tag FROM (SELECT uri, tag, row_number() OVER (PARTITION BY uri ORDER BY chunk_index, pos) AS rank FROM o) y WHERE rank <= 3",
    ),
    "merge_key_points": (lambda t: mg.merge_key_points(tags(t), most=4).select("uri", "chunk_index", "pos", "tag"), f"SELECT uri, chunk_index, pos, tag FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY chunk_index, pos) AS rn FROM {TAGS} g) x WHERE rn <= 4"),
    "merge_summary_confidence": (lambda t: mg.merge_summary_confidence(t.segments), "SELECT uri, coalesce(min_by(summary, chunk_index) FILTER (WHERE trim(summary) <> ''), '') AS summary, min(confidence) AS confidence FROM {segments} GROUP BY uri"),
    "merge_extractions": (
        lambda t: mg.merge_extractions(t.segments, ents(t), t.relations, tags(t), tags(t))["relations"].groupBy("uri").agg(F.count("*").alias("n")),
        f"SELECT uri, count(*) AS n FROM {PRUNED} p GROUP BY 1",
    ),
    "similar_pairs": (lambda t: pairs(t).select("a", "b", F.round("similarity", 4).alias("similarity")), f"SELECT a, b, round(s, 4) AS similarity FROM {PAIRS} p"),
    "entity_clusters": (lambda t: mg.entity_clusters(unit(t), pairs(t)), f"{CLUSTERS} SELECT id, cluster FROM c"),
    "canonical_entities": (
        canonical,
        f"{CLUSTERS}, b AS (SELECT cluster, min(struct_pack(c := -((id * 7) % 10 / 10), id := id)).id AS canonical FROM c GROUP BY cluster) SELECT id, canonical FROM c JOIN b USING (cluster)",
    ),
    "remap_endpoints": (
        lambda t: mg.remap_endpoints(t.relations, t.spark.createDataFrame([(f"part_{k}", f"part_{k - k % 2}") for k in range(20)], "id string, canonical string"), mg.dedup_entities(ents(t))).select("uri", "source", "target"),
        f"SELECT DISTINCT uri, source, target FROM (SELECT uri, 'part_' || (k1 - k1 % 2)::VARCHAR AS source, 'part_' || (k2 - k2 % 2)::VARCHAR AS target FROM (SELECT uri, substr(source, 6)::INT AS k1, substr(target, 6)::INT AS k2 FROM {{relations}}) a) r WHERE EXISTS (SELECT 1 FROM {DEDUP} e WHERE e.uri = r.uri AND e.id = r.source) AND EXISTS (SELECT 1 FROM {DEDUP} e WHERE e.uri = r.uri AND e.id = r.target)",
    ),
    "hashed_embedding": (
        lambda t: vx.hashed_embedding(t.docs).select("uri", "bucket", F.round("value", 6).alias("value")),
        "WITH w AS (SELECT uri, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_-]+')) AS w FROM {docs}), s AS (SELECT uri, (('0x' || substr(sha256(w), 1, 8))::BIGINT % 64)::INT AS bucket, CASE WHEN ('0x' || substr(sha256(w), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign FROM w), v AS (SELECT uri, bucket, sum(sign)::DOUBLE AS v FROM s GROUP BY 1, 2 HAVING sum(sign) <> 0) SELECT uri, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY uri)), 6) AS value FROM v",
    ),
    "embed_with": (lambda t: vx.embed_with(t.docs, lambda texts: [[float(len(x)), 1.0] for x in texts]).select("uri", F.element_at("vector", 1).cast("double").alias("value")), "SELECT uri, length(text)::DOUBLE AS value FROM {docs}"),
    "cosine": (lambda t: t.vectors.join(F.broadcast(t.vector_queries.filter("query_id = 3").select(F.col("vector").alias("q"))), F.lit(True)).select("chunk_id", F.round(vx.cosine(F.col("vector"), F.col("q")), 4).alias("value")), "SELECT chunk_id, round(list_cosine_similarity(vector::DOUBLE[], (SELECT vector::DOUBLE[] FROM {vector_queries} WHERE query_id = 3)), 4) AS value FROM {vectors}"),
    "dot": (
        lambda t: t.vectors.join(F.broadcast(t.vector_queries.filter("query_id = 3").select(F.col("vector").alias("q"))), F.lit(True)).select("chunk_id", F.round(vx.dot(F.col("vector"), F.col("q")), 4).alias("value")),
        "SELECT chunk_id, round(list_dot_product(vector::DOUBLE[], (SELECT vector::DOUBLE[] FROM {vector_queries} WHERE query_id = 3)), 4) AS value FROM {vectors}",
    ),
    "vector_search": (
        lambda t: vx.vector_search(t.vectors, t.stated_queries).select("query_id", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank")),
        "SELECT query_id, chunk_id, round(s, 4) AS score, rank FROM (SELECT query_id, chunk_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, list_dot_product(q.vector::DOUBLE[], v.vector::DOUBLE[]) AS s FROM {stated_queries} q, {vectors} v) a) b WHERE rank <= 5",
    ),
    "vector_search_stated": (
        lambda t: vx.flat_search(t.vectors, t.stated_queries).select("query_id", "chunk_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank")),
        "SELECT query_id, chunk_id, round(s, 4) AS score, rank FROM (SELECT query_id, chunk_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, list_dot_product(q.vector::DOUBLE[], v.vector::DOUBLE[]) AS s FROM {stated_queries} q, {vectors} v) a) b WHERE rank <= 5",
    ),
    "parse_responses": (lambda t: ex.parse_responses(responses(t))[0].select("uri", "parsed.summary", F.element_at("parsed.entities", 1)["label"].alias("label")), "SELECT doc_id::VARCHAR AS uri, text AS summary, 'Word ' || (doc_id % 7)::VARCHAR AS label FROM {documents} WHERE doc_id % 4 < 3"),
    "parse_responses_whole": (lambda t: ex.parse_responses(responses(t))[0].select("uri", F.length("parsed.summary").cast("long").alias("n"), F.md5("parsed.summary").alias("hash")), "SELECT doc_id::VARCHAR AS uri, length(text) AS n, md5(text) AS hash FROM {documents} WHERE doc_id % 4 < 3"),
    "bad_responses": (lambda t: ex.parse_responses(responses(t))[1].select("uri"), "SELECT doc_id::VARCHAR AS uri FROM {documents} WHERE doc_id % 4 = 3"),
    "normalize_responses": (lambda t: ex.normalize_responses(ex.parse_responses(responses(t))[0])["entities"].select("uri", "id", "label", "type"), "SELECT doc_id::VARCHAR AS uri, 'topic_word_' || (doc_id % 7)::VARCHAR AS id, 'Word ' || (doc_id % 7)::VARCHAR AS label, 'Topic' AS type FROM {documents} WHERE doc_id % 4 < 3"),
    "build_prompts": (lambda t: ex.build_prompts(tx.segment_text(t.docs, threshold=8000), [("Topic", "A word")], ["NEAR"], "Be short").select("uri", F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("prompt").alias("hash")), f"SELECT uri, chunk_index, md5({PROMPT} || 'Be short' || chr(10) || 'Text:' || chr(10) || text) AS hash FROM {SEGMENTS.format(table='{docs}', key='uri')} s"),
    "extract_with": (
        lambda t: edge_extract(t).select("uri", F.col("chunk_index").cast("long").alias("chunk_index"), "content", "error"),
        f"""SELECT uri, chunk_index, '{{"summary": "' || length({PROMPT} || 'Be short' || chr(10) || 'Text:' || chr(10) || text)::VARCHAR || '", "tags": [], "entities": [], "relations": [], "key_points": []}}' AS content, NULL::VARCHAR AS error FROM {SEGMENTS.format(table='{documents}', key='doc_id::VARCHAR')} s""",
    ),
    "extract_documents": (
        lambda t: routed(t)["segments"].groupBy("uri").agg(F.min_by("summary", "chunk_index").alias("summary")),
        f"SELECT uri, summary FROM {ROUTED} r WHERE summary IS NOT NULL",
    ),
    "extract_documents_routes": (
        lambda t: routed(t)["routes"],
        f"SELECT uri, CASE WHEN route = 'segments' AND failed = asked THEN 'fallback' ELSE route END AS route, CASE WHEN route = 'segments' AND failed = asked THEN asked + 1 ELSE asked END AS asked, CASE WHEN route = 'segments' AND failed = asked THEN failed + again ELSE failed END AS failed FROM {ROUTED} r",
    ),
    "build_prompts_tabular": (
        lambda t: ex.build_prompts(t.docs.select("uri", F.substring("text", 1, ex.TABLE_CHARS).alias("text")), [], [], kind="tabular").select("uri", F.md5("prompt").alias("hash")),
        "SELECT uri, md5('Describe the table of this structural summary as JSON; list columns, never rows, and no column that isn''t named.' || chr(10) || '- Dataset: The whole file, once' || chr(10) || '- Sheet: Each sheet, once' || chr(10) || '- Field: Each column, once' || chr(10) || '- DataType: Only where it is plain' || chr(10) || '- HAS_FIELD' || chr(10) || '- BELONGS_TO_SHEET' || chr(10) || '- HAS_TYPE' || chr(10) || 'Text:' || chr(10) || substr(text, 1, 6000)) AS hash FROM {docs}",
    ),
    "summarize_with": (lambda t: ex.summarize_with(t.segments, lambda xs: str(len(xs))), "SELECT uri, CASE WHEN count(*) > 1 THEN count(*)::VARCHAR ELSE min(summary) END AS summary FROM {segments} WHERE trim(summary) <> '' GROUP BY uri"),
    "rule_extraction": (lambda t: ex.rule_extraction(t.docs)[0], "SELECT uri, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS summary FROM {docs}"),
    "qa_entities": (lambda t: qa.qa_entities(t.questions, None, index=label_index(t)).withColumn("rank", F.col("rank").cast("long")), f"SELECT * FROM {QA_ENTITIES} q"),
    "qa_entities_renamed": (
        lambda t: qa.qa_entities(t.questions, None, index=renamed_index(t)).select("question_id", "uri", "label", "keyword"),
        f"WITH v AS (SELECT uri, CASE WHEN uri LIKE '%2' THEN 'Nation of ' || id ELSE label END AS label FROM {{nodes}}) SELECT question_id, uri, label, keyword FROM {QA_ENTITIES.replace('{nodes}', 'v')} q",
    ),
    "qa_relations": (lambda t: qa.qa_relations(qa.qa_entities(t.questions, None, index=label_index(t)), t.edges), f"SELECT * FROM {QA_RELATIONS} q"),
    "qa_evidence": (lambda t: qa.qa_context(t.questions, t.nodes, t.edges, t.evidence, t.items, t.batches)["evidence"].select("question_id", "id", "graph_item_id", "status"), f"SELECT * FROM {QA_EVIDENCE} q"),
    "qa_candidates": (
        lambda t: qa.qa_candidates(t.items, t.batches).select("batch_id", "source_uri", "batch_status", "item_id", "kind", F.col("payload.label").alias("label"), "status"),
        "SELECT batch_id, source_uri, b.status AS batch_status, i.id AS item_id, kind, p_label AS label, i.status FROM {flat_items} i JOIN {batches} b ON b.id = batch_id WHERE b.status <> 'committed' AND i.status <> 'rejected'",
    ),
    "qa_candidate_questions": (lambda t: qa.qa_candidate_questions(t.questions), "SELECT question_id FROM {questions} WHERE include_candidates"),
    "match_templates": (lambda t: template_matches(t)[0].select("doc_id", "template_id", F.round("score", 4).alias("score"), "rank"), None),
    "merge_ontologies": (lambda t: tp.merge_ontologies(*template_matches(t))[0].select("doc_id", "rank", "concept", "description"), None),
}
#: The same queries under the names that they had when the first ones read less.
QUERIES |= {f"{name}_all": QUERIES[name] for name in ("similar_pairs", "entity_clusters", "canonical_entities")}
