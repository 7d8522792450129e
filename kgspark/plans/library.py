"""Queries over templates, files and streams. What they read is derived from the given tables and written to the shared folder first."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..operators import extract as ex
from ..operators import merge as mg
from ..operators.state import read_version, write_version
from ..sources import files as fs
from ..sources import templates as tp
from ..storage import shared_folder
from .domain import Tables

#: A template for each part.
PART_TEMPLATES = """
SELECT 'parts/part_' || cast(p_partkey AS string) AS template_id, p_name AS name, CASE p_partkey % 4 WHEN 0 THEN 'graph' WHEN 1 THEN 'list' WHEN 2 THEN 'temporal_graph' ELSE 'set' END AS template_type, p_brand || ' ' || p_type AS description,
  array(lower(p_type), lower(p_brand)) AS tags, CASE WHEN p_partkey % 3 = 0 THEN array('en', 'zh') ELSE array('en') END AS language,
  array(named_struct('name', 'type', 'description', map('en', 'Entity type: ' || replace(p_name, ' ', '/') || ', etc.')), named_struct('name', 'wear_grade', 'description', CASE WHEN p_partkey % 5 = 0 THEN map('zh', '等级') ELSE map('zh', '等级', 'en', 'Grade of wear') END)) AS entity_fields,
  array(named_struct('name', 'type', 'description', map('en', 'Relation type: made_by/part-of, etc.'))) AS relation_fields, CASE WHEN p_partkey % 2 = 0 THEN array('Keep brands', 'Skip prices') ELSE array() END AS rules, CASE WHEN p_partkey % 3 = 0 THEN 'Clerk' ELSE '' END AS role
FROM {part}"""
KIND = "CASE p_partkey % 4 WHEN 0 THEN 'graph' WHEN 1 THEN 'list' WHEN 2 THEN 'temporal_graph' ELSE 'set' END"
WORDS = "(SELECT p_partkey, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT p_partkey, string_split(p_name, ' ') AS l FROM {part}) a)"
WEAR = "CASE WHEN p_partkey % 5 = 0 THEN '等级' ELSE 'Grade of wear' END"


def part_templates(t: Tables):
    return t.spark.sql(PART_TEMPLATES, part=t.part)


def loaded_templates(t: Tables):
    folder = f"{shared_folder(t.spark)}/templates"
    part_templates(t).write.option("ignoreNullFields", False).json(folder)
    return tp.load_templates(t.spark, folder, one_per_file=False)


def text_files(t: Tables) -> str:
    """Texts as lines of files, in a folder for each source."""
    folder = f"{shared_folder(t.spark)}/texts"
    t.documents.select(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("value"), F.coalesce("source", F.lit("none")).alias("source")).write.partitionBy("source").text(folder)
    return folder


def of_source(uri: str = "uri"):
    return F.regexp_extract(uri, "source=([^/]*)/", 1)


def read_texts(t: Tables):
    files = fs.read_text_files(t.spark, text_files(t)).withColumn("source", of_source())
    return files.groupBy("source").agg(F.sum(F.size(F.split("text", "\n")) - 1).alias("n_lines"), F.sum(F.octet_length("text")).alias("n_bytes"))


def inventory(t: Tables):
    return fs.scan_inventory(t.spark, text_files(t)).withColumn("source", of_source()).groupBy("source").agg(F.sum("size_bytes").alias("n_bytes"))


def event_lines(t: Tables):
    named = t.events.filter("event_id % 2 = 0").select(F.col("user_id").alias("conn_id"), (F.col("event_id") * 2).alias("line_no"), F.concat(F.lit("event: "), "event_type").alias("line"))
    data = t.events.select(F.col("user_id").alias("conn_id"), (F.col("event_id") * 2 + 1).alias("line_no"), F.concat(F.lit("data: "), F.col("event_id").cast("string")).alias("line"))
    return named.unionByName(data)


def events_by_lines(t: Tables):
    """The lines of each connection in two micro-batches, cut behind an event line, whose data line comes with the second."""
    folder, lines = shared_folder(t.spark), event_lines(t)
    cuts = lines.filter("line like 'event:%'").groupBy("conn_id").agg(F.max("line_no").alias("cut"))
    lines = lines.join(cuts, "conn_id", "left").withColumn("late", F.coalesce(F.col("line_no") > F.col("cut"), F.lit(False)))
    for late in (False, True):
        lines.filter(F.col("late") == late).select("conn_id", "line_no", "line").write.mode("append").json(f"{folder}/in")
        found = streaming.typed_events(streaming.stream_event_lines(t.spark, f"{folder}/in"))
        found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("conn_id long, line_no long, type string, raw string").parquet(f"{folder}/out")


def file_events(t: Tables):
    """Events as they land in a folder, read as a stream until all are there."""
    folder = shared_folder(t.spark)
    t.events.select(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("raw"), "ts").write.json(f"{folder}/in")
    stream = streaming.stream_file_events(t.spark, f"{folder}/in")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(streaming.EVENT).parquet(f"{folder}/out").groupBy("type").agg(F.count("*").alias("n"), F.min("raw").alias("least"), F.max("raw").alias("most"))


def ingested(t: Tables):
    """The texts of the benchmark as a file each, cut into chunks as they arrive."""
    folder = shared_folder(t.spark)
    t.benchmark.select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"), "item_id").write.partitionBy("item_id").text(f"{folder}/in")
    streaming.stream_ingest(t.spark, f"{folder}/in", f"{folder}/out", f"{folder}/progress").awaitTermination()
    out = t.spark.read.schema("uri string, chunk_index int, text string").parquet(f"{folder}/out")
    return out.select(F.regexp_extract("uri", "item_id=([0-9]+)/", 1).cast("long").alias("item_id"), F.col("chunk_index").cast("long").alias("chunk_index"), F.md5("text").alias("hash"))


def deleted_by_stream(t: Tables, name: str):
    """Delete events of some sources, applied to a stored state."""
    folder = shared_folder(t.spark)
    sources = t.batches.select(F.col("source_uri").alias("uri")).distinct()
    none = F.lit(None).cast("timestamp")
    write_version({"documents": sources.select("uri", F.lit("active").alias("status"), none.alias("deleted_at")), "evidence": t.evidence.select("id", "source_uri", "status")}, f"{folder}/state", "0" * 12)
    sources.filter("uri like '%3' or uri like '%0'").select(F.lit("deleted").alias("type"), F.col("uri").alias("raw"), F.lit("2024-01-01").cast("timestamp").alias("ts")).write.json(f"{folder}/in")
    streaming.stream_lifecycle(streaming.stream_file_events(t.spark, f"{folder}/in"), f"{folder}/state", f"{folder}/progress").awaitTermination()
    return read_version(t.spark, f"{folder}/state", name)


def two_stage(t: Tables, part: str):
    """A stand-in for a model: entities are the words Part and Gear, each next to the other where it knows both."""

    def call(prompt: str) -> str:
        if "Known:" not in prompt:
            return '{"entities": [{"id": "part", "label": "Part", "type": "Thing", "confidence": 0.9}, {"id": "", "label": "Main Gear", "type": "Thing"}, {"id": "no", "label": "No", "confidence": 0.1}]}'
        known = prompt.split("Known: ")[1].split("\n")[0]
        return '{"relations": [{"source": "part", "target": "thing_main_gear", "relation": "NEAR", "evidence": "%s"}]}' % known

    segments = t.segments.select("uri", "chunk_index", F.col("summary").alias("text"))
    return ex.extract_two_stage(segments, call, [("Thing", "A thing")], ["NEAR"])[part]


def semantic(t: Tables, part: str):
    """Labels that differ in case have one vector."""
    rows = mg.dedup_entities(mg.confident(mg.with_entity_ids(t.entities)))
    twice = rows.unionByName(rows.withColumns({"id": F.concat("id", F.lit("_again")), "label": F.upper("label"), "pos": F.col("pos") + 1_000_000, "confidence": F.coalesce("confidence", F.lit(0.8)) + 0.01}))
    relations = mg.prune_dangling(mg.dedup_relations(t.relations), rows)

    def embed(labels: list[str]) -> list[list[float]]:
        found = []
        for x in labels:
            n = int(x.split(" ")[1])
            found.append([1.0 if k == n else 0.0 for k in range(20)])
        return found

    return mg.semantic_dedup(twice, relations, embed)[part]


QUERIES = {
    "load_templates": (
        lambda t: loaded_templates(t).select("template_id", "name", "template_type", F.length("template_hash").cast("long").alias("n_hash")),
        f"SELECT 'parts/part_' || p_partkey::VARCHAR AS template_id, p_name AS name, {KIND} AS template_type, 64::BIGINT AS n_hash FROM {{part}}",
    ),
    "filter_templates": (
        lambda t: tp.filter_templates(part_templates(t), kind="graph", tag="promo", language="zh").select("template_id", "name"),
        "SELECT 'parts/part_' || p_partkey::VARCHAR AS template_id, p_name AS name FROM {part} WHERE p_partkey % 12 = 0 AND lower(p_type) = 'promo'",
    ),
    "search_templates": (
        lambda t: tp.search_templates(part_templates(t), "GEAR").select("template_id", "name"),
        "SELECT 'parts/part_' || p_partkey::VARCHAR AS template_id, p_name AS name FROM {part} WHERE contains(lower(p_name), 'gear') OR contains(lower(p_brand || ' ' || p_type), 'gear') ORDER BY template_id LIMIT 12",
    ),
    "extract_template_examples": (
        lambda t: part_templates(t).select("template_id", F.posexplode(tp.extract_template_examples(F.col("entity_fields")[0]["description"]["en"])).alias("pos", "example")).select("template_id", F.col("pos").cast("long").alias("pos"), "example"),
        f"SELECT 'parts/part_' || p_partkey::VARCHAR AS template_id, pos - 1 AS pos, w AS example FROM {WORDS} x",
    ),
    "template_to_ontology": (
        lambda t: tp.template_to_ontology(part_templates(t)).select("template_id", F.array_join("concepts.concept", ",").alias("concepts"), F.array_join("concepts.description", "|").alias("descriptions"), F.array_join("relations", ",").alias("relations"), "instructions"),
        f"""SELECT 'parts/part_' || p_partkey::VARCHAR AS template_id, CASE WHEN flat THEN 'Type,WearGrade' ELSE upper(left(a, 1)) || substr(a, 2) || ',' || upper(left(b, 1)) || substr(b, 2) || ',WearGrade' END AS concepts,
CASE WHEN flat THEN 'Entity type: ' || replace(p_name, ' ', '/') || ', etc.' ELSE 'A thing of the kind ' || a || '.|A thing of the kind ' || b || '.' END || '|' || {WEAR} AS descriptions,
CASE WHEN flat THEN 'RELATES_TO' ELSE 'MADE_BY,PART_OF' END AS relations,
CASE WHEN p_partkey % 6 = 0 THEN 'Role: Clerk Rules: (1) Keep brands (2) Skip prices' WHEN p_partkey % 3 = 0 THEN 'Role: Clerk' WHEN p_partkey % 2 = 0 THEN 'Rules: (1) Keep brands (2) Skip prices' ELSE 'Take only what the text itself names.' END AS instructions
FROM (SELECT *, p_partkey % 4 IN (1, 3) AS flat, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM {{part}}) p""",
    ),
    "bilingual_text": (
        lambda t: part_templates(t).select("template_id", tp.bilingual_text(F.col("entity_fields")[1]["description"]).alias("text")),
        f"SELECT 'parts/part_' || p_partkey::VARCHAR AS template_id, {WEAR} AS text FROM {{part}}",
    ),
    "scan_inventory": (inventory, "SELECT coalesce(source, 'none') AS source, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_bytes FROM {documents} GROUP BY 1"),
    "read_text_files": (read_texts, "SELECT coalesce(source, 'none') AS source, count(*) AS n_lines, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_bytes FROM {documents} GROUP BY 1"),
    "event_records": (
        lambda t: streaming.event_records(event_lines(t)).select("conn_id", "line_no", "type", "raw"),
        "SELECT user_id AS conn_id, event_id * 2 + 1 AS line_no, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'message' END AS type, event_id::VARCHAR AS raw FROM {events}",
    ),
    "stream_event_lines": (
        events_by_lines,
        "SELECT user_id AS conn_id, event_id * 2 + 1 AS line_no, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'message' END AS type, event_id::VARCHAR AS raw FROM {events}",
    ),
    "stream_file_events": (file_events, "SELECT event_type AS type, count(*) AS n, min(user_id::VARCHAR) AS least, max(user_id::VARCHAR) AS most FROM {events} GROUP BY 1"),
    "stream_ingest": (
        ingested,
        "SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY s) - 1 AS chunk_index, md5(substr(text, s + 1, 1000)) AS hash FROM (SELECT item_id, text, unnest(CASE WHEN length(text) <= 1000 THEN [0] ELSE generate_series(0, length(text) - 1, 900) END) AS s FROM (SELECT item_id, replace(text, chr(10), ' ') || chr(10) AS text FROM {benchmark}) a) b WHERE regexp_matches(substr(text, s + 1, 1000), '\\S')",
    ),
    "stream_lifecycle": (lambda t: deleted_by_stream(t, "documents").select("uri", "status"), "SELECT DISTINCT source_uri AS uri, CASE WHEN source_uri LIKE '%3' OR source_uri LIKE '%0' THEN 'source_deleted' ELSE 'active' END AS status FROM {batches}"),
    "stream_lifecycle_evidence": (lambda t: deleted_by_stream(t, "evidence").select("id", "status"), "SELECT id, CASE WHEN source_uri LIKE '%3' OR source_uri LIKE '%0' THEN 'stale' ELSE status END AS status FROM {evidence}"),
    "extract_two_stage": (
        lambda t: two_stage(t, "relations").select("uri", "chunk_index", "source", "target", "relation", "evidence"),
        "SELECT uri, chunk_index, 'part' AS source, 'thing_main_gear' AS target, 'NEAR' AS relation, 'part, thing_main_gear' AS evidence FROM {segments}",
    ),
    "extract_two_stage_entities": (lambda t: two_stage(t, "entities").select("uri", "chunk_index", "id"), "SELECT uri, chunk_index, unnest(['part', 'thing_main_gear']) AS id FROM {segments}"),
    "semantic_dedup": (
        lambda t: semantic(t, "entities").select("uri", "id"),
        "SELECT DISTINCT uri, first(CASE WHEN id = '' THEN 'product_' || replace(lower(label), ' ', '_') ELSE id END ORDER BY coalesce(confidence, 0.8) DESC, chunk_index, pos) OVER (PARTITION BY uri, label) || '_again' AS id FROM (SELECT DISTINCT ON (uri, label, id = '') * FROM {entities} WHERE coalesce(confidence, 1.0) >= 0.5 ORDER BY uri, label, id = '', chunk_index, pos) e",
    ),
}
