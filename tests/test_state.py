"""Versions by buckets, streams with state, the order of commits, and upserts with ties."""

import json

import pytest
from pyspark.sql import functions as F

from kgspark import streaming
from kgspark.operators import graph as g
from kgspark.operators import review as r
from kgspark.operators import state as st


def run(spark, folder, name):
    q = streaming.stream_lifecycle(streaming.stream_file_events(spark, f"{folder}/in"), f"{folder}/state", f"{folder}/{name}")
    q.awaitTermination(120)
    assert q.exception() is None


def test_batch_rewrites_only_its_buckets(spark, tmp_path):
    written = {}
    for n in (300, 3000):
        top = tmp_path / str(n)
        docs = spark.range(n).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("uri"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("deleted_at"))
        evidence = docs.select(F.concat(F.lit("e"), "uri").alias("id"), F.col("uri").alias("source_uri"), "status")
        st.write_version({"documents": docs, "evidence": evidence}, f"{top}/state", "0" * 12)
        (top / "in").mkdir()
        (top / "in" / "1.json").write_text(json.dumps({"type": "deleted", "raw": "u7", "ts": "2024-01-01T00:00:00Z"}) + "\n")
        run(spark, top, "check")
        folders = [p.name for p in (top / "state" / "documents" / f"version={1:012d}").iterdir() if p.name.startswith("_bucket")]
        assert len(folders) == 1
        written[n] = spark.read.parquet(f"{top}/state/documents/version={1:012d}").count()
        gone = st.read_version(spark, f"{top}/state", "documents").filter("status <> 'active'").collect()
        assert [d.uri for d in gone] == ["u7"] and st.read_version(spark, f"{top}/state", "documents").count() == n
        assert st.read_version(spark, f"{top}/state", "evidence").filter("status = 'stale'").count() == 1
        assert st.read_version(spark, f"{top}/state", "documents", "0" * 12).filter("status <> 'active'").count() == 0
        run(spark, top, "again")  # the same batch once more, as after a lost driver: the same version
        assert [d.uri for d in st.read_version(spark, f"{top}/state", "documents").filter("status <> 'active'").collect()] == ["u7"]
        assert st.manifest(spark, f"{top}/state")[0] == f"{1:012d}"
    assert written[3000] <= 3000 / st.BUCKETS * 2


def test_batch_without_uris_and_empty_state(spark, tmp_path):
    docs = spark.createDataFrame([], "uri string, status string, deleted_at timestamp")
    st.write_version({"documents": docs, "evidence": docs.select(F.col("uri").alias("id"), F.col("uri").alias("source_uri"), "status")}, f"{tmp_path}/state", "0" * 12)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"type": "created", "raw": "u", "ts": "2024-01-01T00:00:00Z"}\n{"type": "deleted", "raw": null, "ts": null}\n')
    run(spark, tmp_path, "check")
    version, rows = st.manifest(spark, f"{tmp_path}/state")
    assert version == f"{1:012d}" and all(x.bucket < 0 for x in rows)
    assert st.read_version(spark, f"{tmp_path}/state", "documents").collect() == []


def test_event_type_is_carried(spark, tmp_path):
    """An event line in one file, its data line in the next: one typed row, and message after it."""
    (tmp_path / "in").mkdir()
    parts = [
        [(1, 1, "event: created"), (2, 1, "data: a:b"), (3, 1, ": note"), (3, 2, None)],
        [(1, 2, ""), (1, 3, "data: u1"), (1, 4, "data:u2"), (2, 2, "event:"), (3, 3, "event: x"), (3, 4, "event: moved")],
        [(2, 3, "data: u3"), (3, 5, "data:"), (2, 4, "eventual: no")],
    ]
    got = []
    for k, lines in enumerate(parts):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"conn_id": c, "line_no": n, "line": x}) + "\n" for c, n, x in lines))
        q = streaming.typed_events(streaming.stream_event_lines(spark, str(tmp_path / "in")))
        q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        got.append(spark.read.schema("conn_id long, line_no long, type string, raw string").parquet(str(tmp_path / "out")).count())
    rows = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [1, 3, 5]
    assert rows == [(1, 3, "created", "u1"), (1, 4, "message", "u2"), (2, 1, "message", "a:b"), (2, 3, "", "u3"), (3, 5, "moved", "")]
    table = spark.createDataFrame([x for p in parts for x in p], streaming.LINES)
    assert sorted(map(tuple, streaming.event_records(table).collect())) == rows


def test_later_batch_wins(spark):
    """A node at a late place of an early batch and at the first place of a later one."""
    batches = spark.sql("SELECT * FROM VALUES ('b1', 'd1', 'me', 'candidate', array('t'), timestamp'2024-01-05', cast(NULL AS timestamp)), ('b2', 'd2', 'me', 'candidate', array('t'), timestamp'2024-02-01', NULL) v(id, source_uri, requested_by, status, template_ids, created_at, committed_at)")
    payload = F.struct(*(F.col(c).alias(c) for c in r.PAYLOAD))
    raw = [("i1", "b1", 8, "node", "x", "old", "", ""), ("i2", "b2", 0, "node", "x", "new", "", ""), ("i3", "b1", 9, "edge", "", "", "x", "y"), ("i4", "b2", 1, "edge", "", "", "x", "y")]
    flat = spark.createDataFrame(raw, "iid string, batch_id string, seq long, kind string, id string, label string, source string, target string")
    flat = flat.withColumns({"type": F.lit("T"), "description": F.lit(""), "relation": F.lit("R"), "evidence": F.col("batch_id")}).withColumn("payload", payload)
    items = flat.select(F.col("iid").alias("id"), "batch_id", "seq", "kind", "payload", F.lit(0.9).alias("confidence"), F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("review_note"))
    nodes = spark.createDataFrame([("entity://x", "x", "stored", "", "T", "L2", 0.5, True)], "uri string, id string, label string, summary string, type string, layer string, confidence double, accessible boolean")
    edges = spark.createDataFrame([], "id string, src_uri string, dst_uri string, relation string, layer string, owner_scope string, source_file_uri string, visibility string, evidence string, confidence double")
    evidence = spark.createDataFrame([], "id string, graph_item_id string, source_uri string, batch_id string, template_id string, evidence_text string, confidence double, status string, created_at timestamp")
    links = spark.createDataFrame([], "id string, source_uri string, target_uri string, relation string, layer string, owner_scope string, source_file_uri string, visibility string, created_by string, created_at timestamp")
    out = r.commit_batch(batches, items.repartition(3), nodes, edges, evidence, links)
    assert {n.uri: n.label for n in out["nodes"].collect()} == {"entity://x": "new", "d1": "d1", "d2": "d2", "entity://y": "y"}
    assert [(e.source_file_uri, e.evidence) for e in out["edges"].filter("relation = 'R'").collect()] == [("d2", "b2")]


@pytest.mark.parametrize("parts", [1, 3])
def test_upsert_ties(spark, parts):
    """Equal seq: the same row, whatever the order of tasks; null seq is the lowest of the new rows, but above the old one."""
    old = spark.createDataFrame([("k", "old"), ("m", "old")], "id string, v string")
    new = spark.createDataFrame([("k", "a", 1), ("k", "b", 1), ("k", "c", 0), ("m", "n", None)], "id string, v string, seq long").repartition(parts)
    assert {x.id: x.v for x in st.upsert(old, new, ["id"]).collect()} == {"k": "b", "m": "n"}
    nodes = spark.createDataFrame([("u", "old"), (None, "z")], "uri string, v string")
    fresh = spark.createDataFrame([("u", "a", 1), ("u", "b", 1), (None, "y", 5)], "uri string, v string, seq long").repartition(parts)
    assert list(map(tuple, g.upsert_nodes(nodes, fresh).collect())) == [("u", "b")]
    assert "Window" not in g.upsert_nodes(nodes, fresh)._jdf.queryExecution().executedPlan().toString()
