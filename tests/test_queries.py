"""Every query against its SQL on the smallest tables; expectations for single operators."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kgspark import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda x: "null" if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_two_stage_failures(spark):
    """Segments whose first call fails still ask for relations, without entities; the other way round entities stay."""
    from kgspark.operators.extract import extract_two_stage

    def call(prompt):
        text = prompt.split("Text:\n")[1]
        if "Known:" in prompt:
            return {"b": None}.get(text, '{"relations": [{"source": "x", "target": "%s", "relation": "R"}]}' % prompt.split("Known: ")[1].split("\n")[0])
        return {"a": '{"entities": [{"id": "x", "label": "X", "type": "T"}]}', "b": '{"entities": [{"id": "y", "label": "Y", "type": "T"}]}', "d": '{"entities": []}'}[text]

    s = spark.createDataFrame([(t, 0, t) for t in "abcd"], "uri string, chunk_index int, text string")
    out = {k: v.collect() for k, v in extract_two_stage(s, call, [("T", "t")], ["R"]).items()}
    assert {(r.uri, r.id) for r in out["entities"]} == {("a", "x"), ("b", "y")}
    assert {(r.uri, r.target) for r in out["relations"]} == {("a", "x"), ("c", ""), ("d", "")}
    assert {(r.uri, r.stage) for r in out["failures"]} == {("c", "nodes"), ("b", "edges")}


def test_semantic_dedup(spark):
    """Near labels become the surest, the first of equals; a failing function changes nothing."""
    from kgspark.operators.merge import semantic_dedup

    e = spark.createDataFrame([("d", 0, 0, "car", "Car", 0.7), ("d", 0, 1, "auto", "Auto", 0.9), ("d", 1, 0, "tree", "Tree", None), ("e", 0, 0, "auto", "Auto", 0.5)], "uri string, chunk_index int, pos int, id string, label string, confidence double")
    r = spark.createDataFrame([("d", 0, 0, "car", "tree", "R"), ("d", 0, 1, "auto", "tree", "R"), ("d", 0, 2, "tree", "car", "R"), ("e", 0, 0, "auto", "auto", "R")], "uri string, chunk_index int, pos int, source string, target string, relation string")
    vector = {"Car": [1.0, 0.1], "Auto": [1.0, 0.0], "Tree": [0.0, 1.0]}
    out = {k: v.collect() for k, v in semantic_dedup(e, r, lambda xs: [vector[x] for x in xs]).items()}
    assert {(x.uri, x.id) for x in out["entities"]} == {("d", "auto"), ("d", "tree"), ("e", "auto")}
    assert sorted((x.uri, x.source, x.target) for x in out["relations"]) == [("d", "auto", "tree"), ("d", "tree", "auto"), ("e", "auto", "auto")]
    assert [tuple(x) for x in out["merged"]] == [("d", "car", "auto")]
    same = semantic_dedup(e, r, lambda xs: 1 / 0)
    assert same["entities"].count() == 4 and same["relations"].count() == 4


def test_semantic_dedup_of_many_documents(spark, monkeypatch):
    """Documents of few entities need no metric join; chains, failing vectors, unlike dimensions and ties, against a plain version, in both ways."""
    from kgspark.operators import merge

    rng = np.random.default_rng(5)
    vector = {f"l{i}": [float(x) for x in np.cos([i * 0.35, i * 0.35 + 1.6])] for i in range(18)} | {"short": [1.0], "short2": [2.0], "zero": [0.0, 0.0], "null": [1.0, None], "inf": [float("inf"), 1.0]}
    names, rows = list(vector), []
    for d in range(60):
        for k in range(int(rng.integers(1, 9))):
            rows.append((f"d{d}", k // 2, k % 2, f"e{k}", names[int(rng.integers(len(names)))], [None, 0.5, 0.8, 0.9, float("nan")][int(rng.integers(5))]))
    rows += [("big", k, 0, f"e{k:02d}", names[k % 20], 0.8) for k in range(40)] + [(None, 0, 0, "e0", "l1", 0.9), (None, 0, 1, "e1", "l1", 0.9)]
    e = spark.createDataFrame(rows, "uri string, chunk_index int, pos int, id string, label string, confidence double")
    r = spark.createDataFrame([], "uri string, chunk_index int, pos int, source string, target string, relation string")

    def near(a, b):
        x, y = vector[a], vector[b]
        if None in x + y or len(x) != len(y) or not np.isfinite(x + y).all() or not any(x) or not any(y):
            return False
        return np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.88

    want = set()
    for d in {x[0] for x in rows} - {None}:
        own = sorted((x for x in rows if x[0] == d), key=lambda x: (np.inf if x[5] is not None and np.isnan(x[5]) else -(0.8 if x[5] is None else x[5]), x[1], x[2], x[3]))
        best = {}
        for x in own:
            if x[3] not in best:
                todo = [x]
                while todo:
                    y = todo.pop()
                    if y[3] not in best:
                        best[y[3]] = x[3]
                        todo += [z for z in own if near(y[4], z[4])]
        want |= {(d, i, c) for i, c in best.items() if i != c}
    call = lambda xs: [vector[x] for x in xs]
    with monkeypatch.context() as m:
        m.setattr(merge, "similar_pairs", None)
        assert {tuple(x) for x in merge.semantic_dedup(e, r, call)["merged"].collect()} == want and len(want) > 60
    with monkeypatch.context() as m:
        m.setattr(merge, "DOC_ROWS", 20)
        m.setattr(merge, "GROUP_ROWS", 50)
        assert {tuple(x) for x in merge.semantic_dedup(e, r, call)["merged"].collect()} == want


def test_paragraph_chunks():
    from kgspark.functions.text import paragraph_chunks

    assert paragraph_chunks("  ", 10, 2) == [] and paragraph_chunks("abc", 10, 2) == ["abc"]
    assert paragraph_chunks("aaaaaaa\n\nbbbbbbbbbb", 12, 3) == ["aaaaaaa\n\n", "a\n\nbbbbbbbbb", "bbbb"]
    text = "one.\n\n" * 400 + "x" * 2500
    chunks = paragraph_chunks(text, 1000, 100)
    assert all(len(c) <= 1000 for c in chunks) and text.startswith(chunks[0]) and chunks[0].endswith("\n\n") and text.endswith(chunks[-1])
    assert sum(map(len, chunks)) - 100 * (len(chunks) - 1) == len(text)


def test_merge(spark):
    from kgspark.operators import merge

    e = spark.createDataFrame([("d", 0, 0, "x", 0.9), ("d", 0, 1, "y", 0.9), ("d", 1, 0, "y", 0.8), ("d", 1, 1, "z", 0.8)], "uri string, chunk_index int, pos int, id string, confidence double")
    r = spark.createDataFrame([("d", 0, 0, "x", "y", "R"), ("d", 1, 0, "x", "y", "R"), ("d", 1, 1, "x", "z", "R"), ("d", 1, 2, "x", "gone", "R"), ("d", 1, 3, "z", "z", "R")], "uri string, chunk_index int, pos int, source string, target string, relation string")
    t = spark.createDataFrame([("d", 0, 0, "a"), ("d", 0, 1, "B"), ("d", 1, 0, "b"), ("d", 1, 1, "c")], "uri string, chunk_index int, pos int, tag string")
    s = spark.createDataFrame([("d", 0, " ", 0.9), ("d", 1, "two", 0.8)], "uri string, chunk_index int, summary string, confidence double")
    out = merge.merge_extractions(s, e, r, t, t)
    assert {x.id for x in out["entities"].collect()} == {"x", "y", "z"}
    assert {(x.source, x.target) for x in out["relations"].collect()} == {("x", "y"), ("x", "z"), ("z", "z")}
    assert [x.tag for x in out["tags"].orderBy("rank").collect()] == ["a", "B", "c"]
    assert out["extractions"].first()[1:] == ("two", 0.8)
    assert out["key_points"].count() == 4


def test_components(spark):
    from kgspark.operators.components import connected_components

    chain = [(i + 1, i) for i in range(40)] + [(100, 101), (None, 5), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_commit_twice(spark):
    """Three items, one accepted edge, one rejected: 1 committed, 2 skipped, 1 evidence; then 0 and 3."""
    from kgspark.operators import review

    requests = spark.createDataFrame([("s", "me", ["general/places"], "2024-01-01")], "source_uri string, requested_by string, template_ids array<string>, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    entities = spark.createDataFrame([("s", "svc-api", "svc-api", "Component", "", 0.91), ("s", "db-main", "db-main", "Database", "", 0.83)], "source_uri string, id string, label string, type string, description string, confidence double")
    relations = spark.createDataFrame([("s", "svc-api", "db-main", "STORES_IN", "it does", 0.88)], "source_uri string, source string, target string, relation string, evidence string, confidence double")
    batches, items = review.create_batches(requests, entities, relations)
    assert items.count() == 3
    edge = items.filter("kind = 'edge'").first()
    node = items.filter("kind = 'node'").first()
    edits = spark.createDataFrame([(edge.id, edge.batch_id, 1, "accepted", None, "ok"), (node.id, node.batch_id, 2, "rejected", {"label": "new"}, None), ("none", node.batch_id, 3, "accepted", None, None)], "item_id string, batch_id string, seq int, status string, payload map<string,string>, review_note string")
    items, errors = review.apply_edits(items, edits, batches)
    assert [r.error for r in errors.collect()] == ["unknown item"]
    assert items.filter("payload.label = 'new' and status = 'rejected'").count() == 1
    none = spark.createDataFrame([], "id string, graph_item_id string, source_uri string, batch_id string, template_id string, evidence_text string, confidence double, status string, created_at timestamp")
    nodes = spark.createDataFrame([], "uri string, id string, label string, summary string, type string, layer string, confidence double, accessible boolean")
    edges = spark.createDataFrame([], "id string, src_uri string, dst_uri string, relation string, layer string, owner_scope string, source_file_uri string, visibility string, evidence string, confidence double")
    links = spark.createDataFrame([], "id string, source_uri string, target_uri string, relation string, layer string, owner_scope string, source_file_uri string, visibility string, created_by string, created_at timestamp")
    out = review.commit_batch(batches, items, nodes, edges, none, links)
    assert tuple(out["summary"].first())[1:] == (1, 2, 1)
    assert {r.uri for r in out["nodes"].collect()} == {"s", "entity://svc-api", "entity://db-main"} and out["links"].count() == 1
    again = review.commit_evidence(out["items"], out["batches"], out["evidence"])
    assert tuple(review.commit_summary(out["items"], batches, again).first())[1:] == (0, 3, 0)


def test_responses(spark):
    from kgspark.operators.extract import extract_with, normalize_responses, parse_responses

    texts = ['{"summary": "s", "entities": [{"id": "", "label": "Project Nexus", "type": "Project", "confidence": 0.8}, {"id": "x", "label": "x", "type": "T", "confidence": 0.3}]}', "no", "", '```json\n{"summary": "f"}\n```', 'so: {"summary": "p"} there']
    d = spark.createDataFrame([(str(i), 0, x) for i, x in enumerate(texts)], "uri string, chunk_index int, content string")
    good, bad = parse_responses(d)
    assert {r.uri: r.parsed.summary for r in good.collect()} == {"0": "s", "3": "f", "4": "p"} and bad.count() == 2
    assert [r.id for r in normalize_responses(good)["entities"].collect()] == ["project_project_nexus"]
    p = spark.createDataFrame([("a", 0, "x"), ("b", 0, "fail")], "uri string, chunk_index int, prompt string")
    out = {r.uri: r.error for r in extract_with(p, lambda t: {"x": "ok"}[t]).collect()}
    assert out["a"] is None and "fail" in out["b"]


def test_files_and_streams(spark, tmp_path):
    from kgspark import streaming
    from kgspark.operators.state import read_version, write_version
    from kgspark.sources import files

    src = tmp_path / "in"
    (src / "deep").mkdir(parents=True)
    (src / "a.txt").write_bytes(b"abc \xff def")
    (src / "deep" / "b.md").write_text("x" * 1500)
    (src / "c.png").write_bytes(b"123")
    assert files.scan_inventory(spark, str(src)).count() == 3
    text = {r.filename: r.text for r in files.read_text_files(spark, str(src)).collect()}
    assert text["a.txt"] == "abc � def" and set(text) == {"a.txt", "b.md"}
    q = streaming.stream_ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "check1"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    lines = spark.createDataFrame([(1, 1, "event: created"), (1, 2, "data: u1"), (1, 3, "data: u2"), (2, 1, "data: u3")], "conn_id int, line_no int, line string")
    assert [(r.type, r.raw) for r in streaming.event_records(lines).orderBy("conn_id", "line_no").collect()] == [("created", "u1"), ("message", "u2"), ("message", "u3")]
    state = str(tmp_path / "state")
    docs = spark.sql("SELECT 'u1' AS uri, 'active' AS status, cast(NULL AS timestamp) AS deleted_at UNION ALL SELECT 'u2', 'active', NULL")
    evidence = spark.sql("SELECT 'e' AS id, 'u1' AS source_uri, 'active' AS status")
    write_version({"documents": docs, "evidence": evidence}, state, "0" * 12)
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "1.json").write_text('{"type": "deleted", "raw": "u1", "ts": "2024-01-01T00:00:00Z"}\n')
    q = streaming.stream_lifecycle(streaming.stream_file_events(spark, str(tmp_path / "events")), state, str(tmp_path / "check2"))
    q.awaitTermination(60)
    assert {r.uri: r.status for r in read_version(spark, state, "documents").collect()} == {"u1": "source_deleted", "u2": "active"}
    assert read_version(spark, state, "evidence").first().status == "stale"


def test_templates(spark):
    from kgspark.sources import templates as tp

    t = tp.own_templates(spark)
    concepts = {(r.template_id, r.concept) for r in tp.template_concepts(t).collect()}
    assert {("general/places", "Person"), ("general/places", "RoleInText"), ("general/facts", "SourceLine"), ("systems/services", "Database"), ("geography/storms", "Position"), ("chemistry/reactions", "Amount")} <= concepts
    assert {r.template_id for r in t.collect()} == {i for i, _ in concepts} and ("history/events", "Time") not in concepts
    assert ("systems/services", "STORES_IN") in {(r.template_id, r.relation) for r in tp.template_relations(t).collect()}
    assert tp.template_to_ontology(t).count() == len(tp.OWN) and len({r.template_type for r in t.collect()}) == 8
    assert [r.template_id for r in tp.filter_templates(t, kind="graph", language="zh").collect()] == ["systems/services"]
    assert [r.template_id for r in tp.filter_templates(t, kind="temporal_graph", tag="history").collect()] == ["history/events", "history/lives"]
    assert tp.search_templates(t, "FACT").count() == 1


def test_gate(spark):
    from kgspark.sources.files import extension

    names = {"x.tar.gz": ".gz", ".bashrc": "", "a.": "", "a.b/c": "", "A.PDF": ".pdf", "d/.x.y": ".y"}
    d = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.e for r in d.select("n", extension(F.col("n")).alias("e")).collect()} == names


def test_similar_pairs_of_all_vectors(spark, tmp_path, monkeypatch):
    """Against brute force: ids of 400 and more, one block of most rows, more tiles than one."""
    import numpy as np

    from kgspark.functions import metric_join

    monkeypatch.setattr(metric_join, "TILE_ROWS", 100)
    x = np.random.default_rng(3).normal(size=(450, 8))
    label = [0 if i % 5 else 1 + i % 2 for i in range(450)]
    spark.createDataFrame([(i, v, b) for i, (v, b) in enumerate(zip(x.tolist(), label, strict=True))], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j): float(x[i] @ x[j]) for i in range(450) for j in range(i + 1, 450) if label[i] == label[j] and x[i] @ x[j] >= 0.3}
    got = plans.QUERIES["similar_pairs"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and all(abs(want[r.a, r.b] - r.similarity) < 1e-4 for r in got) and max(b for _, b in want) > 400
    assert {r.id for r in plans.QUERIES["entity_clusters"](spark, str(tmp_path)).collect()} == set(range(450))
    assert plans.QUERIES["canonical_entities"](spark, str(tmp_path)).count() == 450


def test_all_documents_are_matched_and_extracted(spark, tmp_path):
    from kgspark.sources import templates as tp

    texts = ["people and places", "facts of a text", "software services", ""] * 6
    spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()
    every = set(range(1, 25))
    got = run("match_templates")
    assert {(r.doc_id, r.rank) for r in got} == {(i, k) for i in every for k in (1, 2, 3)}
    assert {r.template_id for r in got if r["rank"] == 1 and r.doc_id % 4 == 1} == {"general/places"}
    assert {r.doc_id for r in run("merge_ontologies")} == every
    assert {int(r.uri) for r in run("extract_with")} == {i for i in every if texts[i - 1]}
    d, t = (spark.createDataFrame(x, f"{c}, vector array<float>") for x, c in (([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "doc_id long"), ([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "template_id string")))
    assert [tuple(r) for r in tp.match_templates(d, t, 2).collect()] == [(1, "a", 1.0, 1), (1, "b", 1.0, 2)]
    spark.range(250).selectExpr("id AS vec_id", "array(1.0 * id, 1.0) AS embedding", "0 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert {r.query_id for r in run("vector_search_stated")} == {0, 100, 200}


def test_whole_texts(spark, tmp_path):
    """Texts of 100,000 characters and with quotes, fences and braces behind their beginnings."""
    import hashlib

    tails = ["long " * 20_000, 'a "quoted" \\ one', "```json\n{}\n``` }{", "} \x01\n é🙂"]
    texts = {i: "y" * 60 + tails[i // 12] for i in range(48)}
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {int(r.uri): (r.n, r.hash) for r in plans.QUERIES["parse_responses_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(t), hashlib.md5(t.encode()).hexdigest()) for i, t in texts.items() if i % 4 < 3}
    head = ("Abstract and methodology. ", "Invoice total. ", "The schema of a request; hazard. ", "")
    found = {r.hash for r in plans.QUERIES["document_content_whole"](spark, str(tmp_path)).collect() if r.status == 200}
    assert found == {hashlib.md5((head[i % 4] + t).encode()).hexdigest() for i, t in texts.items() if i % 6 > 2 and i % 12 != 3}
