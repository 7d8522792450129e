"""Degrees and folder digests against full joins, routes of extraction, candidate ontologies."""

import random

from pyspark.sql import functions as F

from kgspark.operators import degrees as dg
from kgspark.operators import extract as ex
from kgspark.operators import graph as g
from kgspark.operators import lifecycle as lc
from kgspark.operators import review as r


def test_degrees_after_changes(spark, tmp_path):
    rnd = random.Random(3)
    root, uris = str(tmp_path / "d"), [f"entity://n{i}" for i in range(40)] + ["doc://a", "doc://b"]
    edge = lambda some: spark.createDataFrame(some, "id long, src_uri string, dst_uri string")
    edges = {(k, rnd.choice(uris), rnd.choice(uris)) for k in range(60)}
    nodes = spark.createDataFrame([(u,) for u in uris], "uri string")
    dg.write_degrees(nodes, edge(sorted(edges)), root, "0")
    before = {o.uri for o in g.orphan_entities(nodes, edge(sorted(edges))).collect()}
    for step in range(1, 4):
        gone = set(rnd.sample(sorted(edges), 15))
        fresh = {(100 * step + k, rnd.choice(uris), rnd.choice(uris)) for k in range(4)}
        edges = (edges - gone) | fresh
        touched = dg.change_degrees(root, str(step - 1), str(step), edge(sorted(fresh)), edge(sorted(gone)))
        names = {t.uri for t in touched.collect()}
        now = {o.uri for o in g.orphan_entities(nodes, edge(sorted(edges))).collect()}
        assert {o.uri for o in dg.touched_orphans(touched, root, str(step)).collect()} == now & names
        assert now - names <= before
        before = now


def test_diff_by_folders(spark):
    known = [(f"cloudreve://my/f{i // 10}/d{i % 10}.txt", "active") for i in range(200)] + [("cloudreve://my/f1/gone", "source_deleted"), ("local://x", "active")]
    lost = {"cloudreve://my/f3/d4.txt", "cloudreve://my/f7/d0.txt", "cloudreve://my/f7/d1.txt"}
    listing = [(u,) for u, _ in known if u not in lost] + [("cloudreve://my/f9/new.txt",), ("cloudreve://my/f2/d1.txt",)]
    docs, there = spark.createDataFrame(known, "uri string, status string"), spark.createDataFrame(listing, "uri string")
    assert {(s.uri, s.all_stale) for s in lc.inventory_diff(docs, there).collect()} == {(u, False) for u in lost}
    assert {s.all_stale for s in lc.inventory_diff(docs, there.limit(0)).collect()} == {True}
    assert lc.inventory_diff(docs.limit(0), there).count() == 0
    active = docs.filter("status = 'active' and uri like 'cloud%'")
    unlike = lc.unlike_prefixes(lc.prefix_digests(active), lc.prefix_digests(there))
    assert {u.prefix for u in unlike.collect()} == {f"cloudreve://my/f{k}/" for k in (1, 2, 3, 7, 9)}  # of 20 folders; f1 and f2, f9 have more in the listing


def test_routes_of_extraction(spark):
    """Tabular, all segments refused, some refused, short and refused."""
    good = '{"summary": "%s", "tags": ["t"], "entities": [{"label": "Pump", "type": "Thing"}], "relations": [], "key_points": []}'

    def call(prompt):
        text = prompt.split("Text:\n", 1)[1]
        if "BAD" in text and len(text) < 150:
            raise ValueError("refused")
        return "nothing" if "ODD" in text else good % f"{'table' if 'structural' in prompt else 'text'} {len(text)}"

    texts = {"tab": ("T" * 7000, "structural_summary"), "tabbad": ("BAD sheet", "structural_summary"), "all": ("BAD " * 60, "full"), "some": ("BAD " + "x" * 300, None), "short": ("fine", ""), "lost": ("BAD", "full"), "odd": ("ODD " * 50, "full"), "none": (None, "full"), "empty": ("", None)}
    docs = spark.createDataFrame([(k, t, s) for k, (t, s) in texts.items()], "uri string, text string, strategy string")
    out = ex.extract_documents(docs, call, [("Thing", "A thing")], ["NEAR"], threshold=100, size=100, overlap=10)
    assert {x.uri: (x.route, x.asked, x.failed) for x in out["routes"].collect()} == {
        "tab": ("tabular", 1, 0), "tabbad": ("tabular", 1, 1), "all": ("fallback", 4, 3), "some": ("segments", 4, 1), "short": ("single", 1, 0), "lost": ("single", 1, 1), "odd": ("fallback", 4, 4),
    }
    summaries = {}
    for x in out["segments"].orderBy("chunk_index").collect():
        summaries.setdefault(x.uri, []).append(x.summary)
    assert summaries == {"tab": ["table 6000"], "tabbad": ["BAD sheet"], "all": ["text 240"], "some": ["text 100", "text 100", "text 34"], "short": ["text 4"]}
    assert {(x.uri, x.tag) for x in out["tags"].filter("tag = 'tabular_data'").collect()} == {("tabbad", "tabular_data")}
    assert {x.uri: x.error for x in out["failures"].filter("uri in ('lost', 'odd')").collect()} == {"lost": "refused", "odd": "no JSON object"}
    assert {x.uri for x in out["entities"].collect()} == {"tab", "all", "some", "short"}


def test_ontologies(spark):
    batches = spark.createDataFrame([("b1", "s1", "candidate"), ("b2", "s2", "candidate")], "id string, source_uri string, status string")
    c, q = "array<struct<type:string,label:string,description:string>>", "array<struct<relation:string,source:string,target:string,description:string>>"
    rows = [("s1", None, [("A", "x", ""), ("a", "y", ""), (None, "z", ""), ("B", "", "")], None, None), ("s1", "n", [], [("R", "A", "B", None), ("r", "", "", "")], 0.3), ("s2", "", [], None, 0.1), ("s9", "n", [("A", "", "")], None, 1.0)]
    proposed = spark.createDataFrame(rows, f"source_uri string, name string, concepts {c}, relations {q}, confidence double")
    o = r.create_ontologies(batches, proposed.union(proposed))
    assert sorted((x.batch_id, x.name, [y.type for y in x.concepts], [y.relation for y in x.relations], x.confidence) for x in o.collect()) == [("b1", "candidate_ontology", ["A", "B"], [], 0.8), ("b1", "n", [], ["R"], 0.3)]
    items = spark.createDataFrame([("b2", 1, "i", "node", "accepted", 0.5)], "batch_id string, seq long, id string, kind string, status string, confidence double")
    told = {x.id: x for x in r.describe_batch(batches, items, o).collect()}
    assert [y.name for y in told["b1"].ontologies] == ["candidate_ontology", "n"] and told["b1"]["items"] is None and told["b2"].ontologies is None
    found = r.batch_rows(batches, items, o).groupBy("batch_id", "part").agg(F.count("*").alias("n")).collect()
    assert {(x.batch_id, x.part): x.n for x in found} == {("b1", "concept"): 2, ("b1", "relation"): 1, ("b2", "item"): 1}
