"""Edges of a commit: against a plain version, and what of them is shuffled and written."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from kgspark import plans
from kgspark.operators import graph as g
from kgspark.operators import review as r
from kgspark.plans import domain

SF = "/root/testdata/sf0.001"
EDGE = "id string, src_uri string, dst_uri string, relation string, layer string, owner_scope string, source_file_uri string, visibility string, evidence string, confidence double"
ITEM = "id string, batch_id string, seq long, kind string, payload struct<id:string,label:string,type:string,description:string,source:string,target:string,relation:string,evidence:string>, confidence double, status string, review_note string"
BATCH = "id string, source_uri string, requested_by string, status string, template_ids array<string>, created_at timestamp, committed_at timestamp"


def edge(key, src, dst, relation="R", owner="old"):
    return (key, src, dst, relation, "L2", owner, None, "team", "", 0.5)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def shuffled(spark, df):
    """Rows that are written for shuffles while df is computed."""
    sc, none = spark.sparkContext, spark._jvm.java.util.ArrayList()

    def total():
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(spark._jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_mentions_of_given_documents_go(spark):
    """All of them, also without an id or end; an edge of another relation stays, whatever its id and ends."""
    old = [edge("m", "d", "e", "MENTIONS"), edge(None, "d", None, "MENTIONS"), edge("m", "d", "e", "R"), edge("m", "d", "e", None), edge("m", "x", "e", "MENTIONS"), edge("n", None, "e", "MENTIONS")]
    out = g.clear_mentions(spark.createDataFrame(old, EDGE), spark.createDataFrame([("d",), ("y",), (None,)], "uri string"))
    assert rows(out) == sorted(map(repr, old[2:]))


@pytest.mark.parametrize("bits", [1 << 28, 512, 1024])
def test_new_edges_over_old_ones(spark, monkeypatch, bits):
    """The highest seq of equal new keys, and no old row of these; all other old rows, repeated ones and those with nulls, too. In small maps most rows seem to have a partner."""
    monkeypatch.setattr(g, "MAP_BITS", bits)
    rnd = random.Random(4)
    name = lambda: rnd.choice([None, "", "a", "b", "c", "d"])
    old = [edge(name(), name(), name()) for _ in range(400)] + [edge("k", "a", "a")] * 3
    new = [(*edge(name(), name(), name(), owner=f"new{k}"), k) for k in range(60)]
    last = {x[:3]: x[:-1] for x in new}
    want = [x for x in old if x[:3] not in last or None in x[:3]] + list(last.values())
    nodes = spark.createDataFrame([], "uri string, id string, label string, summary string, type string, layer string, confidence double, accessible boolean")
    out = g.upsert_edges(nodes, spark.createDataFrame(old, EDGE), spark.createDataFrame(new, EDGE + ", seq long").repartition(3))[1]
    assert rows(out) == sorted(map(repr, want)) and len(want) > 200


def test_old_edges_stay_where_they_are(spark):
    """Of 30,000 stored edges none is shuffled but those that a commit of three items changes."""
    none = spark.range(30000, numPartitions=3).select(F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("doc"), "id").alias("src_uri"), F.lit("entity://x").alias("dst_uri"), F.when(F.col("id") % 2 == 0, "MENTIONS").otherwise("R").alias("relation"))
    old = none.select("*", *(F.lit("").alias(c) for c in ("layer", "owner_scope", "source_file_uri", "visibility", "evidence")), F.lit(0.5).alias("confidence"))
    at = datetime.datetime(2024, 1, 1)
    batches = spark.createDataFrame([("b1", "doc2", "me", "candidate", ["t"], at, None), ("b2", "doc4", "me", "candidate", ["t"], at, None)], BATCH)
    items = spark.createDataFrame([("i1", "b1", 1, "node", ("x", "X", "T", "", "", "", "", ""), 0.9, "accepted", None), ("i2", "b1", 2, "edge", ("", "", "", "", "x", "y", "R", ""), 0.9, "accepted", None), ("i3", "b2", 1, "edge", ("", "", "", "", "x", "z", "R", ""), 0.9, "accepted", None)], ITEM)
    out = r.commit_edges(batches, items, old)
    assert shuffled(spark, out) < 200
    assert out.count() == 30000 - 2 + 3


@pytest.mark.parametrize("bits", [1 << 28, 512])
def test_edges_of_many_batches(spark, tmp_path, monkeypatch, bits):
    """As commits one after another: mentions of a source's last batch, later items over earlier ones and over stored edges; missing relations are one."""
    monkeypatch.setattr(g, "MAP_BITS", bits)
    rnd = random.Random(9)
    batches = [(f"b{k:02d}", f"doc{k % 5}", f"u{k % 3}", "candidate", ["t"], datetime.datetime(2024, 1, 1 + rnd.randrange(20)), None) for k in range(25)]
    items = []
    for k in range(300):
        kind = rnd.choice(["node", "edge", "edge"])
        e = rnd.choice("xyz"), rnd.choice(["x", "y", "", None]), rnd.choice(["R", "S", "", None, "RELATES_TO"])
        items.append((f"i{k:03d}", f"b{rnd.randrange(26):02d}", rnd.randrange(4), kind, (rnd.choice("xyzw"), "L", "T", "", *e, f"ev{k}"), k / 1000, rnd.choice(["accepted", "accepted", "rejected"]), None))
    old = [edge(f"edge:x:{q}:y", "entity://x", "entity://y", q) for q in ("R", "T")] + [edge(f"mention:doc{k}:q", f"doc{k}", "entity://q", "MENTIONS") for k in range(8)]
    state = {x[:3]: x for x in old}
    for b in sorted(batches, key=lambda b: (b[5], b[0])):
        own = sorted((i for i in items if i[1] == b[0] and i[6] == "accepted"), key=lambda i: (i[2], i[0]))
        state = {k: x for k, x in state.items() if not (x[3] == "MENTIONS" and x[1] == b[1])}
        for i in own:
            p = i[4]
            if i[3] == "node":
                key = (f"mention:{b[1]}:{p[0]}", b[1], f"entity://{p[0]}")
                most = max([i[5]] + [state[key][9] for _ in range(key in state)])
                state[key] = (*key, "MENTIONS", "L1", b[2], b[1], "team", "", most)
            elif p[4] and p[5]:
                key = (f"edge:{p[4]}:{p[6] or ''}:{p[5]}", f"entity://{p[4]}", f"entity://{p[5]}")
                state[key] = (*key, p[6] or "RELATES_TO", "L2", b[2], b[1], "team", p[7], i[5])
    given = spark.createDataFrame(batches, BATCH), spark.createDataFrame(items, ITEM).repartition(3), spark.createDataFrame(old, EDGE)
    assert rows(r.commit_edges(*given)) == sorted(map(repr, state.values()))
    assert rows(r.commit_edges(*given, str(tmp_path / "whole"))) == sorted(map(repr, state.values()))
    few = r.commit_edges(*given[:2], given[2].select("id", "src_uri", "dst_uri", "relation"), str(tmp_path / "few"))
    assert rows(few) == sorted(repr(x[:4]) for x in state.values())
    assert str(few._jdf.queryExecution().executedPlan().toString()).count("Window [") == 0  # what is written first isn't planned again


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["commit_batch_edges", "commit_batch_edge_sources"])
def test_no_derived_table_is_written(spark, monkeypatch, name):
    monkeypatch.setattr(domain, "_kept", {})
    monkeypatch.setattr(domain, "written", None)
    assert plans.QUERIES[name](spark, SF).count() > 0
