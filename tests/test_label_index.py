"""Entities of questions by the stored index: the rows of a scan, also after changes; derived tables follow the given files."""

from pyspark.sql import functions as F

from kgspark.operators import label_index as li
from kgspark.operators import qa
from kgspark.operators import state as st
from kgspark.plans.domain import Tables


def nodes_of(spark, labels):
    return spark.createDataFrame([(u, t) for u, t in labels.items()], "uri string, label string")


def test_index_after_changes(spark, tmp_path):
    root = str(tmp_path / "index")
    labels = {f"entity://{i}": f"Green Pump {i} valve" for i in range(30)} | {"entity://x": None, "entity://y": "ab", "doc://1": "Green Pump", "entity://z": "ÄÖ pump"}
    questions = spark.createDataFrame([(1, "green pump"), (2, "ab valve"), (3, "äö"), (4, ""), (5, None), (6, "missing pump")], "question_id long, question string")
    li.write_index(nodes_of(spark, labels), root, "0")
    rows = lambda nodes, index=None: sorted(map(tuple, qa.qa_entities(questions, nodes, index=index).collect()))
    assert rows(None, root) == rows(nodes_of(spark, labels)) != []
    changed = {"entity://3": "red valve", "entity://5": None, "entity://new": "Aa green pump"}
    before = nodes_of(spark, {u: t for u, t in labels.items() if u in changed})
    li.change_index(root, "0", "1", before, nodes_of(spark, changed))
    assert rows(None, root) == rows(nodes_of(spark, labels | changed))
    buckets = {r.bucket for r in st.manifest(spark, root, "1")[1] if r.version == "1" and r.bucket >= 0}
    assert 0 < len(buckets) < st.BUCKETS  # the others stay where they were
    plan = li.look_up(spark, spark.createDataFrame([("pum",)], "gram string"), root).inputFiles()
    assert len({f.rsplit("/", 2)[1] for f in plan}) == 1


def test_derived_tables_follow_their_files(spark, tmp_path):
    path = str(tmp_path / "lineitem.parquet")
    some = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    some.filter("l_orderkey < 20").write.parquet(path)
    first = Tables(spark, str(tmp_path)).flat_items.count()
    assert Tables(spark, str(tmp_path)).flat_items.count() == first
    some.filter(F.col("l_orderkey") < 60).write.mode("overwrite").parquet(path)
    assert Tables(spark, str(tmp_path)).flat_items.count() > first
