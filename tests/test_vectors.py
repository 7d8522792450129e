"""The metric join and the inverted lists against brute force; counting within rows against plain counts."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.functions import inverted_lists as il
from kgspark.functions import metric_join as mj
from kgspark.functions import text as tx
from kgspark.functions import vectors as vx


def clustered(n, k, dims, spread, seed=1):
    r = np.random.default_rng(seed)
    c = r.normal(size=(k, dims))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c[r.integers(0, k, n)] + r.normal(size=(n, dims)) * spread


def frame(spark, x, block):
    return spark.createDataFrame([(i, v, b) for i, (v, b) in enumerate(zip(x.tolist(), block, strict=True))], "id long, vector array<double>, part string").repartition(3)


@pytest.mark.parametrize("threshold", [0.88, 0.3])
def test_pairs_against_brute_force(spark, monkeypatch, threshold):
    """A large block of clusters, copies and opposite vectors, small blocks, and rows without a direction."""
    monkeypatch.setattr(mj, "TILE_ROWS", 60)
    monkeypatch.setattr(mj, "PIVOT_ROWS", 10)
    monkeypatch.setattr(mj, "PART_ROWS", 150)
    x = np.concatenate([clustered(500, 12, 16, 0.08), np.repeat(clustered(1, 1, 16, 0), 90, 0), -clustered(30, 12, 16, 0.08), clustered(40, 3, 16, 0.2)])
    block = ["big"] * 620 + ["one"] * 20 + ["two"] * 20
    rows = frame(spark, x, block).union(spark.createDataFrame([(900, [0.0] * 16, "big"), (901, None, "big"), (902, [float("nan")] * 16, "big"), (903, [1.0, 2.0], "big"), (None, [1.0] * 16, "big"), (904, [1.0] * 16, None)], "id long, vector array<double>, part string"))
    got = {(r.a, r.b): r.similarity for r in vx.similar_pairs(rows, "part", "id", threshold).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j): s[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if block[i] == block[j] and s[i, j] >= threshold}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert vx.similar_pairs(rows.limit(0), "part").count() == 0


def test_few_pairs_are_compared(spark, tmp_path):
    x = clustered(5000, 100, 64, 0.03)
    width = math.acos(0.88)
    rows = mj.unit_rows(frame(spark, x, ["b"] * len(x)), "part", "id", vx.dot(F.col("vector"), F.col("vector")))
    _, met = mj.tiled(mj.cells(rows, width, f"{tmp_path}/a"), width, f"{tmp_path}/b")
    assert mj.compared(met).first()[0] < 0.05 * len(x) * (len(x) - 1) / 2


def brute(x, asked, k):
    s = x[asked] @ x.T
    return {(q, k2 + 1): (j, s[i, j]) for i, q in enumerate(asked) for k2, j in enumerate(sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k])}


@pytest.mark.parametrize(("spread", "share"), [(0.05, 0.5), (1.0, 1.0)])
def test_search_against_scan(spark, tmp_path, monkeypatch, spread, share):
    monkeypatch.setattr(il, "PART_ROWS", 40)
    monkeypatch.setattr(il, "BLOCK_QUERIES", 3)
    x = clustered(600, 20, 16, spread) * np.random.default_rng(2).uniform(0.5, 2, (600, 1))
    x[100:130] = x[100]  # ties
    rows = frame(spark, x, ["b"] * 600).withColumnRenamed("id", "chunk_id")
    odd = spark.createDataFrame([(700, None), (701, [1.0]), (702, [float("nan")] * 16)], "chunk_id long, vector array<double>")
    asked = list(range(0, 600, 50))
    queries = rows.filter(F.col("chunk_id").isin(asked)).select(F.col("chunk_id").alias("query_id"), "vector").union(spark.createDataFrame([(999, None)], "query_id long, vector array<double>"))
    index = il.build_index(rows.select("chunk_id", "vector").union(odd), f"{tmp_path}/index")
    found, looked = il.search(index, queries, 5, f"{tmp_path}/s")
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in found.collect()}
    want = brute(x, asked, 5)
    assert got.keys() == want.keys() and all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 1e-9 for k, v in want.items())
    assert looked.distinct().count() <= share * len(asked) * len(index.sizes)
    flat = {(r.query_id, r["rank"]): r.chunk_id for r in vx.flat_search(rows, queries.filter("vector is not null")).collect()}
    assert flat == {k: v[0] for k, v in want.items()}


def test_search_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "chunk_id long, vector array<double>")
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, vector array<double>")
    ask = few.select(F.col("chunk_id").alias("query_id"), "vector")
    assert vx.vector_search(none, ask).count() == 0 and vx.vector_search(few, ask.limit(0)).count() == 0
    assert {(r.query_id, r.chunk_id) for r in vx.vector_search(few, ask).collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


TEXTS = [None, "", "   ", "alpha Beta ALPHA beta\tgamma\n\ngamma short a-b_c1 " * 3, "ünïcode ünïcode straße İstanbul", "tie-one tie-two tie-two tie-one", "long " * 40_000 + "words"]


def test_counting_within_rows(spark):
    docs = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(TEXTS)] + [(None, "again again", "x")], "uri string, text string, low string").repartition(2)
    tags, vectors = tx.keyword_tags(docs), vx.hashed_embedding(docs)
    for d in (tags, vectors):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
    low = {r.uri: r.low or "" for r in docs.select("uri", F.lower("text").alias("low")).collect()}
    got = {}
    for r in tags.collect():
        got.setdefault(r.uri, {})[r["rank"]] = (r.tag, r.n)
    for uri, t in low.items():
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t.strip(" ")) if len(w) >= 5]
        first = {w: words.index(w) for w in set(words)}
        want = sorted(Counter(words).items(), key=lambda x: (-x[1], first[x[0]]))[:8]
        assert got.get(uri, {}) == {k + 1: x for k, x in enumerate(want)}
    sums = {}
    for r in vectors.collect():
        sums.setdefault(r.uri, {})[r.bucket] = r.value
    for uri, t in low.items():
        v = Counter()
        for w in re.findall(vx.TOKEN, t):
            d = hashlib.sha256(w.encode()).digest()
            v[int.from_bytes(d[:4], "big") % 64] += -1 if d[4] % 2 else 1
        size = math.sqrt(sum(n * n for n in v.values()))
        assert sums.get(uri, {}) == pytest.approx({b: n / size for b, n in v.items() if n})
