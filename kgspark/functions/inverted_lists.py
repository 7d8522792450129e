"""Exact vector search by an inverted-list index.

build_index fits centroids to a bounded sample, puts every vector into the list of its nearest centroid (a partition of a Parquet table) and notes each list's radius. A list can
hold an inner product of at most q c + |q| radius with a query q (Cauchy-Schwarz). A search looks first into the lists of the largest q c that hold k vectors together; their k-th
score then rules out all lists whose bound lies below it, and only what is left is read, in one pass for all queries. So the rows are those of a scan of all
vectors; how many lists are read depends on how clustered these are.

Long lists are dealt into parts, and the queries of a list into blocks, so that no list is one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written

#: Lists at most; sampled rows for each; rows of a list, and queries, that meet at once.
MOST_LISTS, SAMPLE, PART_ROWS, BLOCK_QUERIES = 1024, 8, 20_000, 1000


@dataclass(frozen=True)
class Lists:
    """What the driver knows of an index: at most MOST_LISTS centroids (a row each), radii and sizes; where the vectors are, and under which key."""

    folder: str
    key: str
    kind: str
    centroids: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray

    @property
    def norms(self) -> np.ndarray:
        return np.linalg.norm(self.centroids, axis=1)


def _centroids(x: np.ndarray, many: int) -> np.ndarray:
    """Centroids of sampled rows: farthest first, then three times the mean of what is nearest."""
    first, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(first) < min(many, len(x)) and near.max() > 0:
        first.append(int(np.argmax(near)))
        near = np.minimum(near, ((x - x[first[-1]]) ** 2).sum(1))
    c = x[first]
    for _ in range(3):
        of = _nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(of, minlength=len(c))
        np.add.at(sums, of, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, 1)


def usable(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """Vectors of doubles without null or non-finite components, of one length."""
    v = vectors.withColumn("vector", F.transform("vector", lambda x: x.cast("double")))
    ok = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(F.col("vector").isNotNull() & (F.size("vector") == dims if dims else F.size("vector") > 0)).filter(ok)


def build_index(vectors: DataFrame, folder: str, key: str = "chunk_id", lists: int | None = None) -> Lists | None:
    """vectors (key, vector): the index, written below folder; None where there is no vector. Vectors of another length than the first by key are left out, as are unusable ones."""
    v = usable(vectors.select(key, "vector"))
    dims = v.agg(F.min(F.struct(key, F.size("vector").alias("dims")))["dims"]).first()[0]
    if dims is None:
        return None
    v = written(usable(v, dims), folder, "vectors")
    kind, n = v.schema[key].dataType.simpleString(), v.count()
    many = min(MOST_LISTS, lists or max(1, int(n**0.5)))
    share = max(1, n // (SAMPLE * many))
    sample = v.filter(F.pmod(F.xxhash64(key), F.lit(share)) == 0).select("vector")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        c = _centroids(np.stack(pdf.vector.to_numpy()), many)
        return pd.DataFrame({"list": np.arange(len(c)), "centroid": list(c)})

    fitted = written(sample.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "list int, centroid array<double>"), folder, "fitted")  # a bounded sample
    c = np.stack([r.centroid for r in fitted.orderBy("list").collect()] or [np.zeros(dims)])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf.vector.to_numpy())
                of = _nearest(x, c)
                yield pdf.assign(list=of.astype(np.int32), far=np.linalg.norm(x - c[of], axis=1))

    placed = written(v.mapInPandas(place, f"{key} {kind}, vector array<double>, list int, far double"), folder, "placed")
    known = placed.groupBy("list").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()  # at most MOST_LISTS rows
    radii, sizes = np.zeros(len(c)), np.zeros(len(c), np.int64)
    for r in known:
        radii[r.list], sizes[r.list] = r.radius, r.n
    parts = _parts(F.col("list"), {r.list: -(-r.n // PART_ROWS) for r in known})
    placed = placed.withColumn("part", F.pmod(F.xxhash64(key), parts).cast("int")).drop("far")
    placed.repartition("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{folder}/lists")
    return Lists(folder, key, kind, c, radii, sizes)


def _parts(list_: F.Column, many: dict[int, int]) -> F.Column:
    """How many parts each list has; for those of one part there is no entry."""
    some = {k: n for k, n in many.items() if n > 1}
    if not some:
        return F.lit(1)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kn in sorted(some.items()) for x in kn)), list_), F.lit(1))


def _looked_up(index: Lists, spark: SparkSession, asked: DataFrame, k: int) -> DataFrame:
    """asked (query_id, query, list): the k best of each query in each part of each of its lists (query_id, key, score). Only these lists' partitions are read."""
    key, kind = index.key, index.kind
    counts = {r.list: r.n for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most MOST_LISTS rows
    rows = spark.read.schema(f"{key} {kind}, vector array<double>, part int, list int").parquet(f"{index.folder}/lists").filter(F.col("list").isin(sorted(counts) or [-1]))
    blocks = _parts(F.col("list"), {i: -(-n // BLOCK_QUERIES) for i, n in counts.items()})
    parts = _parts(F.col("list"), {i: -(-int(index.sizes[i]) // PART_ROWS) for i in counts})
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), key: left[key].iloc[:0], "score": np.zeros(0)})
        if not len(left) or not len(right):
            return none
        x, found = np.stack(left.vector.to_numpy()), []
        for i in range(0, len(right), BLOCK_QUERIES):
            some = right.iloc[i : i + BLOCK_QUERIES]
            score = np.stack(some["query"].to_numpy()) @ x.T
            keep = min(k, score.shape[1])
            q, v = np.nonzero(score >= np.partition(score, -keep, axis=1)[:, -keep, None])
            new = pd.DataFrame({"query_id": some.query_id.to_numpy()[q], key: left[key].to_numpy()[v], "score": score[q, v]})
            found.append(new.sort_values(["query_id", "score", key], ascending=[True, False, True]).groupby("query_id").head(k))
        return pd.concat(found)

    by = ["list", "part", "block"]
    return rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(best, f"query_id long, {key} {kind}, score double")


def search(index: Lists | None, queries: DataFrame, k: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """queries (query_id, vector). query_id, key, score, rank of each query's k best; and the lists that each looked into (query_id, list)."""
    spark = queries.sparkSession
    if index is None:
        none = queries.select(F.col("query_id").cast("long")).limit(0)
        return none.select("query_id", F.lit(None).cast("long").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")), none.select("query_id", F.lit(0).alias("list"))
    c, radii, sizes = index.centroids, index.radii, index.sizes
    q = usable(queries.select(F.col("query_id").cast("long"), "vector"), c.shape[1])
    slack = 1e-9

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near = np.argsort(-(np.stack(pdf.vector.to_numpy()) @ c.T), axis=1, kind="stable")
                need = np.argmax(np.cumsum(sizes[near], axis=1) >= min(k, int(sizes.sum())), axis=1)  # the lists that hold k vectors together
                i, j = np.nonzero(np.arange(len(c))[None, :] <= need[:, None])
                yield pd.DataFrame({"query_id": pdf.query_id.to_numpy()[i], "query": pdf.vector.to_numpy()[i], "list": near[i, j].astype(np.int32)})

    asked = written(q.mapInPandas(first, "query_id long, query array<double>, list int"), folder, "asked")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), index.key)
    found = written(_looked_up(index, spark, asked, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), folder, "found")
    least = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    seen = asked.groupBy("query_id").agg(F.collect_set("list").alias("seen"))

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf.vector.to_numpy())
                most = x @ c.T + np.linalg.norm(x, axis=1)[:, None] * radii[None, :]
                least = np.where(pdf.n.to_numpy() < k, -np.inf, pdf.least.to_numpy())
                open_ = (most >= least[:, None] - slack * (1 + np.abs(least[:, None]))) & (sizes > 0)[None, :]
                for row, some in enumerate(pdf.seen):
                    open_[row, some] = False
                i, j = np.nonzero(open_)
                yield pd.DataFrame({"query_id": pdf.query_id.to_numpy()[i], "query": pdf.vector.to_numpy()[i], "list": j.astype(np.int32)})

    more = q.join(least, "query_id").join(seen, "query_id").mapInPandas(rest, "query_id long, query array<double>, list int")
    more = written(more, folder, "more")
    out = found.drop("rank").unionByName(_looked_up(index, spark, more, k)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return out, asked.select("query_id", "list").unionByName(more.select("query_id", "list"))
