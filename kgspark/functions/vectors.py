"""Embeddings and vector search."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..storage import shared_folder
from .inverted_lists import build_index, search
from .metric_join import near_pairs, unit_rows

TOKEN = "[A-Za-z0-9_-]+"
#: Queries that a search sends to every task at once.
BLOCK_QUERIES = 1000
#: Tokens whose places a task remembers.
MOST_TOKENS = 500_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def hashed_embedding(docs: DataFrame, key: str = "uri", dims: int = 64) -> DataFrame:
    """key, bucket, value (sparse): tokens add their sign to a bucket, both from the token's SHA-256; of unit length, or without rows. Rows are summed where they are; no token is shuffled."""
    kind = docs.schema[key].dataType

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, places = re.compile(TOKEN).findall, _Places(dims)
        for b in batches:
            of, buckets, values = [], [], []
            for row, text in enumerate(b.column("low").to_pylist()):
                tokens = find(text or "")
                if tokens:
                    at = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))
                    sums = np.bincount(at, minlength=2 * dims).astype(np.int64)
                    sums = sums[:dims] - sums[dims:]
                    some = np.flatnonzero(sums)
                    of += [row] * len(some)
                    buckets += some.tolist()
                    values.append(sums[some] / np.sqrt(float((sums * sums).sum())) if len(some) else np.zeros(0))
            keys = b.column(key).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(buckets, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0))], names=[key, "bucket", "value"])

    return docs.select(key, F.lower("text").alias("low")).mapInArrow(embed, StructType([StructField(key, kind), StructField("bucket", IntegerType()), StructField("value", DoubleType())]))


class _Places(dict):
    """The bucket of a token, `dims` higher for a negative sign; worked out once for each token while fewer than MOST_TOKENS are remembered."""

    def __init__(self, dims: int):
        super().__init__()
        self.dims = dims

    def __missing__(self, token: str) -> int:
        d = hashlib.sha256(token.encode()).digest()
        place = int.from_bytes(d[:4], "big") % self.dims + (self.dims if d[4] % 2 else 0)
        if len(self) >= MOST_TOKENS:
            self.clear()
        self[token] = place
        return place


def dense(sparse: DataFrame, docs: DataFrame, key: str = "uri", dims: int = 64) -> DataFrame:
    """key, vector of every document; zeros where nothing is given."""
    m = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    value = lambda b: F.coalesce(F.try_element_at(F.col("m"), b), F.lit(0.0)).cast("float")
    return docs.select(key).join(m, key, "left").select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value).alias("vector"))


def embed_with(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]], key: str = "uri", batch: int = 64, parallel: int | None = None, limit: int | None = None) -> DataFrame:
    """key, vector by a user's function on up to `batch` texts a call, in order; `parallel` bounds the calls at a time, `limit` the characters of a text (all, unless given): cut long texts into chunks first where the function has a limit."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v for k in range(0, len(texts), batch) for v in embed(texts[k : k + batch])], dtype=object)

    rows = docs.repartition(parallel) if parallel else docs
    return rows.select(key, F.pandas_udf(run, "array<float>")(F.substring("text", 1, limit) if limit else F.col("text")).alias("vector"))


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """vectors (key, vector), queries (query_id, vector): query_id, key, score (inner product), rank, through an index built for them; keep that of build_index to search it again."""
    folder = shared_folder(vectors.sparkSession)
    return search(build_index(vectors, f"{folder}/index", key), queries, k, folder)[0]


def flat_search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """The same rows by a scan of all vectors, for a stated set of queries.

    Each block of queries meets all vectors in one pass that keeps the k best of every task; no vector is moved.
    """
    spark, parts = vectors.sparkSession, []
    queries = queries.select(F.col("query_id").cast("long"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    kind = vectors.schema[key].dataType.simpleString()
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        sent = spark.sparkContext.broadcast([(r.query_id, r.vector) for r in rows])  # a block of the stated set

        def best(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            import numpy as np

            ids = np.array([q for q, _ in sent.value], np.int64)
            wanted = np.array([v for _, v in sent.value], np.float64)
            top = None
            for pdf in batches:
                pdf = pdf[pdf.vector.map(lambda v: v is not None and len(ids) > 0 and len(v) == wanted.shape[1])]
                if not len(pdf):
                    continue
                score = wanted @ np.stack(pdf.vector.to_numpy()).astype(np.float64).T
                keep = min(k, score.shape[1])
                q, v = np.nonzero(score >= np.partition(score, -keep, axis=1)[:, -keep, None])
                new = pd.DataFrame({"query_id": ids[q], key: pdf[key].to_numpy()[v], "score": score[q, v]})
                top = new if top is None else pd.concat([top, new])
                top = top.sort_values(["query_id", "score", key], ascending=[True, False, True]).groupby("query_id").head(k)
            if top is not None:
                yield top

        parts.append(vectors.select(key, "vector").mapInPandas(best, f"query_id long, {key} {kind}, score double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, block: str, key: str = "id", threshold: float = 0.88) -> DataFrame:
    """Pairs a < b of rows in the same block with a cosine of at least the threshold, exactly: see metric_join. Null ids, blocks and vectors, and vectors without a direction, have no pairs."""
    rows = unit_rows(vectors, block, key, dot(F.col("vector"), F.col("vector")))
    return near_pairs(rows, threshold).withColumnRenamed("block", block)
