"""Operator 1: approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Walsh-Hadamard transform) turns a unit vector; its hash is the signed axis nearest
to the result, that is its largest component with the sign. The bucket of a vector in a table is the pair of axes of two rotations; TABLES
tables have rotations of their own. A query probes, in each table, the buckets with the least loss (the squared distances by which their axes
stand behind the nearest ones). Rows of probed buckets are its candidates: only their exact distances are computed, in double precision on the original
vectors, ties by the smaller id.

Every row is hashed once, and the index (id, vector, buckets) is written to the shared folder. Queries come in chunks of at most CHUNK_QUERIES, whose
vectors and probed buckets, sorted by bucket, go to all tasks: a task looks up the buckets of its rows, keeps the k best for each query, and
sends only those on. More queries than a chunk holds take further passes over the index, each written to the shared folder; so memory is bounded by the
chunk, and no row is moved. Of equal vectors in a block only the k + 1 smallest ids can be in a result, so the others aren't compared, however
many there are.

The number of probes is fitted to a bounded sample (SAMPLE_ROWS rows, SAMPLE_QUERIES queries): the fewest at which the sample's recall
against brute force is at least RECALL. If MOST_PROBES aren't enough for that (as in small tables), every row is a candidate.

Vectors that are null, zero, of another length than most of the sample, or hold null or non-finite components take no part; neither do null ids. Rows of equal
ids count once each as candidates, once in all as a query (by one of their vectors). Fewer than k candidates: all that are found. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import pick, shared_folder, written

TABLES, RECALL, MOST_PROBES = 64, 0.95, 128
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 200
CHUNK_QUERIES, BLOCK_ROWS, ROTATED_ROWS = 2048, 4096, 512
FOUND = "query_id long, vec_id long, score double, candidates long"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each column; their length is a power of two."""
    d, n = x.shape
    h = 1
    while h < d:
        y = x.reshape(d // (2 * h), 2, h, n)
        x = np.concatenate([y[:, :1] + y[:, 1:], y[:, :1] - y[:, 1:]], axis=1).reshape(d, n)
        h *= 2
    return x


class CrossPolytope:
    """Axes are numbered 0 to wide - 1, and from wide on with a negative sign; a bucket is axis * (2 * wide) + axis."""

    def __init__(self, dim: int, tables: int = TABLES, seed: int = 7):
        self.dim, self.wide, self.tables = dim, 1 << max(0, dim - 1).bit_length(), tables
        self.signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (tables, 2, 3, self.wide, 1))

    def _parts(self, x: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """A few rows at a time as unit vectors in columns, with zeros up to the width."""
        for k in range(0, len(x), ROTATED_ROWS):
            part = x[k : k + ROTATED_ROWS]
            largest = np.abs(part).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
            unit = part / largest
            out = np.zeros((self.wide, len(part)), np.float32)
            out[: self.dim] = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).T
            yield slice(k, k + len(part)), out

    @staticmethod
    def _rotated(y: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            y = hadamard(y * s)
        return y

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table: rows x tables."""
        out = np.empty((len(x), self.tables), np.int32)
        for at, unit in self._parts(x):
            column = np.arange(unit.shape[1])
            for t in range(self.tables):
                axes = []
                for signs in self.signs[t]:
                    y = self._rotated(unit, signs)
                    axis = np.abs(y).argmax(axis=0)
                    axes.append(axis + self.wide * (y[axis, column] < 0))
                out[at, t] = axes[0] * 2 * self.wide + axes[1]
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """The buckets of least loss of each vector in each table, in order: rows x tables x count."""
        axes = 2 * self.wide
        count = min(count, axes * axes)
        # a pair of the i-th and j-th nearest axes has i * j pairs of no greater loss, itself included
        sizes = np.minimum(axes, count // np.arange(1, min(axes, count) + 1))
        i = np.repeat(np.arange(len(sizes)), sizes)
        j = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = np.empty((len(x), self.tables, count), np.int32)
        for at, unit in self._parts(x):
            for t in range(self.tables):
                near, loss = [], []
                for signs in self.signs[t]:
                    y = self._rotated(unit, signs)
                    behind = np.concatenate([y, -y])
                    behind = np.square(behind.max(axis=0) - behind)
                    near.append(np.argsort(behind, axis=0, kind="stable")[: min(axes, count)])
                    loss.append(np.take_along_axis(behind, near[-1], 0))
                best = np.argsort(loss[0][i] + loss[1][j], axis=0, kind="stable")[:count]
                out[at, t] = (np.take_along_axis(near[0][i], best, 0) * axes + np.take_along_axis(near[1][j], best, 0)).T
        return out


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Usable vectors as rows, and their places in the column. dim: the length wanted, else the most frequent one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dim or 0)), np.zeros(0, np.int64)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if dim is None:
        dim = int(np.bincount(sizes).argmax()) if sizes.any() else 0
    rows = np.flatnonzero((sizes == dim) & (dim > 0))
    if not len(rows):
        return np.zeros((0, dim)), rows
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    ok = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)  # nulls have become NaN
    return values[ok], rows[ok]


def fitted_probes(hashing: CrossPolytope, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, recall: float = RECALL) -> int:
    """The fewest probes with the recall wanted, or 0 if MOST_PROBES aren't enough. own: each query's place in rows."""
    if len(rows) <= k + 1:
        return 0
    codes, probes = hashing.codes(rows), hashing.probes(queries, MOST_PROBES)
    d = ((queries**2).sum(1)[:, None] + (rows**2).sum(1)) - 2 * queries @ rows.T
    d[np.arange(len(own)), own] = np.inf
    nearest = np.argpartition(d, k - 1, axis=1)[:, :k]
    needed = np.full(nearest.shape, MOST_PROBES + 1)
    for t in range(hashing.tables):
        hit = probes[:, t, None, :] == codes[nearest, t][:, :, None]
        needed = np.minimum(needed, np.where(hit.any(axis=2), hit.argmax(axis=2) + 1, MOST_PROBES + 1))
    count = int(np.quantile(needed, recall, method="higher"))
    return count if count <= MOST_PROBES else 0


def first_equals(ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """The places of rows without those that have the same vector as `most` rows of smaller ids."""
    h = (np.ascontiguousarray(rows).view(np.uint64) * np.random.default_rng(1).integers(1, 1 << 63, rows.shape[1], np.uint64)).sum(axis=1)
    order = np.lexsort((ids, h))
    same = np.zeros(len(ids), bool)
    same[1:] = (rows[order[1:]] == rows[order[:-1]]).all(axis=1)
    place = np.arange(len(ids))
    return np.sort(order[place - np.maximum.accumulate(np.where(same, 0, place)) < most])


class Queries:
    """A chunk of queries with the buckets that they probe, sorted by bucket in each table. probes: 0 if all rows are candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, hashing: CrossPolytope, probes: int):
        self.ids, self.vectors, self.buckets, self.askers = ids, vectors, [], []
        for at in hashing.probes(vectors, probes).transpose(1, 0, 2) if probes and len(ids) else ():
            order = np.argsort(at.ravel(), kind="stable")
            self.buckets.append(at.ravel()[order])
            self.askers.append((order // probes).astype(np.int32))

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """queries x rows: whether a row, by its buckets, stands in one that the query probes."""
        near = np.full((len(self.ids), len(codes)), not self.buckets)
        for t, (buckets, askers) in enumerate(zip(self.buckets, self.askers, strict=True)):
            first = np.searchsorted(buckets, codes[:, t])
            n = np.searchsorted(buckets, codes[:, t], "right") - first
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
            near[askers[at], np.repeat(np.arange(len(codes)), n)] = True
        return near


class Best:
    """The k nearest candidates of each query so far, and how many there were."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k, n = queries, k, len(queries.ids)
        self.q, self.v, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.edge, self.seen = np.full(n, np.inf), np.zeros(n, np.int64)

    def add(self, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> None:
        keep = first_equals(ids, rows, self.k + 1)
        ids, rows = ids[keep], rows[keep]
        near = self.queries.candidates(codes[keep])
        near &= self.queries.ids[:, None] != ids
        self.seen += near.sum(axis=1)
        i, j = np.nonzero(near)
        found = [(self.q, self.v, self.d)]
        for s in range(0, len(i), 1 << 16):
            p, r = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            d = np.sqrt(np.square(self.queries.vectors[p] - rows[r]).sum(axis=1))
            some = d <= self.edge[p]
            found.append((p[some], ids[r[some]], d[some]))
        q, v, d = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((v, d, q))
        q, v, d = q[order], v[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.q, self.v, self.d = q[keep], v[keep], d[keep]
        last = place == self.k - 1
        self.edge[q[last]] = d[last]


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", chunk_queries: int = CHUNK_QUERIES, probes: int | None = None) -> DataFrame:
    """vectors with ids and arrays of float or double; is_query: a condition on vec_id. query_id, rank (from 1), vec_id, score (Euclidean distance), candidates (rows compared with the query). probes: instead of the fitted number."""
    spark = vectors.sparkSession
    rows = pick(vectors, {"vec_id": vec_id, "embedding": embedding}).filter("vec_id is not null and embedding is not null").withColumn("vec_id", F.col("vec_id").cast("long"))
    total = rows.count()
    digest = F.xxhash64(F.col("vec_id"), F.lit(3))
    sample = rows.filter(F.pmod(digest, F.lit(max(1, total // SAMPLE_ROWS))) == 0).select("embedding").limit(2 * SAMPLE_ROWS).toArrow()
    some, _ = matrix(sample.column(0))
    if not len(some):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, candidates long")
    hashing = CrossPolytope(some.shape[1])
    asked = np.linspace(0, len(some) - 1, min(SAMPLE_QUERIES, len(some))).astype(np.int64)
    count = fitted_probes(hashing, some, some[asked], asked, k) if probes is None else probes
    del sample, some

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, places = matrix(b.column(1), hashing.dim)
            codes = hashing.codes(v) if count else np.zeros((len(v), 0), np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places)), pa.array(map(bytes, v), pa.binary()), pa.array(map(bytes, codes), pa.binary())], names=["vec_id", "vector", "codes"])

    folder, parts = shared_folder(spark), []
    index = written(rows.mapInArrow(hashed, "vec_id long, vector binary, codes binary"), folder, "index")
    queries = index.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    chunks = max(1, -(-queries.count() // chunk_queries))
    for c in range(chunks):
        table = queries.filter(F.pmod(digest, F.lit(chunks)) == c).toArrow()
        asking = Queries(table.column("vec_id").to_numpy(), np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(-1, hashing.dim), hashing, count)
        sent = spark.sparkContext.broadcast(asking)  # bounded by chunk_queries

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = Best(sent.value, k)
            for b in batches:
                for s in range(0, b.num_rows, BLOCK_ROWS):
                    part = b.slice(s, BLOCK_ROWS)
                    v, codes = (np.frombuffer(b"".join(part.column(i).to_pylist()), kind).reshape(part.num_rows, -1) for i, kind in ((1, np.float64), (2, np.int32)))
                    best.add(part.column(0).to_numpy(), v, codes)
            ids, none = sent.value.ids, np.zeros(len(best.q), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.v), pa.array(best.d), pa.array(none)], names=["query_id", "vec_id", "score", "candidates"])
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.array(best.seen)], names=["query_id", "vec_id", "score", "candidates"])

        found = _ranked(index.mapInArrow(search, FOUND), k)
        parts.append(found if chunks == 1 else written(found, folder, f"chunk{c}"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, and the candidates of all tasks, which rows without a vec_id tell."""
    query = Window.partitionBy("query_id")
    rows = found.withColumn("candidates", F.sum("candidates").over(query)).withColumn("rank", F.row_number().over(query.orderBy(F.asc_nulls_last("score"), "vec_id")))
    return rows.filter((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "candidates")
