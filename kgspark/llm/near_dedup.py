"""Operator 2: near-duplicate documents by a multi-index Hamming join of MinHash signatures.

Documents are linked if the Jaccard similarity of their sets of 5-word shingles is at least 75 %; a class is a connected component.

A signature has SYMBOLS MinHash values of 16 bits and is split into CHUNKS chunks. If two signatures differ in at most 2 * CHUNKS - 1
symbols, some chunk differs in one symbol at most (pigeonhole); so each document is filed under every chunk with each one of its symbols
left out, and all pairs under that distance meet under a key. A pair at exactly 75 % meets with probability 0.9997, one at 80 % with 0.99999.
Links are confirmed on the full sets.

Groups of any size are worked on without listing their pairs:
1. Documents of equal sets become one, by partial minima.
2. Under each key, every document is compared with one of the key only: the one that shares most keys (a group's centre). Most links
   of a large group show here, and join it.
3. Keys whose documents are still in different components are left. There, pairs across components are compared, once each: under the
   first key that both have, and only if sizes and maps of the shingles (of 512 bits, then of 2048) leave 75 % possible, which loses no link. Pairs within a component
   needn't be compared, as they can't change it.
So no link between different components is lost among the pairs that meet.

Empty or null text: an empty set, linked with nothing. Fewer than five words: the whole sequence is the one shingle. Null doc_ids are linked with nothing and
stay, with a null class. doc_ids identify documents: rows of one id with equal texts are in one class, and each of them is returned. Very long
texts are sets like others. Extra columns are ignored by `near_duplicates`, and kept by `without_near_duplicates`. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .shared import maybe_in, mix, packed, pick, quoted, shared_folder, small_batches, steps, unpacked, utf8, word_hashes, written

SHINGLE = 5
#: Symbols of a signature, and chunks that it is split into.
SYMBOLS, CHUNKS = 48, 9
#: Links need 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Words of the map that pairs across components must pass, too.
WIDE = 32
#: Documents of a block of a key, and rows of a task, where pairs across components are compared.
BLOCK_ROWS, TASK_ROWS = 256, 4096
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, SYMBOLS, np.uint32)
_MUL = _rng.integers(0, 1 << 31, SYMBOLS, np.uint32) * np.uint32(2) + np.uint32(1)
_EDGES = np.linspace(0, SYMBOLS, CHUNKS + 1).astype(np.int64)
_CHUNK = np.searchsorted(_EDGES, np.arange(SYMBOLS), "right") - 1
_TAGS = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each document the sorted distinct 64-bit hashes of its 5-word shingles; fewer words: of the whole sequence."""
    out = []
    weights = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
    for i, j in steps(offsets):
        h, at = word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n = max(0, len(h) - SHINGLE + 1)
        s = np.zeros(n, np.uint64)
        for k, c in enumerate(weights):
            s += h[k : k + n] * c
        s = mix(s)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(s[a : b - SHINGLE + 1]))
            elif b > a:
                one = np.array([b - a], np.uint64)
                for k in range(b - a):
                    one += h[a + k : a + k + 1] * weights[k]
                out.append(mix(one))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The lowest 16 bits of the smallest hash of the set under each of SYMBOLS hash functions."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 4096):
        low = np.minimum(low, ((x[k : k + 4096, None] ^ _XOR) * _MUL).min(axis=0))
    return (low ^ low >> 16).astype(np.uint16)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """documents x SYMBOLS keys: each is a chunk of the signature with one of its symbols left out."""
    terms = mix(signatures.astype(np.uint64) + (np.arange(SYMBOLS, dtype=np.uint64) + np.uint64(1) << np.uint64(20)))
    sums = np.add.reduceat(terms, _EDGES[:-1], axis=1)
    return mix(sums[:, _CHUNK] - terms + _TAGS)


def bitmap(shingles: np.ndarray, words: int = 8) -> np.ndarray:
    """Words of 64 bits, of which each shingle sets one."""
    bits = np.zeros(64 * words, np.uint8)
    bits[(shingles >> np.uint64(20)).astype(np.int64) & (64 * words - 1)] = 1
    return np.packbits(bits).view(np.int64)


FEATURES = "doc_id long, n long, h1 long, h2 long, bits array<long>, wide array<long>, sig array<short>, keys array<long>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bits", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64())), ("sig", pa.list_(pa.int16())), ("keys", pa.list_(pa.int64()))])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, "text"):
        sets = shingle_sets(*utf8(b.column(1)))
        sigs = np.stack([signature(s) for s in sets]) if sets else np.zeros((0, SYMBOLS), np.uint16)
        sums = [np.array([mix(s ^ np.uint64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (0x1234567, 0x89ABCDEF)]
        lists = []
        maps = [(np.concatenate([bitmap(s, w) for s in sets] or [np.zeros(0, np.int64)]), w, pa.int64()) for w in (8, WIDE)]
        for values, width, kind in (*maps, (sigs.ravel().view(np.int16), SYMBOLS, pa.int16()), (index_keys(sigs).ravel().view(np.int64), SYMBOLS, pa.int64())):
            lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * width, pa.int32()), pa.array(values, kind)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, sums), *lists], schema=_ARROW)


def _possible(n1: Column, bits1: Column, n2: Column, bits2: Column, words: int = 8) -> Column:
    """Whether sizes and bit maps leave the similarity possible: a bit that only one set has is a shingle that the other lacks."""
    only1, only2 = F.lit(0), F.lit(0)
    for k in range(words):
        x, y = bits1[k], bits2[k]
        only1 = only1 + F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
        only2 = only2 + F.bit_count(y.bitwiseAND(F.bitwise_not(x)))
    most = F.least(n1 - only1, n2 - only2)  # of the intersection
    return (100 * F.least(n1, n2) >= SIMILAR * F.greatest(n1, n2)) & ((100 + SIMILAR) * most >= SIMILAR * (n1 + n2))


def _first_key(sig1: Column, sig2: Column) -> Column:
    """The number of the first key that both signatures have (from 0)."""
    equal = F.zip_with(sig1, sig2, lambda x, y: x == y)
    others = F.array(*(F.array(*(F.lit(i + 1) for i in range(_EDGES[c], _EDGES[c + 1]) if i != t)) for t, c in enumerate(_CHUNK.tolist())))
    return F.array_position(F.transform(others, lambda o: F.forall(o, lambda i: F.element_at(equal, i))), True) - 1


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for b in small_batches(small_batches([big], "text_a"), "text_b"):
            texts = pa.chunked_array([b.column(2), b.column(3)]).combine_chunks().dictionary_encode()
            sets = shingle_sets(*utf8(texts.dictionary))
            of = texts.indices.to_numpy()
            n = b.num_rows
            yes = np.zeros(n, bool)
            for i in range(n):
                x, y = sets[of[i]], sets[of[n + i]]
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes[i] = 100 * both >= SIMILAR * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(yes)), b.column(1).filter(pa.array(yes))], names=["a", "b"])


def confirmed(pairs: DataFrame, docs: DataFrame, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts are similar enough, by their full sets. docs: doc_id, text."""
    pairs = written(pairs.select("a", "b"), folder, f"{name}_pairs")
    some = maybe_in(docs, "doc_id", pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))).filter("_maybe")
    texts = written(some.select("doc_id", "text"), folder, f"{name}_texts").dropDuplicates(["doc_id"])
    for c in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")), c)
    return written(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long"), folder, name)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: doc_id, n_shingles, component_id (the smallest doc_id of its class), kept (whether it has that id)."""
    folder = shared_folder(docs.sparkSession)
    docs = pick(docs, {"doc_id": doc_id, "text": text}).withColumn("doc_id", F.col("doc_id").cast("long"))
    feats = written(docs.mapInArrow(_features, FEATURES), folder, "features")
    classes = written(feats.filter("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), folder, "classes")
    first = feats.join(classes.select(F.col("rep").alias("doc_id"), "n", "h1", "h2"), ["doc_id", "n", "h1", "h2"], "left_semi").dropDuplicates(["doc_id"])
    first = written(first.select(F.col("doc_id").alias("doc"), "n", "bits", "wide", "sig", "keys"), folder, "first")

    filed = first.select("doc", F.posexplode("keys").alias("tag", "key"))
    shared = filed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    filed = written(filed.join(shared, "key"), folder, "filed")
    weight = filed.groupBy("doc").agg(F.sum("size").alias("weight"))
    centre = filed.join(weight, "doc").groupBy("key").agg((-F.max(F.struct("weight", -F.col("doc")))["col2"]).alias("centre"))
    pairs = filed.join(centre, "key").filter("doc <> centre").select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(first.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
    links = confirmed(pairs.filter(_possible(F.col("n_a"), F.col("bits_a"), F.col("n_b"), F.col("bits_b"))), docs, folder, "links1")

    found = connected_components(links, folder=f"{folder}/components1")
    filed = written(filed.join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").select("key", "tag", "doc", F.coalesce("component", "doc").alias("component")), folder, "coloured")
    largest = filed.groupBy("key", "component").agg(F.count("*").alias("size")).groupBy("key").agg(F.count("*").alias("colours"), F.max_by("component", F.struct("size", "component")).alias("largest"), F.sum("size").alias("rows"))
    left = filed.join(largest.filter("colours > 1"), "key").select("key", "tag", "doc", "component", (F.col("component") == F.col("largest")).alias("most"), F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks"))
    left = written(left.join(first.select("doc", "n", "bits", "wide", "sig"), "doc"), folder, "left")
    # one side of a key's documents is dealt into blocks, the other meets each of them: a key of many documents is many small groups
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), left.count() // TASK_ROWS)
    x = left.filter("not most").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).repartition(tasks, "key", "block").alias("x")
    y = left.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks"))).repartition(tasks, "key", "block").alias("y")
    across = (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.component") != F.col("y.component")) & (F.col("y.most") | (F.col("x.doc") < F.col("y.doc")))
    across &= _possible(F.col("x.n"), F.col("x.bits"), F.col("y.n"), F.col("y.bits")) & (F.col("x.tag") == _first_key(F.col("x.sig"), F.col("y.sig")))
    across &= _possible(F.col("x.n"), F.col("x.wide"), F.col("y.n"), F.col("y.wide"), WIDE)
    more = confirmed(x.join(y, across).select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b")), docs, folder, "links2")
    found = connected_components(links.union(more), folder=f"{folder}/components2")

    out = feats.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, of one document of each class: the one of the smallest id."""
    gone = near_duplicates(docs, doc_id, text).filter("not kept").select(F.col("doc_id").alias("id")).distinct()
    return packed(docs, id=F.col(quoted(doc_id)).cast("long")).join(gone, "id", "left_anti").select(*unpacked(docs.columns))
