"""Operator 4: n-gram language model in an Elias-Fano trie.

Tokens are the lower-cased words of a text and one end after them, which also stands before the first word. Level 1 holds every training
token: sorted 64-bit hashes with exact counts; a token's id is its place. A node of level k is filed under its context, a node of level k-1, by a
successor: at level 2 the token's id; at level 3 the place of the last token among the successors that the middle token has at level 2
(context-relative, so successors are small numbers). Contexts point to their nodes by a monotone sequence, and the nodes are one
monotone sequence of context * width + successor; both are in Elias-Fano form, in segments. A lookup finds the segment, and searches the
successor among the values of the same high part.

All n-grams are kept, also those seen once. Probabilities are by absolute discounting, interpolated with the shorter context down to the smoothed
unigram (c + 0.1) / (N + 0.1 * (V + 1)): (n - D) / total + D * types / total * shorter. Each node holds the logarithm of its first term, quantised to
steps of 1/STEPS in two bytes, down to 10**-16; a context's types are the difference of its pointers, its total is the exact count of its own node: counts of
255 and more stand in a list of exceptions beside the bytes of the others. So the probabilities of a context add up to 1.

Counts of all training documents are gathered by Spark, level by level, in one shuffle each: a task sends its sorted distinct n-grams with their
counts as delta-coded blobs by ranges of keys, which hold about SEGMENT_TOKENS tokens each. The successors of a frequent context are spread over
several ranges. One task merges a range, and writes its segment to the shared folder, under a name that a repeated task writes again alike. All tasks map
the segments into memory from there; where that folder isn't mounted (an object store), each Python worker maps a fetched copy. Nothing of the model
passes through the driver.

Null or empty text: the end token only. A text of any length is scored whole, token by token. Repeated rows count repeatedly. Without training rows every
token has probability 1 / (V + 1) = 1. A null doc_id counts as empty text for the split of rows. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano
from .shared import Folder, one_word_hash, pick, shared_folder, small_batches, utf8, word_hashes

ORDER, DISCOUNT, ADD = 3, 0.75, 0.1
STEPS = 4096  # of a power of ten
MANY = 255  # counts from here on are stored apart
#: Tokens of the training texts that a segment stands for, about; and that a task holds before it sends their counts on.
SEGMENT_TOKENS = 2_000_000
#: Bytes of text that are looked up together, in the order of keys: more find each other's pages, and repeated n-grams are looked up once.
STEP = 4 << 20
END = one_word_hash(b"\x00end of text") >> 1  # a word can hold this only with a byte 0 and spaces
SCHEMA = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def is_training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 != 0


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of all tokens, an end after each document's words; and where each document starts (n+1)."""
    h, at = word_hashes(raw, offsets)
    n = len(at) - 1
    out = np.full(len(h) + n, END, np.int64)
    starts = at + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[starts[1:] - 1] = False
    out[keep] = (h >> np.uint64(1)).astype(np.int64)
    return out, starts


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEPS), 0, 65535).astype("<u2")


class Counts:
    """A byte for each count, and the exact ones of MANY and more with their places."""

    def __init__(self, raw: np.ndarray, n: int):
        many = int(raw[:8].view("<i8")[0])
        self.at, self.exact, self.bytes = raw[8 : 8 + 8 * many].view("<i8"), raw[8 + 8 * many : 8 + 16 * many].view("<i8"), raw[8 + 16 * many : 8 + 16 * many + n]

    @staticmethod
    def coded(counts: np.ndarray) -> bytes:
        at = np.flatnonzero(counts >= MANY)
        raw = np.array([len(at)], "<i8").tobytes() + at.astype("<i8").tobytes() + counts[at].astype("<i8").tobytes() + np.minimum(counts, MANY).astype(np.uint8).tobytes()
        return raw + bytes(-len(raw) % 8)

    def get(self, i: np.ndarray) -> np.ndarray:
        out = self.bytes[i].astype(np.int64)
        over = np.flatnonzero(out == MANY)
        out[over] = self.exact[np.searchsorted(self.at, i[over])]
        return out


class Nodes:
    """What levels have in common. segments: in the order of their keys, with n, total (the sum of their counts) and counts; base: nodes before each."""

    def __init__(self, segments: list):
        self.segments = segments
        self.base = np.concatenate([[0], np.cumsum([s.n for s in segments])]).astype(np.int64)
        self.size, self.total = int(self.base[-1]), sum(s.total for s in segments)
        at = [s.counts.at + b for s, b in zip(segments, self.base, strict=False)]
        exact = [s.counts.exact for s in segments]
        self.many, self.before_many = np.concatenate([*at, self.base[:0]]), np.concatenate([[0], np.cumsum(np.concatenate([*exact, self.base[:0]]))])
        self.mean = (self.total - int(self.before_many[-1])) / max(1, self.size - len(self.many))

    def counts_of(self, nodes: np.ndarray) -> np.ndarray:
        """Exact counts of nodes in ascending order."""
        out, edges = np.zeros(len(nodes), np.int64), np.searchsorted(nodes, self.base)
        for s, b, x, y in zip(self.segments, self.base, edges[:-1], edges[1:], strict=False):
            if x < y:
                out[x:y] = s.counts.get(nodes[x:y] - b)
        return out

    def tokens_before(self, nodes: np.ndarray) -> np.ndarray:
        """How many tokens the nodes before each stand for: those seen often with their counts, the others with their mean."""
        often = np.searchsorted(self.many, nodes)
        return (nodes - often) * self.mean + self.before_many[often]


class Words:
    """A segment of level 1."""

    def __init__(self, raw: np.ndarray):
        self.n, self.total = raw[:16].view("<i8").tolist()
        self.hashes, self.counts = raw[16 : 16 + 8 * self.n].view("<i8"), Counts(raw[16 + 8 * self.n :], self.n)

    @staticmethod
    def coded(hashes: np.ndarray, counts: np.ndarray) -> bytes:
        return np.array([len(hashes), counts.sum()], "<i8").tobytes() + hashes.astype("<i8").tobytes() + Counts.coded(counts)


class Level1(Nodes):
    def __init__(self, parts: list[np.ndarray]):
        super().__init__(sorted(map(Words, parts), key=lambda s: int(s.hashes[0])))
        self.first = np.array([s.hashes[0] for s in self.segments], np.int64)
        self.successors = max(1, self.size)  # above every successor of level 2

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + ADD) / (self.total + ADD * (self.size + 1))

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and ids (-1: none) of sorted hashes."""
        counts, ids = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        edges = np.append(np.searchsorted(hashes, self.first), len(hashes))
        for s, base, a, b in zip(self.segments, self.base, edges[:-1], edges[1:], strict=False):
            if a < b:
                p = np.minimum(np.searchsorted(s.hashes, hashes[a:b]), s.n - 1)
                hit = np.flatnonzero(s.hashes[p] == hashes[a:b])
                counts[a + hit] = s.counts.get(p[hit])
                ids[a + hit] = base + p[hit]
        return counts, ids


class Segment:
    """Keys low to high of contexts first to last. begins, ends, most: nodes of the first, the last and the largest context; the first and the last one
    may have more in the next segments."""

    def __init__(self, raw: np.ndarray):
        self.n, self.total, self.low, self.high, self.first, self.last, self.width, self.begins, self.ends, self.most = raw[:80].view("<i8").tolist()
        at = 80
        self.pointers, used = EliasFano.at(raw[at:])
        self.nodes, more = EliasFano.at(raw[at + used :])
        at += used + more
        self.codes = raw[at : at + 2 * self.n].view("<u2")
        self.counts = Counts(raw[at + 2 * self.n + -2 * self.n % 8 :], self.n)

    @staticmethod
    def coded(keys: np.ndarray, counts: np.ndarray, p: np.ndarray, successors: int) -> bytes:
        """Distinct keys (context * successors + successor) in ascending order."""
        context, successor = keys // successors, keys % successors
        first, last, width = int(context[0]), int(context[-1]), int(successor.max()) + 1
        ends = np.searchsorted(context, np.arange(first, last + 2))
        sizes = np.diff(ends)
        head = np.array([len(keys), counts.sum(), keys[0], keys[-1], first, last, width, sizes[0], sizes[-1], sizes.max()], "<i8").tobytes()
        return head + EliasFano.coded(ends) + EliasFano.coded((context - first) * width + successor) + quantised(p).tobytes() + bytes(-2 * len(keys) % 8) + Counts.coded(counts)


class Level(Nodes):
    """Level 2 or above. above: how many successors the contexts of its keys can have."""

    def __init__(self, parts: list[np.ndarray], above: int):
        super().__init__(sorted(map(Segment, parts), key=lambda s: s.low))
        self.above = above
        most, context, types = 1, -1, 0
        for s in self.segments:  # a context that goes on in the next segment has the successors of both
            types = s.begins + (types if s.first == context else 0)
            most = max(most, types, s.most)
            context, types = s.last, types if s.first == s.last else s.ends
        self.successors = most

    def find(self, contexts: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (-1: none) and first term of each node. Rows in the order of context, successor; successors below 0 aren't there."""
        rank, p = np.full(len(contexts), -1, np.int64), np.zeros(len(contexts))
        some = np.flatnonzero((successors >= 0) & (successors < self.above))
        keys = contexts[some] * self.above + successors[some]
        for s, base, a, b in zip(self.segments, self.base, np.searchsorted(keys, [s.low for s in self.segments]), np.searchsorted(keys, [s.high for s in self.segments], "right"), strict=False):
            if a < b:
                c, x = contexts[some[a:b]], successors[some[a:b]]
                at = np.where(x < s.width, s.nodes.find((c - s.first) * s.width + x), -1)
                hit = np.flatnonzero(at >= 0)
                rank[some[a + hit]] = at[hit] + base
                p[some[a + hit]] = 10 ** (s.codes[at[hit]] / -STEPS)
        return rank, p

    def contexts(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ascending contexts: the rank of the first node, and the number of nodes."""
        low, types = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
        for s, base, a, b in zip(self.segments, self.base, np.searchsorted(contexts, [s.first for s in self.segments]), np.searchsorted(contexts, [s.last for s in self.segments], "right"), strict=False):
            if a < b:
                lo, hi = (s.pointers.get(contexts[a:b] - s.first + k) for k in (0, 1))
                low[a:b] = np.where(types[a:b] == 0, lo + base, low[a:b])
                types[a:b] += hi - lo
        return low, types


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order, and each row's place among them."""
    order = np.argsort(values)
    v = values[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return v[new], place


class Trie:
    """The first levels of a folder, mapped into memory."""

    def __init__(self, folder: Folder, order: int):
        self.levels: list = []
        for k in range(1, order + 1):
            parts = [folder.mapped(n) for n in folder.names(f"level{k}")]
            if not parts:
                break
            self.levels.append(Level(parts, self.levels[-1].successors) if self.levels else Level1(parts))

    def walk(self, hashes: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Of each token: count, unigram probability, probability; and context and successor in the level after the last."""
        one = self.levels[0]
        h, place = _unique(hashes)
        counts, ids = one.look(h)
        counts, ids = counts[place], ids[place]
        begin = np.zeros(len(hashes), bool)
        begin[starts[:-1]] = True
        end_id = one.look(np.array([END]))[1][0]
        base = one.unigram(counts)
        p, context, successor = base, np.where(begin, end_id, np.concatenate([[-1], ids[:-1]])), ids
        for before, level in zip(self.levels[:-1], self.levels[1:], strict=True):
            both = np.flatnonzero(context >= 0)
            wide = level.above + 1
            key, place = _unique(context[both] * wide + np.where(successor[both] < level.above, successor[both], -1) + 1)
            c, s = key // wide, key % wide - 1
            rank_, own = level.find(c, s)
            only = np.ones(len(c), bool)
            only[1:] = c[1:] != c[:-1]
            low_, types = level.contexts(c[only])
            rest = np.where(types > 0, DISCOUNT * types / np.maximum(1, before.counts_of(c[only])), 1.0)
            of = (np.cumsum(only) - 1)[place]
            rank, low = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
            rank[both], low[both] = rank_[place], low_[of]
            p = p.copy()
            p[both] = own[place] + rest[of] * p[both]
            # the next level's context is the node before this token; its successor the place of this node under its context
            context, successor = np.where(begin, -1, np.concatenate([[-1], rank[:-1]])), np.where(rank >= 0, rank - low, -1)
        return {"count": counts, "base": base, "p": p, "context": context, "successor": successor}


_tries: dict[tuple[str, int], Trie] = {}


def trie(folder: str, order: int) -> Trie:
    """One for all tasks of a Python worker."""
    if (folder, order) not in _tries:
        _tries.clear()
        _tries[folder, order] = Trie(Folder(folder), order)
    return _tries[folder, order]


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Of values that aren't negative: all low bytes, then all second ones, and so on as far as needed."""
    wide = max(1, (int(values.max()).bit_length() + 7) // 8)
    return wide, np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def sent(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, and counts, by planes of bytes, compressed."""
    (a, x), (b, y) = _planes(np.diff(keys, prepend=0)), _planes(counts)
    return np.array([len(keys), a, b], "<i8").tobytes() + pa.compress(x + y, "zstd", asbytes=True)


def received(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, a, b = np.frombuffer(blob[:24], "<i8").tolist()
    raw = np.frombuffer(pa.decompress(blob[24:], n * (a + b), "zstd"), np.uint8)
    out = []
    for wide, part in ((a, raw[: n * a]), (b, raw[n * a :])):
        values = np.zeros((n, 8), np.uint8)
        values[:, :wide] = part.reshape(wide, n).T
        out.append(values.view("<i8").ravel())
    return np.cumsum(out[0]), out[1]


def _ranges(keys: np.ndarray, t: Trie | None, first_ranges: int, segment: int) -> np.ndarray:
    """The number of the range that each ascending key belongs to; ascending as well, and the same in all tasks."""
    if t is None:
        return (keys >> 31) * first_ranges >> 32
    level = t.levels[-1]
    context, successor = keys // level.successors, keys % level.successors
    low, high = ((level.tokens_before(context + k) / segment).astype(np.int64) for k in (0, 1))
    if len(t.levels) == 1:  # successors are tokens, which are as frequent as they are
        share = level.tokens_before(successor) / level.total
    else:
        share = successor / level.successors
    return np.minimum(high, low + ((high - low + 1) * share).astype(np.int64))


def _count(batches: Iterator[pa.RecordBatch], folder: str, order: int, first_ranges: int, segment: int) -> Iterator[pa.RecordBatch]:
    """n-grams of the level `order`: context * successors + successor, and counts; at level 1 the hashes. By ranges of keys."""

    def parts() -> Iterator[np.ndarray]:
        for b in small_batches(batches, "text", STEP):
            h, starts = tokens(*utf8(b.column(b.schema.get_field_index("text"))))
            if order > 1:
                t = trie(folder, order - 1)
                w = t.walk(h, starts)
                ok = (w["context"] >= 0) & (w["successor"] >= 0)
                h = w["context"][ok] * t.levels[-1].successors + w["successor"][ok]
            yield h

    def blobs(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        of = _ranges(keys, trie(folder, order - 1) if order > 1 else None, first_ranges, segment)
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        ends = np.append(cuts[1:], len(keys))
        return pa.RecordBatch.from_arrays([pa.array(of[cuts]), pa.array([sent(keys[a:b], counts[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["range", "blob"])

    held: list[np.ndarray] = []
    for p in parts():
        held.append(p)
        if sum(map(len, held)) > segment:
            yield blobs(held)
            held = []
    if sum(map(len, held)):
        yield blobs(held)


def _code(table: pa.Table, folder: str, order: int) -> pa.Table:
    """One range: its segment, written."""
    keys, counts = (np.concatenate(x) for x in zip(*map(received, table.column("blob").to_pylist()), strict=True))
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, counts = keys[new], np.add.reduceat(counts, new)
    if order == 1:
        data = Words.coded(keys, counts)
    else:
        level = trie(folder, order - 1).levels[-1]
        context = keys // level.successors
        if int(context[-1]) >= (1 << 62) // level.successors:
            raise ValueError("contexts times successors don't fit 63 bits")
        only, of = _unique(context)
        data = Segment.coded(keys, counts, (counts - DISCOUNT) / level.counts_of(only)[of], level.successors)
    number = table.column("range")[0].as_py()
    Folder(folder).write(f"level{order}/{number:012d}", data)
    return pa.table({"nodes": pa.array([len(keys)], pa.int64())})


def train(docs: DataFrame, order: int = ORDER, segment_tokens: int = SEGMENT_TOKENS) -> str:
    """docs (text): the training texts. The folder that has a trie of all their n-grams up to `order`."""
    folder = shared_folder(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 + size // (16 * segment_tokens)

    def level(k: int) -> int:
        def code(range_: pa.Table) -> pa.Table:
            return _code(range_, folder, k)

        parts = docs.select("text").mapInArrow(lambda it: _count(it, folder, k, ranges, segment_tokens), "range long, blob binary")
        return parts.groupBy("range").applyInArrow(code, "nodes long").agg(F.sum("nodes")).first()[0] or 0

    for k in range(1, order + 1):
        if not level(k):
            break
    return folder


def _score(batches: Iterator[pa.RecordBatch], folder: str, order: int) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, "text", STEP):
        h, starts = tokens(*utf8(b.column(2)))
        n, t = np.diff(starts), trie(folder, order)
        if t.levels:
            w = t.walk(h, starts)
            total = t.levels[0].total
            sums = [np.add.reduceat(x, starts[:-1]) for x in ((w["count"] > 0).astype(np.int64), np.log10(w["base"]), np.log10(w["p"]))]
        else:
            total, sums = 0, [np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, (n, *sums)), pa.array(np.full(len(n), total, np.int64))], names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score", "train_tokens"])


def scored(docs: DataFrame, training: Column, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Learns from the rows where `training` (a condition on doc_id) holds, and scores all: doc_id, train, n_tokens, n_known, base_score, score, train_tokens."""
    rows = pick(docs, {"doc_id": doc_id, "text": text}).select(F.col("doc_id").cast("long"), training.alias("train"), "text")
    folder = train(rows.filter("train"), order, segment_tokens)
    return rows.mapInArrow(lambda it: _score(it, folder, order), f"{SCHEMA}, train_tokens long")
