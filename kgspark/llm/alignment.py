"""Operator 13: alignment of two tokenizers over a corpus.

A text is encoded by a byte-level BPE tokenizer (A) and by a sentencepiece model (B). Byte offsets where tokens of both end cut the text into
groups; all A tokens of a group are linked with all its B tokens. How often an A id and a B id are linked is counted in documents.

Identity map: an array gives for each A id the B id of the same bytes. In most groups one A token meets exactly that B token, so those
pairs are counted in a vector as long as A's vocabulary, one for each task, summed afterwards. Only the pairs of other groups are shuffled, and these
pre-aggregated. Their counts are kept as sorted arrays in files of the shared folder; tasks map those they
need into memory and look up each distinct chunk once. No text and no document's links are moved.

Texts are cut into chunks before each run of spaces: no token of A or B reaches across such a cut (B: checked on its pieces), so that a task
encodes and aligns each distinct chunk once while it remembers it.

Null and empty texts, and texts whose joined tokens differ from a space and the text (B normalises or has no such piece), have no tokens:
zeros and ''. Texts of any length are worked on whole. Null doc_ids are kept; repeated rows count as documents of their own. Extra columns of the
input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import _alphabet
from .shared import Folder, pick, shared_folder, small_batches, written

SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Chunks, and bytes of them, that a task remembers: beyond that it forgets all before the next step.
CACHE_CHUNKS, CACHE_BYTES = 400_000, 8_000_000
#: Distinct pairs that a task gathers before it hands them on.
GATHERED = 400_000
#: Files of pairs; a prime, so that pairs are spread evenly.
SHARDS = 509
#: Links of a group that are listed one by one; larger groups are listed by distinct ids.
LISTED = 4096

_CUT = re.compile(r"(?<=\S)(?= )")
#: Chunks of characters whose kind no library's version of Unicode sees differently; longer ones go to A's own library, too.
_COMMON = re.compile(r"[\x00-\u024f]{1,200}")
_SPACE = "▁"


class Tokenizers:
    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in _alphabet().items()}
        n = self.a.get_vocab_size()
        self.a_bytes = [bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t in map(self.a.id_to_token, range(n))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces):
            raise ValueError("B has pieces that reach across a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.n_b = len(pieces)
        same: dict[bytes, int] = {}
        for i, raw in enumerate(self.b_bytes):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                # a piece goes before the single byte that stands in where no piece does
                if raw not in same or self.b.is_byte(same[raw]):
                    same[raw] = i
        self.identity = np.array([same.get(raw, -1) for raw in self.a_bytes], np.int64)
        self.a_size, self.b_size = (np.array([len(x) for x in some], np.int64) for some in (self.a_bytes, self.b_bytes))
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(x), np.uint8) for x in (self.a_bytes, self.b_bytes))
        self.a_at, self.b_at = (np.r_[0, np.cumsum(x)] for x in (self.a_size, self.b_size))
        self._mark = self.b.encode("a")
        self._ranks = self._ranked(a_path)

    def _ranked(self, a_path: str):
        """A faster encoder of the same ids, where A is plain byte-level BPE whose ids are in the order of its merges; else None."""
        import json

        import public_tokenizers
        import tiktoken

        with open(a_path) as f:
            a = json.load(f)
        model, cut = a["model"], a["pre_tokenizer"] or {}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not a["normalizer"]
        if model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges"):
            return None
        if [model["vocab"][x + y] for x, y in pairs] != list(range(256, 256 + len(pairs))):
            return None
        ranks = {self.a_bytes[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def encode_a(self, chunks: Sequence[str]) -> list[list[int]]:
        if self._ranks is None:
            return [e.ids for e in self.a.encode_batch_fast(list(chunks), add_special_tokens=False)]
        fast, common = self._ranks, _COMMON.fullmatch
        return [fast(c) if common(c) else self.a.encode(c, add_special_tokens=False).ids for c in chunks]

    def encode_b(self, chunks: Sequence[str]) -> list[list[int]]:
        """B's ids of chunks that begin with a space, which B adds by itself before the rest."""
        if any(c.isspace() for c in chunks):  # it adds none before nothing: these are encoded behind a letter
            return [self.b.encode("a" + c)[len(self._mark) :] if c.isspace() else self.b.encode(c[1:]) for c in chunks]
        return self.b.encode([c[1:] for c in chunks], num_threads=1)


def chunks_of(text: str) -> list[str]:
    return _CUT.split(" " + text)


class Aligned:
    """Groups and pairs of distinct chunks, each worked out once."""

    def __init__(self, tokenizers: Tokenizers, texts: bool = True):
        self.t, self.texts = tokenizers, texts
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.text: list[bytes] = []  # the groups of a chunk, each ended by ;
        self.ok, self.counts = np.zeros(0, bool), np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.at, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Of all chunks of the texts their numbers, where each text's begin, and the number of the first chunk that is new here."""
        if len(self.number) > CACHE_CHUNKS or self.held > CACHE_BYTES:
            self.clear()
        number, old, out, ends = self.number, len(self.number), [], [0]
        for text in texts:
            if text:
                chunks = chunks_of(text)
                there = list(map(number.get, chunks))
                if None in there:
                    there = [number.setdefault(c, len(number)) if k is None else k for c, k in zip(chunks, there, strict=True)]
                out += there
            ends.append(len(out))
        if len(number) > old:
            self._add(list(number)[old:] if old else list(number))
        return np.array(out, np.int64), np.array(ends, np.int64), old

    def _add(self, new: list[str]) -> None:
        t = self.t
        raw = [c.encode("utf-8", "surrogatepass") for c in new]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.held += int(size.sum())
        (a, n_a), (b, n_b) = (self._flat(ids) for ids in (t.encode_a(new), t.encode_b(new)))
        raw = np.frombuffer(b"".join(raw), np.uint8)
        ok = self._same(a, n_a, t.a_flat, t.a_at, raw, size) & self._same(b, n_b, t.b_flat, t.b_at, raw, size)
        a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
        n_a, n_b = n_a * ok, n_b * ok
        end_a, end_b = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
        # a group ends where tokens of both end; the end of a chunk is one, so all chunks are cut at once
        last_a = np.flatnonzero(np.isin(end_a, end_b, assume_unique=True))
        last_b = np.searchsorted(end_b, end_a[last_a])
        from_a, from_b = np.r_[0, last_a[:-1] + 1][: len(last_a)], np.r_[0, last_b[:-1] + 1][: len(last_b)]
        many_a, many_b = last_a - from_a + 1, last_b - from_b + 1
        chunk = np.searchsorted(np.cumsum(n_a), last_a, "right")  # the chunk of each group
        n = len(new)
        groups = np.bincount(chunk, minlength=n)
        links = np.bincount(chunk, many_a * many_b, minlength=n).astype(np.int64)
        keys, owner, times = self._pairs(a, b, from_a, from_b, many_a, many_b, chunk)
        self.ok = np.r_[self.ok, ok]
        self.counts = np.r_[self.counts, np.stack([n_a, n_b, groups, links], 1)]
        self.at = np.r_[self.at, self.at[-1] + np.cumsum(np.bincount(owner, minlength=n))]
        self.pairs, self.times = np.r_[self.pairs, keys], np.r_[self.times, times]
        if self.texts:
            self.text += self._texts(a, b, many_a, many_b, chunk, n)

    @staticmethod
    def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(n.sum())), n

    @staticmethod
    def _same(ids: np.ndarray, n: np.ndarray, flat: np.ndarray, at: np.ndarray, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes of each chunk's tokens are the chunk's."""
        place, many = _spread(at, ids)
        owner = np.repeat(np.arange(len(n)), n)
        total = np.bincount(owner, many, minlength=len(n)).astype(np.int64)
        ok = total == size
        made, there = flat[place][np.repeat(ok, total)], raw[np.repeat(ok, size)]
        wrong = np.flatnonzero(made != there)
        ok[np.repeat(np.flatnonzero(ok), size[ok])[wrong]] = False
        return ok

    def _pairs(self, a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, many_a: np.ndarray, many_b: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each chunk its distinct pairs, as A id * B's ids + B id, and how often each is linked."""
        n_b, parts = self.t.n_b, []
        one = np.flatnonzero((many_a == 1) & (many_b == 1))
        parts.append((a[from_a[one]] * n_b + b[from_b[one]], chunk[one], np.ones(len(one), np.int64)))
        more = np.flatnonzero((many_a * many_b > 1) & (many_a * many_b <= LISTED))
        if len(more):
            product = many_a[more] * many_b[more]
            g = np.repeat(more, product)
            k = np.arange(int(product.sum())) - np.repeat(np.cumsum(product) - product, product)
            parts.append((a[from_a[g] + k // many_b[g]] * n_b + b[from_b[g] + k % many_b[g]], chunk[g], np.ones(len(g), np.int64)))
        for g in np.flatnonzero(many_a * many_b > LISTED).tolist():
            (x, nx), (y, ny) = (np.unique(ids[i : i + m], return_counts=True) for ids, i, m in ((a, from_a[g], many_a[g]), (b, from_b[g], many_b[g])))
            keys = (x[:, None] * n_b + y[None, :]).ravel()
            parts.append((keys, np.full(len(keys), chunk[g]), (nx[:, None] * ny[None, :]).ravel()))
        keys, owner, times = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((keys, owner))
        keys, owner, times = keys[order], owner[order], times[order]
        if not len(keys):
            return keys, owner, times
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])
        return keys[first], owner[first], np.add.reduceat(times, first)

    def _texts(self, a: np.ndarray, b: np.ndarray, many_a: np.ndarray, many_b: np.ndarray, chunk: np.ndarray, n: int) -> list[bytes]:
        """The groups of each chunk as `a1,a2|b1;a3|b2,b3;`, all at once: each id's digits and the mark behind it."""
        first = np.cumsum(many_a + many_b) - many_a - many_b  # where a group's ids begin, those of A before those of B
        at_a, _ = _runs(first, many_a)
        at_b, _ = _runs(first + many_a, many_b)
        ids = np.empty(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[first + many_a - 1], mark[first + many_a + many_b - 1] = ord("|"), ord(";")
        width = len(str(max(len(self.t.a_size), len(self.t.b_size))))
        digits = np.empty((len(ids), width + 1), np.uint8)
        for k in range(width):
            digits[:, k] = ids // 10 ** (width - 1 - k) % 10 + ord("0")
        digits[:, width] = mark
        long_ = np.maximum(1, np.ceil(np.log10(ids + 1)).astype(np.int64)) + 1
        shown = np.arange(width + 1)[None, :] >= width + 1 - long_[:, None]
        text = digits[shown].tobytes()
        size = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(long_, out=size[1:])
        groups = np.r_[first, len(ids)]
        ends = size[groups[np.searchsorted(chunk, np.arange(n), "right")]].tolist()
        return [text[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def _runs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of runs that begin at `first` and are `size` long, and the run of each."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum())), size


def _spread(at: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the runs `some` of at (n+1 bounds), and how long each run is."""
    return _runs(at[some], at[some + 1] - at[some])


def _documents(numbers: np.ndarray, ends: np.ndarray, aligned: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and chunk of all chunks of documents that have tokens, and which documents these are."""
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    whole = np.bincount(doc, ~aligned.ok[numbers], minlength=len(ends) - 1) == 0
    whole &= np.diff(ends) > 0
    keep = whole[doc]
    return doc[keep], numbers[keep], whole


def pair_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """docs (doc_id, text). pair (A id * B's ids + B id) and the number of documents that have it linked; `vector` tells that it is a pair of the identity map."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tokenizers(a_path, b_path)
        aligned, vector = Aligned(t, texts=False), np.zeros(len(t.identity), np.int64)
        others: list[tuple[np.ndarray, np.ndarray]] = []
        gathered = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate(x) for x in zip(*others, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, n).astype(np.int64)

        def rows(keys: np.ndarray, n: np.ndarray, exact: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(np.full(len(keys), exact))], names=["pair", "n", "vector"])

        for b in small_batches(batches, "text"):
            numbers, ends, _ = aligned.numbers(b.column("text").to_pylist())
            doc, chunk, _ = _documents(numbers, ends, aligned)
            doc, chunk = np.divmod(np.unique(doc * (len(aligned.number) + 1) + chunk), len(aligned.number) + 1)
            at, size = _spread(aligned.at, chunk)
            keys, doc = aligned.pairs[at], np.repeat(doc, size)
            order = np.lexsort((doc, keys))
            keys, doc = keys[order], doc[order]
            keys = keys[np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])][: len(keys)]]  # each document once
            a = keys // t.n_b
            exact = t.identity[a] == keys % t.n_b
            vector += np.bincount(a[exact], minlength=len(vector))
            others.append(np.unique(keys[~exact], return_counts=True))
            gathered += len(others[-1][0])
            if gathered > GATHERED:
                others = [merged()]
                gathered = len(others[0][0])
                if gathered > GATHERED // 2:
                    yield rows(*others[0], False)
                    others, gathered = [], 0
        if gathered:
            yield rows(*merged(), False)
        some = np.flatnonzero(vector)
        if len(some):
            yield rows(some * t.n_b + t.identity[some], vector[some], True)

    found = docs.select("text").mapInArrow(count, "pair long, n long, vector boolean")
    return found.groupBy("pair", "vector").agg(F.sum("n").alias("n"))


class PairArrays:
    """Sorted pairs and their counts, in SHARDS files; opened when first needed."""

    def __init__(self, folder: str):
        self.there, self.open = Folder(folder), {}

    @staticmethod
    def coded(pairs: np.ndarray, counts: np.ndarray) -> bytes:
        order = np.argsort(pairs)
        return pairs[order].astype("<i8").tobytes() + counts[order].astype("<i8").tobytes()

    def counts(self, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), np.int64)
        shard = pairs % SHARDS
        for r in np.unique(shard).tolist():
            if r not in self.open:
                self.open[r] = self.there.mapped(f"pairs/{r}").view("<i8").reshape(2, -1)
            at = np.flatnonzero(shard == r)
            known, n = self.open[r]
            out[at] = n[np.searchsorted(known, pairs[at])]
        return out


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document the columns of SCHEMA. Counts are of documents of the whole table."""
    folder = shared_folder(docs.sparkSession)
    docs = pick(docs, {"doc_id": doc_id, "text": text})
    counts = written(pair_counts(docs, a_path, b_path), folder, "counts")
    t = Tokenizers(a_path, b_path)
    n_b, n_a = t.n_b, len(t.identity)

    def build(some: pa.Table) -> pa.Table:
        data = PairArrays.coded(some.column("pair").to_numpy(), some.column("n").to_numpy())
        Folder(folder).write(f"pairs/{some.column('shard')[0].as_py()}", data)
        return some.slice(0, 1).select(["shard"])

    counts.filter("not vector").select("pair", "n", (F.col("pair") % SHARDS).alias("shard")).groupBy("shard").applyInArrow(build, "shard long").count()
    # both are at most as long as A's vocabulary
    vector, best = np.zeros(n_a, np.int64), np.zeros(n_a, np.int64)
    a_id = F.floor(F.col("pair") / n_b).cast("int")
    for row in counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("best"), F.max(F.when(F.col("vector"), F.col("n"))).alias("exact")).toLocalIterator():
        best[row.a], vector[row.a] = row.best, row.exact or 0

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned, there = Aligned(Tokenizers(a_path, b_path)), PairArrays(folder)
        sums = np.zeros((0, 2), np.int64)  # best links and sum of counts of each chunk

        def judged(first: int) -> np.ndarray:
            at = aligned.at[first:]
            pairs, times = aligned.pairs[at[0] :], aligned.times[at[0] :]
            a = pairs // n_b
            exact = aligned.t.identity[a] == pairs % n_b
            n = np.where(exact, vector[a], 0)
            keys, back = np.unique(pairs[~exact], return_inverse=True)
            n[~exact] = there.counts(keys)[back]
            total = np.zeros((len(pairs) + 1, 2), np.int64)
            np.cumsum(np.stack([times * (n == best[a]), times * n], 1), 0, out=total[1:])
            return total[at[1:] - at[0]] - total[at[:-1] - at[0]]

        for b in small_batches(batches, "text"):
            numbers, ends, first = aligned.numbers(b.column("text").to_pylist())
            sums = np.r_[sums[:first], judged(first)] if len(aligned.number) > first else sums
            doc, chunk, whole = _documents(numbers, ends, aligned)
            out = np.zeros((b.num_rows, 6), np.int64)
            values = np.concatenate([aligned.counts[chunk], sums[chunk]], 1)
            if len(doc):
                begins = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                out[doc[begins]] = np.add.reduceat(values, begins, 0)
            digests = []
            for i, full in enumerate(whole.tolist()):
                some = numbers[ends[i] : ends[i + 1]].tolist() if full else ()
                digests.append(hashlib.sha256(b"".join([aligned.text[k] for k in some])[:-1]).hexdigest() if full else "")
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(out[:, k]) for k in range(6)), pa.array(digests, pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.mapInArrow(judge, SCHEMA)
