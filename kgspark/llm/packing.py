"""Operator 6: cost-balanced packing of tokenised documents into training sequences.

The cost of a sequence is estimated as `linear * tokens + quadratic * sum(piece length squared)`: attention of a packed sequence stays
within each piece. In a window of documents, as many sequences are opened as their tokens fill; documents go in descending cost, each to
the sequence of the lowest cost that has room for it. A document that fills sequences by itself is cut into whole ones and a rest; what then fits
nowhere whole is cut over the sequences with room left. Every
sequence of a window is so filled to the last token; the rest of a window goes to the next one. The tokens left at the end of a partition
go to sequences whose lengths are powers of two, which need no padding.

Tokens never leave the task that made them, so nothing is shuffled: a task packs the documents of its partition.

Null text: as empty text, which still has its end token. Repeated rows and ties: each row is packed by itself, in the order of tokens
(descending), then doc_id (null last). A document of any length is cut. Extra columns of the input are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import mix, pick, powers, small_batches

SEQUENCE = 4096
#: Tokens that a window gathers before it is packed.
WINDOW_TOKENS = 1 << 20
#: Words whose ids a task remembers.
CACHE_WORDS = 1_500_000
END_ID = 2
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"


def _alphabet() -> dict[int, str]:
    """Byte-level BPE writes each byte as one visible character: itself where it is one, else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordIds:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer normalises a text, cuts it into pieces (runs of letters, single digits, runs of other marks, and a few endings such as 's) and
    merges the bytes of each piece. The pieces of many texts are cut here at once, by the same rule on arrays of code points; the distinct ones
    are found by two 64-bit hashes, and merged by the tokenizer's own model, each once while it is remembered. A text with anything that this rule may cut
    differently (characters of kind RARE, text that normalisation changes, special tokens) goes through the whole tokenizer.
    """

    SPACE, LETTER, DIGIT, MARK, RARE = range(5)
    #: Separators that only some count as white space; letters that lower-case in context or to two characters.
    SEPARATORS, CASES = "\x1c\x1d\x1e\x1f", ("\u03a3", "\u0130")
    #: Endings that are pieces of their own where their apostrophe begins a run of marks.
    ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
    #: Characters of the longest piece that is remembered.
    LONGEST = 64

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model  # without normaliser and cutting
        self.bytes = _alphabet()
        self.kinds = np.full(0x110000, self.RARE, np.uint8)
        for c in range(0x10000):
            self.kinds[c] = self._kind(chr(c))
        self.keys, self.checks, self.at, self.n, self.seen = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.step = np.zeros(0, "<u4"), 0

    @classmethod
    def _kind(cls, c: str) -> int:
        if c in cls.SEPARATORS or c.isalnum() and not c.isalpha() and not c.isdecimal():
            return cls.RARE
        if c.isspace():
            return cls.SPACE
        return cls.LETTER if c.isalpha() else cls.DIGIT if c.isdecimal() else cls.MARK

    def _merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has."""
        tokenize, alphabet = self.model.tokenize, self.bytes
        ids = [[t.id for t in tokenize(w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(alphabet))] for w in pieces]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for x in ids for i in x), "<u4", int(n.sum())), n

    def _plain(self, text: str) -> bool:
        return "<|" not in text and (text.isascii() or not any(c in text for c in self.CASES) and unicodedata.is_normalized("NFC", text))

    def _cut(self, points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces start and end; the last point is a space."""
        start = np.ones(len(kinds), bool)
        start[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == self.DIGIT)
        start &= kinds != self.SPACE
        quote = np.flatnonzero((points == 39) & start)
        padded = np.append(points, np.zeros(3, points.dtype))
        for e in self.ENDINGS:
            hit = quote
            for k, c in enumerate(e):
                hit = hit[padded[hit + 1 + k] == ord(c)]
            start[hit + 1] = False
            if len(e) == 2:
                start[hit + 2] = False
            start[hit + 1 + len(e)] = kinds[hit + 1 + len(e)] != self.SPACE
            quote = np.setdiff1d(quote, hit, assume_unique=True)
        starts = np.flatnonzero(start)
        spaces = np.append(np.flatnonzero(kinds == self.SPACE), len(kinds))
        ends = np.minimum(np.append(starts[1:], len(kinds)), spaces[np.searchsorted(spaces, starts)])
        return starts, ends

    def _found(self, joined: str, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece: where its ids are among self.ids, and how many."""
        key, first, place = np.unique(keys, return_index=True, return_inverse=True)
        if np.any(checks[first][place] != checks):  # two pieces of one key: tell them apart by the check as well
            keys = mix(keys + checks)
            key, first, place = np.unique(keys, return_index=True, return_inverse=True)
        check = checks[first]
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        known = (self.keys[at] == key) & (self.checks[at] == check) if len(self.keys) else np.zeros(len(key), bool)
        self.step += 1
        self.seen[at[known]] = self.step
        where, n = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        where[known], n[known] = self.at[at[known]], self.n[at[known]]
        new = np.flatnonzero(~known)
        s, e = starts[first[new]], ends[first[new]]
        ids, n[new] = self._merged([joined[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])
        where[new] = len(self.ids) + np.cumsum(n[new]) - n[new]
        self.ids = np.concatenate([self.ids, ids])
        keep = new[(e - s <= self.LONGEST) & ~np.isin(key[new], self.keys[at[new]] if len(self.keys) else key[:0])]
        into = np.searchsorted(self.keys, key[keep])
        self.keys, self.checks = np.insert(self.keys, into, key[keep]), np.insert(self.checks, into, check[keep])
        self.at, self.n, self.seen = np.insert(self.at, into, where[keep]), np.insert(self.n, into, n[keep]), np.insert(self.seen, into, self.step)
        return where[place], n[place]

    def _forget(self) -> None:
        """Beyond the bound, the half of the words that were met longest ago go, and ids that no word has any more."""
        if len(self.keys) > self.most or len(self.ids) > 8 * self.most:
            keep = np.argsort(-self.seen, kind="stable")[: self.most // 2]
            keep.sort()
            self.keys, self.checks, self.n, self.seen = self.keys[keep], self.checks[keep], self.n[keep], self.seen[keep]
            self.ids = self.ids[_runs(self.at[keep], self.n)]
            self.at = np.cumsum(self.n) - self.n

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        plain = [self._plain(t or "") for t in texts]
        lows = [(t or "").lower() if ok else "" for t, ok in zip(texts, plain, strict=True)]
        joined = " ".join([*lows, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, lows), np.int64, len(lows)) + 1
        begins = np.cumsum(sizes) - sizes
        kinds = self.kinds[points]
        rare = np.zeros(len(texts), bool)
        rare[np.searchsorted(begins, np.flatnonzero(kinds == self.RARE), "right") - 1] = True
        kinds[kinds == self.RARE] = self.SPACE
        starts, ends = self._cut(points, kinds)
        where, n = self._found(joined, starts, ends, *_span_hashes(points, starts, ends)) if len(starts) else (begins[:0], begins[:0])
        ids = self.ids[_runs(where, n)]
        self._forget()
        before = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, np.append(begins, len(points)))].tolist()
        return [
            ids[a:b].tobytes() if ok and not odd else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            for t, ok, odd, a, b in zip(texts, plain, rare.tolist(), before[:-1], before[1:], strict=True)
        ]


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of n[0] places, then those of the next."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - n), n)


def _span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each span of code points, the same wherever it stands."""
    out = []
    for values in (points.astype(np.uint64) + np.uint64(1), mix(points.astype(np.uint64) + np.uint64(0x9E3779B1))):
        up, down = powers(len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(values * up[: len(points)], out=total[1:])
        out.append(mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return out[0], out[1]


_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    if path not in _ids:
        _ids[path] = WordIds(path)
    return _ids[path]


def assign(lengths: list[int], capacities: list[int]) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, length, sequence) of documents in descending cost; all capacities together hold all tokens."""
    room, cost = np.array(capacities, np.int64), np.zeros(len(capacities))
    out, cut = [], []

    def put(d: int, start: int, n: int, s: int) -> None:
        out.append((d, start, n, s))
        room[s] -= n
        cost[s] += LINEAR * n + QUADRATIC * n * n

    for d, n in enumerate(lengths):
        s = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[s] >= n:
            put(d, 0, n, s)
        else:
            cut.append(d)
    for d in cut:
        at = 0
        while at < lengths[d]:
            s = int(np.argmin(np.where(room > 0, cost, np.inf)))
            n = min(int(room[s]), lengths[d] - at)
            put(d, at, n, s)
            at += n
    return out


def _descending(d: tuple[int, int, bytes, int]) -> tuple:
    return -len(d[2]), d[0] is None, d[0] or 0, d[1]


def pack_window(docs: list[tuple[int, int, bytes, int]], sequence: int, last: bool) -> tuple[list[tuple], list[tuple[int, int, bytes, int]]]:
    """docs: (doc_id, start, ids, tokens of the whole document). Pieces with the number of their sequence in this window, and what is left over."""
    pieces, rest = [], []
    for i, start, ids, whole in sorted(docs, key=_descending):  # what fills a sequence has one of its own
        full = len(ids) // (4 * sequence)
        pieces += [(i, start + k * sequence, sequence, ids[4 * k * sequence : 4 * (k + 1) * sequence], whole, len(pieces) + k, 0) for k in range(full)]
        if len(ids) > 4 * full * sequence:
            rest.append((i, start + full * sequence, ids[4 * full * sequence :], whole))
    docs, own = sorted(rest, key=_descending), len(pieces)
    total = sum(len(d[2]) for d in docs) // 4
    sizes = [sequence] * (total // sequence)
    spare = total % sequence
    if last:
        sizes += [1 << b for b in range(spare.bit_length() - 1, -1, -1) if spare >> b & 1]
        left: list = []
    else:  # the smallest documents wait, the last of them in part
        left = []
        while spare:
            i, start, ids, whole = docs.pop()
            n = min(spare, len(ids) // 4)
            keep = len(ids) - 4 * n
            if keep:
                docs.append((i, start, ids[:keep], whole))
            left.append((i, start + keep // 4, ids[keep:], whole))
            spare -= n
    filled = [0] * len(sizes)
    for d, at, n, s in assign([len(x[2]) // 4 for x in docs], sizes) if sizes else ():
        i, start, ids, whole = docs[d]
        pieces.append((i, start + at, n, ids[4 * at : 4 * (at + n)], whole, own + s, filled[s]))
        filled[s] += n
    return pieces, left


def _pack(batches: Iterator[pa.RecordBatch], path: str, sequence: int, window: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 36
    ids_of, end = word_ids(path), np.array([END_ID], "<u4").tobytes()
    waiting: list[tuple[int, int, bytes, int]] = []
    held, used = 0, 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal waiting, held, used
        pieces, waiting = pack_window(waiting, sequence, last)
        held = sum(len(x[2]) for x in waiting) // 4
        size, cost = {}, {}
        for p in pieces:
            size[p[5]] = size.get(p[5], 0) + p[2]
            cost[p[5]] = cost.get(p[5], 0.0) + LINEAR * p[2] + QUADRATIC * p[2] * p[2]
        for k in range(0, len(pieces), 2000):
            i, start, n, ids, whole, s, at = zip(*pieces[k : k + 2000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(whole, pa.int64()), pa.array([first + used + x for x in s], pa.int64()), pa.array(at, pa.int64()), pa.array([size[x] for x in s], pa.int64()), pa.array([cost[x] for x in s], pa.float64())],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )
        used += len(size)

    for b in small_batches(batches, "text"):
        texts = b.column(1).to_pylist()
        for i, ids in zip(b.column(0).to_pylist(), ids_of(texts), strict=True):
            ids += end
            waiting.append((i, 0, ids, len(ids) // 4))
            held += len(ids) // 4
            if held >= window:
                yield from flush(False)
    if waiting:
        yield from flush(True)


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, window: int = WINDOW_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their token ids (little-endian unsigned 32-bit) and their place in the packed sequences."""
    return pick(docs, {"doc_id": doc_id, "text": text}).mapInArrow(lambda it: _pack(it, tokenizer, sequence, window), SCHEMA)


def ids_crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
