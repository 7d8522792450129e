"""Operator 3: token counts by a unigram vocabulary, with a trie-shared forward pass.

A pre-token (a run of bytes other than ASCII white space) is segmented into vocabulary pieces of the highest total score; its token count
is that of the best segmentation (of equally good ones, the one with fewer tokens). best[i] = max over pieces ending at i of
best[start] + score depends on the first i characters only. So the distinct pre-tokens of a step, in order, are walked as the paths of
a trie: each keeps the forward scores of the prefix that it shares with the one before, and adds those of its own characters; the count
at its end is stored. Counts are remembered per Python worker, and documents sum those of their pre-tokens.

Characters without a piece cost one token for each of their UTF-8 bytes, at the score of the rarest piece less one.

Null or empty text: no pre-tokens, 0 tokens. Repeated rows are kept. A very long pre-token is walked like any other, in time linear in its length. Extra
columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import pick, small_batches

#: Pre-tokens that a worker remembers.
CACHE_WORDS = 600_000
#: A pre-token of more characters is counted, but not remembered.
LONG = 256
SPACE = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, n_chars long, n_words long, n_tokens long"


def ranked_vocabulary(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file, scored as in a vocabulary by rank: log of 1 / (rank + 1), a unigram model after Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i).replace("▁", "") for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ranked = list(dict.fromkeys(p for p in pieces if p))
    return {p: -math.log(r + 1) for r, p in enumerate(ranked, 1)}


class TrieCounter:
    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 1
        self.ends: dict[str, tuple[int, ...]] = {}  # lengths of pieces by their last character
        for p in scores:
            self.ends.setdefault(p[-1], set()).add(len(p))  # type: ignore[arg-type]
        self.ends = {c: tuple(sorted(n)) for c, n in self.ends.items()}

    def counts(self, words: list[str]) -> dict[str, int]:
        """Token counts of distinct words; forward scores of a shared prefix are computed once."""
        out, best, tokens, before = {}, [0.0], [0], ""
        get, ends, unknown = self.scores.get, self.ends, self.unknown
        for w in sorted(words):
            n, same = len(w), 0
            for a, b in zip(before, w, strict=False):
                if a != b:
                    break
                same += 1
            del best[same + 1 :], tokens[same + 1 :]
            for i in range(same, n):
                c, top, count = w[i], -math.inf, 0
                for k in ends.get(c, ()):
                    if k > i + 1:
                        break
                    s = get(w[i + 1 - k : i + 1])
                    if s is not None:
                        s += best[i + 1 - k]
                        t = tokens[i + 1 - k] + 1
                        if s > top or s == top and t < count:
                            top, count = s, t
                if count == 0:
                    size = len(c.encode("utf-8", "surrogatepass"))
                    top, count = best[i] + unknown * size, tokens[i] + size
                best.append(top)
                tokens.append(count)
            out[w], before = tokens[n], w
        return out


class Counts:
    """Remembers the counts of words across the tasks of a worker."""

    def __init__(self, scores: dict[str, float], most: int = CACHE_WORDS):
        self.trie, self.most, self.known = TrieCounter(scores), most, {"": 0}

    def __call__(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        parts = [SPACE.sub(" ", t or "").split(" ") for t in texts]
        words = set().union(*parts)
        new = words - self.known.keys()
        if len(self.known) + len(new) > self.most:
            self.known = {"": 0}
            new = words - {""}
        found = self.trie.counts(list(new))
        local = {w: self.known[w] for w in words if w in self.known} | found
        self.known.update((w, n) for w, n in found.items() if len(w) <= LONG)
        get = local.__getitem__
        return [sum(map(bool, p)) for p in parts], [sum(map(get, p)) for p in parts]


_counts: dict[object, Counts] = {}


def _count(batches: Iterator[pa.RecordBatch], name: object, scores: Callable[[], dict[str, float]]) -> Iterator[pa.RecordBatch]:
    if name not in _counts:
        _counts[name] = Counts(scores())
    for b in small_batches(batches, "text"):
        texts = b.column(1).to_pylist()
        words, tokens = _counts[name](texts)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_chars", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str | dict[str, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """vocabulary: the path of a sentencepiece file (see ranked_vocabulary), or pieces with scores. doc_id, n_chars, n_words, n_tokens of each document."""
    name = vocabulary if isinstance(vocabulary, str) else frozenset(vocabulary.items())
    scores = (lambda: ranked_vocabulary(vocabulary)) if isinstance(vocabulary, str) else (lambda: vocabulary)
    return pick(docs, {"doc_id": doc_id, "text": text}).mapInArrow(lambda it: _count(it, name, scores), SCHEMA)


