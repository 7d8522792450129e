"""Alignment of two tokenizers against a plain version."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from kgspark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n string, pair string, `range` string, vector string, row string"


def plain(rows, t):
    """The contract word by word, for (doc_id, text) rows."""
    links, out = {}, []
    for k, (_, text) in enumerate(rows):
        groups = []
        if text:
            ids_a, ids_b = t.a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)
            raw = (" " + text).encode()
            if b"".join(t.a_bytes[i] for i in ids_a) == raw and b"".join(t.b_bytes[i] for i in ids_b) == raw:
                ends = []
                for ids, size in ((ids_a, t.a_bytes), (ids_b, t.b_bytes)):
                    at, some = 0, {}
                    for n, i in enumerate(ids, 1):
                        at += len(size[i])
                        some[at] = n
                    ends.append(some)
                i = j = 0
                for at in sorted(set(ends[0]) & set(ends[1])):
                    groups.append((ids_a[i : ends[0][at]], ids_b[j : ends[1][at]]))
                    i, j = ends[0][at], ends[1][at]
        links[k] = groups
    count = Counter()
    for groups in links.values():
        count.update({(a, b) for x, y in groups for a in x for b in y})
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for k, (doc_id, _) in enumerate(rows):
        groups = links[k]
        pairs = [(a, b) for x, y in groups for a in x for b in y]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(pairs), sum(count[p] == best[p[0]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


ODD = [
    None, "", " ", "   ", "a", "a ", " a", "a  b   c", "\n", "a\n b \n\n  c\t d", " x  y　 z", "it's 'll we'LL 12,345.67", "<s> </s> <unk> <0x41> <|endoftext|> [PAD]", "x▁y", "a ▁ b",
    "naïve 日本語の 文 рус \U0001f642\U0001f468‍\U0001f469", "\x00 a\x1cb \x1f c \x85 d", "é é ﬁ Ａ ①", "z" * 3000, "é" * 500 + " q", " " * 700 + "end", "퟿ � ﻿ a",
]


def rows():
    r = random.Random(3)
    words = ["the", "thing", "ing", "aulich", "réeaution", "***", "%%%", "Theablenn,", "x1y2", "(a)", "--", "café.", "中文"]
    out = [(i, t) for i, t in enumerate(ODD)]
    for i in range(40):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\n", ""]) for _ in range(r.randint(1, 60)))
        out.append((100 + i, text))
    out += [(100, out[30][1]), (None, out[31][1]), (7, out[32][1] * 40)]
    return out


@pytest.fixture(scope="module")
def t():
    return alignment.Tokenizers(A, B)


def found(df):
    return sorted(map(tuple, alignment.align(df, A, B).collect()), key=str)


def test_alignment(spark, t):
    some = rows()
    df = spark.createDataFrame([(i, x, "n", "p", "r", "v", "w") for i, x in some], SCHEMA).repartition(3)
    assert found(df) == sorted(plain(some, t), key=str)
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    assert found(df.filter("text is null or text = ''")) == [(0, *[0] * 6, ""), (1, *[0] * 6, "")]


def test_alignment_with_small_bounds(spark, t, monkeypatch):
    """Chunks forgotten in each step, pairs handed on at once, links by distinct ids."""
    from kgspark.llm import shared

    some = rows()
    whole = alignment.Aligned(t)
    whole.numbers([x for _, x in some])
    monkeypatch.setattr(alignment, "LISTED", 1)
    again = alignment.Aligned(t)
    again.numbers([x for _, x in some])
    assert (whole.pairs == again.pairs).all() and (whole.times == again.times).all() and (whole.at == again.at).all()
    monkeypatch.setattr(alignment, "CACHE_CHUNKS", 3)
    few = alignment.Aligned(t)
    for _, x in some:
        numbers, ends, first = few.numbers([x])
        assert len(few.number) <= 3 or first == 0 or len(few.number) > first
    assert shared.STEP_BYTES


def test_identity_map(t):
    for a in range(0, len(t.a_bytes), 7):
        b = t.identity[a]
        if b >= 0:
            assert t.b_bytes[b] == t.a_bytes[a]
    assert sum(t.identity >= 0) > 10_000


def test_alignment_of_documents(spark, t):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    some = [(r.doc_id, r.text) for r in docs.collect()]
    df = spark.createDataFrame(some, "doc_id long, text string")
    assert found(df) == sorted(plain(some, t), key=str)
