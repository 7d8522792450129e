"""The vocabulary of a file against brute force; null ids and repeated rows of operators that work row by row."""

import math
import random

import public_tokenizers
import pytest

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_tokens(word, scores):
    unknown = min(scores.values()) - 1
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        found = [(best[j][0] + scores[word[j:i]], best[j][1] + 1) for j in range(i) if word[j:i] in scores]
        size = len(word[i - 1].encode())
        best.append(max(found, key=lambda x: (x[0], -x[1])) if found else (best[i - 1][0] + unknown * size, best[i - 1][1] + size))
    return best[-1][1]


def test_ranked_vocabulary(spark):
    """Pieces in the order of the file, without marks of word beginnings, each once; counts of real words with them."""
    import sentencepiece

    from kgspark.llm import token_counts as tc

    scores = tc.ranked_vocabulary(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    seen = []
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i).replace("▁", "")
        if p and p not in seen[-2000:] and p not in scores.keys() - set(scores):
            seen.append(p)
    first = list(dict.fromkeys(p for p in seen if not (p.startswith("<") and p.endswith(">") and p in ("<unk>", "<s>", "</s>") or p.startswith("<0x"))))
    assert list(scores) == first and list(scores.values())[:3] == [-math.log(2), -math.log(3), -math.log(4)]
    r = random.Random(2)
    words = ["the", "Theablenn,", "réeaution***", "日本語", "x" * 70, "🙂🙃", "aulich", "a"] + ["".join(r.choice("abcdeéñ,.") for _ in range(r.randint(1, 14))) for _ in range(40)]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(None, "the the"), (7, "aulich"), (7, "aulich")], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.n_words, x.n_tokens) for x in tc.token_counts(docs, PIECES).collect())
    want = [(str(i), 1, plain_tokens(w, scores)) for i, w in enumerate(words)]
    want += [("None", 2, 2 * plain_tokens("the", scores)), *[("7", 1, plain_tokens("aulich", scores))] * 2]
    assert got == sorted(want)


ROWS = [(None, "some words here"), (None, None), (3, "some words here"), (3, "some words here"), (4, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2)


def test_null_ids_and_repeats_in_packing(docs):
    from kgspark.llm.packing import pack

    rows = pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    sizes = {}
    for p in rows:
        sizes.setdefault(p.doc_id, []).append(p.length)
    assert sum(sizes[3]) == 8 and sum(sizes[None]) == 5 and sum(sizes[4]) == 1
    assert len({(p.sequence_id, p.offset) for p in rows}) == len(rows)


def test_null_ids_and_repeats_in_media(docs):
    from kgspark.llm.media import media_columns

    rows = media_columns(docs).collect()
    assert sorted(str(x.doc_id) for x in rows) == ["3", "3", "4", "None", "None"]
    assert len({x.feature for x in rows if x.n_bytes}) == 1 and len({bytes(x.media) for x in rows if not x.n_bytes}) == 1


def test_null_ids_in_quality(spark, docs):
    from kgspark.llm import quality

    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, label int")
    rows = quality.scores(docs, quality.train(docs, labels)).collect()
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x.score)
    assert len(rows) == 5 and len(set(by[3])) == 1 and by[3][0] in by[None]


def test_repeats_in_url_filter(spark):
    from kgspark.llm.url_filter import filter_urls

    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, "http://a.org/x"), (None, None)], "page_id long, url string")
    blocked = spark.createDataFrame([("a.org/x",), ("a.org/x",), (None,)], "key string")
    rows = filter_urls(pages, (), blocked).collect()
    assert sorted((str(x.page_id), x.verdict) for x in rows) == [("1", "block"), ("1", "block"), ("None", "allow"), ("None", "block")]
