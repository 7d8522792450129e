"""Each corpus operator against a plain version, on whole small tables with nulls, empty and long texts, ties, repeats, and clashing columns."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from .plain import WORD, classes, lowered, shingles, without_lines

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, `_maybe` string, ord string, row string"


def edge_rows():
    r = random.Random(5)
    base = [" ".join(f"w{r.randint(0, 400)}" for _ in range(60)) for _ in range(30)]
    texts = list(base)
    for t in base[:10]:
        w = t.split()
        w[7] = "changed"
        texts += [t, " ".join(w), t.upper()]
    texts += [None, "", "   ", "one", "One", "two words", "a\nb\n\na", "line of twenty characters\nline of twenty character!\nshort", "É" * 30 + "\n" + "x", "word " * 30_000, "\x00\ud7ff 🙂"]
    return [(i, t, "en", (None, "a", "b", "Z", "é")[i % 5], len(t or ""), 1, "h", "m", "o", "r") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), COLUMNS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_near_duplicates(spark, docs, empty):
    from kgspark.llm.near_dedup import near_duplicates, without_near_duplicates

    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    top = classes(sets).__getitem__
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    assert found == {i: (len(s), top(i), top(i) == i) for i, s in sets.items()}
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if top(i) == i)
    assert near_duplicates(empty).count() == 0
    twice = docs.filter("doc_id < 3").union(docs.filter("doc_id < 3")).union(spark.createDataFrame([(None,) * 10], COLUMNS))
    assert near_duplicates(twice).filter("doc_id is not null and kept").count() == 6


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Many documents under the same keys, in blocks of two: the classes of brute force."""
    from kgspark.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 2)
    r = random.Random(8)
    base = [f"w{r.randint(0, 999)}" for _ in range(120)]
    texts = []
    for i in range(40):  # families about 55 % alike, of two that are nearly equal
        own = base[:90] + [f"own{i}x{k}" for k in range(25)]
        texts += [" ".join(own), " ".join([*own[:-1], "other"])]
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == classes({i: shingles(t) for i, t in enumerate(texts)}) and len(set(got.values())) == 40


def test_hamming_join_guarantee():
    from kgspark.llm import near_dedup as nd

    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 16, (300, nd.SYMBOLS), np.uint16)
    b = a.copy()
    for row in b:
        row[r.choice(nd.SYMBOLS, 2 * nd.CHUNKS - 1, replace=False)] ^= 1
    assert ((nd.index_keys(a) == nd.index_keys(b)).any(axis=1)).all()


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from kgspark.llm.packing import WordIds, pack

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    odd = ["ΑΣ Σa", "İx", "a\x1cb", "don't I'll", "2²½", "e\u0301é", "<|endoftext|> x", "a_b--c", " nb", "\x00\x01 \t\r", "日本 語", None, ""]
    for t, ids in zip(odd, WordIds(path, 5)(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids
    wanted = sorted([*whole.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect())
    pieces = pack(docs, path, 256, 2000).collect()
    by, sequences = {}, {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    got = []
    for own in by.values():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        ids = [i for p in own for i in np.frombuffer(p.ids, "<u4").tolist()]
        assert {p.doc_tokens for p in own} == {len(ids)}
        got.append(ids)
    assert sorted(got) == wanted
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        n = sum(p.length for p in own)
        assert n <= 256 and (n == 256 or n & (n - 1) == 0)
    assert pack(empty, path).count() == 0


def test_media(docs, empty):
    from kgspark.llm.media import fingerprints, from_wav, media_columns, padded, to_wav

    for r in media_columns(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        raw = (r.text or "").encode()
        assert r.payload == padded(raw) == from_wav(r.media) == from_wav(to_wav(padded(raw))) and r.n_bytes == len(raw)
        assert r.payload[: len(raw)] == raw and set(r.payload[len(raw) :]) <= {255} and len(r.payload) % 576 == 0
        times, codes = fingerprints(np.frombuffer(r.payload, np.uint8))
        assert [(x.time, x.code) for x in r.fingerprints] == list(zip(times.tolist(), codes.tolist(), strict=True))
    assert media_columns(empty).count() == 0
    tone = (128 + 100 * np.sin(np.arange(8192) * 2 * np.pi * 40 / 512)).astype(np.uint8)
    assert set((fingerprints(tone)[1] >> 16).tolist()) == {39}


def test_moved_passage_shares_fingerprints():
    """A passage behind texts of any length, and a byte at the edge of frames."""
    from kgspark.llm.media import FRAME, HOP, feature, fingerprints

    r = random.Random(8)
    text = lambda n: np.frombuffer(" ".join("".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(n)).encode()[:n], np.uint8)
    for _ in range(10):
        passage, before = text(6000), text(8 * FRAME)
        codes = [set(fingerprints(np.concatenate([before[:n], passage, text(FRAME)]))[1].tolist()) for n in (0, r.randrange(1, len(before)))]
        assert len(codes[0] & codes[1]) > 0.35 * len(codes[0])
    assert 2 * HOP <= FRAME
    whole = np.concatenate([text(FRAME), np.full(FRAME, 128, np.uint8)])
    changed = whole.copy()
    changed[FRAME - 1] = 0
    assert feature(*fingerprints(whole)) != feature(*fingerprints(changed))


def test_fingerprints_against_plain():
    """Frames, transform, peaks and pairs by their definitions, without the operator's helpers."""
    from kgspark.llm.media import fingerprints

    r = random.Random(4)
    silence = bytes([128]) * 576
    texts = [" ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "É"]) for _ in range(n)).encode() for n in (30, 200, 700)]
    for raw in [silence, *texts]:
        x = list(raw) + [255] * (-len(raw) % 576)
        count = max(1, -(-(len(x) - 512) // 128) + 1)
        peaks = []
        turn = np.exp(-2j * np.pi * np.outer(np.arange(1, 257), np.arange(512)) / 512)
        hann = [0.5 - 0.5 * math.cos(2 * math.pi * k / 511) for k in range(512)]
        for f in range(count):
            part = (x[128 * f : 128 * f + 512] + [128] * 512)[:512]
            size = np.abs(turn @ np.array([(v - 128) * h for v, h in zip(part, hann, strict=True)]))
            for band in range(4):
                b = max(range(64 * band, 64 * band + 64), key=lambda k: (size[k], -k))
                if size[b] > 2 * size.mean() + 1e-3:
                    peaks.append((f, b))
        pairs = []
        for f, b in peaks:
            later = [p for p in peaks if p[0] > f][:3]
            pairs += [(f, b << 16 | c << 8 | g - f) for g, c in later if g - f <= 32]
        t, c = fingerprints(np.array(x, np.uint8))
        assert list(zip(t.tolist(), c.tolist(), strict=True)) == sorted(pairs) and (pairs or raw == silence)


def test_mixing(spark, docs, empty):
    from kgspark.llm.mixing import mixed, repeated
    from kgspark.llm.queries import OP8_SQL

    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "text", "source").toPandas())
    got = mixed(docs).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken").toPandas().sort_values("doc_id").reset_index(drop=True)
    want = c.sql(OP8_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert (got == want[got.columns]).all().all()
    assert (got.taken <= 2 * got["size"]).all()
    total = got["size"].sum()
    source = docs.select("doc_id", "source").toPandas().fillna({"source": "none"})
    assert abs(got.merge(source, on="doc_id").groupby("source").target.first().sum() - 1.5 * total) < 1
    rows = repeated(docs)
    assert rows.columns == docs.columns
    n = Counter(r.doc_id for r in rows.collect())
    assert all(n[i] == (t // s if s else 1) for i, s, t in zip(got.doc_id, got["size"], got.taken, strict=True))
    assert mixed(empty).count() == 0
    equal = spark.createDataFrame([(1, "a b", "x")] * 3 + [(None, "c", None)], "doc_id long, text string, source string")
    assert mixed(equal).count() == 4


def test_newton_against_closed_form(spark, tmp_path):
    """The dual of one constraint for each source: the multiplier is the logarithm of target / words."""
    from kgspark.llm.mixing import newton, sums_before

    units = spark.createDataFrame([(f"s{i % 7}", i + 1) for i in range(200)] + [("none", 0)], "src string, unit long")
    words = {r.src: r.w for r in units.groupBy("src").agg(F.sum("unit").alias("w")).collect()}
    share = dict(zip(sorted(words), (2.0, 1e-4, 0.5, 1.0, 1.9, 0.01, 1.3, 0.0), strict=True))
    targets = spark.createDataFrame([(s, w, share[s] * w) for s, w in words.items()], "src string, source_size long, target double")
    got = {r.src: r.multiplier for r in newton(units, targets, str(tmp_path)).collect()}
    assert set(got) == {s for s in words if words[s] and share[s]}
    assert all(math.isclose(got[s], math.log(share[s]), abs_tol=1e-12) for s in got)
    rows = spark.range(100).select(((F.col("id") * 37) % 100).alias("k"), F.lit(2).alias("v")).repartition(5)
    assert all(r.v_before == 2 * r.k for r in sums_before(rows, ["k"], ["v"], str(tmp_path), "sums").collect())


def test_lines(docs, empty):
    from kgspark.llm.line_dedup import within, without_repeated_lines

    rows = {r.doc_id: r.text for r in docs.collect()}
    want, late = without_lines(rows)
    assert late
    out = without_repeated_lines(docs)
    assert out.columns == [*docs.columns, "_lines", "_equal", "_near"]
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert without_repeated_lines(empty).count() == 0
    r = random.Random(2)
    pairs = [("".join(r.choice("abé") for _ in range(r.randint(0, 7))), "".join(r.choice("abé") for _ in range(r.randint(0, 7)))) for _ in range(300)]
    d = docs.sparkSession.createDataFrame(pairs, "a string, b string")
    for t in (1, 2):
        assert d.filter(within(F.col("a"), F.col("b"), t) != (F.levenshtein("a", "b") <= t)).count() == 0


def test_token_counts(docs, empty):
    from kgspark.llm.token_counts import token_counts

    scores = {"w": -3.0, "w1": -3.5, "1": -2.0, "12": -2.5, "2": -2.5, "cha": -4.0, "nged": -4.0, "word": -2.0, "o": -5.0, "n": -5.0, "e": -5.0}

    def count(word):
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            ways = [(best[i - n][0] + scores[word[i - n : i]], -best[i - n][1] - 1) for n in range(1, 5) if i >= n and word[i - n : i] in scores]
            if not ways:
                n = len(word[i - 1].encode("utf-8", "surrogatepass"))
                ways = [(best[i - 1][0] + n * (min(scores.values()) - 1), -best[i - 1][1] - n)]
            s, n = max(ways)
            best.append((s, -n))
        return best[-1][1]

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(docs, scores).collect()}
    assert got == {r.doc_id: (len(WORD.findall(r.text or "")), sum(map(count, WORD.findall(r.text or "")))) for r in docs.collect()}
    assert token_counts(empty, scores).count() == 0


def plain_model(texts):
    """Tokens of documents, and the probability of an n-gram's last token, from training texts."""
    train = [[None, *WORD.findall(lowered(t)), None] for t in texts]
    c = Counter(w for t in train for w in t[1:])
    two, three = (Counter(g for t in train for g in zip(*(t[k:] for k in range(n)), strict=False)) for n in (2, 3))
    sizes = Counter(g[:-1] for g in [*two, *three])
    n, v = sum(c.values()), len(c)

    def p(gram):
        if len(gram) == 1:
            return (c[gram[0]] + 0.1) / (n + 0.1 * (v + 1))
        total = c[gram[0]] if len(gram) == 2 else two[gram[:2]]
        if not total or not sizes[gram[:-1]]:
            return p(gram[1:])
        seen = (two if len(gram) == 2 else three)[gram]
        return (seen - 0.75 if seen else 0) / total + 0.75 * sizes[gram[:-1]] / total * p(gram[1:])

    return c, p


def plain_score(text, p):
    t = [None, *WORD.findall(lowered(text)), None]
    return sum(math.log10(p(tuple(t[max(0, k - 2) : k + 1]))) for k in range(1, len(t))), len(t) - 1


def test_language_model(spark, docs, empty, monkeypatch):
    """Every text, one of 30,000 words and a null doc_id too; segments of any size give the same scores."""
    from kgspark.llm import queries
    from kgspark.llm.language_model import is_training, scored

    some = docs.union(docs.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    monkeypatch.setattr(queries, "table", lambda *a: some)
    text = {r.doc_id: r.text for r in some.collect()}
    train = {i for i in text if zlib.crc32(str("" if i is None else i).encode()) % 10}
    c, p = plain_model(text[i] for i in train)
    every = {r.doc_id: r for r in queries.op4_elias_fano_lm(spark, "").collect()}
    small = {r.doc_id: r.score for r in scored(some, is_training(F.col("doc_id")), segment_tokens=500).collect()}
    assert set(every) == set(small) == set(text)
    for i, r in every.items():
        exact, n = plain_score(text[i], p)
        t = [*WORD.findall(lowered(text[i])), None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, sum(c[w] > 0 for w in t), sum(c.values()), i not in train)
        assert math.isclose(r.base_score, sum(math.log10(p((w,))) for w in t), rel_tol=1e-9)
        assert abs(r.score - exact) < 2e-4 * n and math.isclose(small[i], r.score, rel_tol=1e-9)
    assert scored(empty, is_training(F.col("doc_id"))).count() == 0
    assert [r.score for r in scored(docs.filter("doc_id < 2"), F.lit(False)).collect()] == [0.0, 0.0]


def test_language_model_frequent_context(spark):
    """A bigram and a word seen 1,000 times, over several ranges of keys: every successor counts in its total; a passage of one document counts as seen."""
    from kgspark.llm.language_model import quantised, scored

    texts = [f"aa bb {'kept' if i < 300 else f'once{i}'}" for i in range(1000)] + [f"aa {i} bb" for i in range(300)] + ["q r s t u v w"]
    asked = {-1: "aa bb kept", -2: "aa bb once700 x", -3: "q r s t u v w", -4: "w v u t s r q", -5: "aa 7 bb"}
    _, p = plain_model(texts)
    d = spark.createDataFrame([*enumerate(texts), *asked.items()], "doc_id long, text string").repartition(4)
    for size in (200, 2_000_000):
        got = {r.doc_id: r.score for r in scored(d, F.col("doc_id") >= 0, segment_tokens=size).filter("doc_id < 0").collect()}
        for i, text in asked.items():
            exact, n = plain_score(text, p)
            assert abs(got[i] - exact) < 2e-4 * n
        assert got[-3] > got[-4] + 3
    assert quantised(np.array([1e-12])).tolist() == [12 * 4096]


def test_language_model_parts():
    """Blobs are lossless; ranges ascend with the keys; a context goes on in the next segment."""
    from kgspark.llm.language_model import Level, Segment, received, sent

    r = np.random.default_rng(2)
    for top in (5, 1 << 20, 1 << 61):
        keys = np.unique(r.integers(0, top, 2000))
        counts = r.integers(1, 70_000, len(keys))
        assert all((a == b).all() for a, b in zip(received(sent(keys, counts)), (keys, counts), strict=True))
    keys = np.array([1 * 100 + 4, 2 * 100 + 1, 2 * 100 + 50, 2 * 100 + 51, 7 * 100 + 0])
    counts, p = np.array([1, 300, 1, 255, 2]), np.array([0.5, 0.1, 0.2, 1e-9, 1.0])
    level = Level([np.frombuffer(Segment.coded(keys[a:b], counts[a:b], p[a:b], 100), np.uint8) for a, b in ((0, 2), (2, 3), (3, 5))], 100)
    assert level.successors == 3 and level.counts_of(np.arange(5)).tolist() == counts.tolist()
    rank, found = level.find(np.array([1, 2, 2, 2, 7, 7]), np.array([4, 1, 2, 51, -1, 0]))
    assert rank.tolist() == [0, 1, -1, 3, -1, 4] and np.allclose(found, [0.5, 0.1, 0, 1e-9, 0, 1], rtol=3e-4, atol=0)
    low, types = level.contexts(np.array([1, 2, 5, 7]))
    assert types.tolist() == [1, 3, 0, 1] and low[[0, 1, 3]].tolist() == [0, 1, 4]


def test_elias_fano():
    from kgspark.llm.elias_fano import EliasFano

    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 5), (1000, 1 << 40), (3000, 4000)):
        v = np.unique(r.integers(0, top, n))
        e, _ = EliasFano.at(np.frombuffer(EliasFano.coded(v), np.uint8))
        assert (e.get(np.arange(len(v))) == v).all()
        q = r.integers(0, top + 3, 500)
        place = {x: i for i, x in enumerate(v.tolist())}
        assert e.find(q).tolist() == [place.get(x, -1) for x in q.tolist()]


def test_quality(spark, docs, empty):
    from kgspark.llm.quality import kept, scores, train

    r = random.Random(1)
    good = [" ".join(r.choice(["tree", "house", "river", "stone", "light"]) + r.choice("aeiou") for _ in range(40)) for _ in range(60)]
    bad = [" ".join(["SPAM!!", "BUY%%", "NOW##"][r.randint(0, 2)] for _ in range(40)) for _ in range(60)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120) if i % 3] + [(None, 1), (0, None)], "doc_id long, label int")
    model = train(d, labels)
    got = {x.doc_id: x.score for x in scores(d, model).collect()}
    assert all((got[i] >= 0.5) == (i < 60) for i in range(0, 120, 3))
    odd = scores(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= x.score <= 1 for x in odd)
    assert kept(docs, model).columns == docs.columns and scores(empty, model).count() == 0
    assert train(d, labels.filter("label = 1")).bias > 0 and train(d, labels.limit(0)).bias == 0


def plain_indicators(text):
    """The buckets of a text, as the operator's docstring says."""
    from kgspark.llm.quality import BACK, BITS
    from kgspark.llm.shared import one_word_hash

    raw, size = (text or "").encode(), 1 << BITS
    out = {(int.from_bytes(raw[k : k + 3], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - BITS for k in range(len(raw) - 2)}
    words = [one_word_hash(w.encode()) for w in WORD.findall(lowered(text))]
    n = len(words)
    out |= {((a * 0x9FB21C651E98DF25 + b) * 0xD6E8FEB86659FD93 & (1 << 64) - 1) >> 64 - BITS for a, b in zip(words, words[1:], strict=False)}
    for k, back in enumerate(BACK):
        if n > back:
            share = sum(words[i] == words[i - back] for i in range(back, n)) / (n - back)
            out |= {size - 1 - k} if share > 1 / 2 else set()
            out |= {size - 11 - k} if share > 1 / 20 else set()
    return out | ({size - 31 - 8 * len(set(words)) // n} if n >= 8 else set())


def test_quality_against_plain(spark, docs):
    """Indicators, log-count ratios and the hinge-loss fit against dense versions, the latter run until it no longer moves."""
    from kgspark.llm.quality import BITS, MOST_WEIGHT, fit, indicators
    from kgspark.llm.shared import utf8

    texts = [r.text for r in docs.collect() if len(r.text or "") < 3000]
    import pyarrow as pa

    found = list(indicators(*utf8(pa.array(texts, pa.string()))))
    assert [set(x.tolist()) for x in found] == [plain_indicators(t) for t in texts] and all(len(set(x)) == len(x) for x in found)
    r = random.Random(3)
    made = [" ".join(r.choice(["ta ri no", "el su", "mi na", "so"] if i % 3 else ["ta ri", "mi na", "zu ko pa", "so", "zu"]) for _ in range(r.randint(4, 14))) for i in range(90)]
    labels = np.array([int(i % 3 > 0) for i in range(90)])
    rows = [np.array(sorted(plain_indicators(t))) for t in made]
    model = fit(rows, labels, epochs=60)
    x = np.zeros((90, 1 << BITS))
    for i, row in enumerate(rows):
        x[i, row] = 1
    used = np.flatnonzero(x.sum(0) > 1)
    x = x[:, used] / np.sqrt([[len(row)] for row in rows])
    up, down = ((x[labels == c] > 0).sum(0) + 1 for c in (1, 0))
    ratio = np.log(up / (60 + 2)) - np.log(down / (30 + 2))
    v, y = np.hstack([x * ratio, np.ones((90, 1))]), np.where(labels == 1, 1.0, -1.0)
    most = np.where(labels == 1, 1.0, min(MOST_WEIGHT, 2.0))
    w, alpha = np.zeros(v.shape[1]), np.zeros(90)
    for _ in range(3000):
        for i in range(90):
            new = min(max(alpha[i] - (y[i] * (v[i] @ w) - 1) / (v[i] @ v[i]), 0), most[i])
            w += (new - alpha[i]) * y[i] * v[i]
            alpha[i] = new
    loss = lambda z: z[:-1] @ z[:-1] / 2 + z[-1] ** 2 / 2 + (most * np.maximum(0, 1 - y * (v @ z))).sum()
    mine = np.append(np.divide(model.weights[used], ratio, out=np.zeros(len(used)), where=ratio != 0), model.bias)
    assert loss(w) <= loss(mine) * (1 + 1e-9) and loss(mine) < 1.01 * loss(w)
    margins = model.margins(*utf8(pa.array(made)))
    assert np.abs(margins - v @ mine).max() < 1e-9 and ((margins >= 0) == (labels == 1)).mean() > 0.95


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_quality_of_held_out_labels(spark):
    """On the given tables: labels of rows that weren't learned from."""
    from kgspark.llm.queries import op9_naive_bayes_svm

    got = op9_naive_bayes_svm(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out and quality is not null").toPandas()
    recall = [((got.predicted == c) & (got.quality == c)).sum() / (got.quality == c).sum() for c in (0, 1)]
    assert len(got) > 50 and (got.predicted == got.quality).mean() > 0.9 and min(recall) > 0.8, (len(got), recall)


def test_neighbours(spark):
    from kgspark.llm.neighbours import nearest

    r = np.random.default_rng(3)
    v = r.normal(size=(1500, 16))
    v[100:150] = v[100]  # ties
    rows = [(i, x.astype(np.float32).tolist(), 1, 2) for i, x in enumerate(v)]
    rows += [(2000, None, 1, 2), (2100, [0.0] * 16, 1, 2), (2200, [float("nan")] + [1.0] * 15, 1, 2), (2300, [None] + [1.0] * 15, 1, 2), (2400, [1.0] * 3, 1, 2), (None, [1.0] * 16, 1, 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, rank int")
    for chunk in (8192, 4):
        got = {}
        for x in nearest(d, F.col("vec_id") % 100 == 0, chunk_queries=chunk).collect():
            got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
        assert sorted(got) == list(range(0, 1500, 100))
        w, hit = v.astype(np.float32).astype(float), 0
        for q, own in got.items():
            dist = np.sqrt(((w - w[q]) ** 2).sum(1))
            dist[q] = np.inf
            best = np.lexsort((np.arange(1500), dist))[:10]
            own.sort()
            assert [x[0] for x in own] == list(range(1, len(own) + 1)) and all(abs(dist[i] - s) < 1e-12 for _, i, s in own)
            hit += len({i for _, i, _ in own} & set(best.tolist()))
        assert hit >= 0.9 * 150
        assert [i for _, i, _ in sorted(got[100])] == list(range(101, 111))
    assert nearest(d.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_candidates(spark):
    """Only rows of probed buckets are compared: few, and enough for the recall wanted."""
    from kgspark.llm.neighbours import CrossPolytope, Queries, first_equals, hadamard, nearest

    r = np.random.default_rng(5)
    assert np.allclose(hadamard(np.eye(8)) @ hadamard(np.eye(8)), 8 * np.eye(8)) and set(hadamard(np.eye(4)).ravel()) == {-1.0, 1.0}
    v = (r.normal(size=(60, 64))[r.integers(0, 60, 4000)] + 0.7 * r.normal(size=(4000, 64))).astype(np.float32)
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = nearest(d, F.col("vec_id") % 100 == 0).toPandas()
    w, hit = v.astype(float), 0
    for q, own in got.groupby("query_id"):
        dist = ((w - w[q]) ** 2).sum(1)
        dist[q] = np.inf
        hit += len(set(np.argsort(dist)[:10].tolist()) & set(own.vec_id))
    assert hit >= 0.9 * 400 and got.candidates.max() <= 0.1 * 4000
    h = CrossPolytope(64, tables=3)
    codes, probes = h.codes(w[:500]), h.probes(w[:500], 5)
    assert (probes[:, :, 0] == codes).all()  # the first bucket probed is the vector's own
    near = Queries(np.arange(20), w[:20], h, 5).candidates(codes)
    assert near.tolist() == [[any(codes[x, t] in probes[q, t] for t in range(3)) for x in range(500)] for q in range(20)]
    ids = np.array([5, 3, 9, 1, 7])
    assert first_equals(ids, np.array([[1.0, 2]] * 3 + [[2.0, 1]] * 2), 2).tolist() == [0, 1, 3, 4]
    everything = nearest(d.filter("vec_id < 300"), F.col("vec_id") == 0, probes=0).toPandas()
    assert set(everything.candidates) == {299} and set(everything.vec_id) == set(np.argsort(np.where(np.arange(300) == 0, np.inf, ((w[:300] - w[0]) ** 2).sum(1)))[:10].tolist())


def test_url_filter(spark):
    from kgspark.llm.queries import RULES
    from kgspark.llm.url_filter import DigestArray, filter_urls

    urls = [None, "", "nohost", "http://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "https://notexample.org/es/", "http://org/", "http://x.com/de/1", "http://com/fr/", "x://a.com?b", "ftp://b.net/de/", "http://b.net#a://c", "http://x.org"]
    pages = spark.createDataFrame([(i, u, "k", "r") for i, u in enumerate(urls)], "page_id long, url string, key string, rule string")
    blocked = spark.createDataFrame([("b.net/de/",), ("b.net/de/",), (None,), ("a.com",)], "key string")
    want = {3: ("example.org/es/", "block"), 4: ("example.org/en/1", "block"), 5: ("org/", "allow"), 6: ("org/", "allow"), 7: ("com/de/", "block"), 8: ("com/fr/", "allow"), 9: (None, "block"), 10: (None, "block")}
    for limits in ({}, {"shard_rows": 1}):
        got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(pages, RULES, blocked, **limits).collect()}
        assert got == {i: want.get(i, (None, "allow")) for i in range(len(urls))}
    assert filter_urls(pages.limit(0), RULES, blocked.limit(0)).count() == 0
    long_ = "http://" + "sub." * 3000 + "example.org/es/" + "p" * 50_000
    r = filter_urls(pages.limit(0).union(spark.createDataFrame([(1, long_, "k", "r")], pages.schema)), RULES, blocked).first()
    assert (r.rule, r.verdict, len(r.path)) == ("example.org/es/", "block", 50_004)
    a = DigestArray(np.frombuffer(DigestArray.coded([b"x", b"y", b"z"]), np.uint8))
    a.digests = np.array([7, 7, 7], np.uint64)  # all digests collide
    seven = np.array([7, 7], np.uint64)
    assert a.find([b"y", b"none"], seven).tolist()[1] == -1 and a.string(a.find([b"y", b"z"], seven)[1]) == b"z"


def test_near_copies_that_are_not_are_told_by_their_maps(spark):
    """Texts that share 60 % of their shingles are ruled out ahead of their texts, near ones never."""
    from kgspark.llm.near_dedup import WIDE, _possible, bitmap

    rng, rows = np.random.default_rng(3), []
    for k in range(200):
        n = int(rng.integers(20, 1000))
        share = 0.6 if k % 2 else float(rng.uniform(0.75, 1))
        both = int(np.ceil(2 * n * share / (1 + share)))
        h = rng.integers(0, 1 << 64, 2 * n - both, np.uint64)
        a, b = h[:n], h[n - both :]
        near = 100 * both >= 75 * len(h)
        rows.append((near, n, *(bitmap(x, w).tolist() for w in (8, WIDE) for x in (a, b))))
    df = spark.createDataFrame(rows, "near boolean, n long, a array<long>, b array<long>, wa array<long>, wb array<long>")
    n = F.col("n")
    got = df.select("near", _possible(n, F.col("a"), n, F.col("b")).alias("some"), _possible(n, F.col("wa"), n, F.col("wb"), WIDE).alias("wide")).collect()
    assert all(r.some and r.wide for r in got if r.near)
    assert sum(r.wide for r in got if not r.near) < 10 < 50 < sum(r.some for r in got if not r.near)
