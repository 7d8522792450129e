"""The corpus pipeline, each stage on its predecessor's rows, against plain versions."""

import random
from collections import Counter

import duckdb
import numpy as np

from .plain import classes, shingles, without_lines


def tables(spark, folder):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["ta", "ri", "no", "el", "su", "mi"]) for _ in range(r.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    good = ["\n".join(line(r.randint(5, 15)) for _ in range(r.randint(2, 6))) for _ in range(50)]
    common = line(9)
    texts = [*good[:40], *(t + "\n" + common for t in good[40:]), *good[:5]]
    for t in good[5:15]:
        lines = t.split("\n")
        texts.append("\n".join([line(2), *(x + "." for x in lines)]))
    texts += ["BUY!! NOW%% " * r.randint(10, 30) for _ in range(30)] + [None, "", "\n"]
    rows = [(i, t, "en", ("a", "b", None)[i % 3], len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 65), 0) for i in range(95) if i % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as cp
    from kgspark.llm import quality
    from kgspark.llm.queries import OP8_SQL

    sf = str(tmp_path)
    tables(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    stages = [f for _, f in cp.STAGES]

    labels = spark.sql(f"SELECT doc_id, quality AS label FROM parquet.`{sf}/labels.parquet` WHERE crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1")
    model = quality.train(docs.select("doc_id", "text"), labels)
    a = stages[0](spark, docs, sf)
    before = text(docs)

    def margin(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return model.margins(raw, np.array([0, len(raw)]))[0]

    assert a.columns == docs.columns and text(a) == {i: t for i, t in before.items() if margin(t) >= 0}
    assert not [i for i in text(a) if 65 <= i < 95] and all(i in text(a) for i in range(65))

    b = stages[1](spark, a, sf)
    plain, late = without_lines(text(a))
    full = lambda t: any(x.strip() for x in (t or "").split("\n"))
    assert late and text(b) == {i: t for i, t in plain.items() if full(t) or not full(text(a)[i])}
    assert b.columns == docs.columns and all(r.n_chars == (None if r.text is None else len(r.text)) for r in b.collect())

    c = stages[2](spark, b, sf)
    top = classes({i: shingles(t) for i, t in text(b).items()})
    assert text(c) == {i: t for i, t in text(b).items() if top[i] == i}

    b = a  # and with near copies, which the lines' stage has taken away here
    c = stages[2](spark, b, sf)
    top = classes({i: shingles(t) for i, t in text(b).items()})
    assert text(c) == {i: t for i, t in text(b).items() if top[i] == i} and c.columns == docs.columns

    d = stages[3](spark, c, sf)
    duck = duckdb.connect()
    duck.register("documents", c.select("doc_id", "text", "source").toPandas())
    taken = {i: (k // n if n else 1) for i, n, k in duck.sql(OP8_SQL).df()[["doc_id", "size", "taken"]].itertuples(index=False)}
    assert Counter(r.doc_id for r in d.collect()) == Counter({i: k for i, k in taken.items() if k})

    e = stages[4](spark, d, sf).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = sum(len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in d.collect())
    assert sum(p.length for p in e) == size
    assert {r.doc_id for r in cp.run(spark, sf).collect()} <= set(before)


def test_stages_take_any_table(spark, tmp_path):
    """Columns with names that operators use, null doc_ids and texts, repeated rows, a long text; and no rows at all."""
    import corpus_pipeline as cp

    sf = str(tmp_path)
    tables(spark, sf)
    names = ["row", "key", "h", "g", "ord", "src", "size", "_lines", "_maybe", "_at", "_word", "component", "copies", "score", "ids", "id"]
    extra = lambda i: tuple(f"{n} {i}" for n in names)
    r = random.Random(7)
    long_ = "\n".join(" ".join(r.choice(["ta", "ri", "no", "el", "su", "mi"]) * r.randint(1, 3) for _ in range(9)) for _ in range(700))
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *extra(r.doc_id)) for r in docs]
    rows += [rows[3], rows[3], (None, docs[1].text, None, None, None, *extra(None)), (None, None, None, None, None, *extra(None)), (500, long_, "en", "a", 1, *extra(500))]
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    for table in (spark.createDataFrame(rows, columns), spark.createDataFrame([], columns)):
        rows_in = table.count()
        for k, (name, stage) in enumerate(cp.STAGES):
            out = stage(spark, table, sf)
            if k < 4:
                assert out.columns == table.columns
                kept = out.collect()
                assert all(tuple(r[n] for n in names) == extra(r.doc_id) for r in kept), name
                assert bool(kept) == bool(rows_in)
                if rows_in:
                    assert sum(r.doc_id == 3 for r in kept) in (3, 0) or name == "mixing"
                    assert any(r.doc_id is None and r.text for r in kept) and any(r.doc_id == 500 for r in kept) or name == "mixing"
                table = spark.createDataFrame(kept, table.schema)
            else:
                assert (out.count() > 0) == bool(rows_in)
    plain = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, source string")
    assert [r.text for r in cp.line_deduplication(spark, plain, sf).collect()] == ["a b c"]
