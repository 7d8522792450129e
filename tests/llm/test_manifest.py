"""The Merkle manifest against a plain version, and trees of every small size."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from kgspark.llm import manifest as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, h string, n long, block long, up string, `rank` long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    out = ""
    for v in (row[0], row[3], row[2], row[4], text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(out)


def tree(hashes):
    """The top, and of each node its siblings (left, right) by level."""
    proofs, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for k, p in enumerate(proofs):
            run = level[at[k] // 8 * 8 :][:8]
            p.append(("".join(run[: at[k] % 8]), "".join(run[at[k] % 8 + 1 :])))
        level = [H(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], proofs


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    done, tops = [], []
    for g in langs:
        some = sorted(((r, leaf(r, r[1])) for r in groups[g]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        top, proofs = tree([h for _, h in some])
        tops.append(top)
        done.append([(r, h, p) for (r, h), p in zip(some, proofs, strict=True)])
    root, above = tree(tops)
    out = []
    for k, some in enumerate(done):
        for r, h, p in some:
            now = h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                now = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            path = p + above[k]
            for left, right in path:
                now = H(left, now, right)
            out.append((r[0], h, tops[k], root, H("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


def query(df):
    from kgspark.llm.url_filter import LOWER, UPPER

    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    x = m.manifest(df, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"text": F.when(hit, F.translate("text", UPPER, LOWER))})
    x = x.select("id", "leaf", "subroot", "root", m.proof_digest(F.col("proof")), m.folded(F.coalesce("seen", "leaf"), F.col("proof")).alias("f"))
    return sorted((tuple(r) for r in x.withColumn("ok", F.col("f") == F.col("root")).collect()), key=str)


def rows():
    sizes = {None: 1, "": 2, "Z": 7, "a": 8, "b": 9, "de": 64, "en": 65, "fr": 600, "é": 70, **{f"k{i}": 1 for i in range(7)}}
    out, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            out.append((k * 7 % 100_003, ("Text of " + str(k), None, "", "É X" * 3)[k % 4], lang, (None, "S", "é")[k % 3], None if k % 5 == 0 else k, "g", "h", 1, 2, "u", 3))
            k += 1
    out += [out[40], out[40], (None, "A", "a", None, None, *out[0][5:]), (None, None, "a", None, None, *out[0][5:]), (41, "Long " * 50_000, "fr", "s", 1, *out[0][5:])]
    return out


def test_manifest(spark):
    some = rows()
    df = spark.createDataFrame(some, SCHEMA).repartition(3)
    assert query(df) == plain(some)
    assert query(df.limit(0)) == []
    one = [r for r in some if r[2] is None]
    assert query(spark.createDataFrame(one, SCHEMA)) == plain(one)


@pytest.mark.parametrize("digits", [1, 2])
def test_blocks_of_any_size(spark, monkeypatch, digits):
    """Smaller blocks, more rounds: the same rows."""
    monkeypatch.setattr(m, "DIGITS", digits)
    some = rows()[-90:]
    assert query(spark.createDataFrame(some, SCHEMA)) == plain(some)


def test_one_shuffle_per_round(spark):
    nodes = spark.range(100).selectExpr("cast(id % 3 as string) grp", "id + 7 as n", "id as `rank`", "cast(id as string) h")
    plan = m.rolled_up(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
