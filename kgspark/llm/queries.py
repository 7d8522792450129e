"""The queries opN_<name> over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import pick


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import is_training, scored

    found = scored(table(spark, sf_dir, "documents"), is_training(F.col("doc_id")))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_segment_edit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import without_repeated_lines

    docs = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda c: F.col(c).cast("long")
    return docs.select("doc_id", n("_lines").alias("n_lines"), n("_equal").alias("n_equal"), n("_near").alias("n_near"), F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, i - 1 AS pos, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
f AS (SELECT line, min({'doc_id': doc_id, 'pos': pos}) AS first FROM l WHERE regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY line),
z AS (SELECT line, first, length(line) AS n, length(line) // 3 AS k FROM f WHERE length(line) >= 20),
late AS ( -- of three parts of a line, two edits leave the first, the last or the middle one as it is
  SELECT DISTINCT x.line FROM z x JOIN (VALUES (-2), (-1), (0), (1), (2)) s(d) ON true JOIN z y ON y.n = x.n + s.d AND y.first < x.first
  WHERE CASE WHEN left(x.line, x.k) = left(y.line, x.k) OR right(x.line, x.k) = right(y.line, x.k) OR contains(y.line, substr(x.line, x.k + 1, x.n - 2 * x.k))
             THEN levenshtein(x.line, y.line) ELSE 99 END <= 2),
j AS (
  SELECT l.doc_id, l.pos, l.line, f.line IS NOT NULL AS full_, coalesce(f.first <> {'doc_id': l.doc_id, 'pos': l.pos}, false) AS equal, late.line IS NOT NULL AS late
  FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN late ON late.line = l.line)
SELECT doc_id, count(*) FILTER (WHERE full_)::BIGINT AS n_lines, count(*) FILTER (WHERE equal)::BIGINT AS n_equal,
       count(*) FILTER (WHERE late AND NOT equal)::BIGINT AS n_near,
       length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT equal AND NOT late), ''))::BIGINT AS kept_chars,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT equal AND NOT late), '')) AS kept_md5
FROM j GROUP BY doc_id
"""


def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op8_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         md5(coalesce(doc_id::VARCHAR, '')) || coalesce(doc_id::VARCHAR, '') AS ord
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY src),
l AS (SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / weight AS level FROM s),
w AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
        - coalesce(sum(lim) OVER (ORDER BY level, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY level, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM l),
f AS (SELECT min_by(water, {'level': level, 'src': src}) AS mark FROM w WHERE water <= level),
t AS (SELECT src, source_size, least(lim, weight * coalesce(f.mark, 'inf'::DOUBLE)) AS target FROM w, f),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS whole FROM t),
need AS (SELECT *, round(target - whole * source_size, 6) AS need FROM n),
u AS (SELECT src, ord, size, count(*) AS times, size * count(*) AS unit FROM d GROUP BY src, ord, size),
run AS (SELECT u.*, need, sum(unit) OVER (PARTITION BY u.src ORDER BY ord, size ROWS UNBOUNDED PRECEDING) AS upto FROM u JOIN need USING (src)),
k AS (SELECT *, upto > need AS passed, max((upto > need)::INT) OVER (PARTITION BY src ORDER BY ord, size ROWS UNBOUNDED PRECEDING) AS after FROM run),
g0 AS (SELECT src, need - coalesce(sum(unit) FILTER (WHERE after = 0), 0) AS gap, max(after) AS any_after FROM k GROUP BY src, need),
spare AS (SELECT k.src, unit, min({'ord': ord, 'size': k.size}) AS pick FROM k JOIN g0 USING (src) WHERE after = 1 AND unit > 0 AND unit <= gap GROUP BY k.src, unit),
p1 AS (SELECT src, max(unit) AS unit FROM spare JOIN g0 USING (src) WHERE unit <= gap GROUP BY src),
g1 AS (SELECT src, gap - coalesce(unit, 0) AS gap FROM g0 LEFT JOIN p1 USING (src)),
p2 AS (SELECT s.src, max(s.unit) AS unit FROM spare s JOIN g1 USING (src) LEFT JOIN p1 ON p1.src = s.src AND p1.unit = s.unit WHERE s.unit <= gap AND p1.src IS NULL GROUP BY s.src),
g2 AS (SELECT src, gap - coalesce(unit, 0) AS gap FROM g1 LEFT JOIN p2 USING (src)),
p3 AS (SELECT s.src, max(s.unit) AS unit FROM spare s JOIN g2 USING (src) LEFT JOIN p1 ON p1.src = s.src AND p1.unit = s.unit LEFT JOIN p2 ON p2.src = s.src AND p2.unit = s.unit
       WHERE s.unit <= gap AND p1.src IS NULL AND p2.src IS NULL GROUP BY s.src),
more AS (SELECT src, pick.ord AS ord, pick.size AS size FROM spare JOIN (FROM p1 UNION ALL FROM p2 UNION ALL FROM p3) USING (src, unit)
         UNION ALL SELECT src, ord, size FROM k WHERE after = 0),
c AS (SELECT DISTINCT m.src, m.ord, m.size FROM more m JOIN need USING (src) WHERE need > 0)
SELECT d.doc_id, d.size, t.source_size, round(t.target, 4) AS target,
       (d.size * (need.whole + CASE WHEN c.src IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM d JOIN t USING (src) JOIN need USING (src) LEFT JOIN c ON c.src = d.src AND c.ord = d.ord AND c.size = d.size
"""

def op9_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import remainder, scores, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 3) != 1)
    found = scores(docs, train(docs, labels.select("doc_id", F.col("quality").alias("label"))))
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op10_digest_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: pages whose html repeats that of an earlier page."""
    from .url_filter import filter_urls, host_of, path_of

    pages = table(spark, sf_dir, "pages")
    seen = pages.filter("html is not null").select("page_id", F.sha2("html", 256).alias("sha"), F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("key"))
    first = seen.groupBy("sha").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n")).filter("n > 1")
    again = seen.join(first.select("sha", F.col("page_id").alias("first_id")), "sha").filter("page_id > first_id and key <> ''")
    return filter_urls(pages, RULES, again.select("key")).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT page_id, max({'size': length(rhost || rpath), 'rule': rhost || rpath, 'verdict': verdict}) AS best
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
firsts AS (SELECT html, min(page_id) AS first_id FROM h WHERE html IS NOT NULL GROUP BY html HAVING count(*) > 1),
again AS (SELECT DISTINCT host || path AS key FROM h JOIN firsts USING (html) WHERE page_id > first_id AND host || path <> '')
SELECT h.page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN again.key IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM h LEFT JOIN fits USING (page_id) LEFT JOIN again ON again.key = host || path
"""



def op11_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extraction import extract

    return extract(table(spark, sf_dir, "pages"))


def op12_nested_struct_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves by language; where 3 divides the crc32 of the id, somebody has lower-cased the text."""
    from .manifest import folded, manifest, proof_digest
    from .url_filter import LOWER, UPPER

    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = manifest(table(spark, sf_dir, "documents"), "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"text": F.when(hit, F.translate("text", UPPER, LOWER))})
    found = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("seen", "leaf"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _op12_sql(levels: int = 8, heads: int = 5) -> str:
    """Trees of up to 8 ** levels leaves a language, and 8 ** heads languages, level by level."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT)"
    part = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"e AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS bad FROM documents)",
        "d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM e)",
    ]

    def tree(name: str, first: str, key: str, many: int) -> list[str]:
        out = [f"{name}0 AS ({first})"]
        for j in range(many):
            out.append(f"{name}s{j} AS (SELECT {key}, r // 8 AS p, any_value(n) AS n, list(h ORDER BY r) AS hs FROM {name}{j} WHERE n > {8**j} GROUP BY ALL)")
            out.append(f"{name}{j + 1} AS (SELECT {key}, p AS r, n, sha256(array_to_string(hs, '')) AS h FROM {name}s{j})")
        tops = " UNION ALL ".join(f"SELECT {key}, h FROM {name}{j} WHERE r = 0 AND n <= {8**j}" + (f" AND n > {8 ** (j - 1)}" if j else "") for j in range(many + 1))
        return [*out, f"{name}top AS ({tops})"]

    def walk(name: str, first: str, key: str, many: int) -> list[str]:
        out = [f"{name}w0 AS ({first})"]
        for j in range(many):
            pos = f"((w.r // {8**j}) % 8)"
            left, right = f"coalesce(array_to_string(s.hs[1:{pos}], ''), '')", f"coalesce(array_to_string(s.hs[{pos} + 2:], ''), '')"
            out.append(f"{name}w{j + 1} AS (SELECT w.* REPLACE (w.proof || {left} || {right} AS proof, CASE WHEN s.hs IS NULL THEN w.f ELSE sha256({left} || w.f || {right}) END AS f) FROM {name}w{j} w LEFT JOIN {name}s{j} s ON s.{key} IS NOT DISTINCT FROM w.{key} AND s.p = w.r // {8 ** (j + 1)})")
        return out

    steps += tree("g", "SELECT lang, r, n, leaf AS h FROM d", "lang", levels)
    steps += ["hs AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM gtop)"]
    steps += tree("u", "SELECT 0 AS one, r, n, h FROM hs", "one", heads)
    steps += walk("g", "SELECT doc_id, lang, leaf, r, '' AS proof, bad AS f FROM d", "lang", levels)
    steps += [f"m AS (SELECT w.doc_id, w.leaf, w.proof, w.f, hs.h AS subroot, hs.r, 0 AS one FROM gw{levels} w JOIN hs ON hs.lang IS NOT DISTINCT FROM w.lang)"]
    steps += walk("u", "SELECT * FROM m", "one", heads)
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM uw{heads} CROSS JOIN utop t"


OP12_SQL = _op12_sql()


def op13_identity_map_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_cross_polytope, op2_minhash_near_dedup, op3_trie_token_counts, op4_elias_fano_lm, op5_segment_edit_lines, op6_cost_balanced_packing, op7_wav_fingerprints, op8_entropy_balanced_mix, op9_naive_bayes_svm, op10_digest_url_filter, op11_site_style_tree, op12_nested_struct_manifest, op13_identity_map_alignment)}
ORACLE_SQL: dict[str, str] = {"op5_segment_edit_lines": OP5_SQL, "op8_entropy_balanced_mix": OP8_SQL, "op10_digest_url_filter": OP10_SQL, "op12_nested_struct_manifest": OP12_SQL}
