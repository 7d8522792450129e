"""Chunks, segments, keywords and tags of texts."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Words that are no keywords of a question.
STOP = "的 了 是 在 和 与 或 对 有 将 被 由 为 以 从 到 该 这 那 其 一 二 三 a an the is are was were be been has have had do does did what which who how when where why can could would should".split()
#: Document types by words of the file name, in order.
NAME_TYPES = {"academic_paper": ["paper", "论文", "research", "study"], "technical_doc": ["api", "技术", "tech", "doc", "readme"], "meeting_minutes": ["meeting", "会议", "minutes"], "report": ["report", "报告", "月报", "周报"]}
#: White space as Spark's regular expressions have it.
_SPACES = re.compile(r"[ \t\n\x0b\f\r]+")
#: Fixed value: what separates words of a question.
PUNCTUATION = r"[\s,，。？?！!、；;：:「」【】()（）]+"


def chunk_fixed(docs: DataFrame, key: str = "uri", size: int = 1000, stride: int = 900) -> DataFrame:
    """key, chunk_index, text: windows of `size` characters every `stride`; blank ones are dropped, the index counts the rest."""
    n = F.length("text")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(stride)))
    parts = F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(size)))
    return docs.filter("text is not null").select(key, F.posexplode(F.filter(parts, lambda p: p.rlike(r"\S"))).alias("chunk_index", "text"))


def paragraph_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of at most `size` characters that cover a text; blank ones are left out.

    A chunk ends behind the last empty line of its second half; without one, after `size` characters. The next one begins `overlap` characters
    before that end, so that what stands at a border is whole in one of them. overlap is less than half of size.
    """
    borders = [m.start() + 2 for m in re.finditer("(?=\n\n)", text)]
    spans = [(0, 0)]
    while spans[-1][1] < len(text):
        begin = max(0, spans[-1][1] - overlap)
        most = min(begin + size, len(text))
        last = bisect_right(borders, most) - 1
        whole = most == len(text) or last < 0 or borders[last] <= begin + size // 2
        spans.append((begin, most if whole else borders[last]))
    return [text[x:y] for x, y in spans if text[x:y].strip()]


def chunk_paragraph(docs: DataFrame, key: str = "uri", size: int = 1000, overlap: int = 100) -> DataFrame:
    """key, chunk_index, text. Each start depends on the chunks before, so a vectorised UDF cuts each text."""

    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: paragraph_chunks(t or "", size, overlap))

    return docs.select(key, F.posexplode(F.pandas_udf(cut, "array<string>")("text")).alias("chunk_index", "text"))


def segment_text(docs: DataFrame, key: str = "uri", size: int = 8000, overlap: int = 400, threshold: int = 100_000) -> DataFrame:
    """key, chunk_index, char_start, char_end, text. Up to `threshold` characters: one segment; empty text: none."""
    n, stride = F.length("text"), size - overlap
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / stride) + 1)
    starts = F.when(n <= threshold, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: i * stride))
    rows = docs.filter("length(text) > 0").select(key, F.col("text").alias("whole"), F.posexplode(starts).alias("chunk_index", "char_start"))
    end = F.when(F.length("whole") <= threshold, F.length("whole")).otherwise(F.least(F.col("char_start") + size, F.length("whole")))
    return rows.select(key, "chunk_index", "char_start", end.alias("char_end"), F.substring(F.col("whole"), F.col("char_start") + 1, end - F.col("char_start")).alias("text"))


def content_preview(text: Column, n: int = 600) -> Column:
    return F.substring(text, 1, n)


def question_keywords(question: Column, most: int = 5) -> Column:
    """Up to `most` distinct words in order, lower-cased, two characters or more, no stop words."""
    words = F.filter(F.split(F.lower(question), PUNCTUATION), lambda w: (F.length(w) >= 2) & ~w.isin(STOP))
    return F.slice(F.array_distinct(words), 1, most)


def doc_type_from_name(filename: Column) -> Column:
    out = F.lit("general")
    for kind, words in reversed(NAME_TYPES.items()):
        out = F.when(F.lower(filename).rlike("|".join(map(re.escape, words))), kind).otherwise(out)
    return out


def keyword_tags(docs: DataFrame, key: str = "uri", most: int = 8, shortest: int = 5) -> DataFrame:
    """key, tag, n, rank: the most frequent words of `shortest` characters or more of each text; ties: the one seen first. Rows are counted where they are; no word is shuffled."""
    kind = docs.schema[key].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: list[int] = []
            tags: list[str] = []
            counts: list[int] = []
            ranks: list[int] = []
            for row, text in enumerate(b.column("low").to_pylist()):
                words = Counter([w for w in _SPACES.split(text or "") if len(w) >= shortest]).most_common(most)  # stable: ties as first seen
                of += [row] * len(words)
                tags += [w for w, _ in words]
                counts += [n for _, n in words]
                ranks += range(1, len(words) + 1)
            keys = b.column(key).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(tags, pa.string()), pa.array(counts, pa.int64()), pa.array(ranks, pa.int32())], names=[key, "tag", "n", "rank"])

    return docs.select(key, F.trim(F.lower("text")).alias("low")).mapInArrow(count, StructType([StructField(key, kind), StructField("tag", StringType()), StructField("n", LongType()), StructField("rank", IntegerType())]))


def lead_summary(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def bilingual_text(field: Column) -> Column:
    """Of a map by language: English, else Chinese, else nothing."""
    return F.coalesce(F.try_element_at(field, F.lit("en")), F.try_element_at(field, F.lit("zh")), F.lit(""))
