"""Corpus pipeline: documents to packed training sequences.

quality classifier, line dedup, MinHash near-dedup, mixing sources to target weights, packing. Each stage works on all rows that the one
before kept; all but the last return the columns of documents. run() writes each stage's rows to the folder of spark.checkpoint.dir and reads them again.

Every stage takes what the others leave, and any table with doc_id, text and source: an empty one gives no rows; other columns, also ones with names that an operator
uses itself, are kept as they are (n_chars is renewed where lines go); texts of any length are worked on whole. Null and empty texts: the classifier judges them by its
bias; they have no lines and no near copies; the mix keeps them once; packing gives them their end token. Null doc_ids: judged, mixed and packed like
others; their lines and texts are compared with none, and stay. Repeated rows of one doc_id: all judged alike; lines that the first of them has are gone
from none of them, as rows of one id are one document; they are no near copies of each other; each is mixed and packed by itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import line_dedup, mixing, near_dedup, packing, quality
from kgspark.llm.shared import packed, unpacked
from kgspark.storage import shared_folder, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels of two thirds of the ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(quality.remainder(F.col("doc_id"), 3) != 1)
    return quality.kept(docs, quality.train(docs.select("doc_id", "text"), labels.select("doc_id", F.col("quality").alias("label"))))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand before, or nearly so, go; so do documents of which no line is left. A document without lines stays."""
    out = line_dedup.without_repeated_lines(packed(docs, doc_id=F.col("doc_id"), text=F.col("text"))).filter("_lines = 0 or _equal + _near < _lines")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*unpacked(docs.columns, **new))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup.without_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, so that sources come near their targets."""
    return mixing.repeated(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, without their ids but with a checksum of these."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [("quality", quality_classifier), ("lines", line_deduplication), ("near copies", near_deduplication), ("mixing", source_mixing), ("packing", sequence_packing)]

#: SQL can't fit the classifier or tokenise: tests/llm hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), folder, f"stage{k}")
    return docs
