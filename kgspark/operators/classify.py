"""Document classification by weighted keywords. The keyword table is a parameter; DEFAULT_KEYWORDS is a small one in English."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import extension

#: Categories in order, with words of file names (weight 2) and of contents (weight 1). A default to start with: users pass their own.
DEFAULT_KEYWORDS: dict[str, tuple[list[str], list[str]]] = {
    "academic_paper": (["research", "dissertation", "conference"], ["abstract", "we propose", "related work", "et al."]),
    "technical_doc": (["api", "readme", "howto"], ["parameter", "schema", "returns", "command line", "version"]),
    "meeting_minutes": (["meeting", "standup"], ["present:", "agreed that", "to be done by", "next meeting"]),
    "report": (["report", "status", "quarter"], ["overview", "results show", "outlook", "compared with last"]),
    "contract": (["contract", "lease", "terms"], ["the parties", "shall not", "in witness", "governing law"]),
    "invoice": (["invoice", "receipt", "bill"], ["invoice", "total", "amount due", "vat"]),
    "letter": (["letter", "mail"], ["dear ", "sincerely", "kind regards", "subject:"]),
    "health_record": (["patient", "clinic"], ["symptom", "dose", "blood pressure", "follow-up"]),
    "maintenance_manual": (["manual", "maintenance"], ["warning:", "torque", "hazard", "replace the", "spare part"]),
    "court_decision": (["court", "verdict"], ["the court", "claimant", "dismissed", "appeal"]),
    "building_data": (["building", "hvac"], ["air handling", "set point", "sensor", "floor plan"]),
    "recipe": (["recipe", "cooking"], ["tablespoon", "preheat", "serves "]),
    "news": (["news", "press"], ["according to", "spokesperson", "reported on"]),
}
#: Extensions that are always tables, and those that are with many rows.
TABULAR, ROWWISE, MANY_ROWS = [".xlsx", ".xls", ".xlsm", ".ods"], [".csv", ".tsv"], 200


def keyword_table(spark: SparkSession, words: dict[str, tuple[list[str], list[str]]] = DEFAULT_KEYWORDS) -> DataFrame:
    """ordinal, category, field (filename or content), keyword, weight."""
    rows = [(i, c, f, w, weight) for i, (c, both) in enumerate(words.items()) for f, part, weight in zip(("filename", "content"), both, (2.0, 1.0), strict=True) for w in part]
    return spark.createDataFrame(rows, "ordinal int, category string, field string, keyword string, weight double")


def scored_categories(keywords: DataFrame, preview: int = 600) -> Column:
    """Of a row with filename and text: an array of (ordinal, category, score, signals), a struct for each category that has a keyword in the file name or in
    the first characters of the text.

    The keywords, a table for people to write, become one expression, so a document is read once and never leaves its row.
    """
    table: dict[tuple[int, str], list[tuple[str, str, float]]] = {}
    for r in keywords.orderBy("ordinal", "category", F.desc("field"), "keyword").collect():
        table.setdefault((r.ordinal, r.category), []).append((r.field, r.keyword, r.weight))
    name, text = F.lower("filename"), F.lower(F.substring("text", 1, preview))
    scored = []
    for (ordinal, category), words in table.items():
        has = [(name if f == "filename" else text).contains(w) for f, w, _ in words]
        hits = F.array_compact(F.array(*(F.when(h, F.struct(F.lit(f"{f}:{w}").alias("signal"), F.lit(n).alias("weight"))) for h, (f, w, n) in zip(has, words, strict=True))))
        scored.append(F.struct(F.lit(ordinal).alias("ordinal"), F.lit(category).alias("category"), hits.alias("hits")))
    sums = F.transform(F.array(*scored), lambda s: F.struct(s["ordinal"].alias("ordinal"), s["category"].alias("category"), F.aggregate(s["hits"]["weight"], F.lit(0.0), lambda x, y: x + y).alias("score"), F.array_sort(s["hits"]["signal"]).alias("signals")))
    return F.filter(sums, lambda s: F.size(s["signals"]) > 0)


def category_scores(docs: DataFrame, keywords: DataFrame, key: str = "uri", preview: int = 600) -> DataFrame:
    """key, ordinal, category, score, signals of the categories that a document has a keyword of."""
    return docs.select(key, F.explode(scored_categories(keywords, preview)).alias("c")).select(key, "c.*")


def classify(docs: DataFrame, keywords: DataFrame, key: str = "uri") -> DataFrame:
    """docs (key, filename, text, file_type, row_count): key, doc_type, strategy, confidence, signals."""
    best = F.array_max(F.transform(scored_categories(keywords), lambda s: F.struct(s["score"].alias("score"), (-s["ordinal"]).alias("first"), s["category"].alias("category"), s["signals"].alias("signals"))))
    d = docs.select(key, extension(F.col("filename")).alias("ext"), F.coalesce("file_type", F.lit("")).alias("file_type"), F.coalesce("row_count", F.lit(0)).alias("row_count"), best.alias("best"))
    d = d.select("*", "best.category", "best.score", "best.signals")
    table = (F.col("file_type") == "tabular_data") | F.col("ext").isin(TABULAR)
    long_ = F.col("ext").isin(ROWWISE) & (F.col("row_count") > MANY_ROWS)
    return d.select(
        key,
        F.when(table | long_, "tabular_data").otherwise(F.coalesce("category", F.lit("general"))).alias("doc_type"),
        F.when(table | long_, "structural_summary").otherwise("llm_extract").alias("strategy"),
        F.when(table, 1.0).when(long_, 0.9).when(F.col("score").isNull(), 0.3).otherwise(F.least(F.lit(1.0), F.col("score") / 6)).alias("confidence"),
        F.when(table | long_, F.array(F.concat(F.lit("extension:"), "ext"))).otherwise(F.coalesce("signals", F.array(F.lit("none")))).alias("signals"),
    )


def classify_with(classified: DataFrame, docs: DataFrame, decide: Callable, known: list[str], key: str = "uri", below: float = 0.4) -> DataFrame:
    """Rows under the confidence `below` go through a user's function (filename, preview) -> doc_type; unknown types are ignored, others have confidence 0.6."""
    unsure = classified.filter(F.col("confidence") < below).join(docs.select(key, "filename", F.substring("text", 1, 600).alias("preview")), key)
    udf = F.pandas_udf(lambda names, previews: names.combine(previews, decide), "string")
    told = unsure.withColumn("told", udf("filename", "preview"))
    ok = F.coalesce(F.col("told").isin(known), F.lit(False))
    told = told.select(key, F.when(ok, F.col("told")).otherwise(F.col("doc_type")).alias("doc_type"), F.when(ok & (F.col("told") == "tabular_data"), "structural_summary").otherwise(F.col("strategy")).alias("strategy"), F.when(ok, 0.6).otherwise(F.col("confidence")).alias("confidence"), "signals")
    return classified.filter(F.coalesce(F.col("confidence") >= below, F.lit(True))).unionByName(told)
