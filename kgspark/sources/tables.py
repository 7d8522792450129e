"""Pages, paragraphs and tables as text and as graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_blank(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(r"\S")


def _assembled(parts: DataFrame, key: str, order: str, line: Column, count: str) -> DataFrame:
    some = parts.filter(not_blank("text")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), line.alias("text")))).alias("parts"))
    every = parts.groupBy(key).agg(F.count("*").alias(count))
    return every.join(some, key, "left").select(key, F.coalesce(F.array_join("parts.text", "\n\n"), F.lit("")).alias("text"), count)


def assemble_pages(pages: DataFrame, key: str = "uri") -> DataFrame:
    """pages (key, page from 1, text): blank pages go, each of the others under a line with its number; page_count counts all."""
    return _assembled(pages, key, "page", F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text")), "page_count")


def assemble_paragraphs(paragraphs: DataFrame, key: str = "uri") -> DataFrame:
    """paragraphs (key, page as order, text): those that aren't blank, joined by an empty line; paragraph_count counts these."""
    return _assembled(paragraphs.filter(not_blank("text")), key, "page", F.col("text"), "paragraph_count")


def table_structural_summary(tables: dict[str, tuple[DataFrame, list[str]]], samples: int = 3, detailed: int = 5) -> DataFrame:
    """tables: by name a DataFrame with the columns that order it. A row for each: n_rows, n_cols, columns, sample (first rows, only of the first tables)."""
    out = []
    for k, (name, (df, order)) in enumerate(tables.items()):
        row = F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
        first = df.select(*order, row.alias("row")).orderBy(*order, "row").limit(samples if k < detailed else 0)
        sample = first.agg(F.array_sort(F.collect_list(F.struct(*order, "row"))).alias("rows")).select(F.array_join("rows.row", "\n").alias("sample"))
        counts = df.agg(F.count("*").alias("n_rows"))
        facts = counts.select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"), F.lit(" | ".join(c or f"Col{i}" for i, c in enumerate(df.columns, 1))).alias("columns"), F.lit("tabular_data").alias("file_type"))
        out.append(facts.join(sample.select(F.lit(name).alias("name"), "sample"), "name", "left"))
    return reduce(DataFrame.unionByName, out)


def tabular_schema_graph(tables: dict[str, DataFrame], dataset: str) -> tuple[DataFrame, DataFrame]:
    """Entities (Dataset, Sheet, Field) and relations (HAS_FIELD, BELONGS_TO_SHEET) of table schemas."""
    spark = next(iter(tables.values())).sparkSession
    fields = spark.createDataFrame([(s, i, c, df.schema[c].dataType.simpleString()) for s, df in tables.items() for i, c in enumerate(df.columns)], "sheet string, pos int, field string, kind string")
    one = fields.select("sheet").distinct()
    ident = lambda kind, *parts: F.lower(F.concat_ws("_", F.lit(kind), *parts))
    data = spark.range(1).select(ident("dataset", F.lit(dataset)).alias("id"), F.lit(dataset).alias("label"), F.lit("Dataset").alias("type"), F.lit("").alias("description"))
    sheets = one.select(ident("sheet", "sheet").alias("id"), F.col("sheet").alias("label"), F.lit("Sheet").alias("type"), F.lit("").alias("description"))
    cols = fields.select(ident("field", "sheet", "field").alias("id"), F.col("field").alias("label"), F.lit("Field").alias("type"), F.col("kind").alias("description"))
    has = fields.select(ident("dataset", F.lit(dataset)).alias("source"), ident("field", "sheet", "field").alias("target"), F.lit("HAS_FIELD").alias("relation"))
    belongs = fields.select(ident("field", "sheet", "field").alias("source"), ident("sheet", "sheet").alias("target"), F.lit("BELONGS_TO_SHEET").alias("relation"))
    return data.unionByName(sheets).unionByName(cols), has.unionByName(belongs)
