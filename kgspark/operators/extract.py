"""Prompts for, and tables from, a user's extraction function; a rule-based one is the default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_tags, lead_summary, segment_text
from ..storage import shared_folder, written
from .merge import confident, prune_dangling, with_entity_ids

RESPONSE = (
    "summary string, tags array<string>, entities array<struct<id:string,label:string,type:string,description:string,confidence:double>>, "
    "relations array<struct<source:string,target:string,relation:string,evidence:string,confidence:double>>, "
    "key_points array<struct<content:string,type:string,confidence:double>>, confidence double"
)


def response_json(content: Column) -> Column:
    """The JSON object of a model's response: the text, the inside of a fence, or what lies between the outermost braces; null if none parses."""
    fenced = F.regexp_extract(content, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(content, r"(?s)(\{.*\})", 1)
    tries = [F.trim(content), F.trim(fenced), braces]
    good = [F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t) for t in tries]
    return F.coalesce(*good)


def parse_responses(responses: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Rows with the parsed struct `parsed`, and the rows that don't parse."""
    r = responses.withColumn("_json", response_json(F.col(content)))
    return r.filter("_json is not null").withColumn("parsed", F.from_json("_json", RESPONSE)).drop("_json"), r.filter("_json is null").drop("_json")


def normalize_responses(parsed: DataFrame, doc: str = "uri", least: float = 0.5, prune: bool = False) -> dict[str, DataFrame]:
    """parsed (doc, chunk_index, parsed): segments, entities (with ids, without unsure ones), relations, tags, key_points as rows with chunk_index and pos."""
    part = lambda c: parsed.select(doc, "chunk_index", F.posexplode(f"parsed.{c}").alias("pos", "x"))
    entities = confident(with_entity_ids(part("entities").select(doc, "chunk_index", "pos", "x.*")), least)
    relations = part("relations").select(doc, "chunk_index", "pos", "x.*")
    if prune:
        relations = prune_dangling(relations, entities, doc)
    return {
        "segments": parsed.select(doc, "chunk_index", "parsed.summary", "parsed.confidence"),
        "entities": entities,
        "relations": relations,
        "tags": part("tags").select(doc, "chunk_index", "pos", F.col("x").alias("tag")),
        "key_points": part("key_points").select(doc, "chunk_index", "pos", "x.*"),
    }


def build_prompts(segments: DataFrame, concepts: list[tuple[str, str]], relations: list[str], instructions: str = "", kind: str = "all") -> DataFrame:
    """segments (text): adds prompt. kind: all, nodes, edges (then with a column known, an array of ids), or tabular (text is the structural summary of a table; its own concepts and relations)."""
    if kind == "tabular":
        concepts, relations = TABLE_CONCEPTS, TABLE_RELATIONS
    head = {"tabular": "Describe the table of this structural summary as JSON; list columns, never rows, and no column that isn't named.", "all": "List the entities and relations in the text as JSON.", "nodes": "List the entities in the text as JSON.", "edges": "List the relations between these entities as JSON."}[kind]
    lines = [head, *(f"- {t}: {d}" for t, d in (concepts if kind != "edges" else [])), *(f"- {r}" for r in (relations if kind != "nodes" else []))]
    known = [F.concat(F.lit("Known: "), F.array_join("known", ", "))] if kind == "edges" else []
    rules = [F.lit(f"Rules: {instructions}")] if instructions else []
    return segments.withColumn("prompt", F.concat_ws("\n", *map(F.lit, lines), *rules, *known, F.lit("Text:"), F.col("text")))


#: What is to be known of a table.
TABLE_CONCEPTS = [("Dataset", "The whole file, once"), ("Sheet", "Each sheet, once"), ("Field", "Each column, once"), ("DataType", "Only where it is plain")]
TABLE_RELATIONS = ["HAS_FIELD", "BELONGS_TO_SHEET", "HAS_TYPE"]
#: Characters of a structural summary, of a second attempt, and of a stand-in for a table's summary.
TABLE_CHARS, SINGLE_CHARS, LEAD_CHARS = 6000, 100_000, 300


def routed_segments(docs: DataFrame, doc: str = "uri", threshold: int = SINGLE_CHARS, size: int = 8000, overlap: int = 400) -> DataFrame:
    """docs (doc, text, strategy): doc, chunk_index, text, route. Documents of the strategy structural_summary are one tabular segment, short ones one, long ones several; one pass over the texts."""
    tabular = F.coalesce(F.col("strategy") == "structural_summary", F.lit(False))
    whole = docs.filter(F.length("text") > 0)
    tables = whole.filter(tabular).select(doc, F.lit(0).alias("chunk_index"), F.substring("text", 1, TABLE_CHARS).alias("text"), F.lit("tabular").alias("route"))
    parts = segment_text(whole.filter(~tabular).select(F.struct(F.col(doc).alias("doc"), (F.length("text") > threshold).alias("long")).alias("_of"), "text"), "_of", size, overlap, threshold)
    return tables.unionByName(parts.select(F.col("_of.doc").alias(doc), "chunk_index", "text", F.when(F.col("_of.long"), "segments").otherwise("single").alias("route")))


def extract_documents(docs: DataFrame, call: Callable[[str], str | None], concepts: list[tuple[str, str]], relations: list[str], instructions: str = "", doc: str = "uri", parallel: int = 4, threshold: int = SINGLE_CHARS, size: int = 8000, overlap: int = 400) -> dict[str, DataFrame]:
    """docs (doc, text, strategy), one row a document: all of them through a user's function, each by its route.

    tabular: the structural summary in one call; where that fails, its beginning is the summary and tabular_data the tag. single, segments: each segment in a call. fallback: where
    all segments of a document failed, its first SINGLE_CHARS characters in one call more. A call that fails leaves a row in failures, and the other segments as they are.
    Result: what normalize_responses gives, failures (doc, chunk_index, route, error), and routes (doc, route, asked, failed): fallback where that was tried.
    """
    folder = shared_folder(docs.sparkSession)

    def ask(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumn("_at", F.struct(doc, "route", F.when(F.col("route") == "tabular", F.substring("text", 1, LEAD_CHARS)).alias("lead")))
        kinds = [build_prompts(rows.filter(F.col("route") == "tabular"), concepts, relations, instructions, "tabular"), build_prompts(rows.filter(F.col("route") != "tabular"), concepts, relations, instructions)]
        told = extract_with(kinds[0].unionByName(kinds[1]), call, "_at", parallel)
        return written(told.select(F.col(f"_at.{doc}").alias(doc), "_at.route", "_at.lead", "chunk_index", "content", "error"), folder, name)

    first = ask(routed_segments(docs, doc, threshold, size, overlap), "first")
    good, bad = parse_responses(first)
    tally = lambda told, ok: told.groupBy(doc, "route").agg(F.count("*").alias("asked")).join(ok.groupBy(doc).agg(F.count("*").alias("ok")), doc, "left").select(doc, "route", "asked", (F.col("asked") - F.coalesce("ok", F.lit(0))).alias("failed"))
    counts = written(tally(first, good), folder, "counts")
    lost = counts.filter("route = 'segments' and failed = asked").select(doc)
    again = ask(docs.join(lost, doc, "left_semi").select(doc, F.lit(0).alias("chunk_index"), F.substring("text", 1, SINGLE_CHARS).alias("text"), F.lit("fallback").alias("route")), "again")
    good2, bad2 = parse_responses(again)
    out = normalize_responses(good.unionByName(good2), doc)
    plain = bad.filter("route = 'tabular'")
    out["segments"] = out["segments"].unionByName(plain.select(doc, F.lit(0).alias("chunk_index"), F.col("lead").alias("summary"), F.lit(None).cast("double").alias("confidence")))
    out["tags"] = out["tags"].unionByName(plain.select(doc, F.lit(0).alias("chunk_index"), F.lit(0).alias("pos"), F.lit("tabular_data").alias("tag")))
    error = F.coalesce("error", F.lit("no JSON object")).alias("error")
    out["failures"] = bad.unionByName(bad2).select(doc, "chunk_index", "route", error)
    out["routes"] = counts.unionByName(tally(again, good2)).groupBy(doc).agg(F.max_by("route", F.col("route") == "fallback").alias("route"), F.sum("asked").alias("asked"), F.sum("failed").alias("failed"))
    return out


def extract_with(prompts: DataFrame, call: Callable[[str], str | None], doc: str = "uri", parallel: int = 4) -> DataFrame:
    """doc, chunk_index, content, error: the user's function on each prompt, at most `parallel` calls at a time. A failed call is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[[doc, "chunk_index"]].copy()
            content, error = [], []
            for p in b.prompt:
                try:
                    content.append(call(p))
                    error.append(None)
                except Exception as e:  # a user's call may fail in any way; its row says so
                    content.append(None)
                    error.append(str(e))
            out["content"], out["error"] = content, error
            yield out

    kind = prompts.schema[doc].dataType.simpleString()
    return prompts.select(doc, "chunk_index", "prompt").repartition(parallel, doc, "chunk_index").mapInPandas(run, f"{doc} {kind}, chunk_index int, content string, error string")


def extract_two_stage(segments: DataFrame, call: Callable[[str], str | None], concepts: list[tuple[str, str]], relations: list[str], instructions: str = "", doc: str = "uri", parallel: int = 4) -> dict[str, DataFrame]:
    """segments (doc, chunk_index, text): entities first, then relations, each segment with the ids of its own entities. A failed call leaves its segment without the one or the other.

    entities, relations (as normalize_responses has them; pruned when segments are merged) and failures (doc, chunk_index, stage, error).
    Responses are written to the shared folder, so that each call is made once.
    """
    folder, failures = shared_folder(segments.sparkSession), []

    def ask(rows: DataFrame, kind: str) -> dict[str, DataFrame]:
        told = written(extract_with(build_prompts(rows, concepts, relations, instructions, kind), call, doc, parallel), folder, kind)
        good, bad = parse_responses(told)
        failures.append(bad.select(doc, "chunk_index", F.lit(kind).alias("stage"), F.coalesce("error", F.lit("no JSON object")).alias("error")))
        return normalize_responses(good, doc)

    entities = ask(segments, "nodes")["entities"]
    known = entities.groupBy(doc, "chunk_index").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("known")).select(doc, "chunk_index", F.col("known.id").alias("known"))
    with_known = segments.join(known, [doc, "chunk_index"], "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    return {"entities": entities, "relations": ask(with_known, "edges")["relations"], "failures": failures[0].unionByName(failures[1])}


def rule_extraction(docs: DataFrame, key: str = "uri") -> tuple[DataFrame, DataFrame]:
    """Without a model: summaries (key, summary) and entities of the frequent words (key, chunk_index, pos, id, label, type, confidence)."""
    tags = keyword_tags(docs, key)
    entities = tags.select(key, F.lit(0).alias("chunk_index"), F.col("rank").alias("pos"), F.concat(F.lit("concept_"), "tag").alias("id"), F.col("tag").alias("label"), F.lit("Concept").alias("type"), F.lit(0.5).alias("confidence"))
    return docs.select(key, lead_summary(F.col("text")).alias("summary")), entities


def summarize_with(segments: DataFrame, combine: Callable[[list[str]], str], doc: str = "uri", batch: int = 64) -> DataFrame:
    """doc, summary: a user's function on the summaries of a document, two or more, in order; one, or a failed call: the first."""
    s = segments.filter(F.col("summary").rlike(r"\S")).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "summary"))).alias("all")).select(doc, F.col("all.summary").alias("all"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for x in b:
                try:
                    out.append(combine(list(x)) if len(x) > 1 else x[0])
                except Exception:  # as extract_with
                    out.append(x[0])
            yield pd.Series(out)

    return s.select(doc, F.pandas_udf(run, "string")("all").alias("summary"))
