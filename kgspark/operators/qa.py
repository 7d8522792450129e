"""Context for questions: keywords, entities, their neighbourhood under a budget, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import question_keywords
from .graph import both_ways, is_entity
from .label_index import keyword_grams, look_up, postings

HITS, BUDGET = 6, 30


def qa_entities(questions: DataFrame, nodes: DataFrame | None, hits: int = HITS, index: str | None = None) -> DataFrame:
    """question_id, rank, uri, label, keyword: up to `hits` nodes by label for each keyword; the first keyword keeps a node.

    Keywords meet labels by a join on runs of three characters (of two, for keywords of two): each keyword by that of its runs which the fewest labels have.
    Labels that hold it are looked at once each, and every task sends on the first `hits` of a keyword only. index: the folder of a stored label_index, of which only the buckets
    of the keywords' runs are read, in place of the nodes.
    """
    words = questions.select("question_id", F.posexplode(question_keywords(F.col("question"))).alias("k", "keyword"))
    terms = keyword_grams(words.select("keyword").distinct())
    labels = look_up(questions.sparkSession, terms, index) if index else postings(nodes)
    counts = labels.join(terms.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = terms.join(counts, "gram", "left").groupBy("keyword").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram"))["gram"].alias("gram"))
    found = labels.join(rarest, "gram").filter(F.contains(F.lower("label"), F.col("keyword"))).select("keyword", "uri", "label")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("keyword").orderBy("label", "uri"))).filter(F.col("place") <= hits)
    rows = words.join(found, "keyword")
    one = rows.withColumn("rn", F.row_number().over(Window.partitionBy("question_id", "uri").orderBy("k"))).filter("rn = 1")
    return one.select("question_id", F.row_number().over(Window.partitionBy("question_id").orderBy("k", "label", "uri")).alias("rank"), "uri", "label", "keyword")


def qa_relations(entities: DataFrame, edges: DataFrame, budget: int = BUDGET) -> DataFrame:
    """question_id and the edges of its entities, in their order, until they brought `budget` new nodes; the entity at which that happens is finished."""
    e = entities.select("question_id", "rank", "uri").join(both_ways(edges), "uri")
    other = e.select("question_id", "rank", F.col("other_uri").alias("node")).join(entities.select("question_id", F.col("uri").alias("node")), ["question_id", "node"], "left_anti")
    first = other.groupBy("question_id", "node").agg(F.min("rank").alias("rank"))
    new = entities.select("question_id", "rank").join(first.groupBy("question_id", "rank").agg(F.count("*").alias("new")), ["question_id", "rank"], "left")
    run = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    open_ = new.withColumn("spent", F.coalesce(F.sum("new").over(run), F.lit(0))).filter(F.col("spent") < budget)
    kept = e.join(open_.select("question_id", "rank"), ["question_id", "rank"])
    return kept.select("question_id", "id", "src_uri", "dst_uri", "relation", "layer").distinct()


def qa_evidence(entities: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """question_id and the valid evidence of its entities and of the nodes at its relations' ends."""
    ends = relations.select("question_id", F.explode(F.array("src_uri", "dst_uri")).alias("uri"))
    ids = entities.select("question_id", "uri").union(ends).distinct().filter(is_entity(F.col("uri"))).select("question_id", F.concat(F.lit("node:"), F.substring("uri", 10, 1 << 20)).alias("graph_item_id"))
    return ids.join(evidence.filter(~F.col("status").isin("stale", "purged")), "graph_item_id")


def qa_candidates(items: DataFrame, batches: DataFrame) -> DataFrame:
    """Of every batch that isn't committed, all items that aren't rejected, nodes and edges: batch_id, source_uri, batch_status, item_id, kind, payload, status.

    The same rows are the context of every question that asks for candidates (qa_candidate_questions), so they stand here once.
    """
    open_ = batches.filter("status <> 'committed'").select(F.col("id").alias("batch_id"), "source_uri", F.col("status").alias("batch_status"))
    return items.filter("status <> 'rejected'").join(open_, "batch_id").select("batch_id", "source_uri", "batch_status", F.col("id").alias("item_id"), "kind", "payload", "status")


def qa_candidate_questions(questions: DataFrame) -> DataFrame:
    return questions.filter("include_candidates").select("question_id")


def qa_context(questions: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, items: DataFrame, batches: DataFrame) -> dict[str, DataFrame]:
    entities = qa_entities(questions, nodes)
    relations = qa_relations(entities, edges)
    return {"entities": entities, "relations": relations, "evidence": qa_evidence(entities, relations, evidence), "candidates": qa_candidates(items, batches), "candidate_questions": qa_candidate_questions(questions)}
