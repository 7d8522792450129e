"""Candidate batches: from extractions to reviewed, previewed and committed items.

items: id, batch_id, seq, kind (node, edge), payload struct<id,label,type,description,source,target,relation,evidence>, confidence, status, review_note.
batches: id, source_uri, requested_by, status, template_ids, created_at, committed_at. evidence: id, graph_item_id, source_uri, batch_id, template_id, evidence_text, confidence, status, created_at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

PAYLOAD = ["id", "label", "type", "description", "source", "target", "relation", "evidence"]
OPEN = ["candidate", "pending", "reviewing"]


def given(*columns: Column | str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) if isinstance(c, Column) else F.nullif(F.col(c), F.lit("")) for c in columns))


def stable_id(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def to_candidate_entity(entities: DataFrame) -> DataFrame:
    """entities (id, label, name, type, description, confidence): defaults filled in. A missing id is the label, trimmed and lower-cased, with _ for spaces."""
    label = F.coalesce(given("label", "name"), F.lit("Unknown"))
    made = F.replace(F.lower(F.trim(label)), F.lit(" "), F.lit("_"))
    return entities.withColumns({"label": label, "id": F.coalesce(given("id"), made), "type": F.coalesce(given("type"), F.lit("Concept")), "confidence": F.coalesce("confidence", F.lit(0.8)), "description": F.coalesce("description", F.lit(""))})


def to_candidate_relation(relations: DataFrame) -> DataFrame:
    """relations (source, from, target, to, relation, type, confidence, evidence): defaults filled in."""
    return relations.withColumns({
        "source": F.coalesce(given("source", "from"), F.lit("")),
        "target": F.coalesce(given("target", "to"), F.lit("")),
        "relation": F.coalesce(given("relation", "type"), F.lit("RELATES_TO")),
        "confidence": F.coalesce("confidence", F.lit(0.8)),
        "evidence": F.coalesce("evidence", F.lit("")),
    })


def create_batches(requests: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests (source_uri, requested_by, template_ids, created_at) with candidates by source_uri: one batch each, and its items."""
    b = requests.withColumns({"id": stable_id("source_uri", F.col("created_at").cast("string")), "status": F.lit("candidate"), "committed_at": F.lit(None).cast("timestamp")})
    of = b.select("source_uri", F.col("id").alias("batch_id"))
    none = F.lit(None).cast("string")

    def items(rows: DataFrame, kind: str, have: list[str], first: int) -> DataFrame:
        payload = F.struct(*((F.col(c).cast("string") if c in have else none).alias(c) for c in PAYLOAD))
        by = Window.partitionBy("batch_id").orderBy(*have)
        r = rows.join(of, "source_uri").withColumn("seq", F.row_number().over(by).cast("long") * 2 + first)
        return r.select(stable_id("batch_id", F.lit(kind), F.col("seq").cast("string")).alias("id"), "batch_id", "seq", F.lit(kind).alias("kind"), payload.alias("payload"), F.coalesce("confidence", F.lit(0.8)).alias("confidence"), F.lit("candidate").alias("status"), none.alias("review_note"))

    return b, items(entities, "node", ["id", "label", "type", "description"], 0).unionByName(items(relations, "edge", ["source", "target", "relation", "evidence"], 1))


#: A candidate ontology: what a batch proposes to know of.
CONCEPTS = "array<struct<type:string,label:string,description:string>>"
RELATIONS = "array<struct<relation:string,source:string,target:string,description:string>>"


def create_ontologies(batches: DataFrame, proposed: DataFrame) -> DataFrame:
    """proposed (source_uri, name, concepts, relations, confidence; null columns allowed): an ontology for each proposal of a batch's source that proposes anything.

    id, batch_id, name, concepts, relations, status, confidence, review_note. Concepts of equal type and relations of equal name become one, the first of each; those without are dropped.
    """
    of = batches.select("source_uri", F.col("id").alias("batch_id"))

    def first(items: Column, key: str) -> Column:
        named = F.filter(items, lambda x: given(x[key]).isNotNull())
        return F.filter(named, lambda x, i: ~F.exists(F.slice(named, 1, i), lambda y: F.lower(y[key]) == F.lower(x[key])))

    p = proposed.join(of, "source_uri").select("batch_id", given("name").alias("name"), F.coalesce(F.col("concepts").cast(CONCEPTS), F.array().cast(CONCEPTS)).alias("concepts"), F.coalesce(F.col("relations").cast(RELATIONS), F.array().cast(RELATIONS)).alias("relations"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.8)).alias("confidence"))
    p = p.withColumns({"concepts": first(F.col("concepts"), "type"), "relations": first(F.col("relations"), "relation"), "name": F.coalesce("name", F.lit("candidate_ontology"))})
    p = p.filter((F.size("concepts") > 0) | (F.size("relations") > 0)).distinct()
    return p.select(stable_id("batch_id", "name", F.to_json(F.struct("concepts", "relations", "confidence"))).alias("id"), "batch_id", "name", "concepts", "relations", F.lit("candidate").alias("status"), "confidence", F.lit(None).cast("string").alias("review_note"))


def edge_id(of: Callable[[str], Column] = F.col) -> Column:
    return F.concat_ws(":", F.lit("edge"), *(F.coalesce(of(c), F.lit("")) for c in ("source", "relation", "target")))


def graph_item_id(kind: Column, payload: Column, item_id: Column) -> Column:
    return F.when(kind == "edge", edge_id(payload.getField)).otherwise(F.concat(F.lit("node:"), given(payload["id"], payload["label"], item_id)))


def with_graph_id(items: DataFrame) -> DataFrame:
    return items.withColumn("graph_item_id", graph_item_id(F.col("kind"), F.col("payload"), F.col("id")))


def items_to_nodes(items: DataFrame) -> DataFrame:
    """Node items as nodes of layer L2."""
    n = items.filter("kind = 'node'").withColumn("nid", given(F.col("payload.id"), F.col("payload.label"), F.col("id")))
    return n.select(F.concat(F.lit("entity://"), "nid").alias("uri"), F.col("nid").alias("id"), given(F.col("payload.label"), F.col("nid")).alias("label"), F.coalesce("payload.description", F.lit("")).alias("summary"), F.col("payload.type").alias("type"), F.lit("L2").alias("layer"), "confidence", F.lit(True).alias("accessible"), "seq")


def items_to_edges(items: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edge items as edges of layer L2; and those without a source or target, with a warning."""
    e = items.join(batches.select(F.col("id").alias("batch_id"), "source_uri", "requested_by"), "batch_id")
    return _as_edges(_edge_parts(_with_ends(e))), _without_ends(e)


def _ends() -> Column:
    return (F.coalesce("payload.source", F.lit("")) != "") & (F.coalesce("payload.target", F.lit("")) != "")


def _with_ends(items: DataFrame) -> DataFrame:
    return items.filter("kind = 'edge'").filter(_ends())


def _without_ends(items: DataFrame) -> DataFrame:
    return items.filter("kind = 'edge'").filter(~_ends()).select("id", "batch_id", F.lit("edge without source or target").alias("warning"))


def _edge_parts(items: DataFrame) -> DataFrame:
    """What edges are made of: items with the source_uri and requested_by of their batches."""
    return items.select("requested_by", "source_uri", "payload.evidence", "confidence", "payload.source", "payload.target", "payload.relation", "seq")


def _entity(name: str) -> Column:
    return F.concat(F.lit("entity://"), name)


def _as_edges(parts: DataFrame) -> DataFrame:
    return parts.select(
        edge_id().alias("id"), _entity("source").alias("src_uri"), _entity("target").alias("dst_uri"), F.coalesce(given("relation"), F.lit("RELATES_TO")).alias("relation"),
        F.lit("L2").alias("layer"), F.col("requested_by").alias("owner_scope"), F.col("source_uri").alias("source_file_uri"), F.lit("team").alias("visibility"), "evidence", "confidence", "seq",
    )


def apply_edits(items: DataFrame, edits: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edits (item_id, batch_id, seq, status, payload map, review_note; null: not edited), in the order of seq. Edited items, and edits that can't be made with an error."""
    known = edits.join(items.select(F.col("id").alias("item_id"), F.col("batch_id").alias("of")), "item_id", "left").join(batches.select(F.col("id").alias("of"), F.col("status").alias("batch_status")), "of", "left")
    error = F.when(F.col("of").isNull() | (F.col("of") != F.col("batch_id")), "unknown item").when(F.col("batch_status") == "committed", "batch is committed")
    known = known.withColumn("error", error)
    good = known.filter("error is null")
    last = lambda c, k: F.max(F.when(c.isNotNull(), F.struct("seq", c.alias("v"))))["v"].alias(k)
    fields = [last(F.try_element_at(F.col("payload"), F.lit(c)), f"p_{c}") for c in PAYLOAD]
    done = good.groupBy("item_id").agg(last(F.col("status"), "e_status"), last(F.col("review_note"), "e_note"), *fields).withColumnRenamed("item_id", "id")
    out = items.join(done, "id", "left").withColumns({
        "status": F.coalesce("e_status", "status"),
        "review_note": F.coalesce("e_note", "review_note"),
        "payload": F.struct(*(F.coalesce(f"p_{c}", F.col(f"payload.{c}")).alias(c) for c in PAYLOAD)),
    })
    return out.select(items.columns), known.filter("error is not null").select("item_id", "batch_id", "seq", "error")


def payload_merge(old: Column, new: Column) -> Column:
    """The entries of both maps, those of the new one first."""
    old, new = F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def bulk_review(items: DataFrame, batches: DataFrame, to: str) -> tuple[DataFrame, DataFrame]:
    """batches (id, status): open items of uncommitted batches get the status `to` (accepted or rejected). Items, and by batch: updated, skipped, error."""
    b = batches.select(F.col("id").alias("batch_id"), F.when(F.col("status") == "committed", "batch is committed").alias("error"), F.lit(True).alias("asked"))
    r = items.join(b, "batch_id", "left").withColumn("hit", F.coalesce(F.col("asked"), F.lit(False)) & F.col("error").isNull() & F.col("status").isin(OPEN))
    out = r.withColumn("status", F.when(F.col("hit"), to).otherwise(F.col("status"))).select(items.columns)
    counts = r.groupBy("batch_id").agg(F.count_if("hit").alias("updated"), F.count_if(~F.col("hit")).alias("skipped"))
    return out, b.join(counts, "batch_id", "left").select("batch_id", F.coalesce("updated", F.lit(0)).alias("updated"), F.coalesce("skipped", F.lit(0)).alias("skipped"), "error")


def preview_changes(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Accepted items with what a commit would do: create_node, create_edge, or append_evidence where their graph item has some."""
    have = evidence.select("graph_item_id").distinct().withColumn("has", F.lit(True))
    a = with_graph_id(items.filter("status = 'accepted'")).join(have, "graph_item_id", "left")
    return a.select("batch_id", F.col("id").alias("item_id"), "graph_item_id", F.when(F.col("has"), "append_evidence").otherwise(F.concat(F.lit("create_"), "kind")).alias("action"))


def preview_summary(items: DataFrame, batches: DataFrame) -> DataFrame:
    counts = items.groupBy("batch_id").agg(F.count("*").alias("n_items"), *(F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "rejected", "committed")))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_items", "accepted", "rejected", "committed")]
    return batches.select(F.col("id").alias("batch_id")).join(counts, "batch_id", "left").select("batch_id", *zero)


def commit_evidence(items: DataFrame, batches: DataFrame, evidence: DataFrame, append: bool = False) -> DataFrame:
    """Accepted items whose graph item has no evidence yet (append: none of their batch), the first of each graph item, as evidence rows with item_id."""
    b = batches.select(F.col("id").alias("batch_id"), "source_uri", F.try_element_at("template_ids", F.lit(1)).alias("template_id"), F.col("created_at"))
    a = with_graph_id(items.filter("status = 'accepted'")).join(b, "batch_id")
    keys = ["graph_item_id", "batch_id"] if append else ["graph_item_id"]
    by = Window.partitionBy(*keys).orderBy("created_at", "batch_id", "seq", "id")
    new = a.withColumn("rn", F.row_number().over(by)).filter("rn = 1").join(evidence.select(*keys).distinct(), keys, "left_anti")
    return new.select(stable_id("graph_item_id", "batch_id").alias("id"), "graph_item_id", "source_uri", "batch_id", "template_id", F.coalesce("payload.evidence", F.lit("")).alias("evidence_text"), "confidence", F.lit("active").alias("status"), "created_at", F.col("id").alias("item_id"))


def append_evidence(evidence: DataFrame, new: DataFrame) -> DataFrame:
    """evidence and the new rows of pairs (graph_item_id, batch_id) that aren't there."""
    keys = ["graph_item_id", "batch_id"]
    return evidence.unionByName(new.select(evidence.columns).join(evidence, keys, "left_anti").dropDuplicates(keys).select(evidence.columns))


def mention_edges(items: DataFrame, batches: DataFrame) -> DataFrame:
    """MENTIONS edges (L1) from a batch's document to the entities of its accepted node items."""
    b = batches.select(F.col("id").alias("batch_id"), "source_uri", "requested_by")
    a = items.filter("status = 'accepted' and kind = 'node'").withColumn("nid", given(F.col("payload.id"), F.col("payload.label"), F.col("id"))).join(b, "batch_id")
    return a.groupBy("source_uri", "nid").agg(F.max("confidence").alias("confidence"), F.min("requested_by").alias("owner_scope")).select(
        F.concat(F.lit("mention:"), "source_uri", F.lit(":"), "nid").alias("id"), F.col("source_uri").alias("src_uri"), F.concat(F.lit("entity://"), "nid").alias("dst_uri"), F.lit("MENTIONS").alias("relation"), F.lit("L1").alias("layer"), "owner_scope",
        F.col("source_uri").alias("source_file_uri"), F.lit("team").alias("visibility"), F.lit("").alias("evidence"), "confidence",
    )


def commit_links(new_evidence: DataFrame, items: DataFrame, batches: DataFrame) -> DataFrame:
    """A link for each edge item that got evidence in this commit."""
    b = batches.select(F.col("id").alias("batch_id"), "requested_by")
    e = new_evidence.select("item_id", "source_uri", "created_at").join(items.filter("kind = 'edge'").select(F.col("id").alias("item_id"), "batch_id", "payload"), "item_id").join(b, "batch_id")
    return e.select(stable_id(F.lit("link"), "item_id").alias("id"), F.concat(F.lit("entity://"), "payload.source").alias("source_uri"), F.concat(F.lit("entity://"), "payload.target").alias("target_uri"), F.col("payload.relation").alias("relation"), F.lit("L2").alias("layer"), F.col("requested_by").alias("owner_scope"), F.col("source_uri").alias("source_file_uri"), F.lit("team").alias("visibility"), F.col("requested_by").alias("created_by"), "created_at")


def commit_summary(items: DataFrame, batches: DataFrame, new_evidence: DataFrame) -> DataFrame:
    """By batch: committed (items with new evidence), skipped (the others), evidence_created."""
    n = items.groupBy("batch_id").agg(F.count("*").alias("n"))
    e = new_evidence.groupBy("batch_id").agg(F.count("*").alias("c"))
    r = batches.select(F.col("id").alias("batch_id")).join(n, "batch_id", "left").join(e, "batch_id", "left")
    c = F.coalesce("c", F.lit(0))
    return r.select("batch_id", c.alias("committed"), (F.coalesce("n", F.lit(0)) - c).alias("skipped"), c.alias("evidence_created"))


def describe_batch(batches: DataFrame, items: DataFrame, ontologies: DataFrame | None = None) -> DataFrame:
    """Batches with their items as an array, by seq; and with their ontologies, by name. A batch is what people review: its arrays are as long as that. batch_rows gives the same in long form."""
    own = items.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("seq", "id", "kind", "status", "confidence"))).alias("items"))
    out = batches.join(own, batches["id"] == own["batch_id"], "left").drop("batch_id")
    if ontologies is None:
        return out
    known = ontologies.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("name", "id", "status", "confidence", "concepts", "relations"))).alias("ontologies"))
    return out.join(known, out["id"] == known["batch_id"], "left").drop("batch_id")


def batch_rows(batches: DataFrame, items: DataFrame, ontologies: DataFrame) -> DataFrame:
    """What a batch holds, a row each: batch_id, batch_status, part (item, concept, relation), of (the ontology's name), seq, id, kind, status, confidence. Batches of any size; an empty one has one row without part."""
    b = batches.select(F.col("id").alias("batch_id"), F.col("status").alias("batch_status"))
    none = F.lit(None).cast("string")
    rows = items.select("batch_id", F.lit("item").alias("part"), none.alias("of"), "seq", "id", "kind", "status", "confidence")
    for part, column, name in (("concept", "concepts", "type"), ("relation", "relations", "relation")):
        some = ontologies.select("batch_id", "name", "status", "confidence", F.posexplode(column).alias("seq", "x"))
        rows = rows.unionByName(some.select("batch_id", F.lit(part).alias("part"), F.col("name").alias("of"), F.col("seq").cast("long").alias("seq"), F.col(f"x.{name}").alias("id"), none.alias("kind"), "status", "confidence"))
    return b.join(rows, "batch_id", "left")


def accepted_items(batches: DataFrame, items: DataFrame) -> DataFrame:
    """Accepted items with the source_uri and requested_by of their batch; seq is their place in the order of commits."""
    of = batches.select(F.col("id").alias("batch_id"), F.col("created_at").alias("_at"), "source_uri", "requested_by")
    place = F.struct(F.col("_at").alias("at"), F.col("batch_id").alias("batch"), F.col("seq").alias("seq"), F.col("id").alias("item"))
    return items.filter("status = 'accepted'").join(of, "batch_id").withColumn("seq", place).drop("_at")


def commit_edges(batches: DataFrame, items: DataFrame, edges: DataFrame, folder: str | None = None) -> DataFrame:
    """The edges of commit_batch, with the columns that edges has: of the batches' sources only the last batch's mentions, and accepted edge items over stored edges.

    Without columns that differ between items of an edge, less is shuffled. With a folder the new edges are written to it first, and plans stay small.
    """
    from .graph import clear_mentions, merge_edges, once, partners

    docs = batches.select(F.col("source_uri").alias("uri")).distinct()
    last = batches.withColumn("_rn", F.row_number().over(Window.partitionBy("source_uri").orderBy(F.desc("created_at"), F.desc("id")))).filter("_rn = 1")
    of_last = partners(items.filter("status = 'accepted' and kind = 'node'"), last.select(F.col("id").alias("batch_id")), ["batch_id"])[1]
    mentions = mention_edges(of_last, last)
    # equal ends and relations make equal keys: what is shuffled are these, texts are made of the last item of each
    short = _edge_parts(_with_ends(accepted_items(batches, items))).withColumn("relation", F.coalesce("relation", F.lit("")))
    ends = ["source", "target", "relation"]
    new, keys = once(short, ends, "seq")
    if set(edges.columns) <= {"id", "src_uri", "dst_uri", "relation", "layer", "visibility"}:  # the same of all items of a key
        keys = short.select(ends).distinct()
        new = None
    if folder:
        mentions = written(mentions.select(edges.columns), folder, "mentions")
        keys = written(keys if new is None else new, folder, "new")
        new = None if new is None else keys
    if new is None:
        new = keys.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in short.schema if f.name not in ends))
    key = {"src_uri": _entity("source"), "dst_uri": _entity("target"), "id": edge_id()}
    all_keys = keys.select(*(c.alias(n) for n, c in key.items())).unionByName(mentions.select(*key))
    return merge_edges(clear_mentions(edges, docs), _as_edges(new).select(edges.columns).unionByName(mentions.select(edges.columns)), all_keys)


def commit_batch(batches: DataFrame, items: DataFrame, nodes: DataFrame, edges: DataFrame, evidence: DataFrame, links: DataFrame, now: Column | None = None) -> dict[str, DataFrame]:
    """All state tables after the commit of all batches given, as if one after another: by their time, id, and the items' seq and id, later rows go over earlier ones.
    Of several batches of a source, the last one's mentions stay."""
    from .graph import stub_nodes, upsert_nodes
    from .state import upsert_links

    accepted = accepted_items(batches, items)
    new = commit_evidence(items, batches, evidence)
    found = items_to_nodes(accepted)
    docs = batches.select(F.col("source_uri").alias("uri")).distinct()
    doc_nodes = docs.select("uri", F.col("uri").alias("id"), F.element_at(F.split("uri", "/"), -1).alias("label"), F.lit("").alias("summary"), F.lit("document").alias("type"), F.lit("L1").alias("layer"), F.lit(1.0).alias("confidence"), F.lit(True).alias("accessible"), F.lit(None).cast(accepted.schema["seq"].dataType).alias("seq"))
    all_nodes = upsert_nodes(nodes, found.unionByName(doc_nodes).select(*nodes.columns, "seq"))
    edge_items, warnings = _as_edges(_edge_parts(_with_ends(accepted))), _without_ends(accepted)
    all_nodes = stub_nodes(all_nodes, edge_items)
    when = now if now is not None else F.current_timestamp()
    return {
        "nodes": all_nodes,
        "edges": commit_edges(batches, items, edges),
        "evidence": append_evidence(evidence, new),
        "links": upsert_links(links, commit_links(new, items, batches)),
        "items": items.withColumn("status", F.when(F.col("status") == "accepted", "committed").otherwise(F.col("status"))),
        "batches": batches.withColumns({"status": F.lit("committed"), "committed_at": when}),
        "warnings": warnings,
        "summary": commit_summary(items, batches, new),
    }
