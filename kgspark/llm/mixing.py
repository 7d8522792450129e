"""Operator 8: mixing sources to target weights by entropy balancing.

Of all rates of documents that give every source its target number of words, the wanted ones are closest (in relative entropy, each word
counted) to the even rates 1. The dual of this problem is convex and separates by source: the rate is exp(multiplier of the source), the
gradient the sum of words * exp(multiplier) over its documents, less the target. Documents are first summed by source and by the beginning of a digest of
their ids, on the map side; each step of Newton's method then sums gradient and Hessian over these sums, for all sources at once, until all constraints hold.

Rates become whole copies: each document of a source gets the whole part; of the rest, documents in the order of a digest of their id
take one copy more, as long as the source's need is not passed; up to FILLS further documents, each the largest that still fits, close
the gap. A source is described by its digest bound and these few documents, so that copies are found without moving any text.

Targets: sources by code point (null last) weigh WEIGHTS, repeating, and share SHARE of all words; no target passes MOST times its source's
words, what is above is reshared by weight.

Null and empty texts have size 0; texts of any length count whole. Null doc_ids are in order as empty ones; rows with equal source, doc_id and size take the same number of copies. A source without words has
target 0. An empty table gives no rows. Extra columns of the input are ignored by `mixed`, and kept by `repeated`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, packed, pick, quoted, shared_folder, unpacked, written

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
NEWTON_STEPS, PRECISION, FILLS = 60, 1e-9, 3
#: Hexadecimal digits of the digest by which sizes are first summed.
BUCKET_DIGITS = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source(source: Column) -> Column:
    """A key that is never null and keeps the order of code points, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _order(doc_id: Column) -> Column:
    d = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.concat(F.md5(d), d)


def sums_before(rows: DataFrame, order: list[str], values: list[str], folder: str, name: str) -> DataFrame:
    """The rows with `<value>_before` for each value: its sum over all rows that come before in the order. Rows are dealt by ranges of the order; only the ranges' sums meet in one task."""
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), folder, name)
    ranges = dealt.groupBy("_range").agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(ranges, "_range").select(*rows.columns, *((F.col(f"_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"{v}_before") for v in values))


def targets(sizes: DataFrame, folder: str, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (src, source_size), a row for each source, with the target number of words of each."""
    w = sums_before(sizes.withColumn("one", F.lit(1)), ["src"], ["one"], folder, "ranks").drop("one")
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("one_before") % len(weights) + 1).cast("int")))
    w = w.withColumn("limit", most * F.col("source_size")).withColumn("level", F.col("limit") / F.col("weight"))
    w = written(sums_before(w, ["level", "src"], ["limit", "weight"], folder, "levels"), folder, "shares")
    words, weight = w.agg(F.sum("source_size"), F.sum("weight")).first()
    # the first source whose own limit lies above the level at which it and all after it share what is left
    water = (F.lit(share * (words or 0)) - F.col("limit_before")) / (F.lit(weight or 0.0) - F.col("weight_before"))
    found = w.withColumn("water", water).filter("water <= level").agg(F.min(F.struct("level", "src", "water"))["water"]).first()[0]
    return w.select("src", "source_size", F.least(F.col("limit"), F.col("weight") * F.lit(float("inf") if found is None else found)).alias("target"))


def newton(units: DataFrame, targets: DataFrame, folder: str, steps: int = NEWTON_STEPS) -> DataFrame:
    """units (src, unit): the words; targets (src, target). src, multiplier of the sources that have words and a target.

    A step sums the tilted words over all units: these less the target are the gradient, and, as no unit has two sources, the Hessian's
    diagonal, which is all of it. It ends when no gradient is above PRECISION of its target.
    """
    x = written(targets.filter("target > 0 and source_size > 0").select("src", "target", F.lit(0.0).alias("multiplier")), folder, "dual0")
    for k in range(steps):
        tilted = units.join(x, "src").groupBy("src").agg(F.sum(F.col("unit") * F.exp("multiplier")).alias("hessian"))
        new = x.join(tilted, "src").withColumn("gradient", F.col("hessian") - F.col("target"))
        x = written(new.select("src", "target", (F.col("multiplier") - F.col("gradient") / F.col("hessian")).alias("multiplier"), (F.abs("gradient") / F.col("target")).alias("off")), folder, f"dual{k + 1}")
        if (x.agg(F.max("off")).first()[0] or 0.0) < PRECISION:
            break
        x = x.drop("off")
    return x.select("src", "multiplier")


def source_plans(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs (doc_id, source, size). A row for each source: source_size, target, multiplier, whole (copies of each), bound and extra (who takes one more)."""
    folder = shared_folder(docs.sparkSession)
    units = docs.groupBy(_source(F.col("source")).alias("src"), _order(F.col("doc_id")).alias("ord"), "size").agg(F.count("*").alias("times"))
    units = written(units.select("src", "ord", "size", (F.col("size") * F.col("times")).alias("unit"), F.substring("ord", 1, BUCKET_DIGITS).alias("bucket")), folder, "sizes")
    buckets = written(units.groupBy("src", "bucket").agg(F.sum("unit").alias("unit")), folder, "buckets")
    plans = written(targets(buckets.groupBy("src").agg(F.sum("unit").alias("source_size")), folder, weights, share, most), folder, "targets")
    plans = plans.join(newton(buckets, plans, folder), "src", "left")
    plans = plans.withColumn("whole", F.coalesce(F.floor(F.exp("multiplier") + 1e-9), F.lit(0)))
    plans = written(plans.withColumn("need", F.round(F.col("target") - F.col("whole") * F.col("source_size"), 6)), folder, "plans")
    run = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = buckets.withColumn("before", F.coalesce(F.sum("unit").over(run), F.lit(0))).join(plans.select("src", "need"), "src")
    edge = edge.filter((F.col("before") <= F.col("need")) & (F.col("before") + F.col("unit") > F.col("need"))).select("src", "bucket", "before", "need")
    inside = units.join(edge, ["src", "bucket"])
    upto = Window.partitionBy("src", "bucket").orderBy("ord", "size")
    inside = inside.withColumn("upto", F.col("before") + F.sum("unit").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    # a source without an edge takes all of its documents once more or, where nothing is needed, its need is 0
    stop = inside.filter(F.col("upto") > F.col("need")).groupBy("src").agg(F.min(F.struct("ord", "size", F.expr("upto - unit as taken"))).alias("stop"))
    plans = plans.join(stop, "src", "left").select("*", F.col("stop.ord").alias("stop_ord"), F.col("stop.size").alias("stop_size"), F.coalesce(F.col("need") - F.col("stop.taken"), F.lit(0.0)).alias("gap")).drop("stop")
    plans = written(plans, folder, "bounds")
    spare = units.join(plans.select("src", "stop_ord", "stop_size", "gap"), "src").filter((F.col("unit") > 0) & (F.col("unit") <= F.col("gap")))
    spare = spare.filter((F.col("ord") > F.col("stop_ord")) | ((F.col("ord") == F.col("stop_ord")) & (F.col("size") >= F.col("stop_size"))))
    spare = written(spare.groupBy("src", "unit").agg(F.min(F.struct("ord", "size")).alias("first")), folder, "spare")
    for k in range(FILLS):
        best = spare.join(plans.select("src", "gap"), "src").filter(F.col("unit") <= F.col("gap")).groupBy("src").agg(F.max("unit").alias("fill"))
        spare = spare.join(best, "src", "left")
        chosen = spare.filter(F.col("unit") == F.col("fill")).select("src", F.col("fill"), F.col("first").alias(f"fill{k}"))
        plans = plans.join(chosen, "src", "left").withColumn("gap", F.col("gap") - F.coalesce("fill", F.lit(0))).drop("fill")
        spare = spare.filter(~F.coalesce(F.col("unit") == F.col("fill"), F.lit(False))).drop("fill")
    extra = F.array_compact(F.array(*(f"fill{k}" for k in range(FILLS))))
    return written(plans.select("src", "source_size", "target", "multiplier", "whole", "stop_ord", "stop_size", extra.alias("extra"), (F.col("need") > 0).alias("more")), folder, "done")


def _copies(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, doc_id: str, source: str, text: str) -> DataFrame:
    """The rows of docs as `row`, with src, ord, size, the plan of their source, and copies."""
    id_, from_, words = F.col(quoted(doc_id)), F.col(quoted(source)), size_of(F.col(quoted(text)))
    plans = source_plans(docs.select(id_.alias("doc_id"), from_.alias("source"), words.alias("size")), weights, share, most)
    rows = packed(docs, src=_source(from_), ord=_order(id_), size=words).join(plans, "src")
    before = F.col("stop_ord").isNull() | (F.col("ord") < F.col("stop_ord")) | ((F.col("ord") == F.col("stop_ord")) & (F.col("size") < F.col("stop_size")))
    once_more = F.col("more") & (before | F.array_contains("extra", F.struct("ord", "size")))
    return rows.withColumn("copies", F.col("whole") + once_more.cast("long"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """For each document: doc_id, size, source_size, target, rate (before rounding), copies, taken (size times copies)."""
    rows = _copies(pick(docs, {"doc_id": doc_id, "source": source, "text": text}), weights, share, most, "doc_id", "source", "text")
    return rows.select("row.doc_id", "size", "source_size", "target", F.coalesce(F.exp("multiplier"), F.lit(0.0)).alias("rate"), "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs, each as often as the mix has it (some not at all). Null texts and texts without words are of no weight; they stay once."""
    rows = _copies(docs, weights, share, most, doc_id, source, text)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies")).cast("int")
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times))).select(*unpacked(docs.columns))
