"""Operator 12: Merkle manifest of a dataset, rolled up in nested structs.

H is the lowercase hex sha256 of its inputs, concatenated. A row's leaf is the H of its fields, each `-` if null, else its UTF-8 byte count, `:` and
its value. The leaves of a group ascend by id; every FAN consecutive nodes become their H (the last run may be shorter) until one is left, the group's
subroot. Subroots, in order of their group (null first, by bytes), become the root in the same way.

A node's rank, written in digits to the base FAN, says where it stands: blocks hold all nodes that differ in the last DIGITS digits only. Within a
block the last digit is grouped away, then the last but one and so on: each time the nodes of a run become an array of structs inside their parent's
struct. So a block is one row of at most FAN ** DIGITS nodes, whatever the table's size; its top is a node of the next round, in which blocks are formed
again. Back from the root, a block meets the proof of its top (by grouping both under the block's number), and transform and explode emit each node's
proof, the siblings left and right of it at each level, without joins of nodes.

Ranks come from one sort by ranges: a row's place in its range, and the number of rows of its group in ranges before. No group, whatever its
size, is one task. The rounds need four passes over rows of about 200 bytes; texts are read once and not shuffled.

Null ids come first in their group; rows of equal group and id are in order of their leaves, so that repeated rows give equal leaves side by side.
Null and empty texts have different leaves (`-` and `0:`). An empty table gives no rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import pick, quoted, shared_folder, written

FAN, DIGITS = 8, 3

#: Left and right siblings of a node at each level, from the bottom up.
PROOF = "array<struct<l:string,r:string>>"


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def ranked(rows: DataFrame, group: str, order: list[str], folder: str, name: str) -> DataFrame:
    """The rows with `rank` (from 0) in their group by the order, nulls first, and `n`, the group's size."""
    # the id tells the range a row is in and its place there
    dealt = rows.repartitionByRange(*(F.asc_nulls_first(c) for c in (group, *order))).sortWithinPartitions(*(F.asc_nulls_first(c) for c in (group, *order)))
    dealt = written(dealt.withColumn("_id", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_id", 33)), folder, name)
    runs = dealt.groupBy("_range", group).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))  # ranges and groups: each range has all of a group, or it is the group's first or last, or full of it
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("_range").alias("_of"), F.col(group).alias("_group"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("n"))
    out = dealt.join(runs, (dealt["_range"] == runs["_of"]) & dealt[group].eqNullSafe(runs["_group"]))
    return out.select(*rows.columns, (F.col("_id") - F.col("_first") + F.col("_before")).alias("rank"), "n")


def _top(kids: Column, level: int) -> Column:
    """The hash of a run, where its group has so many nodes that there is such a level; else that of the one node."""
    hashes = F.array_join(F.transform(kids, lambda k: k["h"]), "")
    return F.when(F.col("n") > FAN**level, F.sha2(hashes, 256)).otherwise(F.element_at(kids, 1)["h"])


def rolled_up(nodes: DataFrame) -> DataFrame:
    """nodes (grp, n, rank, h, and others), as blocks (grp, n, block, h, kids): kids are nested DIGITS levels deep, with the others at the bottom."""
    block = F.floor(F.col("rank") / FAN**DIGITS).cast("long")
    digits = [F.floor(F.col("rank") / FAN**d).cast("long") % FAN for d in range(DIGITS)]
    others = [c for c in nodes.columns if c not in ("grp", "n", "rank", "h")]
    rows = nodes.select("grp", "n", block.alias("block"), *(d.cast("int").alias(f"d{k}") for k, d in enumerate(digits)), "h", *others)
    rows = rows.repartition("grp", "block")  # the only shuffle: all groupings below are finer than it
    for level in range(DIGITS):
        keys = ["grp", "n", "block", *(f"d{k}" for k in range(DIGITS - 1, level, -1))]
        inner = others if level == 0 else ["kids"]
        runs = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(f"d{level}", "h", *inner))).alias("kids"))
        rows = runs.withColumn("h", _top(F.col("kids"), level))
    return rows.select("grp", "n", "block", "h", "kids")


def _unnested(blocks: DataFrame, fields: dict[str, str], up: str = "up", extra: tuple[str, ...] = ()) -> DataFrame:
    """blocks (grp, n, block, kids, up), back as nodes: their fields and proof, that of their place in the block before up."""

    def step(kids: Column, level: int) -> Column:
        """An array of structs at the bottom, with the proof inside the block."""

        def one(k: Column, i: Column) -> Column:
            side = lambda part: F.array_join(F.transform(part, lambda s: s["h"]), "")
            place = F.struct(side(F.slice(kids, 1, i)).alias("l"), side(F.slice(kids, i + 2, FAN)).alias("r"))
            here = F.when(F.col("n") > FAN**level, F.array(place)).otherwise(F.array().cast(PROOF))
            if level == 0:
                digit = k["d0"].cast("long")
                return F.array(F.struct(digit.alias("place"), *(k[c].alias(c) for c in fields), here.alias("proof")))
            return F.transform(step(k["kids"], level - 1), lambda x: F.struct((x["place"] + k[f"d{level}"].cast("long") * FAN**level).alias("place"), *(x[c].alias(c) for c in fields), F.concat(x["proof"], here).alias("proof")))

        return F.flatten(F.transform(kids, one))

    rows = blocks.select("grp", "block", *extra, up, F.explode(step(F.col("kids"), DIGITS - 1)).alias("x"))
    rank = F.col("block") * FAN**DIGITS + F.col("x.place")
    return rows.select("grp", rank.alias("rank"), *extra, *(F.col(f"x.{c}").alias(c) for c in fields), F.concat("x.proof", up).alias("proof"))


def _met(blocks: DataFrame, ups: DataFrame, names: list[str]) -> DataFrame:
    """The blocks with what ups (grp, block, and names) say of them: one group of two rows for each block."""
    nothing = [F.lit(None).cast(ups.schema[c].dataType).alias(c) for c in names]
    left = blocks.select("grp", "block", "n", "kids", *nothing)
    right = ups.select("grp", "block", F.lit(None).cast("long").alias("n"), F.lit(None).cast(blocks.schema["kids"].dataType).alias("kids"), *names)
    return left.unionByName(right).groupBy("grp", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", *names)))


def _rounds(nodes: DataFrame, folder: str, name: str) -> list[DataFrame]:
    """Rounds of blocks, each over the tops of the one before, until every group has one."""
    out = []
    while True:
        out.append(written(rolled_up(nodes), folder, f"{name}{len(out)}"))
        if not out[-1].filter("n > %d" % FAN**DIGITS).limit(1).count():
            return out
        more = out[-1].filter("n > %d" % FAN**DIGITS)
        nodes = more.select("grp", F.ceil(F.col("n") / FAN**DIGITS).cast("long").alias("n"), F.col("block").alias("rank"), "h")


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """grp and h of each group's one remaining node."""
    tops = [r.filter("n <= %d" % FAN**DIGITS).select("grp", "h") for r in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _descended(rounds: list[DataFrame], tops: DataFrame, names: list[str], folder: str, name: str) -> DataFrame:
    """The first round's blocks with up, the proof of their tops, and names: tops (grp, up, names) are those of the groups' last nodes."""
    tops = tops.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, 0, -1):
        # tops of groups that end in this round belong here; the others belong to a round below, as they are
        ends = rounds[k].select("grp").distinct()
        met = _met(rounds[k], tops.join(ends, tops["grp"].eqNullSafe(ends["grp"]), "left_semi"), ["up", *names])
        down = _unnested(met, {}, extra=tuple(names)).select("grp", F.col("rank").alias("block"), F.col("proof").alias("up"), *names)
        here = tops.join(ends, tops["grp"].eqNullSafe(ends["grp"]), "left_anti").select("grp", "block", "up", *names)
        tops = written(down.unionByName(here), folder, f"{name}{k}")
    return _met(rounds[0], tops, ["up", *names])


def manifest(rows: DataFrame, group: str, order: str, fields: list[str], tampered: dict[str, Column] | None = None) -> DataFrame:
    """A leaf of each row's fields; leaves of equal group are in order of the column order.

    tampered: other values of some fields, null where the row stays as it is. For each row: grp, id, leaf, subroot, root, proof (left and right siblings
    from the bottom up), seen (the leaf of tampered values, else null).
    """
    folder = shared_folder(rows.sparkSession)
    value = {c: F.col(quoted(c)) for c in fields}
    changed = F.lit(None).cast("string")
    for c, new in (tampered or {}).items():
        changed = F.when(new.isNotNull(), leaf(*(new if c == f else value[f] for f in fields))).otherwise(changed)
    leaves = rows.select(F.col(quoted(group)).cast("string").alias("grp"), F.col(quoted(order)).alias("id"), leaf(*value.values()).alias("h"), changed.alias("seen"))
    rounds = _rounds(ranked(leaves, "grp", ["id", "h"], folder, "leaves"), folder, "round")
    # the subroots are leaves of one more tree, of one group
    heads = _tops(rounds).select(F.lit("").alias("grp"), F.col("grp").alias("of"), "h")
    upper = _rounds(ranked(heads, "grp", ["of"], folder, "heads"), folder, "upper")
    root = _tops(upper).select("grp", F.col("h").alias("root"), F.array().cast(PROOF).alias("up"))
    heads = _unnested(_descended(upper, root, ["root"], folder, "above"), {"of": "string", "h": "string"}, extra=("root",))
    heads = heads.select(F.col("of").alias("grp"), F.col("proof").alias("up"), "root", F.col("h").alias("subroot"))
    blocks = _descended(rounds, written(heads, folder, "subroots"), ["root", "subroot"], folder, "below")
    out = _unnested(blocks, {"id": "", "h": "", "seen": ""}, extra=("root", "subroot"))
    return out.select("grp", "id", F.col("h").alias("leaf"), "subroot", "root", "proof", "seen")


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["l"], p["r"])), ""), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, start, lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]), 256))
