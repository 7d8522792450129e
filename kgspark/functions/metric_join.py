"""Pairs of near vectors: an exact metric join.

On unit vectors the angle is a metric, and a cosine of at least t is an angle of at most w = acos(t). A group of more than TILE_ROWS rows is cut by pivots,
chosen from a sample: a row lives in the cell of its nearest pivot. A row y of cell i visits a cell j of lower number unless no row of j can be within w of it: rows of j lie within
the radius of j around its pivot (triangle inequality), and beyond the plane between both pivots, from which y is asin((i - j) y / |i - j|) away. Two rows within w of each other
so meet in exactly one cell, where one of them lives at least. Large cells are cut again. What is still large is dealt into rings by the distance from the pivot: two rings whose
distances differ by more than w never meet. Where tiles meet, the products of the first quarter of the dimensions (in order of their variance) and of the norms of the rest bound
the cosine, and rows that can't reach t are left out.

Where a sample shows that cells wouldn't halve the pairs (vectors without clusters, wide angles), a group goes into tiles at once. Which pivots are chosen only changes the work. A group is never one task: rows meet their pivots in salted parts, and cells in tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_folder, written

#: Rows of a tile; rows for which a group gets a pivot, and at most; rows of a part that meets its group's pivots; sampled rows for a pivot.
TILE_ROWS, PIVOT_ROWS, MOST_PIVOTS, PART_ROWS, SAMPLE = 2000, 50, 1024, 20_000, 4
#: Times that large cells are cut.
ROUNDS = 3
#: Rows whose products are made at once.
STEP = 512
#: Slack of angles, for rounding; distances near 0 are only exact to the square root of a double's precision.
SLACK = 1e-6

GROUP = ["block", "dims", "path"]
#: Ends the path of a group that cells wouldn't make cheaper: it goes into tiles as it is.
KEPT = "!"


def unit_rows(vectors: DataFrame, block: str, key: str, dot: Column) -> DataFrame:
    """block, dims, path, id, mask, far, vector of unit length; without nulls and vectors that have no direction."""
    size = F.sqrt(dot)
    v = vectors.select(F.col(block).alias("block"), F.size("vector").alias("dims"), F.col(key).alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("vector"), size.alias("size"))
    v = v.filter("size > 0 AND size < double('infinity') AND id IS NOT NULL AND block IS NOT NULL")
    unit = F.transform("vector", lambda x: x / F.col("size"))
    return v.select("block", "dims", F.lit("").alias("path"), "id", F.lit(0).alias("mask"), F.lit(0.0).alias("far"), unit.alias("vector"))


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _chosen(x: np.ndarray, many: int) -> np.ndarray:
    """Pivots of sampled rows: farthest first, then twice the mean direction of what is nearest."""
    first = [0]
    near = x @ x[0]
    while len(first) < min(many, len(x)):
        k = int(np.argmin(near))
        if near[k] > 1 - 1e-9:
            break
        first.append(k)
        near = np.maximum(near, x @ x[k])
    pivots = x[first]
    for _ in range(2):
        of = np.argmax(x @ pivots.T, 1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, of, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), pivots)
    return pivots


def _cells_of(s: np.ndarray, pivots: np.ndarray, radius: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with products s with the pivots: the home of each, and which cells it is in (its home and those it visits)."""
    far, at = np.arccos(np.clip(s, -1.0, 1.0)), np.arange(len(s))
    home = np.argmin(far, 1)
    there = far <= radius[None, :] + width + SLACK
    if width < math.pi / 2:
        apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
        there &= s[at, home][:, None] - s <= math.sin(width) * apart[home] + SLACK
    there &= np.arange(s.shape[1])[None, :] < home[:, None]
    there[at, home] = True
    return home, there


def _pays(x: np.ndarray, pivots: np.ndarray, n: int, width: float) -> bool:
    """Whether cells would halve the pairs of the sampled rows x, without more copies of rows than tiles need."""
    s = np.clip(x @ pivots.T, -1.0, 1.0)
    far = np.arccos(s)
    radius = np.full(len(pivots), -4.0)
    np.maximum.at(radius, np.argmin(far, 1), far.min(1))
    home, there = _cells_of(s, pivots, radius, width)
    lives, copies = np.bincount(home, minlength=len(pivots)), there.sum(0)
    return float((lives * (copies - lives / 2)).sum()) <= len(x) ** 2 / 4 and there.sum() <= len(x) * max(4, n / TILE_ROWS)


def cut(v: DataFrame, large: DataFrame, width: float, level: int, folder: str) -> DataFrame:
    """v, the rows of large groups (GROUP, n): in the cells where they live and visit, with a bit of mask set where they visit."""
    v = v.join(large, GROUP)
    many = F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n") / PIVOT_ROWS))
    sample = v.filter(F.pmod(F.xxhash64("id", F.lit(level)), F.col("n")) < SAMPLE * many).select(*GROUP, "n", "vector")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        n, x = int(pdf.n.iloc[0]), np.stack(pdf.vector.to_numpy())
        pivots = _chosen(x, min(MOST_PIVOTS, -(-n // PIVOT_ROWS)))
        if len(pivots) < 2 or not _pays(x, pivots, n, width):
            pivots = pivots[:0]
        return pd.DataFrame({c: pdf[c].iloc[0] for c in GROUP} | {"n": n, "number": np.arange(len(pivots)), "pivot": pd.Series(list(pivots), dtype=object)})

    kinds = {c: v.schema[c].dataType.simpleString() for c in (*GROUP, "id")}
    head = ", ".join(f"{c} {kinds[c]}" for c in GROUP)
    pivots = sample.groupBy(*GROUP).applyInPandas(choose, f"{head}, n long, number int, pivot array<double>")
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    keys = [*GROUP, "part"]
    rows = v.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("int"))
    pivots = written(pivots, folder, f"pivots{level}")

    def measure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The radius of each cell among the rows of a part."""
        out = right[[*GROUP, "number"]].assign(radius=-4.0)
        if len(left) and len(right):
            pivots, radius = np.stack(right["pivot"].to_numpy()), np.full(len(right), -4.0)
            for k in range(0, len(left), TILE_ROWS):
                far = _angles(np.stack(left.vector.iloc[k : k + TILE_ROWS].to_numpy()), pivots)
                near = far <= far.min(1, keepdims=True) + SLACK  # of equally near pivots all, since rounding may choose either
                radius = np.maximum(radius, np.where(near, far, -4.0).max(0))
            out = out.assign(radius=radius)
        return out

    dealt = lambda p: p.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).groupBy(*keys)
    radius = rows.groupBy(*keys).cogroup(dealt(pivots)).applyInPandas(measure, f"{head}, number int, radius double")
    pivots = pivots.join(radius.groupBy(*GROUP, "number").agg(F.max("radius").alias("radius")), [*GROUP, "number"])

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):  # a group without pivots stays as it is
            return left.assign(path=left.path + KEPT)[[*GROUP, "id", "mask", "far", "vector"]]
        right = right.sort_values("number")
        pivots, radius = np.stack(right["pivot"].to_numpy()), right["radius"].to_numpy()
        done = []
        for k in range(0, len(left), TILE_ROWS):
            some = left.iloc[k : k + TILE_ROWS]
            s = np.clip(np.stack(some.vector.to_numpy()) @ pivots.T, -1.0, 1.0)
            home, there = _cells_of(s, pivots, radius, width)
            far = np.arccos(s)
            i, j = np.nonzero(there)
            out = some.iloc[i][[*GROUP, "id", "mask", "vector"]]
            done.append(out.assign(path=out.path + np.char.add(".", j.astype(str)), mask=out["mask"].to_numpy() | np.where(j == home[i], 0, 1 << level), far=far[i, j])[[*GROUP, "id", "mask", "far", "vector"]])
        return pd.concat(done)

    return rows.groupBy(*keys).cogroup(dealt(pivots)).applyInPandas(place, f"{head}, id {kinds['id']}, mask int, far double, vector array<double>")


def cells(v: DataFrame, width: float, folder: str) -> DataFrame:
    """The rows in groups that are small, or were cut ROUNDS times."""
    done, level = [], 0
    v = written(v, folder, "rows")
    while level < ROUNDS:
        sizes = v.groupBy(*GROUP).agg(F.count("*").alias("n"))
        large = written(sizes.filter((F.col("n") > TILE_ROWS) & ~F.col("path").endswith(KEPT)), folder, f"large{level}")
        if large.isEmpty():
            break
        done.append(v.join(large, GROUP, "left_anti"))
        v = written(cut(v, large, width, level, folder), folder, f"cells{level}")
        level += 1
    for d in done:
        v = v.unionByName(d)
    return v


def tiled(v: DataFrame, width: float, folder: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their tile, and pairs of tiles that may hold near rows: GROUP, lo, hi, n_lo, n_hi."""
    sizes = v.groupBy(*GROUP).agg(F.count("*").alias("n"))
    many = F.ceil(F.col("n") / TILE_ROWS).cast("int")
    # rings of about equal numbers of rows: the bounds are only estimates
    cuts = v.join(sizes.filter(F.col("n") > TILE_ROWS), GROUP).groupBy(*GROUP, many.alias("many")).agg(F.percentile_approx("far", [k / 100 for k in range(1, 100)]).alias("cuts"))
    v = v.join(cuts, GROUP, "left")
    ring = F.when(F.col("many") > 1, F.size(F.filter("cuts", lambda c: c <= F.col("far")))).otherwise(0)
    step = F.greatest(F.lit(1), F.ceil(F.lit(100) / F.coalesce("many", F.lit(1))))  # of 100 rings, as many together as fill a tile
    v = v.withColumn("ring", F.floor(ring / step).cast("int")).drop("cuts", "many")
    rings = written(v.groupBy(*GROUP, "ring").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far")), folder, "rings")
    parts = rings.select(*GROUP, "ring", F.ceil(F.col("n") / TILE_ROWS).cast("int").alias("parts"), "near", F.col("far").alias("end"))
    tile = lambda part: F.concat_ws("-", F.format_string("%03d", F.col("ring")), F.format_string("%06d", part))
    v = v.join(parts.select(*GROUP, "ring", "parts"), [*GROUP, "ring"]).withColumn("tile", tile(F.pmod(F.xxhash64("id", F.lit("tile")), F.col("parts")).cast("int")))
    v = written(v.select(*GROUP, "tile", "id", "mask", "vector"), folder, "tiles")
    counts = v.groupBy(*GROUP, "tile").agg(F.count("*").alias("n")).withColumn("ring", F.substring("tile", 1, 3).cast("int"))
    t = counts.join(parts.select(*GROUP, "ring", "near", "end"), [*GROUP, "ring"])
    a = t.select(*GROUP, F.col("tile").alias("lo"), F.col("n").alias("n_lo"), F.col("near").alias("near_lo"), F.col("end").alias("end_lo"))
    b = t.select(*GROUP, F.col("tile").alias("hi"), F.col("n").alias("n_hi"), F.col("near").alias("near_hi"), F.col("end").alias("end_hi"))
    met = a.join(b, GROUP).filter((F.col("lo") <= F.col("hi")) & (F.col("near_hi") - F.col("end_lo") <= width + SLACK) & (F.col("near_lo") - F.col("end_hi") <= width + SLACK))
    return v, met.select(*GROUP, "lo", "hi", "n_lo", "n_hi")


def compared(met: DataFrame) -> DataFrame:
    """One row: the number of pairs of rows that meet, of the pairs of tiles that `tiled` gives."""
    n = F.when(F.col("lo") == F.col("hi"), F.col("n_lo") * (F.col("n_lo") - 1) / 2).otherwise(F.col("n_lo") * F.col("n_hi"))
    return met.agg(F.coalesce(F.sum(n), F.lit(0.0)).cast("double").alias("compared"))


def near_products(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i of x and j of y, rows of unit length, with a product of at least the threshold, and the products."""
    dims = x.shape[1]
    head = dims // 4 if dims >= 16 else 0
    if head:
        order = np.argsort(-(x.var(0) + y.var(0)), kind="stable")
        x1, y1 = x[:, order[:head]], y[:, order[:head]]
        x2, y2 = (np.linalg.norm(z[:, order[head:]], axis=1) for z in (x, y))
    found = []
    for i in range(0, len(x), STEP):
        for j in range(0, len(y), STEP):
            left, right = np.arange(i, min(i + STEP, len(x))), np.arange(j, min(j + STEP, len(y)))
            if head:
                may = x1[left] @ y1[right].T + x2[left][:, None] * y2[right][None, :] >= threshold - 1e-9
                left, right = left[may.any(1)], right[may.any(0)]
                if not len(left):
                    continue
            s = x[left] @ y[right].T
            p, q = np.nonzero(s >= threshold)
            found.append((left[p], right[q], s[p, q]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def near_pairs(v: DataFrame, threshold: float) -> DataFrame:
    """v as of unit_rows: block, a, b (a < b), similarity."""
    folder, width = shared_folder(v.sparkSession), math.acos(max(-1.0, min(1.0, threshold)))
    kinds = {c: v.schema[c].dataType.simpleString() for c in ("block", "id")}
    rows, met = tiled(cells(v, width, folder), width, folder)
    groups = max(1, rows.count() // TILE_ROWS)
    group = Window.partitionBy(*GROUP)
    met = met.withColumn("alone", F.max("hi").over(group) == F.min("lo").over(group))
    # groups of one tile share tasks of about TILE_ROWS rows
    met = met.withColumn("shared", F.when(F.col("alone"), F.pmod(F.xxhash64(*GROUP), F.lit(groups))).otherwise(F.xxhash64(*GROUP, "lo", "hi")))
    left = rows.join(met.select(*GROUP, F.col("lo").alias("tile"), "lo", "hi", "shared"), [*GROUP, "tile"])
    right = rows.join(met.filter("lo <> hi").select(*GROUP, F.col("hi").alias("tile"), "lo", "hi", "shared"), [*GROUP, "tile"])
    both = left.unionByName(right)

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, tile, mask = np.stack(pdf.vector.to_numpy()), pdf.id.to_numpy(), pdf.tile.to_numpy(), pdf["mask"].to_numpy()
        number = pdf.groupby([*GROUP, "lo", "hi"], sort=False).ngroup().to_numpy()
        order = np.argsort(number, kind="stable")
        found = [pd.DataFrame({"block": pdf.block.iloc[:0], "a": ids[:0], "b": ids[:0], "similarity": np.zeros(0)})]
        for some in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            lo, hi = pdf.lo.iloc[some[0]], pdf.hi.iloc[some[0]]
            one, two = some[tile[some] == lo], some[tile[some] == hi]
            i, j, s = near_products(x[one], x[two], threshold)
            i, j = one[i], two[j]
            ok = (mask[i] & mask[j]) == 0
            if lo == hi:
                ok &= ids[i] < ids[j]  # a tile with itself has each pair twice
            else:
                ok &= ids[i] != ids[j]
            i, j, s = i[ok], j[ok], s[ok]
            up = ids[i] < ids[j]
            found.append(pd.DataFrame({"block": pdf.block.iloc[some[0]], "a": np.where(up, ids[i], ids[j]), "b": np.where(up, ids[j], ids[i]), "similarity": s}))
        return pd.concat(found)

    return both.groupBy("shared", "dims").applyInPandas(close, f"block {kinds['block']}, a {kinds['id']}, b {kinds['id']}, similarity double")

