"""How large a sample estimates pathlet frequencies: Chernoff and VC bounds, and the draw.

Every bound but Chernoff's counts pathlets near each trajectory (c), turns c into
floor(log2 c) + 1 and takes the h-index over trajectories. The modes differ in the
count: pathlets that survive (VC), near pairs of points and pathlet ends (rough), cells
touched instead of exact distances (no-erase), or sums of cells' totals (turbo).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadica.functions.numeric import binomial
from dyadica.operators import counting, pathlets
from dyadica.operators.geometry import bounded, cell, radius_join, touched_cells
from dyadica.sources.tables import pack


def ends(points: DataFrame, min_length: int, which: str) -> DataFrame:
    """(tid, pos, x, y) with node: the first ("l") or last ("r") point of each canonical pathlet of min_length or more; tid is the mother."""
    nodes = pathlets.canonical(pack(points)).where(F.col("len") >= min_length)
    return nodes.select(F.col("mother").alias("tid"), F.col(which).cast("int").alias("pos"), "node").join(points.hint("merge"), ["tid", "pos"])


def near(points: DataFrame, marks: DataFrame, radius: float, side: float | None = None, exact: bool = True) -> DataFrame:
    """(tid, pos, mother, node) for each point and mark near it: within the radius, or (not exact) in a cell that the ball touches."""
    if exact:
        pairs = radius_join(points, marks.select("tid", "pos", "x", "y").distinct(), radius, max(side or radius, radius / 8))
        return pairs.select("tid", "pos", "tid2", "pos2").join(marks.select(F.col("tid").alias("tid2"), F.col("pos").alias("pos2"), "node").hint("merge"), ["tid2", "pos2"]).select("tid", "pos", F.col("tid2").alias("mother"), "node")
    cells = touched_cells(points, radius, side or 0.2 * radius).select("tid", "pos", "cx", "cy")
    held = marks.select(F.col("tid").alias("mother"), "node", cell("x", side or 0.2 * radius).alias("cx"), cell("y", side or 0.2 * radius).alias("cy"))
    return cells.join(held.hint("merge"), ["cx", "cy"]).select("tid", "pos", "mother", "node")


def surviving(data: DataFrame, source: DataFrame, radius: float, min_length: int = 1, side: float | None = None, exact: bool = True) -> DataFrame:
    """(tid, mother, node): pathlets of which every minimal sub-pathlet has its begin and its end near the trajectory."""
    begin, end = (near(data, ends(source, min_length, w), radius, side, exact).select("tid", "mother", "node").distinct() for w in "lr")
    nodes = pathlets.canonical(pack(source)).where(F.col("len") >= min_length)
    small = pathlets.minimal(nodes, min_length).select("mother", "node")
    up = pathlets.ancestors(small).select("mother", "node", "ancestor").union(small.select("mother", "node", F.col("node").alias("ancestor")))
    held = up.groupBy("mother", "ancestor").agg(F.count("*").alias("held"))
    good = begin.join(end, ["tid", "mother", "node"]).join(up, ["mother", "node"]).groupBy("tid", "mother", "ancestor").agg(F.count("*").alias("good"))
    return good.join(held, ["mother", "ancestor"]).where("good = held").select("tid", "mother", F.col("ancestor").alias("node"))


def vc_counts(data: DataFrame, source: DataFrame, radius: float, min_length: int = 1, **how) -> DataFrame:
    """(tid, c): surviving pathlets a trajectory."""
    side = None if how.get("exact", True) else how.get("side") or 0.2 * radius
    return counting.survivors(data, source, radius, min_length, side)


def rough_counts(data: DataFrame, source: DataFrame, radius: float, min_length: int = 1, least: bool = False, **how) -> DataFrame:
    """(tid, c): near pairs of a point and a pathlet's begin; least: or end, if those are fewer (from min_length 3 on)."""
    if how.get("exact", True):
        count = lambda w: counting.near_marks(data, ends(source, min_length, w), radius).withColumnRenamed("c", w)
    else:
        count = lambda w: _by_cells(data, ends(source, min_length, w), radius, how.get("side") or 0.2 * radius).withColumnRenamed("c", w)
    out = count("l")
    if least and min_length >= 3:
        return out.join(count("r"), "tid").select("tid", F.least("l", "r").alias("c"))
    return out.withColumnRenamed("l", "c")


def by_near_pathlets(data: DataFrame, source: DataFrame, radius: float, min_length: int = 1, **how) -> DataFrame:
    """(tid, c, place): trajectories by how many pathlets begin near them, most first; one row a trajectory is ranked."""
    return rough_counts(data, source, radius, min_length, **how).withColumn("place", F.rank().over(Window.orderBy(F.desc("c"))))


def turbo_counts(data: DataFrame, source: DataFrame, radius: float, min_length: int = 1, side: float | None = None) -> DataFrame:
    """(tid, c): sums over touched cells of the pathlets that begin there, counted by cell beforehand."""
    return _by_cells(data, ends(source, min_length, "l"), radius, side or 0.2 * radius)


def _by_cells(data: DataFrame, marks: DataFrame, radius: float, side: float) -> DataFrame:
    held = marks.groupBy(cell("x", side).alias("cx"), cell("y", side).alias("cy")).agg(F.count("*").alias("n"))
    return touched_cells(data, radius, side).join(bounded(held), ["cx", "cy"]).groupBy("tid").agg(F.sum("n").alias("c"))


def h_index(counts: DataFrame, c: str = "c") -> DataFrame:
    """(d): the largest d such that d rows have floor(log2 c) + 1 >= d. Rows are counted by that value first, of which there are few."""
    value = F.when(F.col(c) > 0, F.floor(F.log2(c)) + 1).otherwise(0)
    by_value = counts.groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    above = by_value.withColumn("n", F.sum("n").over(Window.orderBy(F.desc("v"))))
    return above.agg(F.coalesce(F.max(F.least("v", "n")), F.lit(0)).cast("long").alias("d"))


def chernoff_size(n_pathlets: int, eps: float, delta: float) -> int:
    return int(int(12 / eps**2) * math.log(2 * n_pathlets / delta)) if n_pathlets else 0


def vc_size(d: int, eps: float, delta: float) -> int:
    return int(int(2 / eps**2) * (d + math.log(2 / delta)))


def capacity(sizes: dict[int, int], k: int) -> bool:
    """Whether as many ranges of each size exist as a shattered set of k needs: subsets of size s or more for each s."""
    have = need = 0
    for s in range(k, 0, -1):
        have = sum(n for c, n in sizes.items() if c >= s)
        need += binomial(k, s)
        if have < need:
            return False
    return True


def pathlet_vc(data: DataFrame, source: DataFrame, radius: float, min_length: int = 1) -> int:
    """Bound from the pathlets' side: each covers at most one more than the trajectories near both its ends; the largest k that their sizes have capacity for."""
    covered = counting.near_both_ends(data, source, radius, min_length)
    sizes = {r["c"] + 1: r["n"] for r in covered.groupBy("c").agg(F.count("*").alias("n")).collect()}
    k = 0
    while capacity(sizes, k + 1):
        k += 1
    return k


def pathlet_aware_vc(data: DataFrame, source: DataFrame, radius: float, min_length: int = 1, **how) -> int:
    """The VC bound, lowered while the pathlets' sizes have no capacity for it."""
    d = h_index(vc_counts(data, source, radius, min_length, **how)).first()["d"]
    return min(d, pathlet_vc(data, source, radius, min_length))


def draw(trajectories: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``size`` trajectories in the order of a seeded hash; any id may be drawn. Fewer rows than that are an error."""
    held = trajectories.count()
    if size > held:
        raise ValueError(f"a sample of {size} from {held} trajectories")
    return trajectories.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "tid")), "tid").limit(size)


#: The numbered modes and what each counts; 5, 9, 11 and 13 are other names.
MODES = {0: "fixed", 1: "chernoff", 2: "vc", 3: "rough", 4: "rough_cells", 5: "vc", 6: "rough_least", 7: "rough_least_cells", 8: "vc_cells", 9: "vc_cells", 10: "pathlet_vc", 11: "pathlet_vc", 12: "aware", 13: "aware", 14: "turbo"}


def sample_size(mode: int, data: DataFrame, source: DataFrame, radius: float, *, eps: float = 0.1, delta: float = 0.05, cardinality: int = 1, min_length: int = 1, grid: float = 0.2) -> int:
    """The sample size of a numbered mode; grid is the cells' side by the radius."""
    name, side = MODES[mode], grid * radius
    if name == "fixed":
        return cardinality
    if name == "chernoff":
        return chernoff_size(pathlets.count_bound(pack(source), min_length).first()[0], eps, delta)
    how = {"exact": not name.endswith("_cells"), "side": side if name.endswith("_cells") else None}
    if name.startswith("vc"):
        d = h_index(vc_counts(data, source, radius, min_length, **how)).first()["d"]
    elif name.startswith("rough"):
        d = h_index(rough_counts(data, source, radius, min_length, "least" in name, **how)).first()["d"]
    elif name == "turbo":
        d = h_index(turbo_counts(data, source, radius, min_length, side)).first()["d"]
    else:
        d = (pathlet_vc if name == "pathlet_vc" else pathlet_aware_vc)(data, source, radius, min_length)
    return vc_size(d, eps, delta)


def duplicate_statistics(sampled: DataFrame) -> DataFrame:
    """(tid, mean, variance, top) of repetitions (tid, repetitions): the five highest, where there are five."""
    rows = sampled.groupBy("tid").agg(F.avg("repetitions").alias("mean"), F.var_samp("repetitions").alias("variance"), F.slice(F.sort_array(F.collect_list("repetitions"), False), 1, 5).alias("top"))
    return rows.where(F.size("top") == 5)
