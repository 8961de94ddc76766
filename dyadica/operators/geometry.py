"""Radius joins of points through a grid of cells, neighbours and the distance ladder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadica.functions.numeric import squared_distance


def cell(c: str, side: float):
    return F.floor(F.col(c) / F.lit(float(side))).cast("long")


#: Rows that a join may broadcast. Spark's own estimate of rows that were exploded is the size of the file they come from.
MOST_BROADCAST = 200_000


def bounded(df: DataFrame) -> DataFrame:
    """The rows, kept and broadcast where they are few, else merged in joins."""
    df = df.persist()
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df.hint("merge")


def radius_join(left: DataFrame, right: DataFrame, radius: float, side: float | None = None) -> DataFrame:
    """Pairs (tid, pos, x, y, tid2, pos2, x2, y2) at squared distance radius² at most.

    Points meet in cells: the left ones stand in their own, the right ones in each
    cell within reach (nine for cells as wide as the radius). The equi-join may be
    split where a cell is crowded, and broadcasts neither side; the exact test is in the join.
    """
    side = side or radius
    reach = -(-radius // side)
    near = lambda c: F.sequence(cell(c, side) - int(reach), cell(c, side) + int(reach))
    a = left.select("tid", "pos", "x", "y", cell("x", side).alias("cx"), cell("y", side).alias("cy"))
    b = right.select(F.col("tid").alias("tid2"), F.col("pos").alias("pos2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    b = b.withColumn("cx", F.explode(near("x2"))).withColumn("cy", F.explode(near("y2")))
    return a.join(b.hint("merge"), ["cx", "cy"]).where(squared_distance("x", "y", "x2", "y2") <= radius * radius).drop("cx", "cy")


def cell_counts(points: DataFrame, side: float) -> DataFrame:
    """(cx, cy, n): points a cell."""
    return points.groupBy(cell("x", side).alias("cx"), cell("y", side).alias("cy")).agg(F.count("*").alias("n"))


def touched_cells(points: DataFrame, radius: float, side: float) -> DataFrame:
    """(tid, pos, cx, cy, whole): cells with a corner in the ball around each point; whole if all corners are (with a tolerance of 1e-5). Cells that the ball only pokes through an edge are left out."""
    reach = int(-(-radius // side))
    span = lambda c: F.sequence(cell(c, side) - reach, cell(c, side) + reach)
    p = points.withColumn("cx", F.explode(span("x"))).withColumn("cy", F.explode(span("y")))
    inside = [F.pow((F.col("cx") + i) * side - F.col("x"), 2) + F.pow((F.col("cy") + j) * side - F.col("y"), 2) <= radius * radius * 1.00001 for i in (0, 1) for j in (0, 1)]
    corners = sum((c.cast("int") for c in inside), F.lit(0))
    return p.withColumn("corners", corners).where("corners > 0").select("tid", "pos", "x", "y", "cx", "cy", (F.col("corners") == 4).alias("whole"))


def nearest_and_farthest(points: DataFrame) -> DataFrame:
    """(tid, pos, nearest, farthest): squared distances to the nearest other point and the farthest point.

    The farthest point is a vertex of the convex hull. Nearest: rings of cells grow from a width of about one point a cell, point by
    point only for those that have not yet found one closer than the ring.
    """
    box = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    if not box[4]:
        return points.select("tid", "pos", F.lit(None).cast("double").alias("nearest"), F.lit(None).cast("double").alias("farthest"))
    width = max(box[1] - box[0], box[3] - box[2], 1e-9)
    side = width / max(1.0, box[4] ** 0.5)
    left, found = points, None
    while True:
        pairs = radius_join(left, points, side).where("tid != tid2 OR pos != pos2")
        hit = pairs.groupBy("tid", "pos").agg(F.min(squared_distance("x", "y", "x2", "y2")).alias("nearest")).persist()
        found = hit if found is None else found.union(hit)
        if side > 2 * width:
            break
        rest = left.join(hit.select("tid", "pos").hint("merge"), ["tid", "pos"], "left_anti")
        if rest.isEmpty():
            break
        left, side = rest, side * 4
    hull = hull_vertices(points)
    far = F.lit(0.0)
    for a in range(0, len(hull), 256):  # blocks bound the literal's size
        block = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in hull[a : a + 256]])
        far = F.greatest(far, F.aggregate(block, F.lit(0.0), lambda m, h: F.greatest(m, (F.col("x") - h.x) * (F.col("x") - h.x) + (F.col("y") - h.y) * (F.col("y") - h.y))))
    reach = points.select("tid", "pos", far.alias("farthest"))
    return reach.join(found.hint("merge"), ["tid", "pos"], "left").select("tid", "pos", "nearest", "farthest")


def hull_vertices(points: DataFrame) -> list[tuple[float, float]]:
    """Vertices of the convex hull: the hull of the hulls of all partitions."""

    def kernel(frames):
        held = []
        for f in frames:
            held = _hull(held + list(zip(f["x"].tolist(), f["y"].tolist(), strict=True)))
        yield pd.DataFrame(held, columns=["x", "y"])

    local = points.select("x", "y").mapInPandas(kernel, "x double, y double")
    return _hull([tuple(r) for r in local.toLocalIterator()])


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def distance_ladder(points: DataFrame) -> list[float]:
    """Squared distances from the least positive nearest one, times four while below the farthest."""
    r = nearest_and_farthest(points).agg(F.min(F.when(F.col("nearest") > 0, F.col("nearest"))), F.max("farthest")).first()
    out, d = [], r[0]
    while d is not None and d < r[1]:
        out.append(d)
        d *= 4
    return out
