"""Free-space reachability: which intervals of a mother curve match which trajectories.

For a mother m and a trajectory t, cells (j, i) with squared distance at most r² are
free. L(j, i) = min(j, L(j-1, i), L(j-1, i-1), L(j, i-1)) over free cells; [l, r] of m
matches t if and only if min over i of L(r, i) is at most l. The kernel sweeps columns
j over all trajectories of a block at once. The block's points are sorted by grid cell
once; a column tests only those in the nine cells around its point, and the term inside
a column is a running minimum along runs of free cells.

The sample is broadcast in blocks whose points are counted beforehand. Beyond
``most_points`` altogether, up to ``most_held`` of mothers and sample each, both are
broadcast once (16 bytes a point), and a task sweeps its mothers over one block after the
other, so that rows go out as they are found and nothing is shuffled. Beyond, mothers and
trajectories meet in an equi-join of cells instead and the kernel runs pair by pair, so
nothing that grows is broadcast.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadica.operators import growth
from dyadica.operators.geometry import cell
from dyadica.sources.tables import pack, unpack

BLOCK_POINTS, MOST_POINTS = 500_000, 4_000_000
#: Mothers that a task sweeps over all blocks; labels that it holds at once (and those of a column more).
MOTHERS_EACH, MOST_LABELS = 100, 500_000
_FAR = np.int64(1) << 40


class Block:
    """Trajectories end to end: ids, points and where each begins."""

    def __init__(self, tids, xs, ys):
        sizes = np.array([len(x) for x in xs], np.int64)
        self.tids = np.array(tids, np.int64)
        self.x = np.concatenate([np.asarray(x, float) for x in xs]) if len(xs) else np.zeros(0)
        self.y = np.concatenate([np.asarray(y, float) for y in ys]) if len(ys) else np.zeros(0)
        self.begin = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.starts = np.zeros(len(self.x), bool)
        self.starts[self.begin[sizes > 0]] = True
        self._grid: tuple | None = None

    def candidates(self, mx: np.ndarray, my: np.ndarray, r2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(points by cell, first, last): for each query point three runs of the points by cell, which hold all within the radius."""
        side = float(np.sqrt(r2)) * (1 + 1e-9) or 1e-9
        if self._grid is None or self._grid[0] != side:
            cx, cy = np.floor(self.x / side), np.floor(self.y / side)
            low, height = (cy.min(), cy.max() - cy.min() + 4) if len(cy) else (0.0, 4.0)
            key = cx * height + (cy - low + 1)
            order = np.argsort(key, kind="stable")
            self._grid = side, low, height, order, key[order]
        _, low, height, order, keys = self._grid
        column = (np.floor(mx / side)[:, None] + np.arange(-1, 2)) * height
        at = np.clip(np.floor(my / side) - low + 1, -1, height)[:, None]
        return order, np.searchsorted(keys, column + np.maximum(at - 1, 0), "left"), np.searchsorted(keys, column + np.minimum(at + 1, height - 1), "right")


def sweep(mx: np.ndarray, my: np.ndarray, block: Block, r2: float, first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, free rows, labels) for each column of the mother that has free cells; columns before ``first`` are left out."""
    before_rows, before = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = np.full(len(block.x) + 1, _FAR)
    order, lo, hi = block.candidates(mx, my, r2)
    for j in range(first, len(mx) if last is None else last + 1):
        rows = np.concatenate([order[a:b] for a, b in zip(lo[j].tolist(), hi[j].tolist(), strict=True)])
        rows = np.sort(rows[(block.x[rows] - mx[j]) ** 2 + (block.y[rows] - my[j]) ** 2 <= r2])
        held[before_rows + 1] = before
        label = np.minimum(j, held[rows + 1])
        label = np.minimum(label, np.where(block.starts[rows], _FAR, held[rows]))
        held[before_rows + 1] = _FAR
        if len(rows):
            run = np.cumsum((np.diff(rows, prepend=-2) != 1) | block.starts[rows])
            label = np.minimum.accumulate(label - run * _FAR) + run * _FAR
            yield j, rows, label
        before_rows, before = rows, label


def least_labels(mx: np.ndarray, my: np.ndarray, block: Block, r2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(j, trajectory id, least label) of every column and trajectory with a free cell."""
    for found in label_parts(mx, my, block, r2, None):
        return found
    return (np.zeros(0, np.int64),) * 3


def label_parts(mx: np.ndarray, my: np.ndarray, block: Block, r2: float, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same in parts of whole columns, each of ``most`` rows and those of a column more; None: in one."""
    js, ts, ls, held = [], [], [], 0
    for j, rows, label in sweep(mx, my, block, r2):
        owner = block.owner[rows]
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        ts.append(block.tids[owner[begin]])
        ls.append(np.minimum.reduceat(label, begin))
        js.append(np.full(len(begin), j))
        held += len(begin)
        if most is not None and held > most:
            yield np.concatenate(js), np.concatenate(ts), np.concatenate(ls)
            js, ts, ls, held = [], [], [], 0
    if js:
        yield np.concatenate(js), np.concatenate(ts), np.concatenate(ls)


_LABELS, _COUNTS = "m long, j long, t long, minl long", "m long, j long, minl long, k long"


def _batch(m: int, j: np.ndarray, t: np.ndarray, minl: np.ndarray, counts: bool) -> pa.RecordBatch:
    """A mother's labels, or how often each is found."""
    if counts:
        pair, k = np.unique(j * (1 << 31) + minl, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), m, np.int64)), pa.array(pair >> 31), pa.array(pair & ((1 << 31) - 1)), pa.array(k)], names=["m", "j", "minl", "k"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(j), m, np.int64)), pa.array(j), pa.array(t), pa.array(minl)], names=["m", "j", "t", "minl"])


def label_counts(mothers: DataFrame, sample: DataFrame, radius: float, narrow: bool = False) -> DataFrame:
    """(m, j, minl, k): how many trajectories have each least label, counted in the kernel, so that what is shuffled does not grow with the sample."""
    found = labels(mothers, sample, radius, narrow, counts=True)
    return found.groupBy("m", "j", "minl").agg(F.sum("k").alias("k"))


def labels(mothers: DataFrame, sample: DataFrame, radius: float, narrow: bool = False, most_points: int = MOST_POINTS, counts: bool = False, most_held: int = growth.MOST_HELD) -> DataFrame:
    """(m, j, t, minl) of packed mothers and sample (tid, n, xs, ys). narrow: the squared radius is rounded to single precision. counts: (m, j, minl, k) within blocks instead."""
    r2 = float(np.float32(radius * radius)) if narrow else radius * radius
    points = sample.agg(F.sum("n")).first()[0] or 0
    if points > most_points:
        if max(points, points if mothers is sample else mothers.agg(F.sum("n")).first()[0] or 0) <= most_held:
            return _streamed(mothers, sample, r2, counts)
        found = _joined(mothers, sample, radius, r2)
        return found.groupBy("m", "j", "minl").agg(F.count("*").alias("k")) if counts else found
    out, held, size = None, [], 0
    for row in sample.orderBy("tid").toLocalIterator():
        if size and size + row["n"] > BLOCK_POINTS:
            out = _swept(mothers, held, r2, out, counts)
            held, size = [], 0
        held.append(row)
        size += row["n"]
    return _swept(mothers, held, r2, out, counts)


def _swept(mothers: DataFrame, rows: list, r2: float, out: DataFrame | None, counts: bool) -> DataFrame:
    block = mothers.sparkSession.sparkContext.broadcast(Block([r["tid"] for r in rows], [r["xs"] for r in rows], [r["ys"] for r in rows]))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, xs, ys in zip(*(batch.column(k) for k in range(3)), strict=True):
                yield _batch(m.as_py(), *least_labels(np.array(xs.values), np.array(ys.values), block.value, r2), counts)

    # few heavy rows: spread them over all cores before the kernel
    wide = mothers.select("tid", "xs", "ys").repartition(mothers.sparkSession.sparkContext.defaultParallelism * 3, "tid")
    new = wide.mapInArrow(kernel, _COUNTS if counts else _LABELS)
    return new if out is None else out.union(new)


def _streamed(mothers: DataFrame, sample: DataFrame, r2: float, counts: bool) -> DataFrame:
    within = growth.held(sample)
    whose = within if mothers is sample else growth.held(mothers)
    spark = sample.sparkSession
    data = spark.sparkContext.broadcast((whose, None if whose is within else within))
    tasks = min(len(whose.sizes), max(spark.sparkContext.defaultParallelism * 3, -(-len(whose.sizes) // MOTHERS_EACH)))
    size = BLOCK_POINTS

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, within = data.value
        within = whose if within is None else within
        for task in [t for b in batches for t in b.column(0).to_pylist()]:
            for block in _blocks(within, size):
                for m in range(task, len(whose.sizes), tasks):
                    own = slice(whose.begin[m], whose.begin[m] + whose.sizes[m])
                    for found in label_parts(whose.x[own], whose.y[own], block, r2, MOST_LABELS):
                        yield _batch(int(whose.tids[m]), *found, counts)

    return spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(kernel, _COUNTS if counts else _LABELS)


def _blocks(within: growth.Curves, size: int) -> Iterator[Block]:
    """Trajectories in order, in blocks of ``size`` points or of one longer trajectory."""
    first, held = 0, 0
    for t, n in enumerate([*within.sizes.tolist(), size + 1]):
        if held and held + n > size:
            cut = [slice(a, a + k) for a, k in zip(within.begin[first:t].tolist(), within.sizes[first:t].tolist(), strict=True)]
            yield Block(within.tids[first:t], [within.x[c] for c in cut], [within.y[c] for c in cut])
            first, held = t, 0
        held += n


def near_pairs(mothers: DataFrame, sample: DataFrame, radius: float) -> DataFrame:
    """(m, t): pairs with points in the same or neighbouring cells."""
    at = lambda df, name: unpack(df).select(F.col("tid").alias(name), cell("x", radius).alias("cx"), cell("y", radius).alias("cy")).distinct()
    around = at(mothers, "m").withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1))).withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1))).distinct()
    return around.join(at(sample, "t"), ["cx", "cy"]).select("m", "t").distinct()


def _joined(mothers: DataFrame, sample: DataFrame, radius: float, r2: float) -> DataFrame:
    pairs = near_pairs(mothers, sample, radius)
    whole = pairs.join(mothers.select(F.col("tid").alias("m"), F.col("xs").alias("mx"), F.col("ys").alias("my")), "m").join(sample.select(F.col("tid").alias("t"), "xs", "ys"), "t")

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                j, t, minl = least_labels(r.mx, r.my, Block([r.t], [r.xs], [r.ys]), r2)
                yield pd.DataFrame({"m": r.m, "j": j, "t": t, "minl": minl})

    return whole.select("m", "t", "mx", "my", "xs", "ys").mapInPandas(kernel, _LABELS)


def matches(mx: np.ndarray, my: np.ndarray, l: int, r: int, block: Block, r2: float, shortest: bool = False) -> list[tuple[int, int, int]]:  # noqa: E741
    """Disjoint matches (trajectory index, first row, last row, within the trajectory) of the interval [l, r]: in each trajectory from the last row that ends one upwards, each as long (or as short) as can be without touching the one before. ``block`` holds live points only where ``starts`` also cut at covered points."""
    return trace(start_rows(mx, my, block, r2, l, r, shortest), block)


def start_rows(mx: np.ndarray, my: np.ndarray, block: Block, r2: float, l: int, r: int, shortest: bool) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """(rows, first rows) in column r: the row in column l where the best path to each begins (least, or greatest if shortest)."""
    out = (np.zeros(0, np.int64),) * 2
    for j, rows, first in start_sweep(mx, my, block, r2, l, r, shortest):
        if j == r:
            out = rows, first
    return out


def start_sweep(mx, my, block: Block, r2: float, l: int, r: int, shortest: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:  # noqa: E741
    """(column, rows reached, first rows) from column l on. Where few rows are reached, only what they lead to is tested."""
    sign = -1 if shortest else 1
    held, rows = np.full(len(block.x) + 1, _FAR), np.zeros(0, np.int64)
    for j in range(l, r + 1):
        if j == l or len(rows) * 8 > len(block.x):
            free = np.flatnonzero((block.x - mx[j]) ** 2 + (block.y - my[j]) ** 2 <= r2)
        else:
            free = _led_to(rows, block, mx[j], my[j], r2)
        if not len(free):
            return
        if j == l:
            value = sign * free
        else:
            value = np.minimum(held[free + 1], np.where(block.starts[free], _FAR, held[free]))
        run = np.cumsum((np.diff(free, prepend=-2) != 1) | block.starts[free])
        value = np.minimum.accumulate(np.minimum(value, _FAR - 1) - run * 4 * _FAR) + run * 4 * _FAR
        on = value < _FAR - 1
        held[rows + 1] = _FAR
        rows, best = free[on], value[on]
        if not len(rows):
            return
        held[rows + 1] = best
        yield j, rows, sign * best


def _led_to(rows: np.ndarray, block: Block, x: float, y: float, r2: float) -> np.ndarray:
    """Free rows among ``rows`` and the next ones, and the runs of free rows that go on from them."""

    def free(at: np.ndarray) -> np.ndarray:
        return at[(block.x[at] - x) ** 2 + (block.y[at] - y) ** 2 <= r2]

    def after(at: np.ndarray) -> np.ndarray:
        at = at + 1
        at = at[at < len(block.x)]
        return at[~block.starts[at]]

    first = free(np.union1d(rows, after(rows)))
    out, edge = [first], first
    while len(edge):
        edge = free(after(edge))
        edge = edge[first[np.minimum(np.searchsorted(first, edge), len(first) - 1)] != edge]
        out.append(edge)
    return np.sort(np.concatenate(out))


def chosen(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the disjoint matches in reached rows: from the last row that ends one upwards, each the last before the one taken begins."""
    if (rows == first).all():
        return np.arange(len(rows) - 1, -1, -1)
    ends, begins, out, i = rows.tolist(), first.tolist(), [], len(rows) - 1
    while i >= 0:
        out.append(i)
        i = bisect_left(ends, begins[i], 0, i) - 1
    return np.array(out, np.int64)


def trace(reached: tuple[np.ndarray, np.ndarray], block: Block) -> list[tuple[int, int, int]]:
    rows, first = reached
    at = chosen(rows, first)
    owner = block.owner[rows[at]]
    begin = block.begin[owner]
    return list(zip(owner.tolist(), (first[at] - begin).tolist(), (rows[at] - begin).tolist(), strict=True))
