"""Frequent pathlets and subtrajectories: support, thresholds, maximality, nets and reports."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadica.operators import growth, pathlets
from dyadica.operators.counting import near_marks
from dyadica.operators.reach import BLOCK_POINTS, label_counts, labels
from dyadica.sources.shared import written
from dyadica.sources.tables import unpack


def threshold(frequency: float, trajectories: int, narrow: bool = False) -> int:
    """Least support; narrow: the product in single precision."""
    return math.ceil(float(np.float32(frequency) * np.float32(trajectories)) if narrow else frequency * trajectories - 1e-9)


def support(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """nodes (mother, l, r, ...) with cnt: trajectories that match, by counts of least labels (m, j, minl, k)."""
    hit = nodes.join(counts, (F.col("mother") == F.col("m")) & (F.col("r") == F.col("j")) & (F.col("minl") <= F.col("l")))
    return hit.groupBy(*nodes.columns).agg(F.sum("k").alias("cnt"))


def supporters(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with the sorted ids of the trajectories that match."""
    hit = nodes.join(found, (F.col("mother") == F.col("m")) & (F.col("r") == F.col("j")) & (F.col("minl") <= F.col("l")))
    return hit.groupBy(*nodes.columns).agg(F.sort_array(F.collect_list("t")).alias("supporters"))


def _sizes(trajectories: DataFrame) -> tuple[int, int]:
    """How many trajectories and points there are."""
    n, points = trajectories.agg(F.count("*"), F.sum("n")).first()
    return n, points or 0


def _grown(mothers: DataFrame, sample: DataFrame, points: int, radius: float, narrow: bool, canonical: bool, frequency: float | None, ids: bool = False, joined: bool = False) -> DataFrame | None:
    """(mother, node, l, r, len, cnt), or with supporters those of two points or more, grown from the first two points (see growth.py), of all matched ones or of frequent ones, where the sample is more than one block to sweep; None where it is not, or too large to be held."""
    if points <= BLOCK_POINTS or points > growth.MOST_HELD or mothers is not sample and _sizes(mothers)[1] > growth.MOST_HELD:
        return None
    within = growth.held(sample)
    whose = within if mothers is sample else growth.held(mothers)
    if not growth.fits(whose, within, radius):
        return None
    least = 1 if frequency is None else max(1, threshold(frequency, len(within.sizes), narrow))
    r2 = float(np.float32(radius * radius)) if narrow else radius * radius
    if ids:
        return growth.supporters(whose, within, sample.sparkSession, r2, least, joined)
    return growth.support(whose, within, sample.sparkSession, r2, canonical, least)


def pathlet_support(mothers: DataFrame, sample: DataFrame, radius: float, narrow: bool = False) -> DataFrame:
    """(mother, node, l, r, len, cnt) of canonical pathlets that match."""
    found = _grown(mothers, sample, _sizes(sample)[1], radius, narrow, True, None)
    return support(pathlets.canonical(mothers).drop("level"), label_counts(mothers, sample, radius, narrow)) if found is None else found


def frequent(mothers: DataFrame, sample: DataFrame, radius: float, frequency: float, *, min_length: int = 1, maximal: bool = False, single_points: bool = True, keep_ids: bool = False, joined: bool = False, net: DataFrame | None = None, narrow: bool = False) -> DataFrame:
    """(mother, node, l, r, len, cnt, frequency[, supporters]) of canonical pathlets with enough support in the sample.

    net: only mothers of which some pathlet matches a trajectory of this sample. maximal:
    only those without a frequent ancestor; single_points: whether these may have length one.
    joined: supporters are one text, ids with commas between. Those of maximal or single
    points are shuffled; others of large samples are listed where they are found.
    """
    if net is not None:
        mothers = net_filter(mothers, net, radius)
    n, points = _sizes(sample)
    nodes = pathlets.canonical(mothers).where(F.col("len") >= min_length).drop("level")
    if keep_ids and min_length >= 2 and not maximal and (found := _grown(mothers, sample, points, radius, narrow, True, frequency, True, joined)) is not None:
        counted = found.where(F.col("len") >= min_length)
    elif keep_ids:
        counted = supporters(nodes, labels(mothers, sample, radius, narrow)).withColumn("cnt", F.size("supporters").cast("long"))
        if joined:
            counted = counted.withColumn("supporters", F.array_join(F.transform("supporters", lambda t: t.cast("string")), ","))
    elif (found := _grown(mothers, sample, points, radius, narrow, True, frequency)) is not None:
        counted = found.where(F.col("len") >= min_length)
        if maximal:  # read more than once
            counted = written(counted)
    else:
        counted = support(nodes, label_counts(mothers, sample, radius, narrow))
    out = counted.where(F.col("cnt") >= threshold(frequency, n, narrow)).withColumn("frequency", F.col("cnt") / F.lit(max(n, 1)))
    if maximal:
        above = out.select("mother", F.col("node").alias("ancestor"))
        covered = pathlets.ancestors(out).join(above, ["mother", "ancestor"], "left_semi").select("mother", "node").distinct()
        out = out.join(covered, ["mother", "node"], "left_anti")
        if not single_points:
            out = out.where("len > 1")
    return out


def frequent_intervals(mothers: DataFrame, sample: DataFrame, radius: float, frequency: float, *, min_length: int = 1, maximal: bool = False, narrow: bool = False) -> DataFrame:
    """(mother, l, r, len, cnt, frequency) of all frequent intervals.

    Matches are never listed by interval: by mother and right end, support as a function
    of l is the running count of least labels, and only the frequent part is expanded.
    """
    n, points = _sizes(sample)
    found = _grown(mothers, sample, points, radius, narrow, False, frequency)
    if found is not None:
        enough = found.select(F.col("mother").alias("m"), F.col("r").alias("j"), F.col("l").alias("minl"), "cnt", (F.col("l") + 1).alias("next"))
    else:
        counts = label_counts(mothers, sample, radius, narrow)
        by_end = Window.partitionBy("m", "j").orderBy("minl")
        steps = counts.select("m", "j", "minl", F.sum("k").over(by_end).alias("cnt"), F.coalesce(F.lead("minl").over(by_end), F.col("j") + 1).alias("next"))
        enough = steps.where(F.col("cnt") >= threshold(frequency, n, narrow))
    if maximal:  # the longest frequent interval to each right end, unless one to a later end begins no later
        longest = enough.groupBy("m", "j").agg(F.min("minl").alias("l"), F.min_by("cnt", "minl").alias("cnt"))
        later = Window.partitionBy("m").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, -1)
        rows = longest.withColumn("least", F.min("l").over(later)).where("least IS NULL OR least > l")
    else:
        rows = enough.select("m", "j", "cnt", F.explode(F.expr("sequence(minl, next - 1)")).alias("l"))
    rows = rows.select(F.col("m").alias("mother"), "l", F.col("j").alias("r"), (F.col("j") - F.col("l") + 1).alias("len"), "cnt", (F.col("cnt") / F.lit(max(n, 1))).alias("frequency"))
    return rows.where(F.col("len") >= min_length)


def net_filter(mothers: DataFrame, net: DataFrame, radius: float) -> DataFrame:
    """Mothers with a pathlet (so a point) that matches some trajectory of the net."""
    return mothers.join(_near(mothers, net, radius), "tid", "left_semi")


def _near(mothers: DataFrame, net: DataFrame, radius: float) -> DataFrame:
    """(tid): mothers with a point within the radius of one of the net."""
    return near_marks(unpack(mothers), unpack(net), radius).select("tid")


def net_report(mothers: DataFrame, net: DataFrame, radius: float) -> DataFrame:
    """(mother, pathlets, kept): canonical pathlets of each mother, and whether the net keeps it."""
    near = _near(mothers, net, radius).select(F.col("tid").alias("mother"), F.lit(True).alias("kept"))
    sizes = pathlets.canonical(mothers).groupBy("mother").agg(F.count("*").alias("pathlets"))
    return sizes.join(near, "mother", "left").select("mother", "pathlets", F.coalesce("kept", F.lit(False)).alias("kept"))


def first_chunk_filter(mothers: DataFrame, sample: DataFrame, radius: float, size: int, min_length: int = 1) -> DataFrame:
    """Mothers of which a pathlet of min_length or more matches within the first ``size`` trajectories of the sample (a lossy filter)."""
    first = sample.orderBy("tid").limit(size)
    nodes = pathlets.canonical(mothers).where(F.col("len") >= min_length).drop("level")
    near = support(nodes, label_counts(mothers, first, radius)).select(F.col("mother").alias("tid")).distinct()
    return mothers.join(near, "tid", "left_semi")


def distinct_supports(supported: DataFrame) -> DataFrame:
    """(range_id, supporters, size): distinct supports, numbered by size, then ids."""
    sets = supported.select("supporters").distinct().withColumn("size", F.size("supporters"))
    return sets.withColumn("range_id", F.row_number().over(Window.orderBy("size", "supporters")) - 1)
