"""Checks and measures of clusterings in long form (cid, ref_tid, ref_l, ref_r, tid, l, r)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covered_points(clusters: DataFrame) -> DataFrame:
    return clusters.select("cid", "tid", F.explode(F.sequence("l", "r")).alias("pos"))


def overlaps(clusters: DataFrame) -> DataFrame:
    """(tid, pos, n): points in more than one member."""
    return covered_points(clusters).groupBy("tid", "pos").agg(F.count("*").alias("n")).where("n > 1")


def cluster_vertices(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cid").agg(F.sum(F.col("r") - F.col("l") + 1).alias("vertices"), F.count("*").alias("members"))


def uncovered(points: DataFrame, clusters: DataFrame, ignore_points: bool = False) -> DataFrame:
    """(uncovered): share of points in no member."""
    held = covered_points(clusters.where("r > l") if ignore_points else clusters).select("tid", "pos").distinct()
    left = points.join(held, ["tid", "pos"], "left_anti").agg(F.count("*").alias("free"))
    return left.select((F.col("free") / F.lit(max(1, points.count()))).alias("uncovered"))


def first_uncovered(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """(tid, pos): the first free point of each trajectory that has one."""
    held = covered_points(clusters).select("tid", "pos").distinct()
    return points.join(held, ["tid", "pos"], "left_anti").groupBy("tid").agg(F.min("pos").alias("pos"))
