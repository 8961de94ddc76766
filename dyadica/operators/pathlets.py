"""Candidate intervals of a trajectory: canonical dyadic pathlets and all intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def canonical(trajectories: DataFrame, min_length: int = 1) -> DataFrame:
    """(mother, node, level, l, r, len) of trajectories (tid, n): the root is the whole curve; a node longer than min_length splits after half its points, rounded down. Nodes are numbered as in a heap (children 2k+1, 2k+2).

    A node is the path of bits below the root, so each is built by itself from its number: no recursion and no shuffle.
    """
    step = "named_struct('l', if(b = 0, a.l, a.l + a.len div 2), 'len', if(a.len > {m}, if(b = 0, a.len div 2, a.len - a.len div 2), -1L))"
    bits = "transform(if(level = 0, cast(array() AS array<int>), sequence(1, level)), k -> cast(shiftright(at, level - k) & 1 AS int))"
    fold = f"aggregate({bits}, named_struct('l', 0L, 'len', n), (a, b) -> if(a.len < 0, a, {step.format(m=max(1, min_length))}))"
    levels = trajectories.select(F.col("tid").alias("mother"), F.col("n").cast("long").alias("n")).withColumn("level", F.explode(F.expr("sequence(0, cast(ceil(log2(greatest(n, 1))) AS int))")))
    nodes = levels.withColumn("at", F.explode(F.expr("sequence(0L, shiftleft(1L, level) - 1)"))).withColumn("i", F.expr(fold)).where("i.len > 0")
    return nodes.select("mother", F.expr("shiftleft(1L, level) - 1 + at").alias("node"), F.col("level").cast("long").alias("level"), F.col("i.l").alias("l"), F.expr("i.l + i.len - 1").alias("r"), F.col("i.len").alias("len"))


def all_intervals(trajectories: DataFrame) -> DataFrame:
    """(mother, l, r, len) of every interval."""
    rows = trajectories.select(F.col("tid").alias("mother"), F.explode(F.expr("sequence(0L, n - 1L)")).alias("l"), "n").withColumn("r", F.explode(F.expr("sequence(l, n - 1L)")))
    return rows.select("mother", "l", "r", (F.col("r") - F.col("l") + 1).alias("len"))


def minimal(nodes: DataFrame, min_length: int) -> DataFrame:
    """Nodes of min_length or more that hold no other such node: neither child is long enough."""
    long = nodes.where(F.col("len") >= min_length)
    child = long.where("node > 0").select("mother", F.expr("(node - 1) div 2").alias("node")).distinct()
    return long.join(child, ["mother", "node"], "left_anti")


def leaves(nodes: DataFrame) -> DataFrame:
    """(mother, pos, node): the node of each single point."""
    return nodes.where("len = 1").select("mother", F.col("l").alias("pos"), "node")


def count_bound(trajectories: DataFrame, min_length: int) -> DataFrame:
    """(pathlets): upper bound on the number of pathlets, 2 * floor(n / min_length) a trajectory."""
    return trajectories.agg(F.coalesce(F.sum(F.expr(f"2 * (n div {min_length})")), F.lit(0)).alias("pathlets"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """(mother, node, ancestor): all ancestors of each node, by its number."""
    chain = "filter(transform(sequence(1, 62), k -> shiftright(node + 1, k) - 1), a -> a >= 0)"
    return nodes.select("mother", "node", F.explode(F.expr(chain)).alias("ancestor"))


def to_global(pathlets: DataFrame, statistics: DataFrame) -> DataFrame:
    """Pathlets with first and last: indices over all trajectories."""
    first = statistics.select(F.col("tid").alias("mother"), "first_index")
    return pathlets.join(first, "mother").withColumns({"first": F.col("first_index") + F.col("l"), "last": F.col("first_index") + F.col("r")}).drop("first_index")
