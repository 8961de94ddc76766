"""Exact VC dimension of trajectories by pathlet supports: a level-wise search of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadica.sources.shared import written


def elements(ranges: DataFrame) -> DataFrame:
    """(range_id, tid) of ranges (range_id, supporters), without trajectories in every range."""
    long = ranges.select("range_id", F.explode("supporters").alias("tid"))
    n = ranges.count()
    everywhere = long.groupBy("tid").agg(F.count("*").alias("k")).where(F.col("k") == n).select("tid")
    return long.join(everywhere, "tid", "left_anti").select("range_id", "tid")


def shattered(candidates: DataFrame, long: DataFrame, n_ranges: int, strict: bool = False) -> DataFrame:
    """Candidates (ids: sorted array) of which every non-empty subset is what some range holds of them; strict: the empty one too."""
    member = candidates.select("ids", F.explode("ids").alias("tid"))
    traces = member.join(long, "tid").groupBy("ids", "range_id").agg(F.sort_array(F.collect_list("tid")).alias("trace"))
    found = traces.groupBy("ids").agg(F.count_distinct("trace").alias("k"), F.count("*").alias("touched"))
    full = found.where(F.expr("k = shiftleft(1L, size(ids)) - 1"))
    return (full.where(F.col("touched") < n_ranges) if strict else full).select("ids")


def pairs(long: DataFrame) -> DataFrame:
    """Pairs (ids) held together by some range and each held without the other."""
    single = long.groupBy("tid").agg(F.count("*").alias("k"))
    a, b = long.select("range_id", F.col("tid").alias("a")), long.select("range_id", F.col("tid").alias("b"))
    both = a.join(b, "range_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    rows = both.join(single.select(F.col("tid").alias("a"), F.col("k").alias("ka")), "a").join(single.select(F.col("tid").alias("b"), F.col("k").alias("kb")), "b")
    return rows.where("both < ka AND both < kb").select(F.array("a", "b").alias("ids"))


def next_candidates(level: DataFrame) -> DataFrame:
    """Sets one larger of which all subsets one smaller are in the level: two that share all but their last id join, then the others are looked up."""
    head, last = F.expr("slice(ids, 1, size(ids) - 1)"), F.element_at("ids", -1)
    a, b = level.select(head.alias("head"), last.alias("a")), level.select(head.alias("head"), last.alias("b"))
    joined = a.join(b, "head").where("a < b").select(F.expr("concat(head, array(a, b))").alias("ids"))
    subsets = joined.select("ids", F.explode(F.expr("transform(ids, x -> array_remove(ids, x))")).alias("sub"))
    there = subsets.join(level.select(F.col("ids").alias("sub")), "sub", "left_semi")
    return there.groupBy("ids").agg(F.count("*").alias("k")).where(F.expr("k = size(ids)")).select("ids")


def vc_dimension(ranges: DataFrame, strict: bool = False) -> int:
    """The largest size of a shattered set. Every level is written before the next; none is tried for which there are too few ranges."""
    ranges = written(ranges)
    n = ranges.count()
    long = written(elements(ranges))
    if long.isEmpty():
        return 0
    k, level = 1, pairs(long)
    while 2 ** (k + 1) - (not strict) <= n:
        level = written(shattered(level, long, n, strict))
        if level.isEmpty():
            break
        k += 1
        level = written(next_candidates(level))
    return k
