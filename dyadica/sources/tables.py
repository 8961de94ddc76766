"""Points (tid, pos, x, y) from tables and text, packed trajectories, slices, and result writers.

Schemas are explicit and malformed rows fail; ids need not be consecutive.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTS = "tid long, pos int, x double, y double"


def ordered_points(rows: DataFrame, tid: str, x: str, y: str, *order: str) -> DataFrame:
    """Points of any table: ``order`` ranks the rows of a trajectory."""
    w = Window.partitionBy("tid").orderBy(*order)
    return rows.withColumn("tid", F.expr(tid).cast("long")).select("tid", (F.row_number().over(w) - 1).cast("int").alias("pos"), F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))


def event_points(events: DataFrame) -> DataFrame:
    """One trajectory a user: value by event number modulo 97, in order of time."""
    return ordered_points(events, "user_id", "value", "event_id % 97", "ts", "event_id")


def supplier_points(supplier: DataFrame) -> DataFrame:
    """One trajectory a nation: account balance in hundreds by supplier number modulo 97, in order of number."""
    return ordered_points(supplier, "s_nationkey", "s_acctbal / 100", "s_suppkey % 97", "s_suppkey")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Text rows ``x y tid``; a trajectory's points stand in file order. Line numbers come from file splits and offsets inside them, so only their order inside a file is used."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("f")).where("f[0] != ''")
    checked = lines.select("line", F.when(F.size("f") == 3, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not x y tid: "), F.array_join("f", " ")))).alias("f"))
    return ordered_points(checked, "cast(f[2] AS bigint)", "cast(f[0] AS double)", "cast(f[1] AS double)", "line")


def read_timed_points(spark: SparkSession, path: str) -> DataFrame:
    """Text rows ``tid t x y``, ordered by t, which must rise strictly within a trajectory as the rows stand."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("f")).where("f[0] != ''")
    rows = lines.selectExpr("line", "cast(f[0] AS bigint) AS tid", "cast(f[1] AS double) AS t", "cast(f[2] AS double) AS x", "cast(f[3] AS double) AS y")
    before = F.lag("t").over(Window.partitionBy("tid").orderBy("line"))
    rows = rows.withColumn("t", F.when(before >= F.col("t"), F.raise_error(F.concat(F.lit("times do not rise in trajectory "), F.col("tid").cast("string")))).otherwise(F.col("t")))
    return ordered_points(rows, "tid", "x", "y", "t")


def pack(points: DataFrame) -> DataFrame:
    """(tid, n, xs, ys): one row a trajectory, points in order."""
    rows = points.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    return rows.select("tid", F.size("p").alias("n"), F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))


def unpack(trajectories: DataFrame) -> DataFrame:
    return trajectories.select("tid", F.posexplode(F.arrays_zip("xs", "ys")).alias("pos", "p")).select("tid", "pos", F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))


def statistics(points: DataFrame) -> DataFrame:
    """(tid, n, first_index): sizes, and the index of the first point where trajectories follow one another by id. Only one row a trajectory is windowed, in ranges of ids."""
    sizes = points.groupBy("tid").agg(F.count("*").alias("n"))
    by_range = sizes.withColumn("band", F.floor(F.col("tid") / 4096))
    bands = by_range.groupBy("band").agg(F.sum("n").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("band").orderBy("tid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return by_range.join(bands.select("band", before.alias("before")), "band").select("tid", "n", (F.col("before") + inside).alias("first_index"))


def between(points: DataFrame, first: int, last: int) -> DataFrame:
    """Points of the trajectories with ids from first to last."""
    return points.where(F.col("tid").between(first, last))


def chunks(points: DataFrame, size: int) -> DataFrame:
    """Points with ``chunk``: trajectories by id, ``size`` to a chunk."""
    ids = points.select("tid").distinct().select("tid", F.floor((F.row_number().over(Window.orderBy("tid")) - 1) / size).alias("chunk"))
    return points.join(ids, "tid")


def as_one_curve(points: DataFrame) -> DataFrame:
    """All points as trajectory 0, by id and position."""
    first = statistics(points).select("tid", "first_index")
    return points.join(first, "tid").select(F.lit(0).cast("long").alias("tid"), (F.col("first_index") + F.col("pos")).cast("int").alias("pos"), "x", "y")


def write_pathlets(frequent: DataFrame, path: str) -> None:
    """Lines ``l r mother frequency``, longest first."""
    frequent.orderBy(F.desc("len"), "mother", "l").select(F.concat_ws(" ", "l", "r", "mother", "frequency")).write.text(path)


def write_points(points: DataFrame, path: str) -> None:
    """Lines ``x y tid``, by id and position."""
    points.orderBy("tid", "pos").select(F.concat_ws(" ", "x", "y", "tid")).write.text(path)


def write_clusters(clusters: DataFrame, path: str, header: tuple[str, str, float] | None = None, spaced: bool = True, first_index: DataFrame | None = None) -> None:
    """Clusters (cid, ref_tid, ref_l, ref_r, tid, l, r). Spaced: the header's data set, algorithm and seconds, then for each cluster a line ``tid l r`` and a line with all members. Otherwise ``.,.,.,.,cid,first,second`` by indices over all trajectories (first_index: tid, first_index)."""
    if not spaced:
        rows = clusters.join(first_index, "tid")
        rows.orderBy("cid", "tid", "l").select(F.concat_ws(",", *[F.lit(".")] * 4, "cid", F.col("first_index") + F.col("l"), F.col("first_index") + F.col("r"))).write.text(path)
        return
    member = F.struct("tid", "l", "r")
    rows = clusters.groupBy("cid", "ref_tid", "ref_l", "ref_r").agg(F.sort_array(F.collect_list(member)).alias("m"))
    line = F.concat_ws("\n", F.concat_ws(" ", "ref_tid", "ref_l", "ref_r"), F.array_join(F.transform("m", lambda m: F.concat_ws(" ", m.tid, m.l, m.r)), " "))
    text = rows.select(F.col("cid").cast("long").alias("at"), line.alias("value"))
    if header:
        text = text.union(text.sparkSession.createDataFrame([(-1, f"{os.path.basename(header[0])}\n{header[1]}\n{header[2]}")], "at long, value string"))
    text.orderBy("at").select("value").write.text(path)
