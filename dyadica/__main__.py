"""Command lines over text files: ``python -m dyadica mine|sample|vcdim|cluster INPUT [OUTPUT] ...``; each prints a JSON line of what it did."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession

from dyadica.operators import clustering, geometry, mining, pathlets, reach, sampling, simplify, vcdim
from dyadica.sources import tables

CLUSTER_MODES = ("means", "center", "aided-means", "aided-all", "aided-center", "aided-random", "vertices", "length", "size", "longest")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="dyadica", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, output: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("input", help="points, x y tid a line")
        if output:
            p.add_argument("output")
        p.add_argument("--timed", action="store_true", help="input lines are tid t x y")
        return p

    p = command("mine", "frequent pathlets or intervals")
    p.add_argument("-r", "--radius", type=float, required=True)
    p.add_argument("-f", "--frequency", type=float, required=True)
    p.add_argument("-l", "--min-length", type=int, default=1)
    p.add_argument("-m", "--maximal", action="store_true")
    p.add_argument("-k", "--keep-ids", action="store_true", help="list the trajectories that support each pathlet")
    p.add_argument("--sample", help="points in which support is counted (default: input)")
    p.add_argument("--intervals", action="store_true", help="all intervals, not only pathlets of the tree")
    p.add_argument("-n", "--net", help="points; mothers far from them are left out")
    p.add_argument("-s", "--simplify", type=float, default=0.0, help="factor of the radius")
    p = command("sample", "a sample whose size a bound names")
    p.add_argument("-m", "--mode", type=int, choices=sorted(sampling.MODES), required=True)
    p.add_argument("-e", "--eps", type=float, default=0.1)
    p.add_argument("-d", "--delta", type=float, default=0.05)
    p.add_argument("-r", "--radius", type=float, default=50.0)
    p.add_argument("-p", "--pathlets", help="points of the mothers (default: input)")
    p.add_argument("-c", "--cardinality", type=int, default=1)
    p.add_argument("-s", "--seed", type=int, default=0)
    p.add_argument("-l", "--min-length", type=int, default=1)
    p.add_argument("-g", "--grid", type=float, default=0.2)
    p = command("vcdim", "exact VC dimension of the supports", output=False)
    p.add_argument("-r", "--radius", type=float, required=True)
    p = command("cluster", "greedy clustering")
    p.add_argument("-m", "--mode", choices=CLUSTER_MODES, default="center")
    p.add_argument("-d", "--distances", type=float, nargs=2, metavar=("LEAST", "MOST"), help="default: from the points")
    p.add_argument("-c", "--weights", type=float, nargs=3, default=(1.0, 0.0003, 128.0), metavar=("C1", "C2", "C3"))
    p.add_argument("-p", "--ignore-points", action="store_true")
    p.add_argument("-s", "--simplify", type=float, default=0.2)
    p.add_argument("--sample", help="points in which seeds are mined (default: input)")
    p.add_argument("-f", "--frequency", type=float, default=0.1)
    p.add_argument("-k", "--draws", type=int, default=5)
    p.add_argument("-r", "--seed", type=int, default=0)
    p.add_argument("--length", type=int, default=1)
    p.add_argument("--size", type=int, default=1)
    p.add_argument("--csv", action="store_true", help="indices over all points, not spaced lines")
    return out


def ladder(least: float, most: float) -> list[float]:
    """Squared distances from the least, four times each, to the most."""
    out, d = [], least * least
    while d <= most * most:
        out.append(d)
        d *= 4
    return out


def mine(spark: SparkSession, a: argparse.Namespace, mothers: DataFrame) -> dict:
    sample = tables.pack(tables.read_points(spark, a.sample)) if a.sample else mothers
    net = tables.pack(tables.read_points(spark, a.net)) if a.net else None
    if a.intervals:
        kept = mining.net_filter(mothers, net, a.radius) if net is not None else mothers
        found = mining.frequent_intervals(kept, sample, a.radius, a.frequency, min_length=a.min_length, maximal=a.maximal)
    else:
        options = {"min_length": a.min_length, "maximal": a.maximal, "keep_ids": a.keep_ids, "net": net}
        found = simplify.frequent_simplified(mothers, sample, a.radius, a.frequency, a.simplify, **options) if a.simplify else mining.frequent(mothers, sample, a.radius, a.frequency, **options)
    tables.write_pathlets(found, a.output)
    return {"mothers": mothers.count(), "pathlets": spark.read.text(a.output).count()}


def sample(spark: SparkSession, a: argparse.Namespace, packed: DataFrame) -> dict:
    data = tables.unpack(packed)
    source = tables.read_points(spark, a.pathlets) if a.pathlets else data
    size = sampling.sample_size(a.mode, data, source, a.radius, eps=a.eps, delta=a.delta, cardinality=a.cardinality, min_length=a.min_length, grid=a.grid)
    held = packed.count()
    tables.write_points(tables.unpack(sampling.draw(packed, min(size, held), a.seed)), a.output)
    return {"size": size, "drawn": min(size, held), "trajectories": held}


def vcdim_of(spark: SparkSession, a: argparse.Namespace, packed: DataFrame) -> dict:
    supported = mining.supporters(pathlets.canonical(packed).drop("level"), reach.labels(packed, packed, a.radius))
    return {"dimension": vcdim.vc_dimension(mining.distinct_supports(supported))}


def cluster(spark: SparkSession, a: argparse.Namespace, packed: DataFrame) -> dict:
    began = time.perf_counter()
    w = clustering.Weights(*a.weights, a.ignore_points)
    steps = ladder(*a.distances) if a.distances else geometry.distance_ladder(tables.unpack(packed))
    cost, seeds = None, None
    if a.mode.startswith("aided"):
        base = tables.pack(tables.read_points(spark, a.sample)) if a.sample else packed
        tids = [r["tid"] for r in packed.orderBy("tid").select("tid").collect()]
        mined = lambda r: simplify.frequent_simplified(packed, base, r, a.frequency, a.simplify, maximal=True, single_points=False)
        seeds = {d: clustering.pathlet_seeds(mined(d**0.5), tids) for d in steps}
    if a.mode in ("center", "aided-center"):
        found, cost = clustering.center(packed, steps, w, factor=a.simplify, seeds=seeds)
    elif a.mode in ("length", "size"):
        found, cost = clustering.basic(packed, steps, w, **{a.mode: getattr(a, a.mode)})
    elif a.mode == "longest":
        found = clustering.bbgll(packed, steps[-1], a.size)
    else:
        score = (lambda d2: clustering.by_vertices(a.length, 0.0, d2**0.5)) if a.mode == "vertices" else None
        clusters, cost, data = clustering.means(packed, steps, w, seeds=seeds, tries=a.draws if a.mode == "aided-random" else None, seed=a.seed, every=a.mode == "aided-all", score=score)
        found = clustering.to_frame(spark, data, clusters)
    first = tables.statistics(tables.unpack(packed)).select("tid", "first_index") if a.csv else None
    tables.write_clusters(found, a.output, (a.input, a.mode, round(time.perf_counter() - began, 3)), not a.csv, first)
    return {"clusters": found.select("cid").distinct().count(), "efficacy": cost}


RUN = {"mine": mine, "sample": sample, "vcdim": vcdim_of, "cluster": cluster}


def main(argv: list[str] | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("dyadica").getOrCreate()
    began = time.perf_counter()
    points = (tables.read_timed_points if a.timed else tables.read_points)(spark, a.input)
    report = {"command": a.command, "input": a.input} | RUN[a.command](spark, a, tables.pack(points)) | {"seconds": round(time.perf_counter() - began, 3)}
    print(json.dumps(report))
    return report


if __name__ == "__main__":
    main()
