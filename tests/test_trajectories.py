"""Golden fixture, brute force and properties of the trajectory operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadica.functions import numeric
from dyadica.operators import clustering, geometry, mining, pathlets, reach, sampling, simplify, validate, vcdim
from dyadica.sources import tables

TINY = {0: [(0, 0), (1, 0), (2, 0), (3, 0)], 1: [(0, 0.5), (1, 0.5), (2, 0.5), (3, 0.5)], 2: [(0, 0), (1, 0), (5, 5), (6, 6)], 3: [(2, 0), (3, 0), (3, 0), (4, 0)]}


def frame(spark, curves):
    return spark.createDataFrame([(t, i, float(x), float(y)) for t, ps in curves.items() for i, (x, y) in enumerate(ps)], tables.POINTS)


@pytest.fixture(scope="module")
def tiny(spark):
    return tables.pack(frame(spark, TINY)).cache()


def walk(seed, curves=8, longest=9):
    rnd = random.Random(seed)
    out = {}
    for t in range(curves):
        x = y = 0
        out[10 * t + 1] = [(x := x + rnd.randint(-1, 1), y := y + rnd.randint(-1, 1)) for _ in range(rnd.randint(1, longest))]
    return out


def near(p, q, r2):
    return (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= r2


def brute_match(a, b, r2):
    """Whether some interval of b is within the radius of the whole of a."""
    for s in range(len(b)):
        cells = {(0, s)} if near(a[0], b[s], r2) else set()
        todo = list(cells)
        while todo:
            i, j = todo.pop()
            if i == len(a) - 1:
                return True
            for c in ((i + 1, j), (i, j + 1), (i + 1, j + 1)):
                if c[0] < len(a) and c[1] < len(b) and c not in cells and near(a[c[0]], b[c[1]], r2):
                    cells.add(c)
                    todo.append(c)
    return False


def brute_frechet(a, b):
    table = {}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d = (a[i][0] - b[j][0]) ** 2 + (a[i][1] - b[j][1]) ** 2
        ways = [table[k] for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if k in table]
        table[i, j] = max(d, min(ways)) if ways else d
    return table[len(a) - 1, len(b) - 1]


def test_golden_labels(spark, tiny):
    got = {(r.m, r.j, r.t): r.minl for r in reach.labels(tiny, tiny, 1.0).collect()}
    want = {0: [0, 0, 0, 0], 1: [0, 0, 0, 0], 2: [0, 0, 0, None], 3: [None, 1, 1, 1]}
    assert {(j, t): got.get((0, j, t)) for j in range(4) for t in TINY} == {(j, t): want[t][j] for j in range(4) for t in TINY}


def test_golden_mining(spark, tiny):
    assert mining.frequent(tiny, tiny, 1.0, 0.5).count() == 24
    assert mining.frequent(tiny, tiny, 1.0, 0.75).count() == 19
    ends = lambda df: sorted((r.mother, r.l, r.r) for r in df.collect())
    assert ends(mining.frequent(tiny, tiny, 1.0, 0.5, maximal=True)) == [(0, 0, 3), (1, 0, 3), (2, 0, 1), (3, 0, 3)]
    seven = [(0, 0, 1), (0, 2, 3), (1, 0, 1), (1, 2, 3), (2, 0, 1), (3, 0, 1), (3, 2, 2)]
    assert ends(mining.frequent(tiny, tiny, 1.0, 0.75, maximal=True)) == seven
    assert ends(mining.frequent(tiny, tiny, 1.0, 0.75, maximal=True, single_points=False)) == seven[:-1]


def test_golden_supports_and_vc(spark, tiny):
    sets = mining.distinct_supports(mining.supporters(pathlets.canonical(tiny).drop("level"), reach.labels(tiny, tiny, 1.0)))
    assert sorted(tuple(r.supporters) for r in sets.collect()) == [(0, 1), (0, 1, 2), (0, 1, 2, 3), (0, 1, 3), (0, 3), (2,)]
    long = vcdim.elements(sets)
    assert sorted(tuple(r.ids) for r in vcdim.shattered(vcdim.pairs(long), long, 6).collect()) == [(0, 2), (1, 2), (1, 3), (2, 3)]
    assert vcdim.vc_dimension(sets) == 2


def test_vc_dimension_equals_brute_force(spark):
    rnd = random.Random(5)
    for strict in (False, True):
        ranges = {tuple(sorted(rnd.sample(range(6), rnd.randint(1, 5)))) for _ in range(25)}
        df = spark.createDataFrame([(i, list(r)) for i, r in enumerate(sorted(ranges))], "range_id long, supporters array<long>")
        best = 0
        for k in range(1, 6):
            for s in itertools.combinations(range(6), k):
                traces = {tuple(x for x in r if x in s) for r in ranges}
                if len(traces - {()}) == 2**k - 1 and (not strict or () in traces):
                    best = k
        assert vcdim.vc_dimension(df, strict) == best


def test_golden_frechet(spark, tiny):
    want = {(0, 1): 0.25, (0, 2): 45, (0, 3): 4, (1, 2): 39.25, (1, 3): 4.25, (2, 3): 40}
    a, b = tiny.selectExpr("tid AS a", "xs AS ax", "ys AS ay"), tiny.selectExpr("tid AS b", "xs AS bx", "ys AS by")
    got = a.join(b, F.col("a") < F.col("b")).select("a", "b", F.expr(numeric.frechet_expression("ax", "ay", "bx", "by")).alias("d")).collect()
    assert {(r.a, r.b): r.d for r in got} == want
    curves = walk(2)
    for p, q in itertools.product(curves.values(), repeat=2):
        assert numeric.frechet(np.array(p, float), np.array(q, float)) == brute_frechet(p, q)


def test_labels_equal_brute_force_by_either_plan(spark):
    mothers, sample = walk(3), {t + 1: c for t, c in walk(4).items()}
    m, s = tables.pack(frame(spark, mothers)), tables.pack(frame(spark, sample))
    for radius in (0.0, 1.0, 1.5):
        found = {tuple(r) for r in reach.labels(m, s, radius).collect()}
        if radius:
            assert found == {tuple(r) for r in reach.labels(m, s, radius, most_points=0).collect()}
        least = {(a, j, t): v for a, j, t, v in found}
        for (a, c), (t, b) in itertools.product(mothers.items(), sample.items()):
            for j in range(len(c)):
                hits = [l for l in range(j + 1) if brute_match(c[l : j + 1], b, radius**2)]
                assert least.get((a, j, t)) == (min(hits) if hits else None)


def test_empty_and_disjoint_inputs(spark, tiny):
    none = tiny.limit(0)
    assert mining.frequent(none, tiny, 1.0, 0.5).count() == 0
    assert mining.frequent(tiny, none, 1.0, 0.5).count() == 0
    far = tables.pack(frame(spark, {9: [(100, 100)]}))
    assert reach.labels(tiny, far, 1.0).count() == 0
    assert [r.kept for r in mining.net_report(tiny, far, 1.0).collect()] == [False] * 4
    one = mining.frequent(far, far, 0.0, 1.0).collect()
    assert [(r.l, r.r, r.cnt) for r in one] == [(0, 0, 1)]


def test_support_is_antimonotone_and_intervals_agree(spark):
    t = tables.pack(frame(spark, walk(6)))
    n = t.count()
    rows = {(r.mother, r.l, r.r): r.cnt for r in mining.frequent_intervals(t, t, 1.0, 1 / n).collect()}
    nodes = mining.frequent(t, t, 1.0, 1 / n).collect()
    assert all(rows[r.mother, r.l, r.r] == r.cnt for r in nodes)
    for (m, l, r), c in rows.items():
        assert rows.get((m, l + 1, r), 10**9) >= c and rows.get((m, l, r - 1), 10**9) >= c
    enough = {k for k, c in rows.items() if c >= 3}
    want = {k for k in enough if not any(o != k and o[0] == k[0] and o[1] <= k[1] and o[2] >= k[2] for o in enough)}
    assert {(r.mother, r.l, r.r) for r in mining.frequent_intervals(t, t, 1.0, 3 / n, maximal=True).collect()} == want


def test_first_chunk_filter_is_lossy_only(spark, tiny):
    kept = {r.tid for r in mining.first_chunk_filter(tiny, tiny, 1.0, 1, min_length=4).collect()}
    assert kept == {0, 1, 3}


def test_grid_join_and_neighbours_equal_brute_force(spark):
    p = frame(spark, walk(7))
    rows = p.collect()
    for radius, side in ((1.0, 1.0), (2.5, 0.7)):
        want = {(a.tid, a.pos, b.tid, b.pos) for a in rows for b in rows if near((a.x, a.y), (b.x, b.y), radius**2)}
        got = [tuple(r) for r in geometry.radius_join(p, p, radius, side).select("tid", "pos", "tid2", "pos2").collect()]
        assert len(got) == len(want) and set(got) == want
    far = {(r.tid, r.pos): (r.nearest, r.farthest) for r in geometry.nearest_and_farthest(p).collect()}
    for a in rows:
        d = [(a.x - b.x) ** 2 + (a.y - b.y) ** 2 for b in rows if (a.tid, a.pos) != (b.tid, b.pos)]
        assert far[a.tid, a.pos] == (min(d), max(d))
    alone = geometry.nearest_and_farthest(frame(spark, {0: [(1, 1)]})).collect()
    assert [(r.nearest, r.farthest) for r in alone] == [(None, 0.0)]


def test_tree_of_odd_sizes(spark):
    sizes = spark.createDataFrame([(n, n) for n in (1, 2, 3, 5, 8, 100)], "tid long, n int")
    rows = pathlets.canonical(sizes).collect()
    for n in (1, 2, 3, 5, 8, 100):
        mine = {r.node: (r.l, r.r) for r in rows if r.mother == n}
        assert len(mine) == 2 * n - 1 and mine[0] == (0, n - 1)
        for k, (l, r) in mine.items():
            if l < r:
                h = l + (r - l + 1) // 2
                assert mine[2 * k + 1] == (l, h - 1) and mine[2 * k + 2] == (h, r)


def test_simplify_and_back(spark, tiny):
    s = simplify.simplify(tiny, 2.0, 1.0).orderBy("tid").collect()
    assert [r.anchors for r in s] == [[0, 2], [0, 2], [0, 2, 3], [0, 3]] and all(sum(r.weights) == 4 for r in s)
    back = simplify.unsimplify(spark.createDataFrame([(0, 0, 0), (2, 1, 2)], "mother long, l long, r long"), simplify.simplify(tiny, 2.0, 1.0))
    assert sorted(map(tuple, back.collect())) == [(0, 0, 1), (2, 2, 3)]
    same = simplify.frequent_simplified(tiny, tiny, 1.0, 0.5, 0.0)
    # points that repeat are dropped even without a reach
    assert same.count() >= 20
    there = simplify.to_simplified(spark.createDataFrame([(0, 1, 3)], "mother long, l long, r long"), simplify.simplify(tiny, 2.0, 1.0))
    assert [tuple(r) for r in there.collect()] == [(0, 0, 1)]


def test_bounds():
    assert sampling.chernoff_size(100, 0.1, 0.05) == int(1199 * math.log(4000)) or sampling.chernoff_size(100, 0.1, 0.05) == int(1200 * math.log(4000))
    assert sampling.capacity({1: 2, 2: 1}, 2) and not sampling.capacity({1: 1, 2: 1}, 2) and not sampling.capacity({1: 9}, 2)


def test_h_index(spark):
    counts = spark.createDataFrame([(c,) for c in (0, 1, 2, 4, 4, 9, 700)], "c long")
    assert sampling.h_index(counts).first().d == 3
    assert sampling.h_index(counts.limit(0)).first().d == 0


def test_draw(spark, tiny):
    a = [r.tid for r in sampling.draw(tiny, 2, seed=1).collect()]
    assert a == [r.tid for r in sampling.draw(tiny.repartition(3), 2, seed=1).collect()] and len(a) == 2
    with pytest.raises(ValueError):
        sampling.draw(tiny, 5)


def test_gamma_and_coverage_per_cost():
    cov = np.array([3.0, 2.0])
    g = numeric.coverage_per_cost(cov, 0.5)
    assert g == pytest.approx(2.5) and numeric.coverage_per_cost(cov, 0) == -1
    assert numeric.gamma(cov, np.array([0.0, 1.0]), 10, 1.0, 0.1) == pytest.approx(0.5 / 1.1)


def disjoint_and_matching(data, clusters, d2):
    seen = set()
    for c in clusters:
        assert c.ref in c.members
        for t, a, b in c.members:
            assert data.distance(c.ref, (t, a, b)) ** 2 <= d2 + 1e-9
            points = {(t, i) for i in range(a, b + 1)}
            assert not points & seen
            seen |= points
    return seen


@pytest.mark.parametrize("seed", [8, 9])
def test_greedy_covers_every_point_once(seed):
    curves = walk(seed)
    make = lambda: clustering.Data(list(curves), [[p[0] for p in c] for c in curves.values()], [[p[1] for p in c] for c in curves.values()])
    for score, candidates, factor in ((clustering.by_coverage_per_cost(0), clustering.tree_intervals, 0), (clustering.by_coverage_per_cost(0.5), clustering.all_intervals, 0), (clustering.by_cardinality(1), clustering.all_intervals, 0), (clustering.by_coverage_per_cost(0), clustering.tree_intervals, 0.8)):
        data = make()
        clusters = clustering.greedy(data, lambda d, s=score, c=candidates, f=factor: clustering.simplified_best(d, 2.0, s, f, c))
        assert len(disjoint_and_matching(data, clusters, 2.0)) == data.total
        assert clustering.uncovered_share(data, clusters) == 0
    data = make()
    best = clustering.best_cluster(data, 2.0, clustering.by_length(3), clustering.all_intervals)
    longest = max((b - a for t, c in enumerate(curves.values()) for a in range(len(c)) for b in range(a, len(c)) if len(members_by_force(data, (t, a, b), 2.0)) >= 3), default=-1)
    assert best.ref[2] - best.ref[1] == longest
    assert clustering.most_then_longest(data, 2.0, 1) and clustering.bbgll_by_sizes(data, 2.0)


@pytest.mark.parametrize("bits", [1024, 7])
def test_rounds_score_again_only_what_covered_points_touch(monkeypatch, bits):
    monkeypatch.setattr(clustering, "BITS", bits)
    rnd = np.random.default_rng(8)
    xs, ys = [rnd.uniform(0, 12, n) for n in (9, 14, 1, 11)], [rnd.uniform(0, 12, n) for n in (9, 14, 1, 11)]
    make = lambda: clustering.Data([3, 5, 8, 9], xs, ys)
    w = clustering.Weights(1.0, 0.005, 128.0)
    for d2 in (0.5, 4.0, 16.0, 300.0):
        for rule, candidates in ((clustering.by_coverage_per_cost(0), clustering.tree_intervals), (clustering.by_coverage_per_cost(0.1), clustering.all_intervals), (clustering.by_cardinality(2), clustering.all_intervals), (clustering.by_length(3), clustering.all_intervals), (clustering.by_vertices(1, 0.5, 2.0), clustering.tree_intervals), (clustering.by_gamma(make(), w), clustering.tree_intervals)):
            whole = clustering.greedy(make(), lambda data, d2=d2, rule=rule, candidates=candidates: clustering.best_cluster(data, d2, rule, candidates))
            calls = []
            counted = lambda ref, members, rule=rule, calls=calls: calls.append(ref) or rule(ref, members)
            if hasattr(rule, "least"):
                counted.least = rule.least
            kept = clustering.greedy(make(), clustering.best_by_rounds(d2, counted, candidates))
            assert [(c.ref, c.members) for c in kept] == [(c.ref, c.members) for c in whole]
            if d2 == 0.5 and bits > 35 and candidates is clustering.tree_intervals:
                assert len(calls) < 2 * len(set(calls))  # not once a round


def test_rounds_on_simplified_curves_sweep_again_only_runs_that_changed(monkeypatch):
    sweep, calls = clustering.start_sweep, []
    monkeypatch.setattr(clustering, "start_sweep", lambda *a: calls.append(1) or sweep(*a))
    rnd = np.random.default_rng(12)
    sizes = (19, 24, 1, 16, 22)
    xs, ys = [np.cumsum(rnd.uniform(-2, 2, n)) for n in sizes], [np.cumsum(rnd.uniform(-2, 2, n)) for n in sizes]
    make = lambda: clustering.Data([3, 5, 8, 9, 11], xs, ys)
    for factor in (0.2, 1.0):
        for d2 in (0.01, 1.0, 4.0, 16.0, 300.0):
            rule = clustering.by_coverage_per_cost(0)
            whole = clustering.greedy(make(), lambda data, d2=d2, factor=factor, rule=rule: clustering.simplified_best(data, d2, rule, factor))
            plain = len(calls)
            calls.clear()
            rounds = clustering.greedy(make(), clustering.simplified_by_rounds(d2, factor))
            assert [(c.ref, c.members) for c in rounds] == [(c.ref, c.members) for c in whole]
            assert d2 != 0.01 or len(calls) < plain / 2  # not whole once a round
            calls.clear()


def test_longest_cluster_sweeps_few_columns(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    xs, ys = [rnd.uniform(0, 30, 60) for _ in range(4)], [rnd.uniform(0, 30, 60) for _ in range(4)]
    make = lambda: clustering.Data([1, 2, 4, 7], xs, ys)
    sweep, columns = clustering.start_sweep, []

    def counted(*a):
        for found in sweep(*a):
            columns.append(found[0])
            yield found

    plain = clustering.best_cluster(make(), 64.0, lambda ref, members: clustering.by_length(3)(ref, members), clustering.all_intervals)
    monkeypatch.setattr(clustering, "start_sweep", counted)
    best = clustering.best_cluster(make(), 64.0, clustering.by_length(3), clustering.all_intervals)
    assert (best.ref, best.members) == (plain.ref, plain.members)
    assert len(columns) < 4 * 60 * 60 / 2 / 5
    monkeypatch.undo()
    t = spark.createDataFrame([(i, 60, x.tolist(), y.tolist()) for i, x, y in zip((1, 2, 4, 7), xs, ys, strict=True)], "tid long, n int, xs array<double>, ys array<double>")
    rows = clustering.bbgll(t, 64.0, 3, step=7).collect()
    assert [(r.tid, r.l, r.r) for r in rows] == [((1, 2, 4, 7)[a], b, c) for a, b, c in plain.members]


def members_by_force(data, ref, d2):
    """Other trajectories with a match, and greedy disjoint ones; at least those counted by reachability."""
    block = data.live()
    curve = data.curves[ref[0]]
    reached = reach.start_rows(curve[:, 0], curve[:, 1], block, d2, ref[1], ref[2], True)
    return clustering.members_of(reached, block, ref)


def test_spark_clusterings_agree_with_the_kernel(spark):
    curves = walk(10, curves=5, longest=6)
    p = frame(spark, curves)
    t, ladder = tables.pack(p), geometry.distance_ladder(p)
    w = clustering.Weights(1.0, 0.01, 50.0)
    best, cost = clustering.center(t, ladder, w)
    assert validate.overlaps(best).count() == 0
    costs = []
    for d2 in ladder:
        data = clustering.Data(sorted(curves), [[q[0] for q in curves[k]] for k in sorted(curves)], [[q[1] for q in curves[k]] for k in sorted(curves)])
        kept = clustering.drop_inefficient(data, clustering.greedy(data, lambda d, r=d2: clustering.best_cluster(d, r, clustering.by_coverage_per_cost(0))), w, center=True)
        costs.append(clustering.efficacy(data, kept, w, center=True))
    assert cost == pytest.approx(min(costs))
    clusters, value, data = clustering.means(t, ladder, w)
    assert all(c.all() for c in data.covered) and value == pytest.approx(clustering.efficacy(data, clusters, w))
    assert validate.overlaps(clustering.to_frame(spark, data, clusters)).count() == 0


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0 5\n1.5 2 5\n\n7 7 9\n")
    got = sorted(map(tuple, tables.read_points(spark, str(tmp_path / "a.txt")).collect()))
    assert got == [(5, 0, 0.0, 0.0), (5, 1, 1.5, 2.0), (9, 0, 7.0, 7.0)]
    tables.write_points(spark.createDataFrame(got, tables.POINTS).coalesce(1), str(tmp_path / "b"))
    assert sorted(map(tuple, tables.read_points(spark, str(tmp_path / "b")).collect())) == got
    (tmp_path / "bad.txt").write_text("0 0\n")
    with pytest.raises(Exception, match="not x y tid"):
        tables.read_points(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "t.txt").write_text("1 0.5 3 4\n1 0.7 5 6\n2 0 1 1\n")
    assert sorted(map(tuple, tables.read_timed_points(spark, str(tmp_path / "t.txt")).collect())) == [(1, 0, 3.0, 4.0), (1, 1, 5.0, 6.0), (2, 0, 1.0, 1.0)]
    (tmp_path / "u.txt").write_text("1 0.5 3 4\n1 0.5 5 6\n")
    with pytest.raises(Exception, match="do not rise"):
        tables.read_timed_points(spark, str(tmp_path / "u.txt")).collect()


def test_result_files(spark, tiny, tmp_path):
    tables.write_pathlets(mining.frequent(tiny, tiny, 1.0, 0.75, maximal=True).coalesce(1), str(tmp_path / "f"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert len(lines) == 7 and lines[-1] == "2 2 3 0.75"
    rows = spark.createDataFrame([(0, 1, 0, 1, 1, 0, 1), (0, 1, 0, 1, 2, 2, 3)], "cid long, ref_tid long, ref_l long, ref_r long, tid long, l long, r long")
    tables.write_clusters(rows, str(tmp_path / "c"), ("d/x.txt", "means", 1.5))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["x.txt", "means", "1.5", "1 0 1", "1 0 1 2 2 3"]
    tables.write_clusters(rows, str(tmp_path / "v"), spaced=False, first_index=tables.statistics(tables.unpack(tiny)))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "v")).collect()) == [".,.,.,.,0,10,11", ".,.,.,.,0,4,5"]


def cross(seed, curves, longest):
    return {t: [(x * 3.7, y) for x, y in ps] for t, ps in walk(seed, curves, longest).items()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_whole_curve_may_be_minimal(spark):
    nodes = pathlets.canonical(tables.pack(frame(spark, {1: [(0, 0)], 2: [(0, 0), (1, 0), (2, 0)]})))
    assert sorted((r.mother, r.node) for r in pathlets.minimal(nodes.where("len >= 2"), 2).collect()) == [(2, 2)]
    assert [(r.mother, r.node) for r in pathlets.minimal(nodes.where("mother = 1"), 1).collect()] == [(1, 0)]


@pytest.mark.parametrize("min_length", [1, 2, 5])
def test_survivors_by_cells_are_those_of_the_listed_pairs(spark, monkeypatch, min_length):
    from dyadica.operators import counting

    p = frame(spark, cross(8, 150, 23))
    listed = sampling.surviving(p, p, 6.0, min_length, side=3.0, exact=False).groupBy("tid").count()
    want = {r["tid"]: r["count"] for r in listed.collect()}
    got = sampling.vc_counts(p, p, 6.0, min_length, side=3.0, exact=False)
    assert {r.tid: r.c for r in got.collect()} == want
    monkeypatch.setattr(counting, "BLOCK_MARKS", 40)
    monkeypatch.setattr(counting, "STEP_POINTS", 70)
    assert {r.tid: r.c for r in sampling.vc_counts(p, p, 6.0, min_length, side=3.0, exact=False).collect()} == want


@pytest.mark.parametrize("radius", [1.0, 5.0, 0.35])
def test_near_marks_are_those_of_brute_force(spark, monkeypatch, radius):
    from dyadica.operators import counting

    rnd = random.Random(4)
    points = [(t, i, round(rnd.uniform(-9, 9), 1), rnd.choice([rnd.randint(-4, 4), rnd.uniform(-4, 4)])) for t in range(20) for i in range(15)]
    p = spark.createDataFrame([(t, i, float(x), float(y)) for t, i, x, y in points], tables.POINTS)
    marks = [(float(x), float(y)) for _, _, x, y in points[::3]] + [(0.0, 0.0)] * 3 + [(points[0][2] + radius, float(points[0][3]))]
    want = {}
    for t, _, x, y in points:
        want[t] = want.get(t, 0) + sum((x - a) * (x - a) + (y - b) * (y - b) <= radius * radius for a, b in marks)
    want = {t: c for t, c in want.items() if c}
    m = spark.createDataFrame(marks, "x double, y double")
    assert {r.tid: r.c for r in counting.near_marks(p, m, radius).collect()} == want
    for name, small in (("BLOCK_MARKS", 20), ("STEP_POINTS", 7), ("STEP_PAIRS", 3)):
        monkeypatch.setattr(counting, name, small)
    assert {r.tid: r.c for r in counting.near_marks(p, m, radius).collect()} == want


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    p = frame(spark, cross(8, 12, 23))
    assert "BroadcastHashJoin" not in plan_of(geometry.radius_join(p, p, 2.0))
    assert "BroadcastHashJoin" not in plan_of(geometry.nearest_and_farthest(p))
    want = sorted(map(tuple, sampling.turbo_counts(p, p, 6.0, 2, 3.0).collect()))
    monkeypatch.setattr(geometry, "MOST_BROADCAST", 0)
    got = sampling.turbo_counts(p, p, 6.0, 2, 3.0)
    assert "BroadcastHashJoin" not in plan_of(got) and sorted(map(tuple, got.collect())) == want


def test_counts_by_exact_ends_are_those_of_the_listed_pairs(spark, monkeypatch):
    from dyadica.operators import counting

    p = frame(spark, cross(6, 70, 17))
    begin, end = (sampling.near(p, sampling.ends(p, 2, w), 4.0).select("tid", "mother", "node").distinct() for w in "lr")
    both = {(r.mother, r.node): r["count"] for r in begin.join(end, ["tid", "mother", "node"]).groupBy("mother", "node").count().collect()}
    want = {r.tid: r["count"] for r in sampling.surviving(p, p, 4.0, 2).groupBy("tid").count().collect()}
    for marks in (500_000, 30):
        monkeypatch.setattr(counting, "BLOCK_MARKS", marks)
        assert {(r.mother, r.node): r.c for r in counting.near_both_ends(p, p, 4.0, 2).collect()} == both
        assert {r.tid: r.c for r in sampling.vc_counts(p, p, 4.0, 2).collect()} == want
