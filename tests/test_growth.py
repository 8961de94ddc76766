"""Support grown from the first two points against support by swept blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadica.operators import growth, mining, reach, simplify
from dyadica.sources import tables


def packed(spark, seed, sizes, levels=None, spread=30.0):
    rnd = np.random.default_rng(seed)
    rows = []
    for t, n in enumerate(sizes):
        x = np.round(rnd.exponential(spread / 3, n), 1) + (rnd.integers(0, 2) * 500 if t % 7 == 3 else 0)
        y = rnd.integers(0, levels, n).astype(float) if levels else rnd.uniform(0, spread, n)
        rows += [(10 * t + 3, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return tables.pack(spark.createDataFrame(rows, tables.POINTS)).cache()


@pytest.fixture
def large(monkeypatch):
    """Every sample counts as too large to be swept, and must be grown."""

    def no(*_, **__):
        raise AssertionError("swept")

    def only():
        monkeypatch.setattr(mining, "BLOCK_POINTS", 0)
        monkeypatch.setattr(mining, "label_counts", no)

    yield only


@pytest.mark.parametrize(("seed", "levels", "radius"), [(1, 20, 5.0), (2, 20, 9.0), (3, None, 6.0), (4, 9, 1.0), (5, 12, 60.0)])
def test_grown_support_equals_swept_support(spark, large, seed, levels, radius):
    t = packed(spark, seed, [1, 2, 3, 5, 8, 13, 21, 17, 1, 9, 30, 12], levels)
    other = packed(spark, seed + 50, [4, 11, 2, 25], levels, spread=45.0)

    def results():
        out = [mining.pathlet_support(t, t, radius), mining.pathlet_support(other, t, radius), mining.frequent(t, t, radius, 0.4), mining.frequent(t, t, radius, 0.3, maximal=True, min_length=2), mining.frequent(t, t, radius, 0.2, net=other)]
        out += [mining.frequent_intervals(t, t, radius, 0.2), mining.frequent_intervals(other, t, radius, 0.3), mining.frequent_intervals(t, t, radius, 0.2, maximal=True), simplify.frequent_simplified(t, t, radius, 0.2, 0.5)]
        return [(sorted(d.columns), sorted(map(tuple, d.select(*sorted(d.columns)).collect()))) for d in out]

    swept = results()
    assert sum(len(rows) for _, rows in swept) > 300
    large()
    for (columns, rows), (wanted, known) in zip(results(), swept, strict=True):
        assert (columns, rows) == (wanted, known)


def test_points_at_the_radius_and_far_away_are_counted_exactly():
    rnd = np.random.default_rng(7)
    make = lambda n, low, high: growth.Curves(np.arange(n), np.full(n, 6), np.round(rnd.uniform(low, high, 6 * n), 1), rnd.integers(0, 8, 6 * n).astype(float))
    sample, mothers = make(40, -20, 20), make(30, -60, 60)
    for r2 in (0.09, 1.0, 6.25, 25.0, 0.1 * 0.1):
        for y in np.unique(mothers.y).tolist():
            rows, n = growth.point_support(mothers, sample, y, r2)
            near = (mothers.x[rows][:, None] - sample.x) ** 2 + (mothers.y[rows][:, None] - sample.y) ** 2 <= r2
            assert n.tolist() == [len(set(sample.owner[h].tolist())) for h in near]
        found = {(m, a, b): n for k in range(3) for m, _, a, b, n in growth.grown(mothers, sample, r2, False, 1, k, 3) if b == a + 1}
        for m in range(30):
            for a in range(5):
                p = [(mothers.x[6 * m + a + i], mothers.y[6 * m + a + i]) for i in (0, 1)]
                one, two = ((sample.x - px) ** 2 + (sample.y - py) ** 2 <= r2 for px, py in p)
                hit = one & two
                hit[1:] |= one[:-1] & two[1:] & ~sample.starts[1:]
                assert found.get((m, a, a + 1), 0) == len(set(sample.owner[hit].tolist()))


def test_a_net_keeps_mothers_without_a_row_for_each_pair(spark):
    t, net = packed(spark, 11, [3, 9, 1, 14, 6, 8, 2, 20], 15), packed(spark, 12, [5, 7, 1], 15)
    near = mining._near(t, net, 2.0)
    assert "Join" not in near._jdf.queryExecution().executedPlan().toString()
    points = {r.tid: list(zip(r.xs, r.ys, strict=True)) for r in net.collect()}
    marks = [p for ps in points.values() for p in ps]
    kept = {r.tid for r in t.collect() if any((x - a) ** 2 + (y - b) ** 2 <= 4.0 for x, y in zip(r.xs, r.ys, strict=True) for a, b in marks)}
    assert {r.tid for r in near.collect()} == kept
    assert 0 < len(kept) < 8


def test_supporters_of_a_large_sample_are_listed_where_they_are_found(spark, monkeypatch):
    t, other = packed(spark, 1, [1, 2, 3, 5, 8, 13, 21, 17, 1, 9, 30, 12], 20), packed(spark, 51, [4, 11, 2, 25], 15, spread=45.0)

    def results():
        out = [mining.frequent(m, s, 9.0, f, min_length=k, keep_ids=True, joined=j) for m, s, f in ((t, t, 0.3), (other, t, 0.05), (t, other, 0.5)) for k in (2, 3) for j in (False, True)]
        return [(d.schema, sorted(map(tuple, d.collect()))) for d in out]

    swept = results()
    assert sum(len(rows) for _, rows in swept) > 200

    def no(*_, **__):
        raise AssertionError("swept")

    monkeypatch.setattr(mining, "BLOCK_POINTS", 0)
    monkeypatch.setattr(mining, "labels", no)
    for batch in (2_000_000, 7):
        monkeypatch.setattr(growth, "BATCH_IDS", batch)
        for (schema, rows), (wanted, known) in zip(results(), swept, strict=True):
            assert (schema.simpleString(), rows) == (wanted.simpleString(), known)


def test_ids_in_text():
    tids = np.array([-120, -15, -3, 0, 7, 9, 10, 99, 100, 12345])
    texts = growth._Texts(tids)
    rnd = np.random.default_rng(3)
    for _ in range(50):
        ranks = np.flatnonzero(rnd.random(len(tids)) < rnd.random())
        assert texts.joined(ranks).decode() == ",".join(map(str, tids[ranks].tolist()))


def test_labels_of_a_large_sample_go_out_without_a_shuffle(spark, monkeypatch):
    t, other = packed(spark, 21, [1, 2, 3, 5, 8, 13, 21, 17, 1, 9, 30, 12], 20), packed(spark, 71, [4, 11, 2, 25], 15, spread=45.0)
    got = lambda d: sorted(map(tuple, d.collect()))
    for m, s in ((t, t), (other, t)):
        swept, counted = got(reach.labels(m, s, 9.0)), got(reach.label_counts(m, s, 9.0))
        assert len(swept) > 100
        monkeypatch.setattr(reach, "BLOCK_POINTS", 25)
        monkeypatch.setattr(reach, "MOST_LABELS", 10)
        whole = reach.labels(m, s, 9.0, most_points=0)
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert got(whole) == swept == got(reach.labels(m, s, 9.0, most_points=0, most_held=0))
        k = reach.labels(m, s, 9.0, most_points=0, counts=True).groupBy("m", "j", "minl").agg(F.sum("k").alias("k"))
        assert got(k) == counted
        monkeypatch.undo()
    assert reach.labels(t.where("tid < 0"), t, 9.0, most_points=0).count() == 0
