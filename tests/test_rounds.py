"""Candidates scored side by side and kept between rounds: the same clusters, with few sweeps."""

import numpy as np
import pytest
from tests.test_trajectories import TINY, frame

from dyadica.functions.numeric import frechet, frechet_many
from dyadica.operators import clustering, mining, rounds
from dyadica.sources import tables

RULES = [
    (clustering.by_coverage_per_cost(0), clustering.tree_intervals),
    (clustering.by_coverage_per_cost(0.1), clustering.all_intervals),
    (clustering.by_vertices(2, 0.5, 2.0), clustering.tree_intervals),
    (clustering.by_cardinality(2), clustering.all_intervals),
]


def curves(seed):
    rng = np.random.default_rng(seed)
    made = [rng.integers(0, 6, (n, 2)).astype(float) for n in rng.integers(1, 16, 4)]
    return lambda: clustering.Data([3, 5, 8, 9], [c[:, 0] for c in made], [c[:, 1] for c in made])


@pytest.mark.parametrize("bits", [1024, 8])
def test_rounds_side_by_side_find_the_clusters_of_whole_searches(monkeypatch, bits):
    monkeypatch.setattr(clustering, "BITS", bits)
    sweep, calls = clustering.start_sweep, []
    monkeypatch.setattr(clustering, "start_sweep", lambda *a: calls.append(1) or sweep(*a))
    for seed in range(6):
        for d2 in (0.5, 1.0, 4.0, 10.0):
            for score, candidates in RULES:
                whole = clustering.greedy(curves(seed)(), lambda data, d2=d2, s=score, c=candidates: clustering.best_cluster(data, d2, s, c))
                calls.clear()
                assert clustering.greedy(curves(seed)(), clustering.best_by_rounds(d2, score, candidates)) == whole
                assert len(calls) == len(whole)  # only for the members of what is established


def test_dense_begins_are_swept_alike(monkeypatch):
    data = curves(2)()
    refs, block = clustering.candidates_of(data, clustering.tree_intervals), data.live()
    one = lambda: [v.tolist() for v in rounds.evaluated(data.curves, block, data.first, refs, 16.0, rounds.Rule(0.1), 1, 128)]
    sparse = one()
    monkeypatch.setattr(rounds, "DENSE", 0.0)
    assert one() == sparse


def test_distances_side_by_side_are_those_one_by_one():
    rng = np.random.default_rng(5)
    for n in (1, 4, 9):
        a, others = rng.normal(size=(n, 2)), [rng.normal(size=(k, 2)) for k in (7, 1, 3, 12, 1)]
        assert frechet_many(a, others).tolist() == [frechet(a, b) for b in others]


def test_seeds_of_one_job_are_those_mined_by_distance(spark):
    t = tables.pack(frame(spark, TINY))
    tids = [r["tid"] for r in t.orderBy("tid").select("tid").collect()]
    found = clustering.mined_seeds(t, [0.25, 1.0, 4.0], 0.5)
    for d2, seeds in found.items():
        assert seeds == clustering.pathlet_seeds(mining.frequent(t, t, d2**0.5, 0.5, maximal=True, single_points=False), tids)
