"""Clustering aided by mined pathlets: which references are tried, and in which order."""

import pytest
from tests.test_trajectories import TINY, frame

from dyadica.operators import clustering
from dyadica.plans import catalog
from dyadica.sources import tables


def test_seeds_are_maximal_pathlets_by_support(spark, monkeypatch):
    t = tables.pack(frame(spark, TINY))
    monkeypatch.setattr(catalog, "FREQUENCY", 0.5)
    assert catalog._seeds(t, [1.0]) == {1.0: [(2, 0, 1), (0, 0, 3), (1, 0, 3), (3, 0, 3)]}
    monkeypatch.setattr(catalog, "FREQUENCY", 0.75)
    assert catalog._seeds(t, [1.0]) == {1.0: [(0, 0, 1), (0, 2, 3), (1, 0, 1), (1, 2, 3), (2, 0, 1), (3, 0, 1)]}
    assert all(b > a for _, a, b in catalog._seeds(t, [1.0], 0.2)[1.0])


def test_every_free_seed_is_tried_by_gamma(spark):
    t = tables.pack(frame(spark, TINY))
    w = clustering.Weights(1.0, 0.01, 50.0)
    seeds = {1.0: [(2, 0, 1), (0, 0, 3), (1, 2, 3)]}
    data = clustering.Data(*clustering._held(t))
    found = {ref: clustering.best_cluster(data, 1.0, clustering.by_gamma(data, w), only=[ref]) for ref in seeds[1.0]}
    best = max(found.values(), key=lambda c: clustering.cluster_gamma(data, c, w))
    clusters, value, done = clustering.means(t, [1.0], w, seeds=seeds, every=True)
    assert clusters[0].ref == best.ref != seeds[1.0][0]
    assert clustering.means(t, [1.0], w, seeds=seeds)[0][0].ref == seeds[1.0][0]
    assert value == pytest.approx(clustering.efficacy(done, clusters, w))
