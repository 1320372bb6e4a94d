"""Nearest vectors against all pairs."""

import numpy as np
import pytest

from tessera.operators import nearest


def brute(vectors, queries, k):
    out = []
    ids = [i for i, v in vectors if v is not None and np.linalg.norm(v) > 0]
    m = np.array([np.array(v) / np.linalg.norm(v) for _, v in vectors if v is not None and np.linalg.norm(v) > 0])
    for q, v in queries:
        if v is None or not np.linalg.norm(v):
            continue
        s = np.round(m @ (np.array(v) / np.linalg.norm(v)), 9)
        best = sorted((-x, i) for x, i in zip(s.tolist(), ids, strict=True) if x > 0)[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("clustered", "n_lists", "probes", "block"), [(True, None, 2, 4096), (False, 30, 1, 50), (True, 1, 1, 7)])
def test_as_all_pairs(spark, clustered, n_lists, probes, block):
    r = np.random.default_rng(4)
    centers = r.normal(size=(12, 16)) * (3 if clustered else 0)
    data = [(i, (centers[i % 12] + r.normal(size=16)).tolist()) for i in range(600)]
    data += [(1000 + i, data[5][1]) for i in range(40)]  # copies tie
    data += [(2000, None), (2001, [0.0] * 16)]
    ask = [(i, v) for i, v in data if i % 20 == 0] + [(5000, [0.0] * 16), (5001, None)]
    kind = "id long, embedding array<double>"
    index = nearest.build(spark.createDataFrame(data, kind).repartition(4), n_lists=n_lists)
    got = nearest.nearest(index, spark.createDataFrame(ask, kind).repartition(2), k=10, probes=probes, block=block)
    assert sorted((x.qid, x.rank, x.id) for x in got.collect()) == [x[:3] for x in brute(data, ask, 10)]


def test_clusters_leave_most_lists_alone(spark):
    r = np.random.default_rng(5)
    centers = r.normal(size=(20, 16)) * 8
    data = [(i, (centers[i % 20] + 0.3 * r.normal(size=16)).tolist()) for i in range(2000)]
    index = nearest.build(spark.createDataFrame(data, "id long, embedding array<double>"), n_lists=20)
    asked = spark.createDataFrame([(v, 4, 0.2) for _, v in data[:50]], "v array<double>, done int, bound double")
    unit = asked.selectExpr("0L as qid", "transform(v, x -> x / sqrt(aggregate(v, 0D, (s, y) -> s + y * y))) as v", "done", "bound")
    assert unit.mapInArrow(nearest._probes(index, 16, None), "qid long, v array<double>, list int").count() < 0.1 * 50 * 20


def test_no_vectors_and_no_queries(spark):
    kind = "id long, embedding array<double>"
    none, some = spark.createDataFrame([], kind), spark.createDataFrame([(1, [1.0, 0.0])], kind)
    assert nearest.nearest(nearest.build(some), none).count() == 0
    assert nearest.nearest(nearest.build(none), some).count() == 0
    assert [tuple(x) for x in nearest.nearest(nearest.build(some), some).collect()] == [(1, 1, 1, 1.0)]
