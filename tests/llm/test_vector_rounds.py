"""Nearest vectors when queries are searched in several rounds."""

import numpy as np

from weft.llm import cross_polytope


def test_queries_in_rounds_find_what_they_find_at_once(spark, monkeypatch):
    draw = np.random.default_rng(3)
    vectors = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(draw.normal(size=(300, 8)))], "vec_id bigint, embedding array<double>")
    queries = vectors.filter("vec_id % 7 = 0")
    found = lambda: sorted(map(tuple, cross_polytope.search(spark, vectors, queries).collect()))
    once = found()
    assert len(once) == 43 * 5
    # a bucket has few queries at once, and no round is left out
    monkeypatch.setattr(cross_polytope, "AT_ONCE", 15 * cross_polytope.TABLES * cross_polytope.probes_for(300))
    calls = []
    hashed = cross_polytope._hashed
    monkeypatch.setattr(cross_polytope, "_hashed", lambda *a: calls.append(a[1]) or hashed(*a))
    assert found() == once and calls == ["class_id", *["query"] * 3]


def test_sums_that_can_be_among_the_largest_are_all_looked_at():
    draw = np.random.default_rng(4)
    for first, second, probes in ((1, 128, 40), (40, 64, 40), (199, 128, 199), (5, 2, 40), (7, 9, 3)):
        a, b = -np.sort(-draw.integers(0, 50, first)), -np.sort(-draw.integers(0, 50, second))
        i, j = cross_polytope._pairs(first, second, probes)
        every = np.argsort(-(a[:, None] + b).ravel(), kind="stable")[:probes]
        few = np.argsort(-(a[i] + b[j]), kind="stable")[:probes]
        assert (i[few] * second + j[few]).tolist() == every.tolist() and len(i) < 7 * probes
