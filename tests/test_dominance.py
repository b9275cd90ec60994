"""Dominance counts against comparing everything with everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import dominance, experiments


@pytest.mark.parametrize("fields, ties", [(1, 40), (2, 5), (3, 3)])
def test_below(spark, fields, ties):
    """Small ranges, so that every level of the tree of ranges is used; a third of the values are equal."""
    chance = np.random.default_rng(fields)
    x = chance.integers(0, ties * 20, (400, fields)) / 4
    x[chance.random(x.shape) < 0.33] = 7.0
    n = chance.integers(1, 5, 400)
    names = [f"f{i}" for i in range(fields)]
    points = spark.createDataFrame([(int(a), *map(float, r)) for a, r in zip(n, x)], ["n", *names])
    queries = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["q", *names])
    got = {r.q: r.n for r in dominance.below(points, queries, names, 60).collect()}
    want = (x[None, :, :] <= x[:, None, :]).all(2) @ n
    assert got == {i: v for i, v in enumerate(want.tolist()) if v}


def test_pareto_equals_brute_force(spark):
    chance = np.random.default_rng(8)
    x = chance.random((2000, 3)).round(2)
    x[::9] = x[3]
    x[5] = x[3] + 4e-10
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "profile int, a double, b double, c double")
    got = {r.profile: (r.dominates, r.dominated_by) for r in experiments.pareto(frame, "profile", ["a", "b"], ["c"], rows_a_range=500).collect()}
    d = (x[:, None, :] - x[None, :, :]) * np.array([1, 1, -1])
    up = ((d.max(2) > 1e-9) & (d.min(2) >= -1e-9)).sum(1)
    down = ((d.min(2) < -1e-9) & (d.max(2) <= 1e-9)).sum(1)
    assert got == {i: (int(up[i]), int(down[i])) for i in range(2000)}


def test_pareto_without_numbers(spark):
    frame = spark.createDataFrame([(1, 0.5, 1.0), (2, None, 1.0), (3, float("nan"), 0.0), (4, 0.6, 0.5), (5, None, 1.0)], "profile int, a double, c double")
    got = {r.profile: (r.dominates, r.dominated_by, r.optimal) for r in experiments.pareto(frame, "profile", ["a"], ["c"]).collect()}
    assert got == {1: (0, 1, False), 2: (0, 0, True), 3: (0, 0, True), 4: (1, 0, True), 5: (0, 0, True)}
    assert experiments.pareto(frame.limit(0), "profile", ["a"], ["c"]).count() == 0


def test_ranges_of_many_points(spark, monkeypatch):
    """200,000 random points, a third of them with one equal field: no range has much more than its rows, and rows grow by levels, not by pairs."""
    sizes = []
    real = dominance.stored

    def noted(df, name):
        out = real(df, name)
        if name == "ranges":
            parts = out.groupBy("part").count().agg(F.count("*").alias("parts"), F.max("count").alias("most"), F.sum("count").alias("rows")).head()
            sizes.append((parts.parts, parts.most, parts.rows))
        return out

    monkeypatch.setattr(dominance, "stored", noted)
    points = spark.range(200_000).select(F.lit(1).alias("n"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"))
    queries = spark.range(2000).select(F.col("id").alias("q"), F.rand(4).alias("a"), F.rand(5).alias("b"), F.rand(6).alias("c"))
    points, queries = real(points, "points"), real(queries, "queries")
    got = {r.q: r.n for r in dominance.below(points, queries, ["a", "b", "c"]).collect()}
    assert len(sizes) == 3 and all(parts > 10 and most < 3 * dominance.ROWS_A_RANGE for parts, most, _ in sizes)
    assert sizes[-1][2] < 200_000 * 20
    p, q = (np.array([tuple(r) for r in f.select("a", "b", "c").collect()]) for f in (points, queries.orderBy("q")))
    for i in range(0, 2000, 100):
        assert got.get(i, 0) == (p <= q[i]).all(1).sum()
