"""Clusters from spread seeds: planted clouds, small keys, and the same result however rows lie."""

import numpy as np
from conftest import rows

from foliospark.operators.reports import seeded_clusters


def cloud(spark, data):
    return spark.createDataFrame([(k, [float(x) for x in p] if p is not None else None) for k, p in data], "image string, point array<double>")


def planted():
    rng = np.random.default_rng(4)
    # The largest cloud lies far from the smallest points, which are many distinct ones close together.
    data = [("a", (i % 7, i // 7, 0)) for i in range(60)]
    data += [("a", p) for p in rng.integers(198, 203, (150, 3)).tolist()] + [("a", p) for p in rng.integers(98, 103, (80, 3)).tolist()]
    data += [("b", (5, 5, 5))] * 30 + [("b", (250, 0, 0))] * 10 + [("one", (1, 2, 3))] * 4 + [("none", None)]
    return data


def test_planted_clouds(spark):
    data = planted()
    got = {r.image: r for r in seeded_clusters(cloud(spark, data), by="image").collect()}
    assert set(got) == {"a", "b", "one"}
    assert got["a"].members == 150 and all(abs(x - 200) < 1 for x in got["a"].centre)
    assert got["b"].members == 30 and got["b"].centre == [5.0, 5.0, 5.0] and got["b"].spread == 0
    assert got["one"].members == 4 and got["one"].centre == [1.0, 2.0, 3.0]
    # The spread is that of the three planted clouds.
    points = np.array([p for k, p in data if k == "a"], float)
    want = sum(((part - part.mean(axis=0)) ** 2).sum() for part in (points[:60], points[60:210], points[210:]))
    assert abs(got["a"].spread - want) < 1e-3 * want


def test_rows_may_lie_anyhow(spark):
    frame = cloud(spark, planted())
    first = rows(seeded_clusters(frame.repartition(1), by="image", steps=5), "image", "members", "centre", "spread")
    assert first == rows(seeded_clusters(frame.repartition(7), by="image", steps=5), "image", "members", "centre", "spread")
    assert seeded_clusters(frame.limit(0), by="image").count() == 0
    # One step is a stop as well.
    assert {r.image for r in seeded_clusters(frame, by="image", steps=1, tries=1).collect()} == {"a", "b", "one"}
