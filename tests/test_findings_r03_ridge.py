"""Finding 7: a story's rows meet in parts, so no Python process holds a whole story."""

import numpy as np

from tidegrid.operators import ridge


def test_a_story_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ridge, "PART", 20)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(120, 2)), rng.normal(size=(120, 2))
    xs = spark.createDataFrame([(i, "ab"[i % 2], *map(float, x[i])) for i in range(120)], "i int, story string, x0 double, x1 double")
    ys = spark.createDataFrame([(i, t, float(y[i, t])) for i in range(120) for t in range(2)], "i long, target int, y double")
    got = {(r.story, r.target): r for r in ridge.cross(xs, ys, ["i"], "story", ["x0", "x1"]).collect()}
    assert len(got) == 4
    for (story, t), r in got.items():
        own = ["ab"[i % 2] == story for i in range(120)]
        assert np.allclose(r.b, x[own].T @ y[own, t]) and np.isclose(r.q, (y[own, t] ** 2).sum())
