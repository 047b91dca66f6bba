"""The density by linear binning and convolution against the exact curve and its stated error bound."""

import math

import numpy as np
import pytest

from loadlens.operators import density


def values(kind, n, rng):
    return {"normal": rng.normal(100, 15, n), "skewed": rng.exponential(1, n) ** 3, "few": rng.choice([1.0, 2.0, 50.0], n),
            "tail": np.concatenate([rng.normal(0, 1, n - 1), [1e4]]), "two": np.array([0.0] * (n - 1) + [1.0])}[kind]


@pytest.mark.parametrize("kind", ["normal", "skewed", "few", "tail", "two"])
@pytest.mark.parametrize("n", [40, 3000])
def test_error_bound(spark, kind, n):
    v = values(kind, n, np.random.default_rng(n))
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double").repartition(3)
    got = {r["i"]: r for r in density.kde_by_convolution(df, "v").collect()}
    h = float(np.std(v, ddof=1)) * n ** -0.2
    lo, hi = float(v.min()), float(v.max())
    x = lo + np.arange(500) * (hi - lo) / 500
    exact = np.exp(-0.5 * ((x[:, None] - v[None]) / h) ** 2).sum(axis=1) / (n * h * math.sqrt(2 * math.pi))
    assert sorted(got) == list(range(500))
    assert np.allclose([got[i]["x"] for i in range(500)], x)
    bound = 1 / density.CELLS_PER_BANDWIDTH ** 2 / 8 / (h * math.sqrt(2 * math.pi))
    worst = max(abs(got[i]["density"] - exact[i]) for i in range(500))
    assert worst <= bound * (1 + 1e-6), (kind, worst / bound)
    step = (hi - lo) / 500  # the curve still holds all the weight that lies over its grid
    assert sum(r["density"] for r in got.values()) * step == pytest.approx(exact.sum() * step, rel=1e-3)


def test_nothing_to_show(spark):
    for rows in ([], [(1.0,)], [(1.0,), (1.0,)], [(None,), (float("nan"),)]):
        assert density.kde_by_convolution(spark.createDataFrame(rows, "v double"), "v").count() == 0
    with pytest.raises(ValueError):
        density.kde_by_convolution(spark.range(3), "id", grid=1)


def test_no_shuffle_of_values(spark):
    """Behind the scan stands a partial aggregate by fine cell; what is exchanged is that aggregate."""
    df = spark.range(100_000).selectExpr("cast(id % 977 as double) as v")
    text = density.kde_by_convolution(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" not in text and "NestedLoop" not in text and "partial_count" in text
