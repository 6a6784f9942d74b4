"""Queries without SQL use all of their rows."""

import numpy as np

from meadow.plans import bindings as b
from meadow.plans import registry, yields


def test_orchard_yield_of_all_draws(spark, sf):
    got = {r.crop: r for r in registry.queries()["m10_orchard_yield"](spark, sf).collect()}
    draws, rows = yields._draws(spark, sf).collect(), b.trial(spark, sf).selectExpr("crop", "round(V, 0) AS V").collect()
    assert got
    for crop, r in got.items():
        v, n = np.unique([x.V for x in rows if (x.crop == "F") == (crop == "pomegranate")], return_counts=True)
        at = np.array([(d.F0, d.Fmax, d.k) for d in draws if d.crop == crop]).T[:, :, None]
        f = at[0] + (at[1] - at[0]) * (1 - np.exp(-at[2] * v))
        kg = (n * f * 0.3 * (1 + 0.25 * (f - at[0]))).sum(1)
        mean = (n * v).sum() / n.sum()
        jensen = (at[0] + (at[1] - at[0]) * (1 - np.exp(-at[2] * mean)))[:, 0] - (n * f).sum(1) / n.sum()
        want = [kg.mean(), np.quantile(kg, 0.025), np.quantile(kg, 0.975), jensen.mean(), n.sum()]
        assert np.allclose([r.mean_kg, r.lo_kg, r.hi_kg, r.jensen, r.n_flowers], want, rtol=1e-6, atol=1e-4)


def test_all_detections_are_attributed(spark, sf):
    assert registry.queries()["j6_attributed"](spark, sf).count() == b.detections(spark, sf).count()
