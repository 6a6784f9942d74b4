"""Resamples of flowers, and the numbers they are drawn with."""

import math

import numpy as np
from pyspark.sql import functions as F

from meadow.functions import randoms
from meadow.operators import curve, dose
from tests.compare import connection


def test_random_numbers_are_the_same_everywhere(spark, sf):
    df = spark.range(2000).withColumn("s", F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id"))))
    rows = df.select("id", "s", randoms.uniform(F.col("id"), F.col("s")).alias("u"), randoms.normal(F.col("id"), F.col("s")).alias("z")).collect()
    u = np.array([randoms.uniform_of(r.id, r.s) for r in rows])
    assert [r.u for r in rows] == u.tolist() and np.allclose([r.z for r in rows], randoms.quantiles(u), rtol=0, atol=1e-12)
    sql = connection(sf).execute(f"SELECT u, {randoms.quantile_sql('u')} FROM (SELECT {randoms.uniform_sql('id', 's')} AS u FROM (SELECT id, CASE WHEN id % 7 = 0 THEN '' ELSE 'k' || id END AS s FROM range(2000) r(id)) ORDER BY id)").fetchall()
    assert [x[0] for x in sql] == [r.u for r in sorted(rows)] and np.allclose([x[1] for x in sql], [r.z for r in sorted(rows)], rtol=0, atol=1e-12)
    assert abs(u.mean() - 0.5) < 0.03 and abs(np.std([r.z for r in rows]) - 1) < 0.06
    for x in (1e-9, 0.01, 0.3, 0.5, 0.9, 1 - 1e-9):
        z = float(randoms.quantiles(np.array([x]))[0])
        assert abs(0.5 * math.erfc(-z / math.sqrt(2)) - x) < 2e-9 * max(x, 1e-3) + 1e-15 or abs(0.5 * math.erfc(-z / math.sqrt(2)) / x - 1) < 1e-7


def flowers(spark, n, seed=3, places=None):
    rng = np.random.default_rng(seed)
    v = rng.uniform(0, 40, n)
    v = v if places is None else v.round(places)
    y = (rng.random(n) < 0.2 + 0.5 * (1 - np.exp(-0.15 * v))).astype(int)
    return v, y, spark.createDataFrame([("c", float(a), int(b)) for a, b in zip(v, y)], "crop string, V double, y int")


def test_intervals_are_those_of_resampled_flowers(spark):
    """5,000 flowers, more doses than a group keeps apart, against resamples of the flowers one by one."""
    v, y, rows = flowers(spark, 5000)
    got = curve.intervals(curve.bootstrap_flowers(rows, draws=200)).first()
    rng, fits = np.random.default_rng(1), []
    for _ in range(200):
        i = rng.integers(0, len(v), len(v))
        edges = np.unique(np.quantile(v[i], np.arange(21) / 20))
        into = np.maximum(1, np.searchsorted(edges, v[i], "left"))
        n, total, hits = (np.bincount(into, w)[1:] for w in (np.ones(len(i)), v[i], y[i]))
        fits.append(curve._best_curve(total / n, hits / n, n, curve.DOSE, 81, 2))
    for k, c in enumerate(("F0", "Fmax", "k")):
        want = np.quantile([f[k] for f in fits], [0.025, 0.975])
        width = want[1] - want[0]
        assert abs(got[f"{c}_lo"] - want[0]) < 0.2 * width and abs(got[f"{c}_hi"] - want[1]) < 0.2 * width


def test_sketched_doses_are_near_the_exact_ones(spark):
    v, y, rows = flowers(spark, 5000)
    for most in (16, 64, 4096):
        got = sorted(curve.flower_values(rows, most=most).collect(), key=lambda r: r.at)
        assert len(got) <= most and sum(r.n for r in got) == 5000 and sum(r.hits for r in got) == y.sum()
        assert [r.V for r in got] == sorted(r.V for r in got) and max(r.n for r in got) <= 5000 * 2.3 / most + 2
    few = flowers(spark, 3000, places=0)
    assert {r.V: (r.n, r.hits) for r in curve.flower_values(few[2]).collect()} == {x: (float((few[0] == x).sum()), float(few[1][few[0] == x].sum())) for x in np.unique(few[0])}


def test_one_fit_is_the_fit_of_the_bins(spark):
    _, _, rows = flowers(spark, 2000)
    bins = dose.binned(rows)
    a, b = curve.fitted(bins).first(), bins.orderBy("bin").collect()
    got = curve._best_curve(*(np.array([r[c] for r in b], float) for c in ("mean_v", "rate", "n")), curve.DOSE, 81, 2)
    assert np.allclose(got, [a.F0, a.Fmax, a.k], rtol=1e-6)


def test_resamples_of_hardly_any_flowers(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("b", 0.0, 0), ("b", 0.0, 1), (None, 3.0, 1)], "crop string, V double, y int")
    got = curve.bootstrap_flowers(rows, draws=30).collect()
    assert {r.crop for r in got} <= {"a", "b", None} and all(0 <= r.F0 <= 1 and 0 <= r.Fmax <= 1 for r in got)
    assert curve.bootstrap_flowers(rows.limit(0), draws=30).count() == 0
