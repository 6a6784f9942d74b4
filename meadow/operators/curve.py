"""The saturating response F0 + (Fmax - F0) (1 - exp(-k V)): fits, draws, bands, posterior and yield.

A fit sees binned sums only (bin counts are bounded), so its size doesn't depend on the number of flowers. Given k the
curve is linear, so k runs over a grid and the other two come from sums; the loss is flat in k, so compare losses.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meadow.functions.randoms import normal, quantiles, uniform, uniform_of
from meadow.operators.dose import alike
from meadow.params import DOSE, DoseParams

#: Crop tables: F0, Fmax, the dose of 95 % saturation, seed-set coupling of the fruit mass, mass in kg.
CROPS = {"pomegranate": (0.45, 0.90, 8.0, 0.25, 0.30), "cucumber": (0.05, 0.80, 6.0, 0.30, 0.25)}
DEFAULT_CROP = "pomegranate"


def response(v: Column, f0: Column, fmax: Column, k: Column) -> Column:
    return f0 + (fmax - f0) * (1 - F.exp(-k * v))


def k_of(v_star: Column) -> Column:
    """The rate that saturates to 95 % at v_star."""
    return 3 / v_star


def v_star(k: Column) -> Column:
    return 3 / k


def _log_grid(low: float, high: float, points: int) -> list[float]:
    return [math.exp(math.log(low) + i * (math.log(high) - math.log(low)) / (points - 1)) for i in range(points)]


def _clamped(c: Column, low: float | Column = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(low if isinstance(low, Column) else F.lit(low), c))


def _solved(bins: DataFrame, by: list[str], f0: str | None = None, fmax: float | None = None) -> DataFrame:
    """Least squares for each (by, k) of bins(by, k, mean_v, rate, n): F0, Fmax in [0, 1] and the loss. Either may be given."""
    x = 1 - F.exp(-F.col("k") * F.col("mean_v"))
    w, y = F.col("n"), F.col("rate")
    given = [F.first(f0).alias("a0")] if f0 else []
    s = bins.groupBy(*by, "k").agg(F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * x * x).alias("xx"), F.sum(w * y).alias("y"), F.sum(w * x * y).alias("xy"), F.sum(w * y * y).alias("yy"), *given)
    det = F.col("w") * F.col("xx") - F.col("x") * F.col("x")
    if f0:
        a = F.col("a0")
    elif fmax is not None:
        # y - fmax x = a (1 - x)
        a = F.try_divide(F.col("y") - F.col("xy") - fmax * (F.col("x") - F.col("xx")), F.col("w") - 2 * F.col("x") + F.col("xx"))
    else:
        a = F.try_divide(F.col("y") * F.col("xx") - F.col("x") * F.col("xy"), det)
    s = s.withColumn("F0", _clamped(F.coalesce(a, F.col("y") / F.col("w"))))
    b = F.lit(fmax) - F.col("F0") if fmax is not None else F.coalesce(F.try_divide(F.col("xy") - F.col("F0") * F.col("x"), F.col("xx")), F.lit(0.0))
    s = s.withColumn("Fmax", _clamped(F.col("F0") + b))
    c = F.col("Fmax") - F.col("F0")
    loss = F.col("yy") - 2 * (F.col("F0") * F.col("y") + c * F.col("xy")) + F.col("F0") ** 2 * F.col("w") + 2 * F.col("F0") * c * F.col("x") + c * c * F.col("xx")
    return s.select(*by, "k", "F0", "Fmax", loss.alias("loss"))


def fitted(bins: DataFrame, by: tuple[str, ...] = ("crop",), p: DoseParams = DOSE, points: int = 81, refine: int = 2, f0: str | None = None, fmax: float | None = None) -> DataFrame:
    """by, F0, Fmax, k, loss of bins(by, mean_v, rate, n). `f0` names a column that anchors F0, `fmax` pins Fmax."""
    by_, best, step = list(by), None, (math.log(p.k_max) - math.log(p.k_min)) / (points - 1)
    for level in range(refine + 1):
        if best is None:
            grid = bins.withColumn("k", F.explode(F.array(*[F.lit(k) for k in _log_grid(p.k_min, p.k_max, points)])))
        else:
            near = F.array(*[F.col("k0") * math.exp(step * (2 * i / (points - 1) - 1)) for i in range(points)])
            grid = bins.join(best.select(*by_, F.col("k").alias("k0")), by_).withColumn("k", F.explode(near)).withColumn("k", _clamped(F.col("k"), p.k_min, p.k_max))
            step *= 2 / (points - 1)
        all_ = _solved(grid, by_, f0, fmax)
        best = all_.groupBy(*by_).agg(F.min_by(F.struct("F0", "Fmax", "k", "loss"), F.struct(F.round("loss", 12), "k")).alias("_best")).select(*by_, "_best.*")
    return best


def anchors(df: DataFrame, by: tuple[str, ...] = ("crop",), p: DoseParams = DOSE) -> DataFrame:
    """F0 of the flowers that hardly any insect visits; null where there are fewer than anchor_n of them."""
    low = F.col("V") <= p.anchor_v
    return df.groupBy(*by).agg(F.when(F.count_if(low) >= p.anchor_n, F.avg(F.when(low, F.col("y")))).alias("f0_anchor"))


def _poisson(mean: Column, *key: Column) -> Column:
    """Poisson draw: its inverse by a running sum up to 30, beyond that the rounded normal one."""
    u = uniform(*key)
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))
    step = lambda a, i: F.when(a["c"] < u, F.struct((a["p"] * mean / i).alias("p"), (a["c"] + a["p"] * mean / i).alias("c"), i.alias("n"))).otherwise(a)
    small = F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, step)["n"].cast("double")
    return F.when(mean <= 30, small).otherwise(F.greatest(F.lit(0.0), F.round(mean + F.sqrt(mean) * normal(*key))))


def bootstrap(bins: DataFrame, draws: int = 400, seed: int = 42, by: tuple[str, ...] = ("crop",), rebin: int | None = None, **how) -> DataFrame:
    """Fits of `draws` Poisson resamples: by, b, F0, Fmax, k.

    A flower drawn Poisson(1) times makes a bin's successes Poisson(successes) and its failures Poisson(failures), so a
    resample of flowers is one of bins, however many flowers there are. With `rebin`, `bins` are fine ones (two hundred,
    say), and each resample is cut anew into so many bins of equal weight, as a resample of the flowers would be.
    """
    all_ = bins.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    key = [*[F.col(c) for c in by], F.col("bin"), F.col("b"), F.lit(seed)]
    hits = all_.withColumn("h", _poisson(F.col("hits"), *key, F.lit(1))).withColumn("m", _poisson(F.col("n") - F.col("hits"), *key, F.lit(2)))
    again = hits.withColumn("n", F.col("h") + F.col("m")).where("n > 0")
    if rebin:
        one = Window.partitionBy(*by, "b")
        upto = F.sum("n").over(one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        again = again.withColumn("into", F.ceil(upto / F.sum("n").over(one) * rebin)).groupBy(*by, "b", "into").agg((F.sum(F.col("mean_v") * F.col("n")) / F.sum("n")).alias("mean_v"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    again = again.withColumn("rate", F.col("h") / F.col("n"))
    return fitted(again.select(*by, "b", "mean_v", "rate", "n"), (*by, "b"), **how).select(*by, "b", "F0", "Fmax", "k")


#: Doses of a group that a resample tells apart: a square number.
FLOWERS = 4096


def flower_values(rows: DataFrame, by: tuple[str, ...] = ("crop",), most: int = FLOWERS) -> DataFrame:
    """by, at, V, hits, n of rows(by, V, y): flowers that are alike, numbered by V.

    A group with no more than `most` different doses keeps them all. In others the doses are put into that many ranges, with
    edges from Spark's mergeable quantile sketch, so that ranks are off by 1.1 in `most` at most, and stand at their means.
    """
    doses = alike(rows, by).select(*by, "V", "hits", F.col("n").cast("double").alias("n"))
    few = doses.groupBy(*by).agg(F.count("*").alias("doses")).withColumn("few", F.col("doses") <= most).select(*by, "few")
    marked = doses.join(F.broadcast(few), list(by))
    exact = marked.where("few").withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("V")))
    root = math.isqrt(most)
    sketch = rows.join(F.broadcast(few.where("NOT few")), list(by)).groupBy(*by).agg(F.percentile_approx("V", F.array(*[F.lit(i / most) for i in range(1, most)]), 10 * most).alias("edges"))
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(root), F.size("edges"), F.lit(root)), lambda i: F.element_at("edges", i)), lambda e: e < F.col("V")))
    fine = F.size(F.filter(F.slice("edges", coarse * root + 1, F.lit(root)), lambda e: e < F.col("V")))
    ranged = marked.where("NOT few").join(F.broadcast(sketch), list(by)).withColumn("at", coarse * root + fine)
    ranged = ranged.groupBy(*by, "at").agg((F.sum(F.col("V") * F.col("n")) / F.sum("n")).alias("V"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    columns = [*by, "at", "V", "hits", "n"]
    return exact.select(*columns).unionByName(ranged.select(*columns))


def _poissons(mean: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Poisson draws of uniform numbers: the inverse by a running sum up to 30, beyond that the rounded normal one."""
    p = np.exp(-mean)
    below, n = p.copy(), np.zeros(len(mean))
    for i in range(1, 91):
        more = below < u
        p = np.where(more, p * mean / i, p)
        below, n = np.where(more, below + p, below), np.where(more, i, n)
    return np.where(mean <= 30, n, np.maximum(0, np.floor(mean + np.sqrt(mean) * quantiles(u) + 0.5)))


def _cut_again(v: np.ndarray, hits: np.ndarray, n: np.ndarray, bins: int) -> tuple[np.ndarray, ...]:
    """mean V, rate and n of the quantile bins of values v (ascending) that occur n times."""
    there = n > 0
    v, hits, n = v[there], hits[there], n[there]
    upto = np.cumsum(n)
    place = np.arange(bins + 1) / bins * (upto[-1] - 1)
    low, high = (v[np.searchsorted(upto, f(place), "right")] for f in (np.floor, np.ceil))
    edges = np.unique(low + (high - low) * (place - np.floor(place)))
    into = np.maximum(1, np.searchsorted(edges, v, "left"))
    sums = [np.bincount(into, x)[1:] for x in (n, n * v, hits)]
    some = sums[0] > 0
    size, total, hit = (x[some] for x in sums)
    return total / size, hit / size, size


def _best_curve(v: np.ndarray, rate: np.ndarray, n: np.ndarray, p: DoseParams, points: int, refine: int) -> tuple[float, float, float]:
    """F0, Fmax, k of one set of bins, on the grids of fitted()."""
    step, best, k = (math.log(p.k_max) - math.log(p.k_min)) / (points - 1), None, np.array(_log_grid(p.k_min, p.k_max, points))
    for level in range(refine + 1):
        if level:
            k = np.clip(best[2] * np.exp(step * (2 * np.arange(points) / (points - 1) - 1)), p.k_min, p.k_max)
            step *= 2 / (points - 1)
        x = 1 - np.exp(-k[:, None] * v)
        w, sx, sxx, y, xy, yy = n.sum(), (n * x).sum(1), (n * x * x).sum(1), (n * rate).sum(), (n * x * rate).sum(1), (n * rate * rate).sum()
        with np.errstate(all="ignore"):
            det = w * sxx - sx * sx
            f0 = np.clip(np.where(det == 0, y / w, (y * sxx - sx * xy) / det), 0, 1)
            fmax = np.clip(f0 + np.where(sxx == 0, 0, (xy - f0 * sx) / sxx), 0, 1)
        c = fmax - f0
        loss = yy - 2 * (f0 * y + c * xy) + f0 * f0 * w + 2 * f0 * c * sx + c * c * sxx
        i = np.lexsort([k, np.floor(loss * 1e12 + 0.5)])[0]
        best = f0[i], fmax[i], k[i]
    return best


def bootstrap_flowers(rows: DataFrame, draws: int = 400, seed: int = 42, by: tuple[str, ...] = ("crop",), bins: int = DOSE.bins, p: DoseParams = DOSE, points: int = 81, refine: int = 2, block: int = 10) -> DataFrame:
    """Fits of `draws` resamples of the flowers of rows(by, V, y): by, b, F0, Fmax, k.

    A flower is drawn Poisson(1) times. Flowers of one dose and outcome are alike, so their number in a resample is one Poisson
    draw, from a hash of (by, dose, draw). Each resample has quantile edges of its own and is cut and fitted like the flowers.
    A group is one row of bounded size here, and its draws are dealt to tasks in blocks.
    """
    values = flower_values(rows, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "V", "hits", "n"))).alias("values"))
    parts = values.withColumn("first", F.explode(F.sequence(F.lit(1), F.lit(draws), F.lit(block))))
    n = max(1, min(-(-draws // block), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                at = [x["at"] for x in r["values"]]
                v, hits, all_ = (np.array([x[c] for x in r["values"]]) for c in ("V", "hits", "n"))
                group = [r[c] for c in by]
                for b in range(r["first"], min(r["first"] + block, draws + 1)):
                    u = [np.array([uniform_of(*group, a, b, seed, side) for a in at]) for side in (1, 2)]
                    hit, miss = _poissons(hits, u[0]), _poissons(all_ - hits, u[1])
                    if (hit + miss).sum() > 0:
                        out.append((*group, b, *_best_curve(*_cut_again(v, hit, hit + miss, bins), p, points, refine)))
            yield pd.DataFrame(out, columns=[*by, "b", "F0", "Fmax", "k"])

    return parts.repartition(n, *by, "first").mapInPandas(work, f"{kinds}, b int, F0 double, Fmax double, k double")


def intervals(draws: DataFrame, by: tuple[str, ...] = ("crop",), level: float = 0.95) -> DataFrame:
    low, high = (1 - level) / 2, (1 + level) / 2
    return draws.groupBy(*by).agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_{n}") for c in ("F0", "Fmax", "k") for n, q in (("lo", low), ("hi", high))])


def fit_report(fit: DataFrame, ci: DataFrame, scores: DataFrame, truth: DataFrame | None = None, by: tuple[str, ...] = ("crop",)) -> DataFrame:
    """One row per crop: curve, saturation dose, intervals and scores, rounded; known truth beside it if there is one."""
    out = fit.withColumn("v_star", v_star(F.col("k"))).join(ci, list(by)).join(scores, list(by))
    if truth is not None:
        out = out.join(truth, list(by), "left")
    return out.select(*by, *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c not in by])


def draws_from_report(report: DataFrame, draws: int = 400, seed: int = 42, by: str = "crop") -> DataFrame:
    """Draws rebuilt from a saved curve: normal around each value, as wide as its 95 % interval says."""
    b = report.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    one = lambda c, i: F.col(c) + (F.col(f"{c}_hi") - F.col(f"{c}_lo")) / 3.92 * normal(F.col(by), F.col("b"), F.lit(seed), F.lit(i))
    return b.select(by, "b", _clamped(one("F0", 1)).alias("F0"), _clamped(one("Fmax", 2)).alias("Fmax"), F.greatest(one("k", 3), F.lit(DOSE.k_min)).alias("k"))


def set_band(draws: DataFrame, doses: list[float], level: float = 0.95, by: str = "crop") -> DataFrame:
    """Mean and band of the fruit set at each dose."""
    at = draws.withColumn("dose", F.explode(F.array(*[F.lit(float(d)) for d in doses])))
    at = at.withColumn("f", response(F.col("dose"), F.col("F0"), F.col("Fmax"), F.col("k")))
    return at.groupBy(by, "dose").agg(F.avg("f").alias("mean"), F.percentile("f", F.lit((1 - level) / 2)).alias("lo"), F.percentile("f", F.lit((1 + level) / 2)).alias("hi"))


def yield_band(draws: DataFrame, dose: float, n_flowers: int, mass_kg: float, noise: bool = True, seed: int = 42, level: float = 0.95, by: str = "crop") -> DataFrame:
    """Yield at one dose: parameters from the draws, and binomial noise by its normal approximation."""
    f = response(F.lit(float(dose)), F.col("F0"), F.col("Fmax"), F.col("k"))
    z = normal(F.col(by), F.col("b"), F.lit(seed)) if noise else F.lit(0.0)
    fruits = F.greatest(F.lit(0.0), F.least(F.lit(float(n_flowers)), n_flowers * f + F.sqrt(n_flowers * f * (1 - f)) * z))
    at = draws.withColumn("kg", fruits * mass_kg)
    return at.groupBy(by).agg(F.avg("kg").alias("mean_kg"), F.percentile("kg", F.lit((1 - level) / 2)).alias("lo_kg"), F.percentile("kg", F.lit((1 + level) / 2)).alias("hi_kg"))


def orchard_yield(draws: DataFrame, flowers: DataFrame, mass_kg: float, gain: float = 0.0, noise: bool = False, seed: int = 42, by: str = "crop") -> DataFrame:
    """Yield summed over flowers(by, V), each at its own dose, fruit mass rising with its set; and how far the set at the
    mean dose lies above the mean set. Flowers are summed to distinct doses first, then meet the distinct draws, which
    count as often as they occur; with noise, each b has its own."""
    doses = flowers.groupBy(by, "V").agg(F.count("*").alias("n"))
    key = [by, "F0", "Fmax", "k"] + (["b"] if noise else [])
    at = doses.join(draws.groupBy(*key).agg(F.count("*").alias("w")), by).withColumn("f", response(F.col("V"), F.col("F0"), F.col("Fmax"), F.col("k")))
    mass = mass_kg * (1 + gain * (F.col("f") - F.col("F0")))
    z = F.sqrt(F.col("n") * F.col("f") * (1 - F.col("f"))) * normal(F.col(by), F.col("b"), F.col("V"), F.lit(seed)) if noise else F.lit(0.0)
    one = at.groupBy(*key, "w").agg(F.sum((F.col("n") * F.col("f") + z) * mass).alias("kg"), F.sum(F.col("n") * F.col("f")).alias("sf"), F.sum(F.col("n") * F.col("V")).alias("sv"), F.sum("n").alias("n"))
    jensen = response(F.col("sv") / F.col("n"), F.col("F0"), F.col("Fmax"), F.col("k")) - F.col("sf") / F.col("n")
    mean = lambda c: F.sum(c * F.col("w")) / F.sum("w")
    return one.groupBy(by).agg(mean(F.col("kg")).alias("mean_kg"), F.percentile("kg", F.lit(0.025), F.col("w")).alias("lo_kg"), F.percentile("kg", F.lit(0.975), F.col("w")).alias("hi_kg"), mean(jensen).alias("jensen"), F.max("n").alias("n_flowers"))


def crop_params(rows: DataFrame, crops: dict = CROPS) -> DataFrame:
    """rows(crop, ...) with the parameters of their crop; unknown crops get those of the default one."""
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame([(c, *map(float, v)) for c, v in crops.items()], "crop string, F0 double, Fmax double, v_sat double, gain double, mass_kg double"))
    one = F.broadcast(spark.createDataFrame([tuple(map(float, crops[DEFAULT_CROP]))], "dF0 double, dFmax double, dv double, dg double, dm double"))
    return rows.join(table, "crop", "left").join(one).select(*rows.columns, *[F.coalesce(a, b).alias(a) for a, b in (("F0", "dF0"), ("Fmax", "dFmax"), ("v_sat", "dv"), ("gain", "dg"), ("mass_kg", "dm"))])


def estimate(totals: DataFrame, gate: float = 1.0) -> DataFrame:
    """totals(crop, dose, n_flowers): fruit set, yield with mass coupling, deficit against saturation (%) and gain of one more visit."""
    at = crop_params(totals)
    k, v = k_of(F.col("v_sat")), F.col("dose") * gate / F.greatest("n_flowers", F.lit(1))
    f = response(v, F.col("F0"), F.col("Fmax"), k)
    top = F.col("Fmax")
    mass = lambda s: F.col("mass_kg") * (1 + F.col("gain") * (s - F.col("F0")))
    kg = lambda s: F.col("n_flowers") * s * mass(s)
    return at.select("crop", "dose", "n_flowers", f.alias("fruit_set"), kg(f).alias("yield_kg"), ((1 - F.try_divide(kg(f), kg(top))) * 100).alias("deficit_pct"), ((F.col("Fmax") - F.col("F0")) * k * F.exp(-k * v)).alias("gain_per_visit"))


def sweep(fits: DataFrame, doses: list[float], by: str = "crop") -> DataFrame:
    at = fits.withColumn("dose", F.explode(F.array(*[F.lit(float(d)) for d in doses])))
    return at.select(by, "dose", response(F.col("dose"), F.col("F0"), F.col("Fmax"), F.col("k")).alias("fruit_set"))


def field_fit(rows: DataFrame, by: tuple[str, ...] = ("crop",), **how) -> DataFrame:
    """Fit on field data: visitation V and yield as a share of its group's greatest one.

    Rows of one V enter as their mean, so the grid of rates meets distinct values only; what they differ by among
    themselves is added to the loss. The parameters are those of a fit of the rows one by one.
    """
    top = rows.groupBy(*by).agg(F.max("y").alias("_top"))
    share = rows.join(top, list(by)).where("_top > 0").select(*by, F.col("V").alias("mean_v"), (F.col("y") / F.col("_top")).alias("s"))
    rest = F.greatest(F.lit(0.0), F.sum(F.col("s") * F.col("s")) - F.sum("s") * F.sum("s") / F.count("*"))
    bins = share.groupBy(*by, "mean_v").agg(F.avg("s").alias("rate"), F.count("*").cast("double").alias("n"), rest.alias("rest"))
    more = bins.groupBy(*by).agg(F.sum("rest").alias("rest"))
    return fitted(bins.drop("rest"), by, **how).join(more, list(by)).withColumn("loss", F.col("loss") + F.col("rest")).drop("rest")


def posterior(bins: DataFrame, f0: DataFrame, fmax_prior: tuple[float, float] = (0.72, 0.10), k_prior: tuple[float, float] = (0.3, 0.5), points: int = 61, by: str = "crop") -> DataFrame:
    """Posterior of (Fmax, ln k) on a grid: binomial likelihood of the bins, normal priors on Fmax and ln k, F0 given.

    f0(by, f0). Support: f0 < Fmax < 0.999, -6 < ln k < 4. Returns means and the 2.5 and 97.5 % points of both.
    """
    lk = [-6 + 10 * (i + 0.5) / points for i in range(points)]
    share = [(i + 0.5) / points for i in range(points)]
    cells = f0.select(by, "f0", F.explode(F.array(*[F.lit(s) for s in share])).alias("s")).select("*", F.explode(F.array(*[F.lit(x) for x in lk])).alias("lk"))
    cells = cells.withColumn("Fmax", F.col("s") * 0.999).where("Fmax > f0")
    clip = lambda c: F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), c))
    p = clip(response(F.col("mean_v"), F.col("f0"), F.col("Fmax"), F.exp("lk")))
    ll = cells.join(bins, by).groupBy(by, "Fmax", "lk").agg(F.sum(F.col("hits") * F.ln(p) + (F.col("n") - F.col("hits")) * F.ln(1 - p)).alias("ll"))
    prior = -(((F.col("Fmax") - fmax_prior[0]) / fmax_prior[1]) ** 2) / 2 - ((F.col("lk") - math.log(k_prior[0])) / k_prior[1]) ** 2 / 2
    lp = ll.withColumn("lp", F.col("ll") + prior)
    w = F.exp(F.col("lp") - F.max("lp").over(Window.partitionBy(by)))
    weighted = lp.withColumn("w", w)
    out = weighted.groupBy(by).agg((F.sum(F.col("w") * F.col("Fmax")) / F.sum("w")).alias("fmax_mean"), (F.sum(F.col("w") * F.exp("lk")) / F.sum("w")).alias("k_mean"))
    for c, name in (("Fmax", "fmax"), ("lk", "lk")):
        side = weighted.groupBy(by, c).agg(F.sum("w").alias("w"))
        up = Window.partitionBy(by).orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
        cum = side.withColumn("c", F.sum("w").over(up) / F.sum("w").over(Window.partitionBy(by)))
        ends = cum.groupBy(by).agg(*[F.min(F.when(F.col("c") >= q, F.col(c))).alias(f"{name}_{n}") for n, q in (("lo", 0.025), ("hi", 0.975))])
        out = out.join(ends, by)
    return out


def posterior_f0(df: DataFrame, p: DoseParams = DOSE, by: str = "crop") -> DataFrame:
    """F0 for the posterior: the rate among V <= anchor_v if there are enough, else among the lowest 5 % of V."""
    doses = alike(df, (by,))
    low = doses.groupBy(by).agg(F.percentile("V", F.lit(0.05), F.col("n")).alias("q"), F.sum(F.when(F.col("V") <= p.anchor_v, F.col("n"))).alias("low"))
    limit = F.when(F.col("low") >= p.anchor_n, F.lit(p.anchor_v)).otherwise(F.col("q"))
    return doses.join(F.broadcast(low), by).where(F.col("V") <= limit).groupBy(by).agg(F.try_divide(F.sum("hits"), F.sum("rated")).alias("f0"))


def prior_sensitivity(bins: DataFrame, f0: DataFrame, mean: float = 0.72, wide: float = 0.25, narrow: float = 0.05, by: str = "crop", **how) -> DataFrame:
    """How far the mean of Fmax moves from a wide to a narrow prior."""
    a = posterior(bins, f0, (mean, wide), by=by, **how).select(by, F.col("fmax_mean").alias("wide"))
    b = posterior(bins, f0, (mean, narrow), by=by, **how).select(by, F.col("fmax_mean").alias("narrow"))
    return a.join(b, by).select(by, "wide", "narrow", F.abs(F.col("wide") - F.col("narrow")).alias("shift"))
