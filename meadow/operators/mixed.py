"""Binomial mixed model: a standardised dose and random intercepts of two groupings, by penalised reweighted least squares.

The intercepts of the larger grouping stay in a table. Each step sums the normal equations by pairs of groups, in Spark; their
part for the larger grouping is diagonal, so a task eliminates its groups one by one (each meets the few of the smaller
grouping that occur with it) and returns one system as large as the smaller grouping, which are added up on the driver.
With its solution the tasks find their groups' intercepts again. The driver holds a square matrix of the smaller grouping
(years, say), whatever the number of orchards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadow.functions.shared import drop_staged, staged

#: Intercept and slope come before the smaller grouping.
FIXED = 2


class _Model:
    """One crop: scale of the dose, fixed effects, intercepts of the smaller grouping, variances of both."""

    def __init__(self, facts, names: list[str]):
        self.mean, self.sd, self.n, self.larger = facts["mean"], facts["sd"] or 1.0, facts["n"], facts["larger"]
        self.at = {g: k for k, g in enumerate(sorted(names))}
        self.fixed, self.v = np.zeros(FIXED), np.zeros(len(self.at))
        self.var, self.cov, self.done = np.ones(2), np.zeros((FIXED, FIXED)), False
        self.inverse = self.solution = None

    def weights(self) -> np.ndarray:
        return 1 / np.maximum(self.var, 1e-6)

    def solve(self, left: np.ndarray, right: np.ndarray) -> None:
        own = np.concatenate([np.zeros(FIXED), np.full(len(self.v), self.weights()[1])])
        self.inverse = np.linalg.pinv(left + np.diag(own))
        self.solution = self.inverse @ right

    def step(self, squares: float, trace: float, moved: float) -> None:
        new = self.solution
        moved = max(moved, np.abs(new[FIXED:] - self.v).max(), np.abs(new[:FIXED] - self.fixed).max())
        self.fixed, self.v, self.cov = new[:FIXED], new[FIXED:], self.inverse
        self.var = np.array([(squares + trace) / self.larger, (self.v @ self.v + np.trace(self.inverse[FIXED:, FIXED:])) / len(self.v)])
        self.done = moved < 1e-6

    def report(self, turned: bool) -> dict:
        shown = self.var[::-1] if turned else self.var
        return {"slope": float(self.fixed[1]), "intercept": float(self.fixed[0]), "slope_se": float(np.sqrt(self.cov[1, 1])), "var": shown.tolist(), "n": self.n}


def _parts(r, at: dict[str, int], penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Of one group of the larger grouping: where its columns lie, its row of the equations there, its side of the small
    system, its diagonal and right-hand side."""
    j = np.array([FIXED + at[x["g"]] for x in r.others])
    w, wz, wzz, rest, rest_z = (np.array([x[c] for x in r.others]) for c in ("w", "wz", "wzz", "r", "rz"))
    where = np.concatenate([[0, 1], j])
    row = np.concatenate([[w.sum(), wz.sum()], w])
    small = np.zeros((len(where) + 1, len(where)))
    small[0, :2], small[1, :2] = [w.sum(), wz.sum()], [wz.sum(), wzz.sum()]
    small[0, 2:] = small[2:-1, 0] = w
    small[1, 2:] = small[2:-1, 1] = wz
    small[range(2, len(where)), range(2, len(where))] = w
    small[-1] = np.concatenate([[rest.sum(), rest_z.sum()], rest])
    return where, row, small, penalty + w.sum(), rest.sum()


def _eliminated(models: dict):
    """Each task's share of the small systems, flat: a row for each crop."""
    plain = {c: (m.at, float(m.weights()[0])) for c, m in models.items()}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for b in batches:
            for r in b.itertuples(index=False):
                at, penalty = plain[r.c]
                size = FIXED + len(at)
                left, right = sums.setdefault(r.c, (np.zeros((size, size)), np.zeros(size)))
                where, row, small, diagonal, rest = _parts(r, at, penalty)
                left[np.ix_(where, where)] += small[:-1] - np.outer(row, row) / diagonal
                right[where] += small[-1] - row * rest / diagonal
        yield pd.DataFrame({"c": list(sums), "left": [x[0].ravel().tolist() for x in sums.values()], "right": [x[1].tolist() for x in sums.values()]})

    return work


def _found(models: dict):
    """The larger grouping's intercepts by the solution, and what each adds to the trace."""
    plain = {c: (m.at, float(m.weights()[0]), m.solution, m.inverse) for c, m in models.items()}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                at, penalty, x, inverse = plain[r.c]
                where, row, _, diagonal, rest = _parts(r, at, penalty)
                over = row / diagonal
                out.append((r.c, r.g, (rest - row @ x[where]) / diagonal, 1 / diagonal + over @ inverse[np.ix_(where, where)] @ over, r.u))
            yield pd.DataFrame(out, columns=["c", "g", "u", "trace", "was"])

    return work


def fit_by(df: DataFrame, by: str, dose: str = "V", target: str = "y", groups: tuple[str, str] = ("orchard_id", "year"), steps: int = 12) -> dict:
    """A fit for each value of `by` (few): slope (log-odds per standard deviation), intercept, standard error, and the
    variances of the groups, in their order. All of them take a step in one pass over the rows.

    Which grouping is the larger one is settled by all rows; the smaller one must fit the driver as a square matrix.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sizes = df.agg(*[F.approx_count_distinct(text(g)).alias(f"n{i}") for i, g in enumerate(groups)]).first()
    turned = sizes["n0"] < sizes["n1"]
    large, few = groups[::-1] if turned else groups
    rows = df.select(F.col(by).alias("c"), F.col(dose).cast("double").alias("dose"), text(large).alias("g"), text(few).alias("h"), F.col(target).cast("double").alias("y"))
    # Rows of one dose and one pair of groups count together.
    rows = staged(rows.groupBy("c", "dose", "g", "h").agg(F.count("*").alias("m"), F.sum("y").alias("y")), "mixed")
    m, d = F.col("m"), F.col("dose")
    mean = F.sum(m * d) / F.sum("m")
    facts = rows.groupBy("c").agg(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(m * d * d) / F.sum("m") - mean * mean)).alias("sd"), F.sum("m").alias("n"), F.count_distinct("g").alias("larger")).collect()
    names: dict = {}
    for r in rows.select("c", "h").distinct().collect():
        names.setdefault(r["c"], []).append(r["h"])
    models = {r["c"]: _Model(r, names[r["c"]]) for r in facts}
    spark, kind = df.sparkSession, dict(rows.dtypes)["c"]
    held = known = staged(rows.select("c", "g").distinct().withColumn("u", F.lit(0.0)), "intercepts")
    for _ in range(steps):
        left = {c: x for c, x in models.items() if not x.done}
        if not left:
            break
        small = spark.createDataFrame([(c, h, float(x.v[k])) for c, x in left.items() for h, k in x.at.items()], f"c {kind}, h string, v double")
        whole = spark.createDataFrame([(c, x.mean, x.sd, *x.fixed.tolist()) for c, x in left.items()], f"c {kind}, mean double, sd double, base double, slope double")
        z = (d - F.col("mean")) / F.col("sd")
        eta = F.col("base") + F.col("u") + F.col("v") + z * F.col("slope")
        mu = 1 / (1 + F.exp(-eta))
        w = m * F.greatest(mu * (1 - mu), F.lit(1e-6))
        work = w * eta + F.col("y") - m * mu
        joined = rows.join(F.broadcast(whole), "c").join(known, ["c", "g"]).join(small, ["c", "h"])
        pairs = joined.groupBy("c", "g", "h").agg(F.any_value("u").alias("u"), F.sum(w).alias("w"), F.sum(w * z).alias("wz"), F.sum(w * z * z).alias("wzz"), F.sum(work).alias("r"), F.sum(work * z).alias("rz"))
        by_group = pairs.groupBy("c", "g").agg(F.any_value("u").alias("u"), F.collect_list(F.struct(F.col("h").alias("g"), "w", "wz", "wzz", "r", "rz")).alias("others"))
        by_group = staged(by_group, "equations")
        shares = by_group.mapInPandas(_eliminated(left), f"c {kind}, left array<double>, right array<double>").collect()
        for c, x in left.items():
            mine = [s for s in shares if s["c"] == c]
            size = FIXED + len(x.v)
            x.solve(sum(np.array(s["left"]) for s in mine).reshape(size, size), sum(np.array(s["right"]) for s in mine))
        found = staged(by_group.mapInPandas(_found(left), f"c {kind}, g string, u double, trace double, was double"), "intercepts")
        for r in found.groupBy("c").agg(F.sum(F.col("u") * F.col("u")).alias("squares"), F.sum("trace").alias("trace"), F.max(F.abs(F.col("u") - F.col("was"))).alias("moved")).collect():
            left[r["c"]].step(r["squares"], r["trace"], r["moved"])
        for table in (held, by_group):
            drop_staged(table)
        held, known = found, found.select("c", "g", "u")
    return {c: x.report(turned) for c, x in models.items()}


def fit_mixed(df: DataFrame, **how) -> dict:
    """The fit of all rows together."""
    fits = fit_by(df.withColumn("_all", F.lit("all")), "_all", **how)
    return fits.get("all", {"slope": 0.0, "intercept": 0.0, "slope_se": 0.0, "var": [0.0, 0.0], "n": 0})


def mixed_report(df: DataFrame, by: str = "crop", **how) -> DataFrame:
    """One row per crop."""
    fits = fit_by(df.where(F.col(by).isNotNull()), by, **how)
    rows = [(c, f["slope"], f["intercept"], f["slope_se"], *f["var"], f["n"]) for c, f in sorted(fits.items())]
    return df.sparkSession.createDataFrame(rows, f"{by} string, slope double, intercept double, slope_se double, var_0 double, var_1 double, n long")
