"""From visits to an effective dose per flower, and binned responses to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meadow.operators.episodes import weight
from meadow.params import DOSE, DoseParams

VISITS = "flower_id string, species string, dwell_seconds double, velocity double, fraction_on double, weight double, confidence double"


def canonical_visits(table: DataFrame, p: DoseParams = DOSE) -> DataFrame:
    """The seven canonical columns from either layout: landings (landing_s, insect_type, video), or visits as they are."""
    have = set(table.columns)
    if "landing_s" in have:
        return table.select(
            F.concat_ws("::", F.col("video").cast("string"), F.col("flower_id").cast("string")).alias("flower_id"),
            F.col("insect_type").alias("species"),
            F.col("landing_s").cast("double").alias("dwell_seconds"),
            F.lit(None).cast("double").alias("velocity"),
            F.lit(None).cast("double").alias("fraction_on"),
            (F.col("pollination_weight").cast("double") if "pollination_weight" in have else weight(F.col("insect_type"), p.weights, p.default_weight)).alias("weight"),
            (F.col("conf_mean").cast("double") if "conf_mean" in have else F.lit(1.0)).alias("confidence"),
        )
    defaults = {"velocity": None, "fraction_on": None, "weight": 1.0, "confidence": 1.0, "species": ""}
    missing = [c.split()[0] for c in VISITS.split(", ") if c.split()[0] not in have | set(defaults)]
    if missing:
        raise ValueError(f"visits lack {', '.join(missing)}")
    return table.select(*[(F.col(n) if n in have else F.lit(defaults[n])).cast(t).alias(n) for n, t in (c.split() for c in VISITS.split(", "))])


def _gates(p: DoseParams) -> dict[str, Column]:
    return {"dwell_seconds": F.col("dwell_seconds") >= p.dwell_min, "velocity": F.col("velocity") <= p.velocity_max, "fraction_on": F.col("fraction_on") >= p.fraction_min}


def qualifying(visits: DataFrame, p: DoseParams = DOSE) -> DataFrame:
    """visits with `qualifies`. A gate whose column is null in all rows passes; a null in a column that has values fails its
    row. Which columns have values is one row of counts, joined in."""
    gates = _gates(p)
    filled = visits.agg(*[F.count(c).alias(f"_n_{c}") for c in gates])
    ok = F.lit(True)
    for c, gate in gates.items():
        ok = ok & ((F.col(f"_n_{c}") == 0) | F.coalesce(gate & ~F.isnan(c), F.lit(False)))
    return visits.crossJoin(F.broadcast(filled)).select(*visits.columns, ok.alias("qualifies"))


def applied_gates(visits: DataFrame, p: DoseParams = DOSE) -> list[str]:
    """The gates that have values to test."""
    filled = visits.agg(*[F.count(c).alias(c) for c in _gates(p)]).first().asDict()
    return [c for c, n in filled.items() if n]


def effectiveness(dwell: Column, w: Column, tau: float = DOSE.tau) -> Column:
    return w * (1 - F.exp(-dwell / tau))


def flower_doses(visits: DataFrame, p: DoseParams = DOSE) -> DataFrame:
    """Dose V, visits, qualifying ones, mean dwell and confidence per flower; flowers without a qualifying visit have V = 0."""
    marked = qualifying(visits, p)
    ok, eff = F.col("qualifies"), effectiveness(F.col("dwell_seconds"), F.col("weight"), p.tau)
    return marked.groupBy("flower_id").agg(
        F.coalesce(F.sum(F.when(ok, eff)), F.lit(0.0)).alias("V"),
        F.count("*").alias("n_visits"),
        F.count_if(ok).alias("n_qualifying"),
        F.coalesce(F.avg(F.when(ok, F.col("dwell_seconds"))), F.lit(0.0)).alias("mean_dwell"),
        F.avg("confidence").alias("mean_conf"),
    )


def dose_from_aggregates(df: DataFrame, p: DoseParams = DOSE) -> DataFrame:
    """df with V, by whichever columns it has: a score; counts n_<type> with mean_landing_s (missing dwell: the median);
    or older counts nq_<type> with weights w_<type>, scaled by a confidence between 0 and 1."""
    have = df.columns
    if "pollination_score" in have:
        return df.withColumn("V", F.col("pollination_score").cast("double"))
    counts = [c for c in have if c.startswith("n_") and c[2:] in p.weights]
    if counts:
        total = sum((F.coalesce(F.col(c), F.lit(0)) * p.weights[c[2:]] for c in counts), F.lit(0.0))
        if "mean_landing_s" not in have:
            return df.withColumn("V", total)
        middle = df.agg(F.median("mean_landing_s").alias("_m"))
        return df.join(F.broadcast(middle)).withColumn("V", total * (1 - F.exp(-F.coalesce("mean_landing_s", "_m") / p.tau))).drop("_m")
    old = [c[3:] for c in have if c.startswith("nq_") and f"w_{c[3:]}" in have]
    if not old:
        raise ValueError("no column to take a dose from")
    total = sum((F.coalesce(F.col(f"nq_{t}"), F.lit(0)) * F.col(f"w_{t}") for t in old), F.lit(0.0))
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))) if "confidence" in have else F.lit(1.0)
    return df.withColumn("V", total * conf)


def cleaned(df: DataFrame, top: float = 0.99) -> DataFrame:
    """Rows with a finite V and a label, V clipped to 0 and its exact top quantile over the whole frame."""
    fine = df.where("V IS NOT NULL AND y IS NOT NULL").where(~F.isnan("V") & (F.abs("V") < float("inf")))
    most = fine.agg(F.percentile("V", F.lit(top)).alias("_top"))
    return fine.join(F.broadcast(most)).withColumn("V", F.least("_top", F.greatest(F.lit(0.0), F.col("V")))).drop("_top")


def alike(df: DataFrame, by: tuple[str, ...] = ("crop",)) -> DataFrame:
    """by, V, hits, rated, n: flowers of one dose as one row, with the sum of y, how many have a y, and how many there are."""
    return df.groupBy(*by, "V").agg(F.sum("y").cast("double").alias("hits"), F.count("y").alias("rated"), F.count("*").alias("n"))


def binned(df: DataFrame, bins: int = DOSE.bins, by: tuple[str, ...] = ("crop",)) -> DataFrame:
    """Quantile bins of V within each group: mean V, rate of y, successes and rows.

    Edges are exact linear quantiles, equal ones counting once; bins are closed on the right, the first on both sides.
    The edges are one small row for each group, so they are sent to the doses; groups are few, and no task gets all rows of one.
    """
    shares = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    doses = alike(df, by)
    edges = doses.groupBy(*by).agg(F.array_distinct(F.percentile("V", shares, F.col("n"))).alias("edges"))
    placed = doses.join(F.broadcast(edges), list(by))
    at = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("V"))))
    there = F.sum(F.when(F.col("V").isNotNull(), F.col("n")))
    return placed.groupBy(*by, at.alias("bin")).agg((F.sum(F.col("V") * F.col("n")) / there).alias("mean_v"), F.try_divide(F.sum("hits"), F.sum("rated")).alias("rate"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))


def fit_scores(df: DataFrame, by: tuple[str, ...] = ("crop",)) -> DataFrame:
    """Log-loss of predictions p of y, that of the mean rate, their difference, AIC, BIC and the rarer class, per group."""
    w = Window.partitionBy(*by)
    clip = lambda c: F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), c))
    loss = lambda p: -(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))
    sums = df.groupBy(*by).agg(F.avg(loss(clip(F.col("p")))).alias("logloss"), F.sum("y").cast("double").alias("s"), F.count("*").alias("n"))
    q = clip(F.col("s") / F.col("n"))
    base = -(F.col("s") / F.col("n") * F.ln(q) + (1 - F.col("s") / F.col("n")) * F.ln(1 - q))
    nll = F.col("logloss") * F.col("n")
    return sums.select(*by, "logloss", base.alias("baseline"), (F.col("logloss") - base).alias("delta"), (6 + 2 * nll).alias("aic"), (3 * F.ln("n") + 2 * nll).alias("bic"), F.least("s", F.col("n") - F.col("s")).cast("long").alias("events"), "n")


def labelled(flowers: DataFrame, labels: DataFrame, key: str = "flower_id", bisexual_only: bool = False) -> DataFrame:
    """Flowers with their fruit set; `labels` must have the key and fruit_set, and flower_type counts only if it is there."""
    missing = {key, "fruit_set"} - set(labels.columns)
    if missing:
        raise ValueError(f"labels lack {', '.join(sorted(missing))}")
    if bisexual_only and "flower_type" in labels.columns:
        labels = labels.where(F.lower("flower_type") == "bisexual")
    return flowers.join(labels, key)


def confusion(df: DataFrame, predicted: str, actual: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and accuracy; 0 where there is nothing to divide by."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    n = df.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count("*").alias("n"))
    safe = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select(*by, "tp", "fp", "fn", "n", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(F.col("n") - fp - fn, F.col("n")).alias("accuracy"))


def inverse_weights(df: DataFrame, cls: str) -> DataFrame:
    """Each class with 1 / n (for a row of it) and total / n (for the class)."""
    n = df.groupBy(cls).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select(cls, "n", (1 / F.col("n")).alias("row_weight"), (F.col("total") / F.col("n")).alias("class_weight"))


def fit_quality(df: DataFrame, x: str, y: str, fitted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Correlation of x and y, and the share of y's variance that `fitted` explains."""
    a = df.groupBy(*by).agg(F.corr(x, y).alias("corr"), F.sum((F.col(y) - F.col(fitted)) ** 2).alias("res"), (F.var_pop(y) * F.count(y)).alias("tot"))
    return a.select(*by, "corr", F.coalesce(1 - F.try_divide("res", "tot"), F.lit(0.0)).alias("r2"))
