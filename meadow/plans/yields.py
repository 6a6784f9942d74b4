"""Queries from visits to dose, curve and yield."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from meadow.functions.randoms import quantile_sql, uniform_sql
from meadow.operators import curve, dose, mixed
from meadow.params import DOSE
from meadow.plans import bindings as b
from meadow.plans.landing import LANDED, SUMMARY, a1_u2_flower_summary
from meadow.sources import readers

QUERIES, ORACLE = {}, {}
R = lambda c, n=6: F.round(c, n)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df, *keep, n=6):
    return df.select(*[F.round(c, n).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


VISITS = b.sql(*LANDED) + """, visits AS (SELECT video || '::' || flower_id AS flower_id, insect_type AS species, landing_s AS dwell_seconds, pollination_weight AS weight, conf_mean AS confidence FROM landings)
"""


@query(VISITS + "SELECT * FROM visits")
def s1_canonical_visits(spark, d):
    return dose.canonical_visits(b.landings(spark, d)).drop("velocity", "fraction_on")


@query(VISITS + ", g AS (SELECT *, dwell_seconds >= 2 AS qualifies FROM visits) SELECT flower_id, species, qualifies, count(*)::BIGINT AS n FROM g GROUP BY 1, 2, 3")
def p22_qualifying(spark, d):
    return dose.qualifying(dose.canonical_visits(b.landings(spark, d))).groupBy("flower_id", "species", "qualifies").agg(F.count("*").alias("n"))


@query(VISITS + """SELECT flower_id, round(coalesce(sum(CASE WHEN dwell_seconds >= 2 THEN weight * (1 - exp(-dwell_seconds / 5)) END), 0), 6) AS V, count(*)::BIGINT AS n_visits, (count(*) FILTER (dwell_seconds >= 2))::BIGINT AS n_qualifying,
round(coalesce(avg(dwell_seconds) FILTER (dwell_seconds >= 2), 0), 6) AS mean_dwell, round(avg(confidence), 6) AS mean_conf FROM visits GROUP BY 1""")
def a5_p23_j18_flower_doses(spark, d):
    return rounded(dose.flower_doses(dose.canonical_visits(b.landings(spark, d))))


P24 = """SELECT s.video, s.flower_id, round((10.0 * n_honeybee + 3.0 * n_bee + n_fly + 0.5 * n_beetle + 0.3 * n_bug + 0.5 * n_butterfly)::DOUBLE * (1 - exp(-mean_landing_s / 5.0::DOUBLE)), 6) AS V FROM summary s"""


@query(SUMMARY + P24)
def p24_dose_from_counts(spark, d):
    rows = a1_u2_flower_summary(spark, d).select("video", "flower_id", *[f"n_{t}" for t in DOSE.weights], "mean_landing_s")
    return dose.dose_from_aggregates(rows).select("video", "flower_id", R(F.col("V")).alias("V"))


@query(b.sql("trial") + ", q AS (SELECT quantile_cont(V, 0.99) AS top FROM trial) SELECT crop, y, round(sum(least(top, greatest(0, V))), 4) AS total, count(*)::BIGINT AS n FROM trial, q GROUP BY 1, 2")
def p25_cleaned(spark, d):
    return dose.cleaned(b.trial(spark, d)).groupBy("crop", "y").agg(F.round(F.sum("V"), 4).alias("total"), F.count("*").alias("n"))


@query(b.sql("trial", "bins") + "SELECT crop, bin, round(mean_v, 6) AS mean_v, round(rate, 6) AS rate, hits, n FROM bins")
def a21_binned(spark, d):
    return rounded(dose.binned(b.trial(spark, d)).withColumn("bin", F.col("bin").cast("long")))


LOSS = """SELECT crop, sum(y)::DOUBLE AS s, count(*)::BIGINT AS n, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ll FROM (SELECT *, 0.2::DOUBLE + 0.004::DOUBLE * V AS p FROM trial) GROUP BY 1"""


@query(b.sql("trial") + f", a AS ({LOSS}), q AS (SELECT *, s / n AS r FROM a) SELECT crop, round(ll, 6) AS logloss, round(-(r * ln(r) + (1 - r) * ln(1 - r)), 6) AS baseline, round(ll + (r * ln(r) + (1 - r) * ln(1 - r)), 6) AS delta, round(6 + 2 * ll * n, 4) AS aic, round(3 * ln(n) + 2 * ll * n, 4) AS bic, least(s, n - s)::BIGINT AS events, n FROM q")
def a22_fit_scores(spark, d):
    s = dose.fit_scores(b.trial(spark, d).withColumn("p", F.lit(0.2) + F.lit(0.004) * F.col("V")))
    return s.select("crop", R(F.col("logloss")).alias("logloss"), R(F.col("baseline")).alias("baseline"), R(F.col("delta")).alias("delta"), F.round("aic", 4).alias("aic"), F.round("bic", 4).alias("bic"), "events", "n")


@query(b.sql("trial") + "SELECT crop, round(corr(V, y), 6) AS corr, round(1 - sum((y - 0.25) * (y - 0.25)) / (var_pop(y) * count(*)), 6) AS r2 FROM trial GROUP BY 1")
def a23_fit_quality(spark, d):
    return rounded(dose.fit_quality(b.trial(spark, d).withColumn("f", F.lit(0.25)), "V", "y", "f", ("crop",)))


@query(b.sql("trial") + """, c AS (SELECT crop, count(*) FILTER (V > 20 AND y = 1) AS tp, count(*) FILTER (V > 20 AND y = 0) AS fp, count(*) FILTER (V <= 20 AND y = 1) AS fn, count(*) AS n FROM trial GROUP BY 1)
SELECT crop, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, n::BIGINT AS n, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round((n - fp - fn) / n::DOUBLE, 6) AS accuracy FROM c""")
def a24_confusion(spark, d):
    return rounded(dose.confusion(b.trial(spark, d).withColumn("p", (F.col("V") > 20).cast("int")), "p", "y", ("crop",)))


@query(b.sql("trial") + "SELECT crop, n, round(1 / n::DOUBLE, 9) AS row_weight, round(sum(n) OVER () / n::DOUBLE, 6) AS class_weight FROM (SELECT crop, count(*)::BIGINT AS n FROM trial GROUP BY 1)")
def a31_inverse_weights(spark, d):
    return dose.inverse_weights(b.trial(spark, d), "crop").select("crop", "n", F.round("row_weight", 9).alias("row_weight"), R(F.col("class_weight")).alias("class_weight"))


@query("SELECT d.doc_id, d.n_chars, l.quality AS fruit_set, l.toxic AS flower_type FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def j10_p33_labelled(spark, d):
    flowers = b.table(spark, d, "documents").select("doc_id", "n_chars")
    labels = b.table(spark, d, "labels").select("doc_id", F.col("quality").alias("fruit_set"), F.col("toxic").alias("flower_type"))
    return dose.labelled(flowers, labels, "doc_id")


def fit_sql(points: int = 81, refine: int = 2) -> str:
    """CTEs from bins(crop, mean_v, rate, n) to fit(crop, F0, Fmax, k, loss), on the grids that curve.fitted takes."""
    out, step = [], (math.log(DOSE.k_max) - math.log(DOSE.k_min)) / (points - 1)
    for level in range(refine + 1):
        if level == 0:
            grid = f"g0 AS (SELECT bins.*, k FROM bins, (SELECT unnest({curve._log_grid(DOSE.k_min, DOSE.k_max, points)}::DOUBLE[]) AS k))"
        else:
            near = [math.exp(step * (2 * i / (points - 1) - 1)) for i in range(points)]
            grid = f"g{level} AS (SELECT b.crop, b.mean_v, b.rate, b.n, least({DOSE.k_max}::DOUBLE, greatest({DOSE.k_min}::DOUBLE, o.k * z)) AS k FROM bins b JOIN o{level - 1} o ON o.crop = b.crop, (SELECT unnest({near}::DOUBLE[]) AS z))"
            step *= 2 / (points - 1)
        out.append(f"""{grid},
s{level} AS (SELECT crop, k, sum(n) AS w, sum(n * x) AS x, sum(n * x * x) AS xx, sum(n * rate) AS y, sum(n * x * rate) AS xy, sum(n * rate * rate) AS yy FROM (SELECT *, 1 - exp(-k * mean_v) AS x FROM g{level}) GROUP BY 1, 2),
a{level} AS (SELECT *, least(1, greatest(0, coalesce((y * xx - x * xy) / nullif(w * xx - x * x, 0), y / w))) AS F0 FROM s{level}), c{level} AS (SELECT *, least(1, greatest(0, F0 + coalesce((xy - F0 * x) / nullif(xx, 0), 0))) AS Fmax FROM a{level}),
l{level} AS (SELECT *, yy - 2 * (F0 * y + (Fmax - F0) * xy) + F0 * F0 * w + 2 * F0 * (Fmax - F0) * x + (Fmax - F0) * (Fmax - F0) * xx AS loss FROM c{level}),
o{level} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY round(loss, 12), k) AS r FROM l{level}) WHERE r = 1)""")
    return ", " + ",\n".join(out) + f",\nfit AS (SELECT * FROM o{refine})\n"


SOLVED = fit_sql()


@query(b.sql("trial", "bins") + SOLVED + "SELECT crop, round(F0, 3) AS F0, round(Fmax, 3) AS Fmax, round(k, 3) AS k, round(loss, 3) AS loss FROM fit")
def m1_fitted(spark, d):
    return rounded(curve.fitted(dose.binned(b.trial(spark, d))), n=3)


@query(b.sql("trial", "bins") + SOLVED + "SELECT crop, dose, round(F0 + (Fmax - F0) * (1 - exp(-k * dose)), 4) AS fruit_set FROM fit, (SELECT unnest([0.0, 5.0, 20.0, 40.0]::DOUBLE[]) AS dose)")
def m15_p31_sweep(spark, d):
    return rounded(curve.sweep(curve.fitted(dose.binned(b.trial(spark, d))), [0, 5, 20, 40]), n=4)


@query(b.sql("trial") + "SELECT crop, CASE WHEN count(*) FILTER (V <= 1.0) >= 10 THEN round(avg(y) FILTER (V <= 1.0), 6) END AS f0_anchor FROM trial GROUP BY 1")
def m2_anchors(spark, d):
    from dataclasses import replace

    return rounded(curve.anchors(b.trial(spark, d), p=replace(DOSE, anchor_v=1.0)))


def poisson_sql(mean: str, u: str) -> str:
    step = "{'p': a.p * " + mean + " / x.n, 'c': a.c + a.p * " + mean + " / x.n, 'n': x.n}"
    small = f"list_reduce([{{'p': exp(-{mean}), 'c': exp(-{mean}), 'n': 0.0::DOUBLE}}] || list_transform(range(1, 91), lambda i: {{'p': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'n': i::DOUBLE}}), lambda a, x: CASE WHEN a.c < {u} THEN {step} ELSE a END).n"
    return f"CASE WHEN {mean} <= 30 THEN {small} ELSE greatest(0, floor({mean} + sqrt({mean}) * ({quantile_sql(u)}) + 0.5::DOUBLE)) END"


def bootstrap_sql(draws: int = 400, bins: int = DOSE.bins) -> str:
    """CTEs after trial and fit: redrawn(crop, F0, Fmax, k), a row for each resample of the flowers."""
    again = fit_sql().replace(", g0 AS", "g0 AS", 1)
    for name in ("fit", *(f"{c}{level}" for level in range(3) for c in "gsaclo")):
        again = re.sub(rf"\b{name}\b", f"b_{name}", again)
    again = re.sub(r"\bbins\b", "b_bins", again)
    return f""", alike AS (SELECT crop, V, sum(y)::DOUBLE AS hits, count(*)::DOUBLE AS n, row_number() OVER (PARTITION BY crop ORDER BY V) AS at_v FROM trial GROUP BY 1, 2),
us AS (SELECT crop, at_v, b, V, hits, n - hits AS misses, {uniform_sql("crop", "at_v", "b", "42", "1")} AS u1, {uniform_sql("crop", "at_v", "b", "42", "2")} AS u2 FROM alike, range(1, {draws + 1}) r(b)),
drawn AS (SELECT crop, at_v, b, V, {poisson_sql("hits", "u1")} AS h, {poisson_sql("misses", "u2")} AS m FROM us),
there AS (SELECT crop || '|' || b AS crop, V, h, h + m AS n, sum(h + m) OVER (PARTITION BY crop, b ORDER BY V ROWS UNBOUNDED PRECEDING) AS upto FROM drawn WHERE h + m > 0),
sizes AS (SELECT crop, max(upto) AS all_n FROM there GROUP BY 1), places AS (SELECT crop, q / {float(bins)}::DOUBLE * (all_n - 1) AS place FROM sizes, range({bins + 1}) r(q)),
ends AS (SELECT p.crop, p.place, min(t.V) FILTER (t.upto > floor(p.place)) AS low, min(t.V) FILTER (t.upto > ceil(p.place)) AS high FROM places p JOIN there t ON t.crop = p.crop GROUP BY 1, 2),
b_edges AS (SELECT crop, list(DISTINCT low + (high - low) * (place - floor(place))) AS edges FROM ends GROUP BY 1),
b_bins AS (SELECT crop, sum(n * V) / sum(n) AS mean_v, sum(h) / sum(n) AS rate, sum(n) AS n FROM (SELECT t.*, greatest(1, len(list_filter(e.edges, lambda x: x < t.V))) AS bin FROM there t JOIN b_edges e ON e.crop = t.crop) GROUP BY crop, bin),
{again}, redrawn AS (SELECT split_part(crop, '|', 1) AS crop, F0, Fmax, k FROM b_fit)
"""


REPORT = b.sql("trial", "bins") + SOLVED + bootstrap_sql() + """, ci AS (SELECT crop, """ + ", ".join(f"quantile_cont({c}, {q}) AS {c}_{n}" for c in ("F0", "Fmax", "k") for n, q in (("lo", 0.025), ("hi", 0.975))) + """ FROM redrawn GROUP BY 1),
pr AS (SELECT t.crop, t.y, least(1 - 1e-9::DOUBLE, greatest(1e-9::DOUBLE, F0 + (Fmax - F0) * (1 - exp(-k * V)))) AS p FROM trial t JOIN fit f ON f.crop = t.crop),
sc AS (SELECT crop, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS ll, avg(y) AS r, count(*)::BIGINT AS n, least(sum(y), count(*) - sum(y))::BIGINT AS events FROM pr GROUP BY 1)
"""


@query(REPORT + "SELECT f.crop, round(F0, 3) AS F0, round(Fmax, 3) AS Fmax, round(k, 3) AS k, round(3 / k, 2) AS v_star, " + ", ".join(f"round({c}_{n}, 3) AS {c}_{n}" for c in ("F0", "Fmax", "k") for n in ("lo", "hi")) + ", round(ll, 4) AS logloss, round(6 + 2 * ll * n, 1) AS aic, events, n FROM fit f JOIN ci ON ci.crop = f.crop JOIN sc ON sc.crop = f.crop")
def m3_m4_fit_report(spark, d):
    """Curve, intervals of 400 resamples of the flowers, and scores."""
    rows = b.trial(spark, d)
    bins = dose.binned(rows)
    fit = curve.fitted(bins)
    f = F.broadcast(fit.drop("loss"))
    p = rows.join(f, "crop").withColumn("p", curve.response(F.col("V"), F.col("F0"), F.col("Fmax"), F.col("k")))
    out = curve.fit_report(fit, curve.intervals(curve.bootstrap_flowers(rows)), dose.fit_scores(p.select("crop", "y", "p")))
    three = [F.round(c, 3).alias(c) for c in ("F0", "Fmax", "k", *(f"{c}_{n}" for c in ("F0", "Fmax", "k") for n in ("lo", "hi")))]
    return out.select("crop", *three, F.round("v_star", 2).alias("v_star"), F.round("logloss", 4).alias("logloss"), F.round("aic", 1).alias("aic"), "events", "n")


F0SQL = """, q0 AS (SELECT crop, quantile_cont(V, 0.05) AS q, count(*) FILTER (V <= 0.5) AS n FROM trial GROUP BY 1),
f0 AS (SELECT t.crop, avg(t.y) AS f0 FROM trial t JOIN q0 q ON q.crop = t.crop WHERE t.V <= CASE WHEN q.n >= 10 THEN 0.5 ELSE q.q END GROUP BY 1)"""


def posterior_sql(mean: float, sd: float, name: str, points: int = 61) -> str:
    """CTE `name`: the weighted cells of the posterior with a Normal(mean, sd) prior on Fmax."""
    return f"""cells_{name} AS (SELECT crop, f0, (i + 0.5::DOUBLE) / {points} * 0.999::DOUBLE AS Fmax, -6 + 10 * (j + 0.5::DOUBLE) / {points} AS lk FROM f0, range({points}) a(i), range({points}) c(j)),
ll_{name} AS (SELECT o.crop, o.Fmax, o.lk, sum(hits * ln(p) + (n - hits) * ln(1 - p)) - pow((o.Fmax - {mean}::DOUBLE) / {sd}::DOUBLE, 2) / 2 - pow((o.lk - ln(0.3::DOUBLE)) / 0.5, 2) / 2 AS lp
  FROM (SELECT o.*, hits, n, least(1 - 1e-9::DOUBLE, greatest(1e-9::DOUBLE, f0 + (Fmax - f0) * (1 - exp(-exp(lk) * mean_v)))) AS p FROM cells_{name} o JOIN bins b ON b.crop = o.crop WHERE Fmax > f0) o GROUP BY 1, 2, 3),
{name} AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY crop)) AS w FROM ll_{name})"""


POST = b.sql("trial", "bins") + F0SQL + ", "


@query(POST + posterior_sql(0.72, 0.10, "w") + " SELECT crop, round(sum(w * Fmax) / sum(w), 6) AS fmax_mean, round(sum(w * exp(lk)) / sum(w), 6) AS k_mean FROM w GROUP BY 1")
def m5_posterior(spark, d):
    rows = b.trial(spark, d)
    return rounded(curve.posterior(dose.binned(rows), curve.posterior_f0(rows)).select("crop", "fmax_mean", "k_mean"))


@query(POST + posterior_sql(0.72, 0.25, "a") + ", " + posterior_sql(0.72, 0.05, "c") + """, x AS (SELECT crop, sum(w * Fmax) / sum(w) AS wide FROM a GROUP BY 1), y AS (SELECT crop, sum(w * Fmax) / sum(w) AS narrow FROM c GROUP BY 1)
SELECT x.crop, round(wide, 6) AS wide, round(narrow, 6) AS narrow, round(abs(wide - narrow), 6) AS shift FROM x JOIN y ON x.crop = y.crop""")
def m6_prior_sensitivity(spark, d):
    rows = b.trial(spark, d)
    return rounded(curve.prior_sensitivity(dose.binned(rows), curve.posterior_f0(rows)))


@query()
def m7_mixed_model(spark, d):
    return rounded(mixed.mixed_report(b.trial(spark, d)))


def _draws(spark, d):
    """Draws from the orders table: a value of each parameter per order, so that SQL has the same."""
    o = b.table(spark, d, "orders")
    return o.select(F.when(F.col("o_orderstatus") == "F", "pomegranate").otherwise("cucumber").alias("crop"), F.col("o_orderkey").alias("b"), (0.1 + (F.col("o_orderkey") % 10) / 100.0).alias("F0"), (0.6 + (F.col("o_custkey") % 20) / 100.0).alias("Fmax"), (0.1 + (F.col("o_orderkey") % 7) / 50.0).alias("k"))


DRAWS = "WITH draws AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'pomegranate' ELSE 'cucumber' END AS crop, o_orderkey AS b, 0.1::DOUBLE + (o_orderkey % 10) / 100.0::DOUBLE AS F0, 0.6::DOUBLE + (o_custkey % 20) / 100.0::DOUBLE AS Fmax, 0.1::DOUBLE + (o_orderkey % 7) / 50.0::DOUBLE AS k FROM orders)\n"


@query(DRAWS + "SELECT crop, dose, round(avg(f), 6) AS mean, round(quantile_cont(f, 0.025), 6) AS lo, round(quantile_cont(f, 0.975), 6) AS hi FROM (SELECT crop, dose, F0 + (Fmax - F0) * (1 - exp(-k * dose)) AS f FROM draws, (SELECT unnest([1.0, 5.0, 10.0]::DOUBLE[]) AS dose)) GROUP BY 1, 2")
def m8_set_band(spark, d):
    return rounded(curve.set_band(_draws(spark, d), [1, 5, 10]).withColumn("lo", F.col("lo")), "dose")


@query(DRAWS + "SELECT crop, round(avg(kg), 4) AS mean_kg, round(quantile_cont(kg, 0.025), 4) AS lo_kg, round(quantile_cont(kg, 0.975), 4) AS hi_kg FROM (SELECT crop, 1000 * (F0 + (Fmax - F0) * (1 - exp(-k * 4.0::DOUBLE))) * 0.3::DOUBLE AS kg FROM draws) GROUP BY 1")
def m9_m11_yield_band(spark, d):
    return rounded(curve.yield_band(_draws(spark, d), 4.0, 1000, 0.3, noise=False), n=4)


NOISY = "WITH " + DRAWS.removeprefix("WITH ").rstrip() + f""", drawn AS (SELECT *, {uniform_sql("crop", "b", "42")} AS u, F0 + (Fmax - F0) * (1 - exp(-k * 4.0::DOUBLE)) AS f FROM draws),
noisy AS (SELECT crop, greatest(0, least(1000, 1000 * f + sqrt(1000 * f * (1 - f)) * ({quantile_sql("u")}))) * 0.3::DOUBLE AS kg FROM drawn)
"""


@query(NOISY + "SELECT crop, round(avg(kg), 4) AS mean_kg, round(quantile_cont(kg, 0.025), 4) AS lo_kg, round(quantile_cont(kg, 0.975), 4) AS hi_kg FROM noisy GROUP BY 1")
def m9_yield_band_noise(spark, d):
    return rounded(curve.yield_band(_draws(spark, d), 4.0, 1000, 0.3), n=4)


ORCHARD = b.sql("trial") + DRAWS.replace("WITH ", ", ", 1) + """, doses AS (SELECT CASE WHEN crop = 'F' THEN 'pomegranate' ELSE 'cucumber' END AS crop, round(V, 0) AS V, count(*) AS n FROM trial GROUP BY 1, 2),
f AS (SELECT d.crop, d.b, d.F0, d.Fmax, d.k, n, V, F0 + (Fmax - F0) * (1 - exp(-k * V)) AS f FROM doses o JOIN draws d ON d.crop = o.crop),
one AS (SELECT crop, b, F0, Fmax, k, sum(n * f * 0.3::DOUBLE * (1 + 0.25::DOUBLE * (f - F0))) AS kg, sum(n * f) / sum(n) AS mean_f, sum(n * V) / sum(n) AS mean_v, sum(n) AS n FROM f GROUP BY 1, 2, 3, 4, 5)
"""


@query(ORCHARD + "SELECT crop, round(avg(kg), 3) AS mean_kg, round(quantile_cont(kg, 0.025), 3) AS lo_kg, round(quantile_cont(kg, 0.975), 3) AS hi_kg, round(avg(F0 + (Fmax - F0) * (1 - exp(-k * mean_v)) - mean_f), 4) AS jensen, max(n)::BIGINT AS n_flowers FROM one GROUP BY 1")
def m10_orchard_yield(spark, d):
    flowers = b.trial(spark, d).select(F.when(F.col("crop") == "F", "pomegranate").otherwise("cucumber").alias("crop"), F.round("V", 0).alias("V"))
    out = curve.orchard_yield(_draws(spark, d), flowers, 0.3, 0.25)
    return out.select("crop", *[F.round(c, 3).alias(c) for c in ("mean_kg", "lo_kg", "hi_kg")], F.round("jensen", 4).alias("jensen"), "n_flowers")


def _z(i: int) -> str:
    return quantile_sql(f"u{i}")


REDRAWN = b.sql("trial", "bins") + SOLVED + f""", saved AS (SELECT crop, round(F0, 3) AS F0, round(Fmax, 3) AS Fmax, round(k, 3) AS k FROM fit),
drawn AS (SELECT *, {uniform_sql("crop", "b", "42", "1")} AS u1, {uniform_sql("crop", "b", "42", "2")} AS u2, {uniform_sql("crop", "b", "42", "3")} AS u3 FROM saved, range(1, 401) r(b)),
again AS (SELECT crop, least(1, greatest(0, F0 + (F0 * 1.1::DOUBLE - F0 * 0.9::DOUBLE) / 3.92::DOUBLE * ({_z(1)}))) AS F0, least(1, greatest(0, Fmax + (Fmax * 1.1::DOUBLE - Fmax * 0.9::DOUBLE) / 3.92::DOUBLE * ({_z(2)}))) AS Fmax,
  greatest({DOSE.k_min}::DOUBLE, k + (k * 1.1::DOUBLE - k * 0.9::DOUBLE) / 3.92::DOUBLE * ({_z(3)})) AS k FROM drawn)
"""


@query(REDRAWN + "SELECT crop, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_{n}" for c in ("F0", "Fmax", "k") for n, q in (("lo", 0.025), ("hi", 0.975))) + " FROM again GROUP BY 1")
def m12_draws_from_report(spark, d):
    """From a curve saved with three places."""
    fit = curve.fitted(dose.binned(b.trial(spark, d))).select("crop", *[F.round(c, 3).alias(c) for c in ("F0", "Fmax", "k")])
    rep = fit.select("crop", "F0", "Fmax", "k", *[(F.col(c) * s).alias(f"{c}_{n}") for c in ("F0", "Fmax", "k") for n, s in (("lo", 0.9), ("hi", 1.1))])
    return rounded(curve.intervals(curve.draws_from_report(rep)))


M13 = """WITH t AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'pomegranate' WHEN '2-HIGH' THEN 'cucumber' ELSE 'fig' END AS crop, sum(o_totalprice) / 1000 AS dose, count(*)::BIGINT AS n_flowers FROM orders GROUP BY 1),
p AS (SELECT *, CASE crop WHEN 'cucumber' THEN 0.05 ELSE 0.45 END::DOUBLE AS F0, CASE crop WHEN 'cucumber' THEN 0.80 ELSE 0.90 END::DOUBLE AS Fmax, 3 / CASE crop WHEN 'cucumber' THEN 6.0 ELSE 8.0 END::DOUBLE AS k, CASE crop WHEN 'cucumber' THEN 0.30 ELSE 0.25 END::DOUBLE AS g, CASE crop WHEN 'cucumber' THEN 0.25 ELSE 0.30 END::DOUBLE AS m, dose / greatest(n_flowers, 1) AS v FROM t),
f AS (SELECT *, F0 + (Fmax - F0) * (1 - exp(-k * v)) AS f FROM p)
SELECT crop, round(dose, 4) AS dose, n_flowers, round(f, 6) AS fruit_set, round(n_flowers * f * m * (1 + g * (f - F0)), 4) AS yield_kg, round((1 - f * (1 + g * (f - F0)) / (Fmax * (1 + g * (Fmax - F0)))) * 100, 6) AS deficit_pct, round((Fmax - F0) * k * exp(-k * v), 6) AS gain_per_visit FROM f"""


@query(M13)
def m13_p30_estimate(spark, d):
    o = b.table(spark, d, "orders")
    crop = F.when(F.col("o_orderpriority") == "1-URGENT", "pomegranate").when(F.col("o_orderpriority") == "2-HIGH", "cucumber").otherwise("fig")
    t = o.groupBy(crop.alias("crop")).agg((F.sum("o_totalprice") / 1000).alias("dose"), F.count("*").alias("n_flowers"))
    e = curve.estimate(t)
    return e.select("crop", F.round("dose", 4).alias("dose"), "n_flowers", R(F.col("fruit_set")).alias("fruit_set"), F.round("yield_kg", 4).alias("yield_kg"), R(F.col("deficit_pct")).alias("deficit_pct"), R(F.col("gain_per_visit")).alias("gain_per_visit"))


@query("""WITH tops AS (SELECT p_brand, max(p_retailprice) AS top FROM part WHERE p_retailprice > 0 AND p_size > 0 GROUP BY 1), share AS (SELECT p.p_brand AS crop, p_size::DOUBLE AS mean_v, p_retailprice / top AS s FROM part p JOIN tops t ON t.p_brand = p.p_brand WHERE p_retailprice > 0 AND p_size > 0),
bins AS (SELECT crop, mean_v, avg(s) AS rate, count(*)::DOUBLE AS n, greatest(0, sum(s * s) - sum(s) * sum(s) / count(*)) AS rest FROM share GROUP BY 1, 2), more AS (SELECT crop, sum(rest) AS rest FROM bins GROUP BY 1)""" + fit_sql() + "SELECT f.crop, round(F0, 3) AS F0, round(Fmax, 3) AS Fmax, round(loss + rest, 3) AS loss FROM fit f JOIN more m ON m.crop = f.crop")
def m14_s16_field_fit(spark, d):
    """Parts as a field table: written as CSV, read back with bad rows dropped, fitted by brand."""
    at = b.folder(spark, "field")
    b.table(spark, d, "part").select("p_brand", "p_size", "p_retailprice").write.option("header", True).csv(at)
    rows = readers.field_table(spark, at, ["p_size", "p_retailprice"]).select(F.col("p_brand").alias("crop"), F.col("p_size").alias("V"), F.col("p_retailprice").alias("y"))
    return rounded(curve.field_fit(rows).drop("k"), n=3)
