"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target / source size, at most `max_copies`.
Its integral part is taken outright. The fractional parts are rounded by the pivotal method: two fractional
documents exchange mass (words times probability) at random, with unchanged expectation, until one of them is
integral. A source is cut into chunks by a hash of the document; each chunk leaves one fractional document at most,
and these residuals meet in a reduction tree of fan-in `fan_in`, so a hot source is spread over many tasks and the
words taken from a source differ from its target by half the size of one of its documents at most.

Rows that agree in id, source and size are one unit: each of them gets the same copies. Documents without words (null,
empty, white space) are never taken: 0 copies. Null sources form a source of their own, the last one. Columns of other
names are not read, and helper columns get names that clash with none. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meadow.functions.shared import staged
from meadow.llm.common import fresh, n_words


def source_targets(units: DataFrame, weights: tuple[float, ...], share: float, max_copies: float) -> DataFrame:
    """source, source_size, target: `share` of all words, dealt by weight; what a source at max_copies times its size can't use goes to the others.

    The water level is the first one, with the sources by rising cap / weight, that stays under the next cap: the highest of those that fit. One row
    per source is sorted, never the documents.
    """
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(max_copies)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", cap)
    rising = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    found = leveled.withColumn("water", F.max(fits).over(everything))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("water")))
    return found.select("source", F.col("source_size").cast("long").alias("source_size"), target.cast("double").alias("target"))


def _pivot(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Round the fractional parts p of one group; the last row that stays fractional keeps its p."""
    rows = rows.sort_values(["key", "doc_id", "size"], na_position="first", kind="mergesort").reset_index(drop=True)
    salt = hashlib.sha256(f"{seed}|{rows['source'].iat[0]}|{rows['level'].iat[0]}|{rows['chunk'].iat[0]}".encode()).digest()
    draw = np.random.default_rng(int.from_bytes(salt[:8], "little")).random(len(rows))
    mass, p = (rows["size"] * rows["n"]).to_numpy(float), rows["p"].to_numpy(float).copy()
    tiny = 1e-9
    i = -1
    for j in range(len(rows)):
        if not tiny < p[j] < 1 - tiny:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        up, down = min((1 - p[i]) * mass[i], p[j] * mass[j]), min(p[i] * mass[i], (1 - p[j]) * mass[j])
        move = up if draw[j] * (up + down) < down else -down
        p[i] += move / mass[i]
        p[j] -= move / mass[j]
        for k in (i, j):
            if not tiny < p[k] < 1 - tiny:
                p[k] = round(p[k])
        i = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    rows["p"] = p
    rows["level"] += 1
    return rows


def copies(docs: DataFrame, size: str = "size", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_copies: int = 2, chunk: int = 256, fan_in: int = 256, seed: int = 7) -> DataFrame:
    """Units of docs(doc_id, source, <size>): doc_id, source, size, n (rows of the unit), source_size, target, copies."""
    units = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col(size).cast("long").alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "units")
    spark = units.sparkSession
    targets = source_targets(units, weights, share, max_copies)
    counts = units.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("units"))
    plan = staged(targets.join(counts, targets["source"].eqNullSafe(counts["s"])).select("source", "source_size", "target", F.greatest(F.ceil(F.col("units") / chunk), F.lit(1)).alias("chunks")), "targets")
    deepest = plan.agg(F.max("chunks")).first()[0] or 1
    s = plan.select(F.col("source").alias("s"), "source_size", "target", "chunks")
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    dealt = (
        units.join(s, units["source"].eqNullSafe(s["s"]))
        .drop("s")
        .withColumn("per", F.when(F.col("size") > 0, per).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("per"))
        .withColumn("p", F.col("per") - F.col("whole"))
        .withColumn("key", F.xxhash64("doc_id", "size", F.lit(seed)))
        .withColumn("chunk", F.pmod(F.col("key"), F.col("chunks")))
        .withColumn("level", F.lit(0))
        .select("doc_id", "source", "size", "n", "source_size", "target", "whole", "p", "key", "chunk", "level")
    )
    schema = dealt.schema

    def pivot(rows: pd.DataFrame) -> pd.DataFrame:
        return _pivot(rows, seed)

    level = staged(dealt.groupBy("source", "chunk").applyInPandas(pivot, schema), "level")
    open_p = (F.col("p") > 0) & (F.col("p") < 1)
    done = [level.where(~open_p)]
    while deepest > 1:
        deepest = -(-deepest // fan_in)
        left = level.where(open_p).withColumn("chunk", F.floor(F.col("chunk") / fan_in))
        level = staged(left.groupBy("source", "chunk").applyInPandas(pivot, schema), "level")
        done.append(level.where(~open_p))
    # One document of a source may still be fractional: the nearer whole number keeps its source nearest to the target.
    done.append(level.where(open_p))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "n", "source_size", "target", (F.col("whole") + F.round("p")).cast("long").alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with each document as often as the mix takes it; the columns stay the same."""
    size, times, d, src, z, one = fresh(docs.columns, "size", "copies", "doc", "source", "words", "one")
    marked = docs.withColumn(size, n_words(F.col("text")))
    got = copies(marked, size, **how).where("copies > 0").select(F.col("doc_id").alias(d), F.col("source").alias(src), F.col("size").alias(z), F.col("copies").alias(times))
    same = marked["doc_id"].eqNullSafe(got[d]) & marked["source"].cast("string").eqNullSafe(got[src]) & (marked[size] == got[z])
    each = F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))
    return marked.join(got, same).withColumn(one, each).select(*docs.columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    from meadow.llm.common import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    one = F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))
    got = copies(docs).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), one.alias("_one"))
    return got.drop("_one")
