"""Connected components of an edge table, by alternating stars.

Each round hangs every node's larger neighbours on the smallest node it knows (large star), then every node and its
smaller neighbours on the smallest of them (small star). Trees get flat in a logarithmic number of rounds, and no step
brings a component together: a hub's edges are summed by partial aggregates and joined by Spark's skew-aware sort-merge
join. Rounds end when the edges no longer change; each writes its edges to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadow.functions.shared import drop_staged, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v) with v < u, without repeats."""
    out = edges
    if large:
        out = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = out.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    both = out.join(low, "u")
    if large:
        hung = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for every node that has an edge; nulls and loops are left out."""
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = staged(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        then = staged(_star(_star(now, True), False), "edges")
        mark = then.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.when(F.col("u") == F.col("v"), 1))).first()
        drop_staged(now)
        now = then
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
