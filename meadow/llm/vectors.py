"""Near-duplicate vectors by an inverted multi-index.

A vector (scaled to length 1) is halved; a codebook of its own, fitted on a bounded sample, codes each half, and the
product of the codebooks is a grid of cells. Every vector lies in one cell and visits cells by multi-sequence traversal,
nearest sum of half distances first. How many cells it visits follows from the target recall: sampled vectors are moved
to exactly the wanted cosine in random directions, and the visits must reach the cell they land in at that share. Pairs
found are verified by cosine in double precision.

A vector visits its own cell and those of the traversal that come after it in the numbering of the cells, so each pair is
met from one side only and counts for both ends. Equal vectors form a class and only one of them goes on; links count all
of them. Cells are cut into blocks of bounded size, members against visitors, so a crowded cell spreads over many tasks.
A block returns the number of links of each vector and the forest of its links, never its pairs.

Only vectors of one length can link. Each length has a grid of its own, of LEAST codewords for each half or more; the
vectors of a length with no more than `few` (too few to fit them) share a cell. Of length 1 there are two directions only, so the sign is the class.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Rows that repeat an id are
one node; if they hold different vectors, these are tied to one component. Rows with a null id are left alone (component
null, kept). Only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from meadow.functions.shared import staged
from meadow.llm.common import read
from meadow.operators.components import connected_components

SAMPLE, PER_CELL, MEMBERS, VISITORS = 16_384, 1024, 1024, 2048
#: Codewords of a half at least, and vectors of a length that are too few for as many.
LEAST, FEW = 4, 64


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        own = _distances(x, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def traverse(d1: np.ndarray, d2: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The `count` cells with the least d1[i] + d2[j], nearest first."""
    o1, o2 = d1.argsort(kind="stable").tolist(), d2.argsort(kind="stable").tolist()
    heap, seen, out = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < count:
        _, i, j = heapq.heappop(heap)
        out.append((o1[i], o2[j]))
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (d1[o1[a]] + d2[o2[b]], a, b))
    return out


class Grid:
    """Two codebooks, and how many cells a vector visits."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float, recall: float, per_cell: int = PER_CELL, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        k = int(np.clip(np.sqrt(rows / per_cell), LEAST, 4096))
        k = min(k, max(1, len(sample) // 4))
        self.books = [_kmeans(sample[:, : self.half], k, rng), _kmeans(sample[:, self.half :], k, rng)]
        probe = sample[rng.choice(len(sample), min(len(sample), 2000), replace=False)]
        noise = rng.normal(size=probe.shape)
        noise -= (noise * probe).sum(1)[:, None] * probe
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
        moved = cosine * probe + np.sqrt(1 - cosine * cosine) * noise
        sums = [_distances(h, b) for h, b in zip(self._halves(probe), self.books)]
        land = self.cells(moved)
        ranks = [int(((a[:, None] + b[None, :]) < a[c // k] + b[c % k]).sum()) for a, b, c in zip(*sums, land)]
        self.k, self.visits = k, int(min(k * k, np.quantile(ranks, recall) + 2)) if len(ranks) else 1

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        i, j = (_distances(h, b).argmin(1) for h, b in zip(self._halves(x), self.books))
        return i * len(self.books[1]) + j

    def visited(self, x: np.ndarray) -> list[list[int]]:
        """Of each vector, its own cell and the later ones of its traversal."""
        d1, d2 = (_distances(h, b) for h, b in zip(self._halves(x), self.books))
        ways = ([i * self.k + j for i, j in traverse(a, b, self.visits)] for a, b in zip(d1, d2))
        return [[own, *(c for c in way if c > own)] for own, way in zip(self.cells(x).tolist(), ways)]


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors])
    # By a power of two, which changes no digit; else squares may overflow or vanish.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.linalg.norm(x, axis=1)[:, None]


def _block(cosine: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def block(members: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(visitors):
            return pd.DataFrame({"id": [], "links": [], "root": []})
        m, v = members["id"].to_numpy(np.int64), visitors["id"].to_numpy(np.int64)
        close = (_unit(visitors["vec"]) @ _unit(members["vec"]).T >= cosine) & (v[:, None] != m[None, :])
        away = ~visitors["home"].to_numpy(bool)
        out = close @ members["weight"].to_numpy(np.int64)
        back = close[away].T @ visitors["weight"].to_numpy(np.int64)[away]
        i, j = np.nonzero(close)
        nodes, at = np.unique(np.concatenate([v[i], m[j]]), return_inverse=True)
        a, b, low = at[: len(i)], at[len(i) :], np.arange(len(nodes))
        while True:  # the smallest label runs along the links
            then = low.copy()
            np.minimum.at(then, a, low[b])
            np.minimum.at(then, b, low[a])
            then = then[then]
            if (then == low).all():
                break
            low = then
        hit, met = out > 0, back > 0
        ids = np.concatenate([v[hit], m[met], nodes])
        return pd.DataFrame({"id": ids, "links": np.concatenate([out[hit], back[met], np.zeros(len(nodes), np.int64)]), "root": np.concatenate([v[hit], m[met], nodes[low]])})

    return block


FOUND = "id long, links long, root long"


def near_vectors(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.9995, vec_id: str = "vec_id", embedding: str = "embedding", per_cell: int = PER_CELL, few: int = FEW) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors."""
    vec = F.transform(F.col(embedding), lambda x: x.cast("double"))
    fine = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0), F.lit(False))
    one = F.when(F.size(vec) == 1, F.transform(vec, lambda x: F.signum(x))).otherwise(vec)
    # Components that are floats stay exact as floats, at half the size.
    as_was = "array<float>" if dict(vectors.dtypes)[embedding] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.when(fine, one).cast(as_was).alias("vec"))
    # Two hashes stand for a vector wherever the vector itself isn't needed.
    key = ["h", "g"]
    rows = staged(rows.select("id", "vec", F.xxhash64("vec").alias("h"), F.xxhash64("vec", F.lit(1)).alias("g")), "vectors")
    named = rows.where("id IS NOT NULL AND vec IS NOT NULL")
    classes = named.groupBy(*key).agg(F.min("id").alias("own"), F.count("*").alias("weight"), F.any_value("vec").alias("vec"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("id"), "own", "weight", "vec", *key), "classes")
    dims = classes.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n"))
    placed = [classes.join(dims.where(F.col("n") <= few), F.size("vec") == F.col("dims")).select("id", "weight", "vec", (-F.col("dims")).cast("long").alias("cell"), F.array((-F.col("dims")).cast("long")).alias("visited"))]
    first = 0
    for size, n in dims.where(F.col("n") > few).orderBy("dims").collect():
        some = classes.where(F.size("vec") == size)
        sample = some.orderBy(F.xxhash64("own", F.lit(1)), "own", "id").limit(SAMPLE).select("vec").toPandas()["vec"]
        grid = Grid(_unit(sample), n, cosine, recall, per_cell)
        placed.append(_coded(some, grid, first))
        first += grid.k * grid.k
    table = placed[0]
    for p in placed[1:]:
        table = table.unionByName(p)
    found = staged(_found(staged(table, "cells"), cosine), "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    reps = classes.select("id", "own")
    edges = found.where("id <> root").join(reps, "id").select(F.col("root").alias("id"), F.col("own").alias("a")).join(reps, "id").select("a", F.col("own").alias("b"))
    # Ids with several vectors tie the classes of these together.
    ids = named.select(F.col("id").alias("node"), *key).distinct()
    split = ids.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    ties = ids.join(split, "node").join(classes.select(*key, "own"), key).select(F.col("node").alias("a"), F.col("own").alias("b"))
    parts = connected_components(edges.unionByName(ties))
    done = classes.select("id", "own", "weight", *key).join(counts, "id", "left").join(parts, F.col("own") == F.col("node"), "left").select(*key, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "own").alias("c"))
    out = rows.select("id", *[F.when(F.col("vec").isNotNull(), F.col(c)).alias(c) for c in key]).join(done, key, "left")
    alone = F.col("id").isNull()
    component = F.when(~alone, F.coalesce("c", "id"))
    return out.select(F.col("id").alias("vec_id"), F.when(alone, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _coded(classes: DataFrame, grid: Grid, first: int) -> DataFrame:
    """Classes of one length with their cell and the cells they visit, numbered from `first` on."""

    @pandas_udf("struct<cell:long,visited:array<long>>")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _unit(b)
            yield pd.DataFrame({"cell": grid.cells(x) + first, "visited": [[c + first for c in v] for v in grid.visited(x)]})

    return classes.withColumn("at", coded("vec")).select("id", "weight", "vec", "at.cell", "at.visited")


def _found(placed: DataFrame, cosine: float) -> DataFrame:
    visits = placed.select("id", "weight", "vec", F.col("cell").alias("own"), F.explode("visited").alias("cell")).withColumn("home", F.col("own") == F.col("cell"))
    # Blocks: a cell's members in parts of MEMBERS, its visitors in parts of VISITORS, every part against every other.
    n_m = placed.groupBy("cell").agg(F.ceil(F.count("*") / MEMBERS).alias("ms"))
    n_v = placed.select(F.explode("visited").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / VISITORS).alias("vs"))
    plan = staged(n_m.join(n_v, "cell"), "plan")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = placed.join(plan, "cell").select("cell", F.pmod(F.xxhash64("id"), "ms").alias("m"), every("vs").alias("v"), "id", "weight", "vec")
    own = [F.col(c).alias(c) for c in ("id", "weight", "home", "vec")]  # columns apart from those of the members
    visitors = visits.join(plan, "cell").select("cell", every("ms").alias("m"), F.pmod(F.xxhash64("id", F.lit(9)), "vs").alias("v"), *own)
    return members.groupBy("cell", "m", "v").cogroup(visitors.groupBy("cell", "m", "v")).applyInPandas(_block(cosine), FOUND)


def op2_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP2_SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.95
), reach AS (SELECT vec_id, vec_id AS t FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.t
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT r.vec_id, coalesce(any_value(c.n), 0)::BIGINT AS n_links, min(t) AS component_id, r.vec_id = min(t) AS kept FROM reach r LEFT JOIN counts c ON c.a = r.vec_id GROUP BY r.vec_id
"""
