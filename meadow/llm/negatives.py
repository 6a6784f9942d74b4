"""Hard negatives for anchor vectors by an STR-packed R-tree.

A component x becomes floor(scale * x), and the score of two rows is their integer inner product. Rows are ordered by length
of the vector, label and first component, cut into ranges of about `shard` rows, and each range is packed into a tree by
sort-tile-recursive: sorted by the coordinate of the greatest spread and cut into slabs, these by the next one, and so on, down to
pages of `page` rows; runs of FANOUT boxes make the boxes above. A box holds the least and the greatest of each coordinate
(and of the label), so its inner product with an anchor lies between the sums of the coordinates' least and greatest
products: the interval by which whole subtrees are left out.

The roots' boxes are met first, in blocks of roots and anchors; trees that no score window of an anchor reaches are never
sent that anchor. An anchor first goes to the tree of the greatest bound; its k-th best there is the bar that the other
trees must reach. Within a tree a queue opens the box with the greatest possible score first; a box is left
out if its interval misses the window or lies strictly below the k-th best so far. A page's rows are scored at once.

An anchor's positives are the `positives` best other rows of its label. For each of them the `negatives` best rows of
other labels with low * positive score <= 100 * score <= high * positive score are returned; ties go to the smaller vec_id.

Rows with a null label, a null vector or null or non-finite components take no part, nor do rows with a null vec_id, which
nothing could name, and those whose product with themselves is 2**62 or more, so that all scores are exact longs. Rows meet only
rows of their own length. Rows that repeat a vec_id stand each for itself, but aren't "other" rows to one another. Only the
named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meadow.functions.shared import staged
from meadow.llm.common import read

SCALE, SHARD, PAGE, FANOUT, TILED = 256, 8192, 256, 8, 3
#: Anchors of a task, and roots that anchors meet at once.
ANCHORS, ROOTS = 256, 1024
EXACT = float(1 << 53)


def integer_rows(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """id, vec_id, label, vec (longs): the rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("double"))
    small = F.aggregate(whole, F.lit(0.0), lambda s, c: s + c * c) < float(1 << 62)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(fine, whole).alias("vec"), F.when(fine, small).alias("small"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND small")
    return staged(rows.select(F.monotonically_increasing_id().alias("id"), "vec_id", "label", F.transform("vec", lambda c: c.cast("long")).alias("vec")), "rows")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b of integers: as doubles where these hold every sum, with Python's integers elsewhere."""
    most = [float(np.abs(x.astype(float)).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * max(1, a.shape[-1]) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a.astype(object) @ b.astype(object)


def tiles(x: np.ndarray, page: int, tiled: int = TILED) -> list[np.ndarray]:
    """Rows of x in pages: sorted and cut by the coordinates of the greatest spread, one after another."""
    pages = -(-len(x) // page)
    dims = np.argsort(-x.astype(float).std(0), kind="stable")[:tiled].tolist() if x.shape[1] else []

    def split(rows: np.ndarray, count: int, left: list[int]) -> list[np.ndarray]:
        if count <= 1 or not left:
            return [r for r in np.array_split(rows, count) if len(r)]
        rows = rows[np.argsort(x[rows, left[0]], kind="stable")]
        slabs = int(np.ceil(count ** (1 / len(left))))
        each = -(-count // slabs)
        return [p for part in np.array_split(rows, slabs) if len(part) for p in split(part, min(each, -(-len(part) // page)), left[1:])]

    return split(np.arange(len(x)), max(1, pages), dims)


TREE = "dims int, rows int, low_label long, high_label long, low array<long>, high array<long>, pages array<int>, ids binary, labels binary, vecs binary"


def _packed(page: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        pdf = pd.concat(parts)
        for dims, rows in pdf.groupby(pdf["vec"].map(len)):
            x = np.array([np.asarray(v, np.int64) for v in rows["vec"]], np.int64).reshape(len(rows), dims)
            ids, labels = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
            # Labels that fill a page have pages of their own.
            names, of, counts = np.unique(labels, return_inverse=True, return_counts=True)
            large = np.flatnonzero(counts >= page)
            groups = [np.flatnonzero(of == k) for k in large] + [np.flatnonzero(~np.isin(of, large))]
            cut = [g[p] for g in groups if len(g) for p in tiles(x[g], page)]
            order = np.concatenate(cut)
            yield pd.DataFrame({
                "dims": [dims], "rows": [len(rows)], "low_label": [labels.min()], "high_label": [labels.max()], "low": [x.min(0)], "high": [x.max(0)], "pages": [[len(p) for p in cut]],
                "ids": [ids[order].tobytes()], "labels": [labels[order].tobytes()], "vecs": [x[order].tobytes()],
            })

    return pack


def trees(rows: DataFrame, shard: int = SHARD, page: int = PAGE) -> DataFrame:
    """tree, and the columns of TREE: each row of rows in one tree."""
    count = max(1, -(-rows.count() // shard))
    dealt = rows.repartitionByRange(count, F.size("vec"), "label", F.get("vec", F.lit(0)), "vec_id").select("vec_id", "label", "vec")
    packed = staged(dealt.mapInPandas(_packed(page), TREE), "packed")
    return staged(packed.select(F.monotonically_increasing_id().alias("tree"), "*"), "trees")


class Tree:
    """Boxes level by level over pages of rows."""

    def __init__(self, row):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.x = np.frombuffer(row["vecs"], np.int64).reshape(row["rows"], row["dims"])
        ends = np.cumsum(row["pages"])
        self.pages = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
        starts = np.array([a for a, _ in self.pages])
        box = [f.reduceat(v, starts, axis=0) for v in (self.labels[:, None], self.x) for f in (np.minimum, np.maximum)]
        boxes, kids, level = [box], [[()] * len(starts)], np.arange(len(starts))
        total = len(starts)
        while len(level) > 1:
            starts = np.arange(0, len(level), FANOUT)
            kids.append([level[s : s + FANOUT].tolist() for s in starts])
            box = [f.reduceat(b, starts, axis=0) for f, b in zip((np.minimum, np.maximum) * 2, box)]
            boxes.append(box)
            level = np.arange(total, total + len(starts))
            total += len(starts)
        self.low_label, self.high_label, self.low, self.high = (np.concatenate([b[k] for b in boxes]) for k in range(4))
        self.low_label, self.high_label = self.low_label[:, 0], self.high_label[:, 0]
        self.kids = [k for one in kids for k in one]
        self.root = total - 1

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest possible score of each row of q with each box."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return product(up, self.low.T) + product(down, self.high.T), product(up, self.high.T) + product(down, self.low.T)

    def best(self, score, low: np.ndarray, high: np.ndarray, label: int, own: bool, but: int | None, k: int, window: tuple[int, int] | None) -> list[tuple[int, int]]:
        """The k best (score, vec_id) inside the window, of the label or of all others; score(page): scores of its rows."""
        found: list[tuple[int, int]] = []  # a heap with the worst first, as (score, -vec_id)

        def opens(node: int) -> bool:
            if (label < self.low_label[node] or label > self.high_label[node]) if own else (self.low_label[node] == self.high_label[node] == label):
                return False
            if window and (high[node] < window[0] or low[node] > window[1]):
                return False
            return len(found) < k or high[node] >= found[0][0]

        queue = [(-high[self.root], self.root)]
        while queue:
            bound, node = heapq.heappop(queue)
            if len(found) == k and -bound < found[0][0]:
                break
            if not opens(node):
                continue
            if self.kids[node]:
                for kid in self.kids[node]:
                    if opens(kid):
                        heapq.heappush(queue, (-high[kid], kid))
                continue
            a, b = self.pages[node]
            s = score(node)
            fits = (self.labels[a:b] == label) if own else (self.labels[a:b] != label)
            if but is not None:
                fits = fits & (self.ids[a:b] != but)
            if window:
                fits = fits & (s >= window[0]) & (s <= window[1])
            if len(found) == k:
                fits = fits & (s >= found[0][0])
            at = np.flatnonzero(fits)
            if len(at) > k:
                # Ties with the k-th stay in, for their ids decide.
                at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
            for i in at.tolist():
                one = (int(s[i]), -int(self.ids[a + i]))
                if len(found) < k:
                    heapq.heappush(found, one)
                elif one > found[0]:
                    heapq.heapreplace(found, one)
        return [(s, -i) for s, i in sorted(found, reverse=True)]


FOUND = "id long, slot int, score long, vec_id long"


def _searched(own: bool, k: int):
    """Anchors of a task in one tree. windows: of each anchor, (slot, low, high); for positives one without bounds."""

    def search(tree: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(tree) and len(anchors):
            t = Tree(tree.iloc[0])
            q = np.array([np.asarray(v, np.int64) for v in anchors["vec"]], np.int64).reshape(len(anchors), -1)
            low, high = t.intervals(q)
            for n, (i, me, label, windows) in enumerate(zip(anchors["id"], anchors["vec_id"], anchors["label"], anchors["windows"])):
                pages: dict[int, np.ndarray] = {}

                def score(page: int, n: int = n, pages: dict = pages) -> np.ndarray:
                    if page not in pages:
                        a, b = t.pages[page]
                        pages[page] = product(t.x[a:b], q[n])
                    return pages[page]

                for w in windows:
                    bounds = None if own else (w["low"], w["high"])
                    out += [(i, w["slot"], s, v) for s, v in t.best(score, low[n], high[n], label, own, me if own else None, k, bounds)]
        return pd.DataFrame(out, columns=["id", "slot", "score", "vec_id"])

    return search


def _routed(anchors: DataFrame, forest: DataFrame, own: bool) -> DataFrame:
    """id, tree, bound (the greatest possible score): the trees that an anchor's windows reach."""
    roots = forest.select("tree", "dims", "low_label", "high_label", "low", "high")
    r, a = max(1, -(-forest.count() // ROOTS)), max(1, -(-anchors.count() // ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = roots.withColumn("r", F.pmod(F.xxhash64("tree"), F.lit(r)).cast("int")).withColumn("a", every(a))
    right = anchors.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(a)).cast("int")).withColumn("r", every(r))

    def meet(boxes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dims, some in queries.groupby(queries["vec"].map(len)):
            b = boxes[boxes["dims"] == dims]
            if not len(b):
                continue
            q, low, high = (np.array([np.asarray(v, np.int64) for v in c], np.int64).reshape(len(c), dims) for c in (some["vec"], b["low"], b["high"]))
            up, down = np.maximum(q, 0), np.minimum(q, 0)
            least, most = product(up, low.T) + product(down, high.T), product(up, high.T) + product(down, low.T)
            label = some["label"].to_numpy()[:, None]
            l, h = b["low_label"].to_numpy()[None, :], b["high_label"].to_numpy()[None, :]
            fits = (l <= label) & (label <= h) if own else (l != label) | (h != label)
            if not own:
                reach = np.zeros(fits.shape, bool)
                for n, windows in enumerate(some["windows"]):
                    for w in windows:
                        reach[n] |= (most[n] >= w["low"]) & (least[n] <= w["high"])
                fits &= reach
            i, j = np.nonzero(fits)
            out.append(pd.DataFrame({"id": some["id"].to_numpy()[i], "tree": b["tree"].to_numpy()[j], "bound": np.clip(most[i, j].astype(float), -9e18, 9e18)}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "tree": [], "bound": []})

    met = left.groupBy("r", "a").cogroup(right.groupBy("r", "a")).applyInPandas(meet, "id long, tree long, bound double")
    return staged(met, "routed")


def _search(pairs: DataFrame, anchors: DataFrame, forest: DataFrame, own: bool, k: int) -> DataFrame:
    """id, slot, score, vec_id: the k best of each tree for pairs(id, tree)."""
    parts = pairs.groupBy("tree").agg(F.ceil(F.count("*") / ANCHORS).alias("parts"))
    left = forest.join(parts, "tree").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    right = pairs.join(parts, "tree").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).select("tree", "part", "id").join(anchors, "id")
    return staged(left.groupBy("tree", "part").cogroup(right.groupBy("tree", "part")).applyInPandas(_searched(own, k), FOUND), "found")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, label: Column, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE, shard: int = SHARD, page: int = PAGE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are rows whose vec_id is divisible by `every`."""
    rows = integer_rows(vectors, label, scale)
    forest = trees(rows, shard, page)
    free = F.array(F.struct(F.lit(0).alias("slot"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")))
    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("windows", free)
    routed = _routed(anchors, forest, True)
    home = routed.groupBy("id").agg(F.max_by("tree", F.struct("bound", "tree")).alias("tree"))
    began = _search(home, anchors, forest, True, positives)
    bar = began.groupBy("id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("bar")).where(F.col("n") == positives)
    # A double may be a little off a long, so the bar is lowered by more than that.
    others = routed.join(home, ["id", "tree"], "left_anti").join(bar, "id", "left").where(F.col("bar").isNull() | (F.col("bound") >= F.col("bar") - F.abs("bar") * 1e-15 - 1))
    first = _first(began.unionByName(_search(others.select("id", "tree"), anchors, forest, True, positives)), positives)
    chosen = staged(first.select("id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # As decimals, for a product of a long may be none.
    score = F.col("positive_score").cast("decimal(38,0)")
    bounds = chosen.select("id", "slot", F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high")).where("low <= high")
    windows = bounds.groupBy("id").agg(F.collect_list(F.struct("slot", "low", "high")).alias("windows"))
    asked = staged(rows.join(windows, "id"), "asked")
    reached = _routed(asked, forest, False)
    home = staged(reached.groupBy("id").agg(F.max_by("tree", F.struct("bound", "tree")).alias("tree")), "home")
    began = _search(home, asked, forest, False, negatives)
    # The other trees are asked for what is not below the k-th best of the first one.
    bars = began.groupBy("id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("bar")).where(F.col("n") == negatives).select("id", "slot", "bar")
    narrow = bounds.join(bars, ["id", "slot"], "left").withColumn("low", F.greatest("low", "bar")).groupBy("id").agg(F.collect_list(F.struct("slot", "low", "high")).alias("windows"))
    again = staged(asked.drop("windows").join(narrow, "id"), "again")
    best = _first(began.unionByName(_search(reached.join(home, ["id", "tree"], "left_anti").select("id", "tree"), again, forest, False, negatives)), negatives)
    named = rows.select("id", F.col("vec_id").alias("anchor_id"))
    out = best.select("id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen, ["id", "slot"]).join(named, "id")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), label)


OP13_SQL = """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM fine a JOIN fine b ON a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INT AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 3
"""
