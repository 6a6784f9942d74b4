"""Quality scores learned from preference pairs (Bradley-Terry), thresholded at a score quantile.

A pair is a document labelled good and one labelled bad; the model is the logistic loss on the difference of their
features, without an intercept, so it learns what makes one document better than another. Features are how often
classes of bytes follow each other in the whole text (letters of either case, digits, blanks, line ends, single
punctuation marks, bytes of other alphabets), the lengths of text and words, and how many words and lines repeat.
The threshold is the quantile of the training scores that leaves the labels' share of bad documents below it; the
score is the logistic function of the distance to it.

The fit reads every labelled row. They are dealt to blocks, and each row meets all rows of the other class in its block, so the
pairs grow with the rows; sums over them are made by tasks. Scoring covers every row.

Null and empty texts are scored (all features 0). A document with several labels counts as the mean of them, bad below
one half; null labels, and labels of documents that aren't there, are left out. With no pair to learn from, every score is 0.5.
Documents with a null id are scored and never held out. Columns of documents named held_out, score or predicted give way to the new ones; of the others,
only the named ones are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from meadow.functions.shared import staged
from meadow.llm.common import read, small_batches

#: Marks that are classes of their own; other bytes fall into one of the classes after them.
MARKS = b".,;:!?|#$%&*=<>/\\\"'()-_@+"
CLASSES = len(MARKS) + 9


def _classes() -> bytes:
    table = bytearray([CLASSES - 1] * 256)
    for b in range(256):
        c = bytes([b])
        if c in MARKS:
            table[b] = MARKS.index(c)
        elif c.islower():
            table[b] = len(MARKS)
        elif c.isupper():
            table[b] = len(MARKS) + 1
        elif c.isdigit():
            table[b] = len(MARKS) + 2
        elif c == b" ":
            table[b] = len(MARKS) + 3
        elif c == b"\n":
            table[b] = len(MARKS) + 4
        elif c.isspace():
            table[b] = len(MARKS) + 5
        elif 0x80 <= b < 0xC0:
            table[b] = len(MARKS) + 6
        elif b >= 0xC0:
            table[b] = len(MARKS) + 7
    return bytes(table)


TABLE = _classes()
N_FEATURES = CLASSES * CLASSES + 9


def features(text: str | None) -> np.ndarray:
    """Of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    x = np.zeros(N_FEATURES)
    if not raw:
        return x
    c = np.frombuffer(raw.translate(TABLE), np.uint8)
    if len(c) > 1:
        follow = np.bincount(c[:-1].astype(np.int32) * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        x[: CLASSES * CLASSES] = np.sqrt(follow / (len(c) - 1))
    words, lines = raw.split(), raw.split(b"\n")
    n, m = np.log1p(len(c)) / 10, max(len(words), 1)
    same = sum(a == b for a, b in zip(words, words[1:]))
    again = 1 - len(set(lines)) / len(lines)
    x[-9:] = 1, n, n * n, np.log1p(len(c) / m), same / m, np.sqrt(same / m), len(set(words)) / m, n * len(set(words)) / m, np.sqrt(again)
    return x


@dataclass
class Ranker:
    weights: np.ndarray
    threshold: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x @ self.weights - self.threshold) / self.scale, -30, 30)
        return 1 / (1 + np.exp(-z))


def fit_pairs(good: np.ndarray, bad: np.ndarray, bad_share: float, max_pairs: int = 40_000, l2: float = 3e-5, steps: int = 12, solves: int = 100, seed: int = 11) -> Ranker:
    """Newton steps on mean log(1 + exp(-w (x_good - x_bad))) + l2 |w|^2, each solved by conjugate gradients.

    A pair's difference is never formed: what the loss needs of it are the scores of its two documents, and sums over the
    pairs of a document. So a step costs a few products with the `max_rows` rows, however many pairs there are.
    """
    w = np.zeros(good.shape[1])
    if not len(good) or not len(bad):
        return Ranker(w, 0.0, 1.0)
    rng = np.random.default_rng(seed)
    n = min(max_pairs, len(good) * len(bad))
    i = np.concatenate([rng.permutation(len(good)) for _ in range(-(-n // len(good)))])[:n]
    j = np.concatenate([rng.permutation(len(bad)) for _ in range(-(-n // len(bad)))])[:n]
    used = (good != good[0]).any(0) | (bad != good[0]).any(0)  # what all rows agree on tells no pair apart
    g, b, v = good[:, used], bad[:, used], np.zeros(int(used.sum()))

    def back(x: np.ndarray) -> np.ndarray:
        """Sum of x times the difference, over the pairs."""
        return g.T @ np.bincount(i, x, len(g)).astype(g.dtype) - b.T @ np.bincount(j, x, len(b)).astype(b.dtype)

    def ahead(u: np.ndarray) -> np.ndarray:
        """The differences of the pairs, times u."""
        u = u.astype(g.dtype)
        return (g @ u).astype(float)[i] - (b @ u).astype(float)[j]

    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(ahead(v), -30, 30)))
        rest = back(p) / n - 2 * l2 * v  # minus the gradient
        step, way, size = np.zeros_like(v), rest.copy(), rest @ rest
        goal = size * 1e-4
        for _ in range(solves):
            if size <= max(goal, 1e-24):
                break
            curved = back(p * (1 - p) * ahead(way)) / n + 2 * l2 * way
            t = size / (way @ curved)
            step, rest, was = step + t * way, rest - t * curved, size
            size = rest @ rest
            way = rest + size / was * way
        v += step
        if not len(step) or np.abs(step).max() < 1e-4:
            break
    w[used] = v
    s_good, s_bad = np.sort(good @ w), np.sort(bad @ w)
    # Training scores, each class weighted to its share of all labels; the quantile at the share of bad ones.
    s = np.concatenate([s_good, s_bad])
    mass = np.concatenate([np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))])
    order = np.argsort(s, kind="mergesort")
    s, at = s[order], int(np.searchsorted(np.cumsum(mass[order]), bad_share - 1e-12))
    at = min(at, len(s) - 1)
    threshold = (s[at] + s[min(at + 1, len(s) - 1)]) / 2
    return Ranker(w, float(threshold), 1.0)


def label_table(labels: DataFrame) -> DataFrame:
    """doc_id, good: one row for each labelled document."""
    return labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x, np.float32).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.float32).reshape(-1, N_FEATURES)


def learned(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, good, x: the features of every labelled document, whatever rows repeat its id."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "good": b["good"], "x": [_packed(features(t)) for t in b["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    one = docs.select("doc_id", "text").join(label_table(labels), "doc_id").groupBy("doc_id").agg(F.any_value("good").alias("good"), F.min_by("text", F.xxhash64("text")).alias("text"))
    return staged(one.select("doc_id", "good", "text").mapInPandas(vectors, f"doc_id {kind}, good boolean, x binary"), "learned")


def in_blocks(rows: DataFrame, n_good: int, n_bad: int, block_rows: int = 512, least: int = 32) -> DataFrame:
    """One row for each block of about `block_rows` labelled documents: their features by class, and which are there first.

    A document is in one block, by a hash of its id; of a class so rare that a block would hold less than `least`, it is in several.
    """
    n = max(1, round((n_good + n_bad) / block_rows))
    copies = lambda m: F.lit(min(n, max(1, -(-least * n // max(m, 1)))))
    k = F.explode(F.sequence(F.lit(1), F.when(F.col("good"), copies(n_good)).otherwise(copies(n_bad)))).alias("k")
    put = rows.select("doc_id", "good", "x", k).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(7)) + F.col("k") - 1, F.lit(n)))

    def packed(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["doc_id", "k"], kind="mergesort")
        part = {g: b[b["good"] == g] for g in (True, False)}
        x = {g: _packed(np.concatenate([_unpacked(x) for x in p["x"]])) if len(p) else _packed(np.empty((0, N_FEATURES))) for g, p in part.items()}
        return pd.DataFrame({"good": [x[True]], "bad": [x[False]], "first": [np.concatenate([part[g]["k"] == 1 for g in (True, False)]).astype(bool).tobytes()]})

    blocks = put.groupBy("block").applyInPandas(packed, "good binary, bad binary, first binary")
    return staged(blocks.repartition(max(1, n // 32)), "blocks")


def _pair_sums(blocks: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of all pairs in the blocks, its gradient and its curvature. Tasks add up their blocks, Spark the tasks, row by row of the curvature."""
    f = N_FEATURES

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, curved = np.zeros(f + 2), np.zeros((f, f))
        for b in batches:
            for r in b.itertuples(index=False):
                g, d = _unpacked(r.good), _unpacked(r.bad)
                s = np.clip((g @ w)[:, None] - (d @ w)[None], -30, 30)
                p = 1 / (1 + np.exp(s))
                head[:f] += p.sum(1) @ g - p.sum(0) @ d
                head[f:] += np.logaddexp(0, -s).sum(), s.size
                c = (p * (1 - p)).astype(np.float32)
                cross = g.T @ (c @ d)
                curved += (g.T * c.sum(1)) @ g + (d.T * c.sum(0)) @ d - cross - cross.T
        rows = [head.tobytes(), *[curved[i, i:].astype(np.float32).tobytes() for i in range(f)]]
        yield pd.DataFrame({"i": range(f + 1), "v": rows})

    def added(b: pd.DataFrame) -> pd.DataFrame:
        i = int(b["i"].iat[0])
        kind = np.float32 if i else np.float64
        v = np.sum([np.frombuffer(v, kind).astype(float) for v in sorted(b["v"])], axis=0)
        return pd.DataFrame({"i": [i], "v": [v.tobytes()]})

    parts = {r["i"]: np.frombuffer(r["v"]) for r in blocks.select("good", "bad").mapInPandas(summed, "i int, v binary").groupBy("i").applyInPandas(added, "i int, v binary").collect()}
    head, curved = parts[0], np.zeros((f, f))
    for i in range(f):
        curved[i, i:] = parts[i + 1]
    curved += np.triu(curved, 1).T
    n = max(head[f + 1], 1.0)
    return head[f] / n, head[:f] / n, curved / n


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, l2: float = 3e-5, steps: int = 12, **how) -> Ranker:
    """docs(doc_id, text), labels(doc_id, quality): the rows to learn from, held-out ones already taken away.

    Newton steps on the mean loss over all pairs of all blocks, halved while they don't lessen it; they end where the gradient
    vanishes, wherever they began. They begin at the fit of `max_rows` rows of each class, which saves passes and no more.
    """
    small_batches(docs.sparkSession, 64)
    rows = learned(docs, labels)
    n = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count("*").alias("n")).collect()}
    turn = F.xxhash64("doc_id", F.lit(5))
    x = {}
    for g in (True, False):
        picked = rows.where(F.col("good") == g).orderBy(turn, "doc_id").limit(max_rows).select("x").collect()
        x[g] = np.concatenate([np.empty((0, N_FEATURES), np.float32), *[_unpacked(r["x"]) for r in picked]])
    begun = fit_pairs(x[True], x[False], n.get(False, 0) / max(sum(n.values()), 1), l2=l2, steps=steps, **how)
    del x
    if len(n) < 2:
        return begun
    blocks = in_blocks(rows, n[True], n[False])
    w, step, tried = begun.weights, None, begun.weights
    loss = np.inf
    for _ in range(2 * steps):
        mean, back, curved = _pair_sums(blocks, tried.astype(np.float32))
        mean += l2 * tried @ tried
        if step is not None and mean > loss + 1e-7 and np.abs(step).max() > 1e-4:
            step = step / 2
        else:
            w, loss = tried, mean
            step = np.linalg.solve(curved + 2 * l2 * np.eye(len(w)), back - 2 * l2 * w)
            now = step @ (back - 2 * l2 * w)  # about twice what the step gains
            if now < 1e-7:
                break
        tried = w + step

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                z = np.concatenate([_unpacked(r.good), _unpacked(r.bad)]).astype(float) @ w
                yield pd.DataFrame({"z": z[np.frombuffer(r.first, bool)]})

    # As many scores lie below the threshold as there are bad documents.
    sorted_ = staged(blocks.mapInPandas(scores, "z double"), "scores").orderBy("z").rdd.zipWithIndex()
    cut = sorted_.filter(lambda r: r[1] in (n[False] - 1, n[False])).map(lambda r: r[0]["z"]).collect()
    return Ranker(w, float(sum(cut) / len(cut)), 1.0)


def score_column(model: Ranker, text: Column) -> Column:
    """The score of a text column, by an Arrow batch at a time."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.score(np.array([features(t) for t in b]).reshape(-1, N_FEATURES)))

    return score(text)


def scored(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs with held_out, score and predicted; labels of held-out documents are never seen."""
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), **how)
    return docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", score_column(model, F.col("text"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
