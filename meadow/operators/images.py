"""Jobs over image files: corrupt ones, statistics, perceptual hashes.

Files come from Spark's image reader (it gives height -1 for what it can't decode) and go through numpy a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meadow.functions.shared import staged

STATS = "path string, height int, width int, brightness double, contrast double, aspect double, mode string, grayscale boolean, blank boolean, blur double, phash long"


#: Files that a task reads, if there are more than a few tasks a core.
FILES_PER_TASK = 512


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, n_channels, data: every file below `path`.

    Spark's readers pass over files without a byte; its file index (on the driver, names only) has them, and they are added as
    files that can't be decoded. The names come from the JVM as one text (they are encoded, so without line ends). Readers put a few dozen files into a task however small they are, so
    tasks are put together until they have FILES_PER_TASK; Arrow batches are bounded in bytes.
    """
    recursive = {"recursiveFileLookup": "true"}
    rows = spark.read.format("image").options(**recursive).load(path)
    names = [n for n in spark._jvm.org.apache.hadoop.util.StringUtils.join("\n", rows._jdf.inputFiles()).split("\n") if n]
    tasks = max(4 * spark.sparkContext.defaultParallelism, ceil(len(names) / FILES_PER_TASK))
    read = rows.select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.data").coalesce(tasks)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    listed = spark.createDataFrame(pa.table({"path": pa.array(names, pa.string())}))
    there = spark.read.format("binaryFile").options(**recursive).load(path).select(plain("path").alias("there")).coalesce(tasks)
    none = listed.join(there, plain("path") == F.col("there"), "left_anti")
    return read.unionByName(none.select("path", *[F.lit(-1).alias(c) for c in ("height", "width", "n_channels")], F.lit(b"").alias("data")))


def corrupt(rows: DataFrame) -> DataFrame:
    return rows.where("height < 0 OR height IS NULL").select("path", F.lit("can't be decoded").alias("error"))


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of (h, w, channels) in blue, green, red order."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].astype(float)
    b, g, r = (pixels[:, :, i].astype(float) for i in range(3))
    return 0.114 * b + 0.587 * g + 0.299 * r


def laplacian_variance(g: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian; 0 for images under three pixels."""
    if min(g.shape) < 3:
        return 0.0
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


@lru_cache(64)
def _resized(size: int, n: int) -> np.ndarray:
    """(n, size) weights of a Lanczos window of three lobes, stretched to the reduction when it shrinks."""
    scale = size / n
    wide = max(scale, 1.0)
    center = (np.arange(n) + 0.5) * scale
    x = (np.arange(size)[None] + 0.5 - center[:, None]) / wide
    low, high = np.floor(np.maximum(center - 3 * wide + 0.5, 0)), np.floor(np.minimum(center + 3 * wide + 0.5, size))
    inside = (np.arange(size)[None] >= low[:, None]) & (np.arange(size)[None] < high[:, None])
    w = np.where(inside & (np.abs(x) < 3), np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def _shrunk(g: np.ndarray, n: int = 32) -> np.ndarray:
    """n by n bytes: columns first, then rows, each rounded to whole values from 0 to 255."""
    byte = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    return byte(_resized(g.shape[0], n) @ byte(byte(g) @ _resized(g.shape[1], n).T))


def perceptual_hash(g: np.ndarray) -> int:
    """64 bits: the low 8 by 8 of the cosine transform of the image at 32 by 32 (Lanczos), each over the median or not."""
    k = np.arange(32)
    dct = 2 * np.cos(np.pi * np.outer(k, 2 * k + 1) / 64)
    low = (dct @ _shrunk(g) @ dct.T)[:8, :8].ravel()
    bits = "".join("1" if x else "0" for x in low > np.median(low))
    return int(np.array([int(bits, 2)], np.uint64).view(np.int64)[0])


def statistics(rows: DataFrame) -> DataFrame:
    """STATS of every image that can be decoded."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                p = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.n_channels)
                g = gray(p)
                wide = p[:, :, :3].astype(int)
                same = p.shape[2] < 3 or float((wide.max(2) - wide.min(2)).mean()) < 2
                out.append((r.path, r.height, r.width, float(g.mean()), float(g.std()), r.width / r.height, {1: "L", 3: "RGB", 4: "RGBA"}.get(r.n_channels, "?"), same, float(g.std()) < 1, laplacian_variance(g), perceptual_hash(g)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in STATS.split(", ")])

    return rows.where("height > 0").select("path", "height", "width", "n_channels", "data").mapInPandas(work, STATS)


def quality_flags(stats: DataFrame) -> DataFrame:
    """One row: how many are grayscale, blank, dark, bright, and as blurred as the lowest 5 %. The figures are read twice, the
    images once: what is needed of them is staged."""
    stats = staged(stats.select("grayscale", "blank", "blur", "brightness"), "looks")
    limit = stats.agg(F.percentile("blur", F.lit(0.05)).alias("p5"))
    return stats.join(F.broadcast(limit)).agg(
        F.count("*").alias("n"),
        F.count_if("grayscale").alias("grayscale"),
        F.count_if("blank").alias("blank"),
        F.count_if(F.col("blur") <= F.col("p5")).alias("blurred"),
        F.count_if(F.col("brightness") < 30).alias("dark"),
        F.count_if(F.col("brightness") > 225).alias("bright"),
    )


def hashed(rows: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """path, hash; with a cache (path, hash) only what it lacks is worked out."""
    if cache is None:
        return statistics(rows).select("path", F.col("phash").alias("hash"))
    todo = rows.join(cache.select("path"), "path", "left_anti")
    known = cache.join(rows.select("path"), "path", "left_semi").select("path", "hash")
    return known.unionByName(statistics(todo).select("path", F.col("phash").alias("hash")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
