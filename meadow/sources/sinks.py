"""Writers. All go through Spark's committers; none writes from the driver."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadow.operators.rollup import merged


def by_video(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder per video, replacing the videos that df has and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("video").format(fmt).save(path)


def merge_tables(tables: list[DataFrame], path: str) -> None:
    merged(tables).write.mode("overwrite").option("header", True).csv(path)


def manifest(kept: DataFrame, removed: DataFrame, path: str) -> bool:
    """The manifest in order, and the removal log, which is only rewritten if this run removed something."""
    kept.orderBy("class_id", "split", "path").write.mode("overwrite").option("header", True).csv(f"{path}/manifest")
    if removed.isEmpty():
        return False
    removed.orderBy("path").write.mode("overwrite").option("header", True).csv(f"{path}/removed")
    return True


def class_index(rows: DataFrame, path: str) -> None:
    """One JSON row: class name to id, and counts per split."""
    ids = rows.select("cls", "class_id").distinct().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("cls", "class_id")))).alias("class_to_id"))
    n = rows.groupBy("split").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("split", "n")))).alias("splits"))
    ids.join(n).write.mode("overwrite").json(path)


def label_documents(docs: DataFrame, path: str) -> None:
    """One JSON document per split (see dense_labels)."""
    docs.write.mode("overwrite").partitionBy("split").json(path)


def yolo_lines(boxes: DataFrame) -> DataFrame:
    """boxes(split, image, cls, x, y, w, h) as one text per image."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "x", "y", "w", "h").alias("line")
    return boxes.select("split", "image", line).groupBy("split", "image").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("value"))


def yolo_labels(boxes: DataFrame, path: str) -> None:
    yolo_lines(boxes).write.mode("overwrite").partitionBy("split", "image").text(path)


def annotations(rows: DataFrame, path: str, *order: str) -> None:
    rows.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def split_lists(rows: DataFrame, path: str) -> None:
    """A text of paths per split."""
    rows.select("split", F.col("path").alias("value")).repartition("split").sortWithinPartitions("split", "value").write.mode("overwrite").partitionBy("split").text(path)


def report(df: DataFrame, path: str, blessed: tuple[str, ...] = ()) -> None:
    """One JSON document; a path that holds a blessed curve is refused."""
    if any(path.rstrip("/") == b.rstrip("/") for b in blessed):
        raise PermissionError(f"{path} holds a blessed curve")
    df.coalesce(1).write.mode("overwrite").json(path)


def png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """An 8-bit PNG of pixels in Spark's order: gray, or blue, green, red and maybe alpha."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    x = x if channels == 1 else x[:, :, [2, 1, 0, 3][:channels]]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), x.reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def pictures(rows: DataFrame, folder: str) -> DataFrame:
    """rows(path, height, width, n_channels, data) as PNG files below `folder`, written by the tasks; where height is negative or
    null, data goes to the file as it is. Returns path and bytes of each file.

    A file is written under another name and then moved, so a task that runs twice leaves whole files, and the same ones.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = files.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        made = set()
        for b in batches:
            sizes = []
            for r in b.itertuples(index=False):
                body = png(int(r.height), int(r.width), int(r.n_channels), r.data) if r.height is not None and r.height > 0 else bytes(r.data or b"")
                at = f"{top}/{r.path}"
                if (below := at.rpartition("/")[0]) not in made:
                    system.create_dir(below, recursive=True)
                    made.add(below)
                with system.open_output_stream(f"{at}.part") as f:
                    f.write(body)
                system.move(f"{at}.part", at)
                sizes.append(len(body))
            yield pd.DataFrame({"path": b["path"], "bytes": sizes})

    return rows.select("path", "height", "width", "n_channels", "data").mapInPandas(work, "path string, bytes long")
