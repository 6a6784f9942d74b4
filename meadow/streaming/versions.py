"""Tables of folders by key with snapshot isolation: a reader sees all of a batch or nothing of it.

A version is a manifest: which folder holds each partition. A batch writes the partitions it changes to folders of its own,
then publishes the manifest of the next version by renaming it into place, once. Readers take the newest manifest there is
and read the folders it names, which no later batch touches; a batch that breaks off before its rename has changed
nothing, and one that comes again finds its number published. Old versions go once more than `keep` newer ones are there.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Versions:
    """rows partitioned by one column of dates or strings."""

    def __init__(self, spark: SparkSession, at: str, part: str, schema: str, keep: int = 3):
        self.spark, self.at, self.part, self.schema, self.keep = spark, at.rstrip("/"), part, schema, keep

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        path, fs = self._path("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def manifest(self, number: int | None = None) -> dict[str, str]:
        """Partition: folder, in the newest version or a given one."""
        numbers = self.numbers()
        if not numbers:
            return {}
        rows = self.spark.read.schema("text string").text(f"{self.at}/manifests/v={numbers[-1] if number is None else number}").collect()
        return json.loads(rows[0]["text"])

    def read(self, manifest: dict[str, str] | None = None, only: list[str] | None = None) -> DataFrame:
        """The rows of a manifest's partitions (the newest one's, if none is given)."""
        folders = {k: v for k, v in (self.manifest() if manifest is None else manifest).items() if only is None or k in only}
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(set(folders.values())))

    def _publish(self, number: int, manifest: dict[str, str]) -> bool:
        attempt, fs = self._path(f"attempt-{uuid.uuid4().hex}")
        self.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "text string").coalesce(1).write.text(attempt.toString())
        target, _ = self._path(f"manifests/v={number}")
        fs.mkdirs(target.getParent())
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(attempt, target, self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError:
            if number not in self.numbers():
                raise
            fs.delete(attempt, True)
            return False
        return True

    def upsert(self, batch: DataFrame, keys: list[str], number: int) -> bool:
        """Rows of batch replace those of the same keys, as version `number`; False if that is there already.

        Partitions that the batch doesn't touch keep their folders. Their names come to the driver: days, not rows.
        """
        if number in self.numbers():
            return False
        before = self.manifest()
        name: Column = F.col(self.part).cast("string")
        touched = [r[0] for r in batch.select(name).distinct().collect()]
        old = self.read(before, touched).join(batch.select(*keys), keys, "left_anti")
        folder = f"{self.at}/rows/{number}-{uuid.uuid4().hex}"
        whole = old.unionByName(batch.select(*old.columns)).withColumn("_part", name)
        whole.repartition("_part").write.partitionBy("_part").parquet(folder)
        done = self._publish(number, before | {t: f"{folder}/_part={t}" for t in touched})
        self._forget()
        return done

    def _forget(self) -> None:
        """Delete manifests beyond `keep`, and folders that none of the kept ones names."""
        numbers = self.numbers()
        if len(numbers) <= self.keep:
            return
        kept = {f for n in numbers[-self.keep :] for f in self.manifest(n).values()}
        for n in numbers[: -self.keep]:
            for folder in set(self.manifest(n).values()) - kept:
                path, fs = self._path(folder.removeprefix(f"{self.at}/"))
                fs.delete(path, True)
            path, fs = self._path(f"manifests/v={n}")
            fs.delete(path, True)
