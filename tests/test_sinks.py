"""Sinks across failures: calls once, versions whole, a stream that is stopped in the middle."""

import json
import random

import pytest
from pyspark.sql import functions as F

from meadow.plans import streams
from meadow.sources.readers import DETECTIONS, detection_stream
from meadow.streaming import live
from meadow.streaming.callbacks import Ledger, Once
from meadow.streaming.versions import Versions
from tests.test_streaming import rows


class Fails:
    """A callback that notes its calls in a file each, and fails once in the middle of a task."""

    def __init__(self, at, after):
        self.at, self.after = str(at), after

    def open(self, partition, epoch):
        self.here = 0

    def __call__(self, row):
        import os
        import uuid

        self.here += 1
        if self.here > self.after and not os.path.exists(f"{self.at}/failed"):
            open(f"{self.at}/failed", "w").close()
            raise RuntimeError("lost")
        with open(f"{self.at}/{uuid.uuid4().hex}.call", "w") as f:
            f.write(json.dumps([row.camera, row.seq]))


def test_each_landing_is_called_once_though_a_task_fails(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    n = 40
    landed = spark.createDataFrame([("c", k) for k in range(n)], "camera string, seq long").select(*[(F.col(c.split()[0]) if c.split()[0] in ("camera", "seq") else F.lit(None)).cast(c.split()[1]).alias(c.split()[0]) for c in live.LANDED.split(", ")])
    landed.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(live.LANDED).parquet(str(tmp_path / "in"))
    q = live.call_for_each(stream(), Fails(tmp_path / "calls", 17), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    except Exception:  # a local session doesn't try a task again, so the batch is
        q = live.call_for_each(stream(), Fails(tmp_path / "calls", 17), str(tmp_path / "cp"))
        q.processAllAvailable()
    finally:
        q.stop()
    calls = sorted(json.loads(p.read_text())[1] for p in (tmp_path / "calls").glob("*.call"))
    assert (tmp_path / "calls" / "failed").exists() and calls == list(range(n))


def test_ledger_of_a_process_that_dies(tmp_path):
    got = []
    ledger = Ledger(str(tmp_path))
    once = Once(got.append, ledger, every=4)
    once.open(3, 7)
    for k in range(10):
        once.process(k)  # and never closes
    again = Once(got.append, ledger, every=4)
    again.open(3, 7)
    for k in range(12):
        again.process(k)
    again.close(None)
    assert sorted(got) == sorted([*range(12), 8, 9]) and ledger.called(7, 3) == 12 and ledger.called(7, 2) == 0
    other = Once(got.append, ledger)
    other.open(3, 8)
    other.close(None)
    assert ledger.called(8, 3) == 0


KIND = "day date, k long, n long"


def batch(spark, *rows):
    return spark.createDataFrame(rows, "day string, k long, n long").withColumn("day", F.col("day").cast("date"))


def values(df):
    return sorted((str(r.day), r.k, r.n) for r in df.collect())


def test_a_reader_between_two_writes_sees_whole_versions(spark, tmp_path):
    t = Versions(spark, str(tmp_path), "day", KIND, keep=2)
    assert values(t.read()) == [] and t.upsert(batch(spark, ("2024-01-01", 1, 10), ("2024-01-02", 1, 20)), ["day", "k"], 0)
    early = t.read()
    assert t.upsert(batch(spark, ("2024-01-01", 1, 11), ("2024-01-01", 2, 5)), ["day", "k"], 1)
    assert values(early) == [("2024-01-01", 1, 10), ("2024-01-02", 1, 20)]
    assert values(t.read()) == [("2024-01-01", 1, 11), ("2024-01-01", 2, 5), ("2024-01-02", 1, 20)]
    # The same batch again changes nothing.
    assert not t.upsert(batch(spark, ("2024-01-01", 1, 99)), ["day", "k"], 1) and len(values(t.read())) == 3
    for n in range(2, 6):
        t.upsert(batch(spark, ("2024-01-03", 1, n)), ["day", "k"], n)
    assert t.numbers() == [4, 5] and values(t.read())[-1] == ("2024-01-03", 1, 5) and len(values(t.read())) == 4


def test_a_write_that_breaks_off_loses_nothing(spark, tmp_path):
    t = Versions(spark, str(tmp_path), "day", KIND)
    t.upsert(batch(spark, ("2024-01-01", 1, 10)), ["day", "k"], 0)
    publish = t._publish

    def lost(number, manifest):
        raise RuntimeError("lost")

    t._publish = lost
    with pytest.raises(RuntimeError):
        t.upsert(batch(spark, ("2024-01-01", 1, 99)), ["day", "k"], 1)
    assert values(t.read()) == [("2024-01-01", 1, 10)]
    t._publish = publish
    assert t.upsert(batch(spark, ("2024-01-01", 2, 7)), ["day", "k"], 1) and values(t.read()) == [("2024-01-01", 1, 10), ("2024-01-01", 2, 7)]
    # Two writers of one number: the first one's version stays.
    t.numbers = lambda: [0, 1]
    assert not t._publish(1, {}) and t.manifest(1)


@pytest.mark.parametrize("seed", [3])
def test_a_stream_that_is_stopped_anywhere_goes_on(spark, tmp_path, seed):
    spark.conf.set(streams.PROVIDER, live.STATE_STORE)
    r = random.Random(seed)
    data = sorted(rows("a", 1, 20) + rows("b", 2, 20), key=lambda x: x[1])
    at, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    cuts = sorted(r.sample(range(1, len(data)), 3))
    for a, z in zip([0, *cuts], [*cuts, len(data)]):
        spark.createDataFrame(data[a:z], DETECTIONS).coalesce(1).write.mode("append").parquet(at)
        streams._finished(live.append_to(live.live_landings(detection_stream(spark, at)), out, cp))
    table = spark.createDataFrame(data, DETECTIONS)
    for hours in (0, 1):
        streams._after(table, hours).write.mode("append").parquet(at)
        streams._finished(live.append_to(live.live_landings(detection_stream(spark, at)), out, cp))
    names = ["camera", "seq", "t_enter_s", "t_exit_s", "flower_id", "insect_type"]
    got = sorted(map(tuple, spark.read.schema(live.LANDED).parquet(out).where("camera <> 'end'").select(*names).collect()))
    assert got == sorted(map(tuple, live.replayed(table).select(*names).collect())) and len(got) > 1
