"""A callback for each row of a stream, once, with a ledger of what each task has called.

Spark gives the rows of a partition of an epoch again, in the same order, when its task is tried again. So the ledger holds
for each (epoch, partition) how many rows were called, and a later attempt passes over that many. A task that fails
records its count as it closes; for a process that dies without closing, the count is also written every `every` calls, and
no more calls than that can come twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs as files


class Ledger:
    """Counts in a folder that all executors share."""

    def __init__(self, at: str):
        self.at = at.rstrip("/")

    def _file(self, epoch: int, partition: int) -> tuple[files.FileSystem, str]:
        system, path = files.FileSystem.from_uri(self.at if "://" in self.at else f"file://{self.at}")
        return system, f"{path}/{epoch}/{partition}"

    def called(self, epoch: int, partition: int) -> int:
        system, path = self._file(epoch, partition)
        if system.get_file_info(path).type == files.FileType.NotFound:
            return 0
        with system.open_input_stream(path) as f:
            return int(f.read() or b"0")

    def record(self, epoch: int, partition: int, n: int) -> None:
        """By a new file moved over the old one, so that a reader sees one of the two."""
        system, path = self._file(epoch, partition)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{path}.new") as f:
            f.write(str(n).encode())
        system.move(f"{path}.new", path)


class Once:
    """A foreach writer: on_row(row) for every row that the ledger doesn't have.

    on_row may have open(partition, epoch) and close(error), called around the rows of a task.
    """

    def __init__(self, on_row: Callable, ledger: Ledger, every: int = 100):
        self.on_row, self.ledger, self.every = on_row, ledger, every

    def open(self, partition: int, epoch: int) -> bool:
        self.key, self.at, self.done = (epoch, partition), 0, self.ledger.called(epoch, partition)
        if hasattr(self.on_row, "open"):
            self.on_row.open(partition, epoch)
        return True

    def process(self, row) -> None:
        self.at += 1
        if self.at <= self.done:
            return
        self.on_row(row)
        self.done = self.at
        if self.done % self.every == 0:
            self.ledger.record(*self.key, self.done)

    def close(self, error) -> None:
        if hasattr(self.on_row, "close"):
            self.on_row.close(error)
        if hasattr(self, "key") and self.done:
            self.ledger.record(*self.key, self.done)
