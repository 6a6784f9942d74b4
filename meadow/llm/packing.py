"""Best-fit packing with certified bin counts.

A document longer than a sequence is cut into pieces of full length; its first piece takes what is left over. Pieces of
full length are sequences of their own. The others are dealt by length to partitions of about `per_part` pieces, each
packed by best-fit decreasing (largest piece first, into the fullest sequence that has room). Dual feasible functions
give a lower bound on the sequences a partition needs; one that meets its bound is certified and stays. Partitions with
a gap send the documents of their emptiest sequences to an exchange, where they are dealt to new partitions, packed and
bounded anew; this repeats `rounds` times. Partitions hold a bounded number of pieces and the exchange only
what the gaps ask for, so no task grows with the data.

Null texts count as empty (one piece: the end-of-text id). Rows that repeat are packed each. Ties in length go by id and
piece, nulls first. Only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadow.functions.shared import staged
from meadow.llm.common import read, small_batches
from meadow.llm.tokens import RANKS, TOKENIZER, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, with_ids: bool = False, ranks: str = RANKS, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """docs(doc_id, text) as one row for each piece; ids only if asked for."""
    small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kind = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, tokenizer)
        for b in batches:
            got: dict[str, list] = {name: [] for name in kind.names}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*(encode(text) if text else ()), end_id], "<u4")
                first = len(ids) % size or size
                begins = [0, *range(first, len(ids), size)]
                for k, (a, z) in enumerate(zip(begins, [*begins[1:], len(ids)])):
                    row = (doc_id, k, a, z - a, zlib.crc32(ids[a:z].tobytes()), ids[a:z].tolist() if with_ids else None)
                    for name, v in zip(kind.names, row):
                        got[name].append(v)
            yield pa.RecordBatch.from_pydict(got, kind)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Sequences needed at least: the best of two families of dual feasible functions over a histogram of lengths.

    The first rounds lengths over size - t up to a whole sequence and those under t down to nothing; the second rounds
    (k + 1) times a length down to whole parts of 1 / k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    at = np.arange(size + 1)
    number, total = np.cumsum(count), np.cumsum(count * at)
    t = np.arange(size // 2 + 1)
    below = np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    whole = number[-1] - number[size - t]
    best = int(np.max(whole + -(-(total[size - t] - below) // size)))
    for k in range(1, 33):
        exact = (at * (k + 1)) % size == 0
        parts = np.where(exact, at * (k + 1) * k, ((at * (k + 1)) // size) * size * (k + 1))  # times 1 / (size k (k + 1))
        best = max(best, -(-int((parts * count).sum()) // (size * k * (k + 1))))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Sequence of each piece, given by falling length, and how many sequences there are."""
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, n = 0, 0  # bit r of rooms: a sequence has r tokens of room
    into = np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = size, n, n + 1
        into[i] = b
        left = room - length
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return into, n


def _pack(rows: pd.DataFrame, size: int, level: int, last: bool) -> pd.DataFrame:
    """One partition packed; `open` marks the pieces it sends to the exchange."""
    rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], na_position="first", kind="mergesort").reset_index(drop=True)
    lengths = rows["length"].to_numpy(np.int64)
    into, n = best_fit(lengths, size)
    fill = np.bincount(into, weights=lengths, minlength=n).astype(np.int64)
    order = np.argsort(into, kind="stable")
    running = np.cumsum(lengths[order]) - lengths[order]
    starts = np.concatenate([[0], np.cumsum(fill)[:-1]])
    offset = np.empty(len(rows), np.int64)
    offset[order] = running - starts[into[order]]
    gap = n - lower_bound(lengths, size)
    sent = np.zeros(n, bool)
    if gap > 0 and not last:
        sent[np.argsort(fill, kind="stable")[: max(16 * gap, n // 8)]] = True
    rows["sequence_id"] = (level << 56) + (int(rows["part"].iat[0]) << 24) + into
    rows["offset"] = offset
    rows["open"] = sent[into]
    rows["gap"] = gap
    return rows


def _packer(size: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: _pack(rows, size, level, last)


def _dealt(rows: DataFrame, parts: int, held: int = 100_000) -> DataFrame:
    """rows with part: every `held` rows are sorted by length and dealt in turn, so that partitions get like lengths and
    their bounds add up to little more than the bound of all."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, full = 0, []

        def out() -> pd.DataFrame:
            nonlocal turn
            rows = pd.concat(full).sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="mergesort")
            turn = turn or int(rows["ids_crc32"].iat[0])
            rows["part"] = (turn + np.arange(len(rows))) % parts
            turn += len(rows)
            return rows

        for b in batches:
            if len(b):
                full.append(b)
            if sum(map(len, full)) >= held:
                yield out()
                full = []
        if full:
            yield out()

    return rows.select(*[c.split()[0] for c in PIECES.split(", ")]).mapInPandas(deal, f"{PIECES}, part long")


def packed(cut: DataFrame, size: int = 1024, per_part: int = 4096, rounds: int = 3) -> DataFrame:
    """Pieces (as of `pieces`) with sequence_id and offset."""
    rows = staged(cut.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    full = rows.where(F.col("length") == size)
    single = (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id")
    done = [full.select("*", single, F.lit(0).cast("long").alias("offset"))]
    rest = rows.where(F.col("length") < size)
    parts = max(1, -(-rest.count() // per_part))
    schema = f"{PIECES}, part long, sequence_id long, offset long, open boolean, gap long"
    names = [c.split()[0] for c in PACKED.split(", ")]
    left = _dealt(rest, parts)
    for level in range(rounds + 1):
        last = level == rounds or parts == 1
        got = staged(left.groupBy("part").applyInPandas(_packer(size, level, last), schema), "packed")
        done.append(got.where(~F.col("open")).select(*names))
        if last:
            break
        sent = got.where("open")
        n = sent.count()
        if not n:
            break
        parts = -(-n // per_part)
        left = _dealt(sent, parts)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*names)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return packed(pieces(read(spark, sf_dir, "documents")))
