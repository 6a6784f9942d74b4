"""Removal of passages that stand earlier in the corpus, by a compressed FM-index per shard.

Words are runs of anything but ASCII white space, unchanged, and go by 64-bit hashes. A window is `window` consecutive
words of one document. Each word covered by a window whose sequence also starts earlier (smaller doc_id, or same document
and earlier start) leaves; windows are judged on the input.

Shards are of content, so that equal windows meet however many documents there are. The anchor of a window is the least
hash of its runs of GRAM words. Consecutive windows with one anchor at one place form a segment, and only segments whose
anchor stands twice in the corpus go on: all others hold no window that is repeated. Equal segments form a
class whose earliest member stands for it; the windows of the others are all repeated. The representatives are dealt to
shards by their anchor, so any two equal windows are in one shard.

A shard keeps its segments as an FM-index: the Burrows-Wheeler transform of their words in a wavelet tree (laid out by
level, bits packed, with counts of set bits at every 64th). Segments are streamed against it from their last word to their
first, all side by side: backward search gives the suffix range of what has been matched so far, cut back to `window`
words once it is longer, i.e. the matching statistics up to the threshold. A window is repeated if the earliest place in
its range is before its own. What comes back for a segment is the set of its windows that are repeated.

An anchor with more than HOT different segments (say, a run of words that a third of all documents share, each in other
surroundings) would be too much for a shard: its segments are cut into single windows, each of which is an anchor of its
own, classed in the same way.

Null and empty texts have no words. Null doc_ids come after all others. Documents of one doc_id are ordered by a hash of
their texts; of rows that repeat a doc_id and its text the first is as if it were alone, all others are repeats. Only the
named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadow.functions.shared import drop_staged, staged
from meadow.llm.common import read, small_batches

WINDOW, GRAM = 20, 8
#: Segments of a shard, and different segments of an anchor from which on they are cut into windows.
SHARD, HOT = 16_384, 4096
#: Bytes of text that are hashed at once.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LAST = (1 << 63) - 1


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, 1 << 64))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, 2 * len(self.tables[0]))
            for k, base in enumerate(self.bases):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                self.tables[k] = np.cumprod(steps)
        return self.tables


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of words, and of sequences of them: polynomials over prefix sums, mixed."""

    def __init__(self):
        self.bytes, self.words = _Powers(ODD[0]), _Powers(ODD[1])

    def _piece(self, buf: bytes) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(buf, np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        starts, ends = edge[::2], edge[1::2]
        up, down = self.bytes.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return starts, _mixed((sums[ends] - sums[starts]) * down[starts])

    def of_words(self, buf: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each word of buf starts, and its hash; long texts piece by piece, cut at white space."""
        starts, hashes, at = [], [], 0
        while at < len(buf):
            end = min(at + PIECE, len(buf))
            if end < len(buf):
                cut = max(buf.rfind(c, at, end) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
                end = cut if cut > at else m.start() if (m := SPACE.search(buf, end)) else len(buf)
            s, h = self._piece(buf[at:end])
            starts.append(s + at)
            hashes.append(h)
            at = end
        return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))

    def of_runs(self, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = self.words.upto(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return _mixed((sums[end] - sums[start]) * down[start])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Where the first least of each `width` consecutive values stands."""
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at, have = np.where(x[left] <= x[right], left, right), have + step
    return at


def cut(words: np.ndarray, doc: np.ndarray, hasher: Hasher, window: int) -> tuple[np.ndarray, ...]:
    """start, wins, anchor and hash of the segments of documents that stand one after another."""
    n = len(words) - window + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    gram = min(GRAM, window)
    at = np.arange(len(words) - gram + 1)
    grams = hasher.of_runs(words, at, at + gram)
    least = _least(grams, window - gram + 1)
    inside = doc[:n] == doc[window - 1 :]
    # A segment ends where the next begins, or at the last window inside its document.
    start = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])]))
    wins = np.diff(np.append(start, n))
    keep = inside[start]
    start, wins = start[keep], wins[keep]
    return start, wins, grams[least[start]], hasher.of_runs(words, start, start + wins + window - 1)


def _chunks(texts: pa.Array, hasher: Hasher) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts in groups of about PIECE bytes: the first one's number, the text (counted from there) of each word, its hash."""
    texts = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) < PIECE:
            size += len(texts[to]) + 1
            to += 1
        begin = np.cumsum([0, *(len(x) + 1 for x in texts[at : to - 1])])
        where, words = hasher.of_words(b"\n".join(texts[at:to]))
        yield at, np.searchsorted(begin, where, "right") - 1, words
        at = to


SEGMENT = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("wins", pa.int32())])


def _segments(nodes: DataFrame, window: int) -> DataFrame:
    """anchor, seg, doc, h, start, wins: all segments of nodes(doc, h, text)."""
    small_batches(nodes.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            doc, h = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at, own, words in _chunks(b.column(2), hasher):
                start, wins, anchor, seg = cut(words, own, hasher, window)
                row = own[start]
                begin = np.searchsorted(own, row)
                cols = [anchor.view(np.int64), seg.view(np.int64), doc[at + row], h[at + row], (start - begin).astype(np.int32), wins.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=SEGMENT)

    return nodes.mapInArrow(work, "anchor long, seg long, doc long, h long, start int, wins int")


class Wavelet:
    """Ranks in a sequence of numbers below 2**levels: a wavelet tree laid out level by level."""

    def __init__(self, values: np.ndarray, levels: int):
        self.rows, x = [], values
        for k in range(levels - 1, -1, -1):
            bit = (x >> k) & 1 == 1
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            before = np.zeros(len(packed), np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            self.rows.append((k, packed, before, len(bit) - int(bit.sum())))
            x = np.concatenate([x[~bit], x[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the first `place` values equal to `symbol` end in the order of the last level."""
        i = place
        for k, packed, before, zeros in self.rows:
            word = i >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where((symbol >> k) & 1 == 1, zeros + ones, i - ones)
        return i


def _suffixes(text: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of `text` (each run of words has an end of its own), and where each range of suffixes that
    share `window` words begins."""
    n = len(text)
    rank = text + len(ends)
    rank[ends] = np.arange(len(ends))
    have, shared = 1, None
    after = lambda by: np.append(rank[by:] + 1, np.zeros(min(by, n), np.int64))
    while True:
        if shared is None and 2 * have > window:
            # Two overlapping parts say whether `window` words agree.
            shared = (rank, after(window - have))
        key = rank * (n + 2) + after(have)
        order = np.argsort(key, kind="stable")
        key, now = key[order], np.empty(n, np.int64)
        now[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank, have = now, 2 * have
        if shared is not None and rank[order[-1]] == n - 1:
            break
    a, b = (x[order] for x in shared)
    return order, np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))


class FMIndex:
    """Runs of words, each with a place in an order, for matching statistics up to `window`."""

    def __init__(self, runs: list[np.ndarray], places: np.ndarray, window: int):
        """places: of all words of all runs in turn, which stands earlier."""
        self.window, sizes = window, np.array([len(r) for r in runs])
        self.alphabet, ids = np.unique(np.concatenate(runs), return_inverse=True)
        self.ends = np.cumsum(sizes + 1) - 1
        inner = np.ones(int(self.ends[-1]) + 1, bool)
        inner[self.ends] = False
        text, place = np.zeros(len(inner), np.int64), np.full(len(inner), np.iinfo(np.int64).max)
        text[inner], place[inner] = ids + 1, places
        order, self.begin = _suffixes(text, self.ends, window)
        self.n = len(text)
        self.stop = np.append(self.begin[1:], self.n)
        self.range_of = np.repeat(np.arange(len(self.begin)), self.stop - self.begin)
        self.earliest = np.minimum.reduceat(place[order], self.begin)
        levels = max(1, int(len(self.alphabet)).bit_length())
        self.tree = Wavelet(text[order - 1], levels)
        counts = np.bincount(text, minlength=len(self.alphabet) + 1)
        self.less = np.cumsum(counts) - counts
        symbols = np.arange(len(self.alphabet) + 1)
        self.zero = self.tree.rank(symbols, np.zeros(len(symbols), np.int64))
        self.text, self.sizes, self.place = text, sizes, place

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of `symbol` followed by what stands at low .. high."""
        base = self.less[symbol] - self.zero[symbol]
        return base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)

    def repeated(self) -> np.ndarray:
        """For each run a number whose bit j says that the window from its word j on also stands at an earlier place."""
        at, left = self.ends - 1, self.sizes.copy()
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.n)
        lane, out = np.arange(len(at)), np.zeros(len(at), np.int64)
        done = 0
        while len(lane):
            low, high = self.back(self.text[at], low, high)
            done += 1
            if done >= self.window:
                which = self.range_of[low]
                low, high = self.begin[which], self.stop[which]
                hit = self.earliest[which] < self.place[at]
                out[lane[hit]] |= np.int64(1) << (left[hit] - 1)
            go = left > 1
            lane, at, left, low, high = lane[go], at[go] - 1, left[go] - 1, low[go], high[go]
        return out


FOUND = "anchor long, seg long, mask long"


def _shard(window: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = [np.frombuffer(w, np.uint64) for w in pdf["words"]]
        sizes = np.array([len(r) for r in runs])
        where = np.concatenate([np.arange(s) for s in sizes]) + np.repeat(pdf["start"].to_numpy(np.int64), sizes)
        doc, h = (np.repeat(pdf[c].to_numpy(np.int64), sizes) for c in ("doc", "h"))
        order = np.lexsort([where, h, doc])
        new = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1]) | (where[order][1:] != where[order][:-1])
        places = np.empty(len(order), np.int64)
        places[order] = np.concatenate([[0], np.cumsum(new)])
        mask = FMIndex(runs, places, window).repeated()
        some = mask != 0
        return pd.DataFrame({"anchor": pdf["anchor"][some], "seg": pdf["seg"][some], "mask": mask[some]})

    return work


def _words_of(nodes: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """anchor, seg, doc, h, start, words: the words of each of wanted(anchor, seg, doc, h, start, wins, hot); of hot ones a row
    for each window, whose two keys are hashes of its words."""
    small_batches(nodes.sparkSession, 256)
    kind = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("doc", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("hot", pa.bool_()), ("words", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            doc, h = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            ends, flat = b.column(3).offsets.to_numpy(), b.column(3).values
            fields = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "wins", "anchor", "seg", "hot")}
            for at, own, words in _chunks(b.column(2), hasher):
                n = int(own[-1]) + 1 if len(own) else 0
                some = slice(ends[at], ends[at + n])
                row = np.repeat(np.arange(n), np.diff(ends[at : at + n + 1]))
                start, wins, anchor, seg, hot = (fields[c][some] for c in ("start", "wins", "anchor", "seg", "hot"))
                hot = hot.astype(bool)
                begin = np.searchsorted(own, row) + start
                cold = ~hot
                parts = [words[s : s + w + window - 1].tobytes() for s, w in zip(begin[cold].tolist(), wins[cold].tolist())]
                steps = np.concatenate([np.arange(w) for w in [0, *wins[hot].tolist()]])
                single, of = np.repeat(begin[hot], wins[hot]) + steps, np.repeat(np.flatnonzero(hot), wins[hot])
                one = hasher.of_runs(words, single, single + window)
                two = _mixed(one ^ words[single] ^ np.uint64(ODD[0]))
                which = row[np.concatenate([np.flatnonzero(cold), of])]
                cols = [np.concatenate([anchor[cold], one.view(np.int64)]), np.concatenate([seg[cold], two.view(np.int64)]), doc[at + which], h[at + which], np.concatenate([start[cold], start[of] + steps]).astype(np.int32), np.arange(len(which)) >= len(parts)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array([*parts, *[None] * len(single)], pa.binary())], schema=kind)

    by = wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("start", "wins", "anchor", "seg", "hot")).alias("segs"))
    return nodes.join(by.hint("merge"), ["doc", "h"]).select("doc", "h", "text", "segs").mapInArrow(work, "anchor long, seg long, doc long, h long, start int, hot boolean, words binary")


def _firsts(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy("anchor", "seg").agg(F.min(F.struct("doc", "h", "start")).alias("first"), *[F.any_value(c).alias(c) for c in more])


def repeated_windows(nodes: DataFrame, window: int = WINDOW, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc, h, start, mask: bit j of mask says that the window from word start + j on stands earlier too. nodes: doc, h, text."""
    segments = staged(_segments(nodes, window), "segments")
    # A table of its own, so that the join with it is one whose hot keys Spark can split.
    twice = staged(segments.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "twice")
    met = staged(segments.join(twice.hint("merge"), "anchor"), "met")
    for table in (segments, twice):
        drop_staged(table)
    classes = staged(_firsts(met, "wins"), "classes")
    crowded = classes.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor", F.lit(True).alias("hot"))
    wanted = classes.join(crowded, "anchor", "left").select("anchor", "seg", "wins", "first.*", F.coalesce("hot", F.lit(False)).alias("hot"))
    words = staged(_words_of(nodes, wanted, window), "words")
    shards = max(1, -(-words.where("NOT hot").count() // shard))
    dealt = words.where("NOT hot").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = staged(dealt.groupBy("shard").applyInPandas(_shard(window), FOUND), "found")
    place = F.struct("doc", "h", "start")
    marked = met.join(classes.select("anchor", "seg", "first").hint("merge"), ["anchor", "seg"]).join(found.hint("merge"), ["anchor", "seg"], "left")
    mask = F.when(F.col("first") != place, F.expr("shiftleft(1L, wins) - 1")).otherwise(F.coalesce("mask", F.lit(0)))
    single = words.where("hot")
    again = single.join(_firsts(single).hint("merge"), ["anchor", "seg"]).where(F.col("first") != place).select(*("doc", "h", "start"), F.lit(1).cast("long").alias("mask"))
    return marked.select("doc", "h", "start", mask.cast("long").alias("mask")).where("mask <> 0").unionByName(again)


def without_repeated_passages(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space): a row for each row of docs."""
    if not 1 <= window <= 62:
        raise ValueError("a window has 1 to 62 words")
    nodes = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("h"), "text", F.col("doc_id").isNull().alias("no_id"))
    marks = repeated_windows(nodes.select("doc", "h", "text"), window, shard, hot).groupBy("doc", "h").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    repeats = nodes.groupBy("doc", "h", "no_id").agg(F.count("*").alias("n")).where("n > 1").select("doc", "h", "no_id", F.lit(True).alias("again"))
    kind = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("no_id", pa.bool_()), ("again", pa.bool_()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            texts, marked = b.column(4).cast(pa.binary()), b.column(5)
            for k in range(len(b)):
                words = (texts[k].as_py() or b"").split()
                n.append(len(words))
                rows = marked[k].values
                out = 0
                if rows is not None and len(rows):
                    edge = np.zeros(len(words) + 1, np.int64)
                    start, mask = (rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "mask"))
                    row, bit = np.nonzero(mask[:, None] >> np.arange(window) & 1)
                    np.add.at(edge, start[row] + bit, 1)
                    np.add.at(edge, start[row] + bit + window, -1)
                    stays = np.cumsum(edge)[:-1] == 0
                    out = len(words) - int(stays.sum())
                    words = [words[i] for i in np.flatnonzero(stays)]
                gone.append(out)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], schema=kind)

    both = nodes.join(marks.hint("merge"), ["doc", "h"], "left").join(repeats.hint("merge"), ["doc", "h", "no_id"], "left")
    both = both.select("doc", "h", "no_id", F.coalesce("again", F.lit(False)).alias("again"), "text", "marks")
    out = both.mapInArrow(work, "doc long, h long, no_id boolean, again boolean, n_words long, n_removed long, kept binary")
    named = [F.when(~F.col("no_id"), F.col("doc")).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept")]
    return out.select(*named, "again", "h")


def digest(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256. Of rows that repeat a document all but one lose every window they have."""
    rows = without_repeated_passages(docs, window, shard, hot).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "again", "h")
    rows = staged(rows, "kept")
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    same = rows.where("again").groupBy(*columns, "h").agg(F.count("*").alias("n"))
    others = same.select("*", F.explode(F.sequence(F.lit(2).cast("long"), "n")).alias("k"))
    whole = F.col("n_words") >= window
    nothing = hashlib.sha256(b"").hexdigest()
    others = others.select("doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(whole, F.lit(nothing)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
    return rows.where("NOT again").select(*columns).unionByName(same.select(*columns)).unionByName(others)


def op11_substrings(spark, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = r"""
WITH words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM words WHERE len(w) >= 20)
), again AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1
), places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words
), marked AS (
  SELECT l.doc_id, l.word, l.p, coalesce(l.p - a.p < 20, false) AS gone FROM places l ASOF LEFT JOIN again a ON l.doc_id = a.doc_id AND l.p >= a.p
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS t FROM marked GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
