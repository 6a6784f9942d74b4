"""Near-duplicate documents by an LSH forest over MinHash signatures, compared on full shingle sets.

Words are lower-cased (A-Z) runs of anything but ASCII white space; a document's set holds its distinct shingles of
`width` words, or the whole sequence where it has fewer. Documents are linked where |A & B| / |A | B| >= num / den.

1. Every whole text becomes a set, a fingerprint of it and `TREES` * `TURN` minimum hashes. Equal sets form a class;
   only one document of each class goes on, so exact copies cost one row each.
2. The forest: each tree sorts the signatures by a sequence of hashes of its own (the signature, turned). Documents that
   agree on the first `START` hashes of a tree form a region, a run of its order. A region of up to `ROOM` documents is a
   leaf. A larger one is cut into leaves along the order: of the last half of each `ROOM` documents, the cut goes where
   neighbours have the shortest common prefix. So documents stay with those of the longest common prefix, and leaves are
   as deep as the crowd around them needs.
3. In a leaf all pairs are compared on the sets of the whole texts, and a spanning forest of the links comes back, so rows
   stay linear in the documents. Links are joined to components.
4. What leaves of a larger region don't show are pairs across components: all documents outside its largest component
   meet all others, chunk by chunk. Pairs within a component can't change it. So nothing that shares a region is left out.

Recall: a pair at similarity 0.8 shares a region of one tree with probability 0.41, of any of 16 trees with 0.9998.

Null and empty texts, and texts without words, have empty sets and link with nothing. Rows that repeat a doc_id are one
node: they share a component. Rows with a null doc_id are left alone (component null, kept). Ties go to the smallest
doc_id. Only the named columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meadow.functions.shared import staged
from meadow.llm.common import fresh, read, small_batches
from meadow.operators.components import connected_components

#: A signature has TREES * TURN hashes; tree t begins at hash t * TURN.
TREES, TURN, START = 16, 6, 4
ROOM = 256
#: Odd multipliers that mix the hashes of the words of a shingle.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def shingler(width: int) -> Callable[[str | None], np.ndarray]:
    """shingles(text): sorted distinct 64-bit hashes."""
    known: dict[bytes, int] = {}

    def word(w: bytes) -> int:
        h = known.get(w)
        if h is None:
            if len(known) > 400_000:
                known.clear()
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def shingles(text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < width:
            return np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))], np.uint64)
        h = np.fromiter(map(word, words), np.uint64, len(words))
        n = len(h) - width + 1
        out = np.zeros(n, np.uint64)
        for k in range(width):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(MIX[k % 4]) + h[k : k + n]
        return np.unique(out)

    return shingles


def _signer() -> Callable[[np.ndarray], bytes]:
    rng = np.random.default_rng(2024)
    n = TREES * TURN
    mul = rng.integers(0, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, n, dtype=np.uint64)

    def sign(s: np.ndarray) -> bytes:
        low = np.full(n, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(s), 4096):
            part = s[None, at : at + 4096]
            for k in range(0, n, 32):
                v = (part * mul[k : k + 32, None] + add[k : k + 32, None]) >> np.uint64(32)
                low[k : k + 32] = np.minimum(low[k : k + 32], v.min(1).astype(np.uint32))
        return low.tobytes()

    return sign


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (size of the set), fp (fingerprint of the set) and sig, both null for an empty set."""
    small_batches(docs.sparkSession)
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("sig", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sign = shingler(width), _signer()
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            fps = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()), pa.array([sign(s) if len(s) else None for s in sets], pa.binary())], schema=kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n long, fp binary, sig binary")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, set: the sorted hashes of each non-empty text of the documents `ids`.

    Both sides of the join grow with the documents, so it is a sort-merge join at every size.
    """
    small_batches(docs.sparkSession, 256)
    kind = pa.schema([("id", pa.int64()), ("set", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = shingler(width)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], schema=kind)

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids.distinct().hint("merge"), "id")
    return texts.select("id", "text").mapInArrow(work, "id long, set binary").where("length(set) > 0")


def _alike(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which pairs of sets are similar enough."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    if m == 2:
        both = np.zeros((2, 2), np.int64)
        both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), sizes)
        # Elements of one set only are in no intersection.
        place = np.cumsum(count > 1) - 1
        shared = count[code] > 1
        owner, code = owner[shared], place[code[shared]]
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        counts = np.zeros((m, m), np.float64)
        for low in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
            i, j = np.searchsorted(code, (low, low + 4096))
            has = np.zeros((m, 4096), np.float32)
            has[owner[i:j], code[i:j] - low] = 1
            counts += has @ has.T
        both = counts.astype(np.int64)
    out = (both > 0) & (den * both >= num * (sizes[:, None] + sizes[None] - both))
    np.fill_diagonal(out, False)
    return out


def _forest(ids: np.ndarray, joined: np.ndarray, alike: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what `alike` joins, beyond members of one value in `joined`."""
    near = alike | (joined[:, None] == joined[None])
    seen = np.zeros(len(ids), bool)
    found: list[tuple[int, int]] = []
    for start in range(len(ids)):
        if seen[start]:
            continue
        seen[start] = True
        todo = [start]
        while todo:
            i = todo.pop()
            more = np.nonzero(near[i] & ~seen)[0]
            seen[more] = True
            todo += more.tolist()
            found += [(min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))) for j in more if joined[i] != joined[j]]
    return found


def _met(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """rows(leaf, id, joined) to links a, b that join what isn't joined yet (members of one value in `joined` are)."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[c.to_pylist() for c in b.columns])

        out: list[tuple] = []
        for _, group in groupby(stream(), key=lambda r: r[0]):
            members = list({(r[1], r[3]): r[2] for r in group}.items())
            ids, joined = np.array([k[0] for k, _ in members]), np.array([j for _, j in members])
            if len(members) > 1 and (joined != joined[0]).any():
                out += _forest(ids, joined, _alike([np.frombuffer(k[1], np.uint64) for k, _ in members], num, den))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=kind)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=kind)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = rows.hint("merge").join(sets, "id").select("leaf", "id", "joined", "set")
    return staged(full.repartition(n, "leaf").sortWithinPartitions("leaf", "id").mapInArrow(work, "a long, b long"), "links")


def _chunks(n: str) -> Column:
    return F.ceil(F.col(n) / ROOM)


def cut_order(orders: list[bytes], room: int) -> list[int]:
    """Where leaves begin in a sorted run of hash sequences: leaves of up to `room`, cut where the common prefix is shortest."""
    starts = [0]
    while len(orders) - starts[-1] > room:
        low = starts[-1]
        deep = [(_common(orders[k - 1], orders[k]), -k) for k in range(low + max(room // 2, 1), low + room + 1)]
        starts.append(-min(deep)[1])
    return starts


def _common(a: bytes, b: bytes) -> int:
    """Hashes (of 4 bytes) that two sequences share at their beginning."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    differ = x != y
    return int(differ.argmax()) if differ.any() else len(x)


def _cut(large: DataFrame, classes: DataFrame) -> DataFrame:
    """large(region, tree, id) in the order of its tree, cut into leaves: leaf, id."""
    size = 4 * TREES * TURN
    turned = [F.concat(F.substring("sig", 4 * (t * TURN + START) + 1, size), F.substring("sig", 1, 4 * t * TURN)) for t in range(TREES)]
    order = F.element_at(F.array(*[F.substring(x, 1, size // 2) for x in turned]), (F.col("tree") + 1).cast("int"))
    rows = large.join(classes.select(F.col("rep").alias("id"), "sig"), "id").select("region", order.alias("order"), "id")
    n = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = pa.schema([("leaf", pa.int64()), ("id", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            for region, group in groupby(held[:], key=lambda r: r[0]):
                run = list(group)
                more = not last and region == held[-1][0]
                starts = cut_order([r[1] for r in run], ROOM)
                if more and len(starts) < 2:
                    held = run
                    return
                ends = [*starts[1:], len(run)]
                for a, z in list(zip(starts, ends))[: len(starts) - more]:
                    leaf = xxhash.xxh3_64_intdigest(f"{region} {run[a][2]} {a}".encode()) >> 1
                    yield pa.RecordBatch.from_arrays([pa.array([leaf] * (z - a), pa.int64()), pa.array([r[2] for r in run[a:z]], pa.int64())], schema=kind)
                if more:
                    held = run[starts[-1] :]
                    return
            held = []

        for b in batches:
            held += zip(*[c.to_pylist() for c in b.columns])
            if len(held) > 20 * ROOM:
                yield from cut(False)
        if held:
            yield from cut(True)

    return rows.repartitionByRange(n, "region", "order", "id").sortWithinPartitions("region", "order", "id").mapInArrow(work, "leaf long, id long")


def _linked(classes: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """links(a, b) within leaves; the regions of more than one leaf (region, id), if any; the sets of all members."""
    at = lambda t: F.xxhash64(F.substring("sig", 4 * t * TURN + 1, 4 * START), F.lit(t))
    trees = F.array(*[F.struct(at(t).alias("region"), F.lit(t).alias("tree")) for t in range(TREES)])
    rows = classes.select(F.col("rep").alias("id"), F.explode(trees).alias("k")).select("id", "k.region", "k.tree")
    shared = staged(rows.join(rows.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").hint("merge"), "region"), "regions")
    sets = staged(_sets(docs, shared.select("id"), width), "sets")
    large = shared.where(F.col("n") > ROOM)
    crowded = not large.isEmpty()
    leaves = shared.where(F.col("n") <= ROOM).select(F.col("region").alias("leaf"), "id")
    if crowded:
        leaves = leaves.unionByName(_cut(large, classes))
    links = _met(leaves.withColumn("joined", F.col("id")), sets, num, den)
    return links.distinct(), large.select("region", "id") if crowded else None, sets


def _across(large: DataFrame, parts: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components (node, component) that meet in a larger region.

    Its documents outside the largest component are dealt to `q` chunks, those of this component to `t`. Each of the
    first meets every other chunk, so the block (i, j), i < q, i < j < q + t, holds the chunks i and j.
    """
    of = large.join(parts, large["id"] == parts["node"], "left").select("region", "id", F.coalesce("component", "id").alias("joined"))
    of = staged(of.distinct(), "members")
    sizes = of.groupBy("region", "joined").agg(F.count("*").alias("k")).groupBy("region").agg(F.sum("k").alias("n"), F.max(F.struct("k", "joined")).alias("top"))
    sizes = sizes.select("region", F.col("top.joined").alias("top"), (F.col("n") - F.col("top.k")).alias("rest"), F.col("top.k").alias("k")).where("rest > 0")
    at = of.join(sizes, "region").withColumn("q", _chunks("rest")).withColumn("t", _chunks("k"))
    mine = F.when(F.col("joined") == F.col("top"), F.col("q") + F.pmod(F.xxhash64("id", "region"), F.col("t"))).otherwise(F.pmod(F.xxhash64("id", "region"), F.col("q")))
    at = at.withColumn("x", mine).withColumn("all", F.col("q") + F.col("t"))
    # Blocks as one number, i * all + j.
    first = F.transform(F.sequence(F.lit(0).cast("long"), F.least("x", "q") - 1), lambda i: i * F.col("all") + F.col("x"))
    second = F.transform(F.sequence(F.col("x") + 1, F.col("all") - 1), lambda j: F.col("x") * F.col("all") + j)
    none = F.array().cast("array<bigint>")
    blocks = F.concat(F.when(F.col("x") > 0, first).otherwise(none), F.when(F.col("x") < F.col("q"), second).otherwise(none))
    rows = at.select("region", F.explode(blocks).alias("block"), "id", "joined")
    return _met(rows.select(F.xxhash64("region", "block").alias("leaf"), "id", "joined"), sets, num, den).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    signed = staged(signatures(docs, width), "signatures")
    full = signed.where("doc_id IS NOT NULL AND fp IS NOT NULL")
    classes = staged(full.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")), "classes")
    links, large, sets = _linked(classes, docs, width, num, den)
    # A doc_id with several texts ties their classes together.
    rows = full.select("doc_id", "fp").distinct()
    split = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    ties = rows.join(split, "doc_id").join(classes.select("fp", "rep"), "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    parts = connected_components(links.unionByName(ties))
    if large is not None:
        more = _across(large, parts, sets, num, den)
        if not more.isEmpty():
            parts = connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = classes.join(parts, classes["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("c"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "fp").join(named, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (nulls last), then of the text that hashes lowest.

    Each pair of doc_id and text is a node of its own, so a row goes only if its own text has a copy that stays. Of rows that repeat both,
    one stays: that of the lowest hash over all columns.
    """
    node, turn = fresh(docs.columns, "node", "turn")
    marked = docs.withColumn(node, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    rows = staged(marked.select(F.col(node).alias("node"), F.col("doc_id").cast("long").alias("own"), "text"), "rows")
    parts = near_duplicates(rows.select(F.col("node").alias("doc_id"), "text"), width, num, den).select(F.col("doc_id").alias("node"), "component_id")
    owned = rows.groupBy("node").agg(F.min("own").alias("own"), F.count("*").alias("n"))
    least = F.coalesce(F.col("own"), F.lit((1 << 63) - 1))
    named = staged(owned.join(parts.distinct(), "node").withColumn("own", least), "nodes")
    first = named.groupBy("component_id").agg(F.min("own").alias("own"))
    ties = named.join(first, ["component_id", "own"]).groupBy("component_id").agg(F.min("node").alias("node"))
    left = marked.join(ties.select(F.col("node").alias(node)), node, "left_semi")
    again = named.where("n > 1").select(F.col("node").alias(node))
    if not again.isEmpty():
        order = Window.partitionBy(node).orderBy(F.xxhash64(*docs.columns), *[F.col(c) for c, t in docs.dtypes if not t.startswith("map")])
        one = left.join(again, node, "left_semi").withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).drop(turn)
        left = left.join(again, node, "left_anti").unionByName(one)
    return left.select(*docs.columns)


def op1_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), width=4)


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF w <> ''] AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes u ON u.doc_id = p.a JOIN sizes v ON v.doc_id = p.b WHERE 100 * c >= 80 * (u.n + v.n - c)
), reach AS (SELECT doc_id, doc_id AS t FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.t)
SELECT r.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(t) AS component_id, r.doc_id = min(t) AS kept FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""
