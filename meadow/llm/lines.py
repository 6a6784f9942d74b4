"""Near-duplicate lines across documents by a segment-partition edit join, in DataFrame functions throughout.

Lines of at least `min_chars` characters take part; shorter ones are never touched. Equal lines form a class. A line of
length L is cut into edits + 1 segments of nearly equal length, each indexed by (L, which segment, its text). Two lines
within `edits` edits share a segment at a place shifted by a few characters; a line probes the indexes of its own length
and of those up to `edits` shorter with the substrings at the shifts that the edits left and right of the segment allow.

Lines that meet under a key are candidates. Under a key with more than `ROOM` lines only the earliest line of the index
and the earliest prober meet the others, so that a family around one line costs a row for each member. What these don't
settle is cut anew into edits + DEEPER segments, of which DEEPER must agree: keys that hold two thirds of a line instead
of one third. There the earliest lines come first again, and then every pair that still matters and whose bits (parities
of the counts of characters and of character pairs) differ in no more places than `edits` edits can change. Nothing is
dropped: only lines that share two thirds of their characters, yet are far from the earliest of their kind, are
compared pair by pair.

Candidates are verified by a banded, bit-parallel edit distance: the state is one number whose bits say which prefixes
of one line match the other's within 0, 1, .. `edits` edits, on the 2 * edits + 1 diagonals of the band; each character
moves all of them at once.

A line stays if it is the first of its class (by doc_id, then a hash of the text, then place in the text) and no class
with an earlier first line is within `edits` edits of it. The others leave their documents. A text without removed lines
is unchanged; one without any line left is empty.

Null texts stay null and empty ones empty. Each different text of a doc_id, or of the rows without one, is a document of
its own; rows that repeat both are one document and share its decisions. A null doc_id comes before all others. Columns of
other names are kept as they are, helper columns get names of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadow.functions.shared import drop_staged, staged
from meadow.llm.common import fresh, read

EDITS, MIN_CHARS = 2, 40
#: Lines under a key that all meet each other, and the segments that must agree in the second round.
ROOM, DEEPER = 64, 4
#: The state of the verification is one number of (edits + 1) * (2 * edits + 1) bits.
MOST_EDITS = 4


def _hashes() -> list[Column]:
    """Two hashes that together name a line."""
    return [F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g")]


def patterns(edits: int, agree: int) -> list[tuple[int, tuple[tuple[int, int, int], ...]]]:
    """(less, runs): of a line `less` shorter, cut into edits + agree segments, the runs of segments from i up to j are
    looked for `shift` characters further on. Each run is (i, j, shift); the index holds less and all shifts 0.

    The edits lie in `edits` of the segments; what stands before the first of these isn't shifted, what stands after the
    last is by `less`, and between them the shifts take no more edits than there are. Where a single segment agrees, one
    whose left side takes more edits than it has segments is left to another pattern.
    """
    n, out = edits + agree, {}
    for less in range(edits + 1):
        for hurt in combinations(range(n), edits):
            edges = [-1, *hurt, n]
            gaps = [(a + 1, b, k) for k, (a, b) in enumerate(zip(edges, edges[1:])) if b > a + 1]
            ways: list[tuple[int, int, tuple]] = [(0, 0, ())]
            for i, j, k in gaps:
                shifts = [0] if k == 0 else [less] if k == edits else range(-edits, edits + 1)
                if agree == 1:
                    shifts = [s for s in shifts if max(-i, less - (edits - i)) <= s <= min(i, less + edits - i)]
                ways = [(spent + abs(s - at), s, (*runs, (i, j, s))) for spent, at, runs in ways for s in shifts]
            out |= {(less, runs): None for spent, at, runs in ways if spent + abs(less - at) <= edits}
    return list(out)


def _sorted(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join at every size, as both sides grow with the documents. Spark judges a side before it runs by the size of its files,
    in which rows that repeat themselves take little room and the keys of a line aren't counted, and would send millions of rows through the driver."""
    return left.join(right.hint("merge"), on, how)


def _keys(lines: DataFrame, edits: int, agree: int, probe: bool = True) -> DataFrame:
    """id, key, own (the line's own index): a row for each pattern of each line(id, n, line).

    One row for each pattern first and one key in each row then, as a single expression with all keys would be too large
    to be compiled.
    """
    segments, most = edits + agree, min(agree, edits + 1)
    shapes: dict[tuple, int] = {}
    specs = []
    for less, runs in patterns(edits, agree):
        own = less == 0 and not any(s for _, _, s in runs)
        shape = shapes.setdefault(tuple((i, j) for i, j, _ in runs), len(shapes))
        flat = [x for r in [*runs, *[(0, 0, 0)] * (most - len(runs))] for x in r]
        if own or probe:
            specs.append([less, shape, int(own), *flat])
    names = ["less", "shape", "own", *[f"{x}{k}" for k in range(most) for x in ("from", "to", "shift")]]
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(names, s)]) for s in specs]))
    rows = lines.select("id", "line", "n", each.alias("s")).select("id", "line", "n", *[f"s.{c}" for c in names])
    length = (F.col("n") - F.col("less")).cast("int")
    start = lambda i: F.expr(f"{i} * ((n - less) div {segments}) + greatest(0, {i} - {segments} + (n - less) % {segments})")
    parts, fits = [], F.lit(True)
    for k in range(most):
        begin, end = start(f"from{k}") + F.col(f"shift{k}"), start(f"to{k}") + F.col(f"shift{k}")
        fits = fits & (begin >= 0) & (end <= F.col("n"))
        parts.append(F.substr("line", (begin + 1).cast("int"), (end - begin).cast("int")))
    if probe:
        rows = rows.where(fits)
    return rows.select("id", F.xxhash64(length, "shape", *parts).alias("key"), (F.col("own") == 1).alias("own"))


def _met(lines: DataFrame, edits: int, agree: int) -> DataFrame:
    """key, id, own, held (lines in the index of the key), one (the least of these): rows of lines that meet another."""
    index = _keys(lines, edits, agree, False).groupBy("key").agg(F.count("*").alias("held"), F.min("id").alias("one"))
    return staged(_sorted(_keys(lines, edits, agree), index, "key").where("held > 1 OR id <> one"), "met")


def _bits(chars: Column) -> tuple[Column, Column]:
    """64 bits each: which characters, and which pairs of neighbours (modulo 64), stand in a line an odd number of times.

    An edit adds a character, takes one away, or does both, so it turns two bits of the first at most, four of the second.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    flip = lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", one, c))
    pairs = F.transform(chars, lambda c, i: F.when(i > 0, F.pmod(F.get(chars, i - 1) * 37 + c, F.lit(64))))
    return F.aggregate(chars, zero, flip), F.aggregate(F.slice(pairs, 2, F.greatest(F.size(chars) - 1, F.lit(0))), zero, flip)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two arrays of code points, with lengths that differ by `edits` at most, are within `edits` edits.

    Row e of the state holds a bit for each diagonal d of -edits .. edits: the first j + d signs of a match the first j
    of b within e edits. A sign of b keeps a bit where it equals a's, and hands bits on to the next row by a changed, an
    extra or a missing sign.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    long = lambda x: F.lit(x).cast("long")

    def equal(c: Column, j: Column) -> Column:
        out = long(0)
        for d in range(-edits, edits + 1):
            out = out.bitwiseOR(F.when((j + d >= 0) & (F.get(a, j + d) == c), long(1 << (d + edits))).otherwise(long(0)))
        return out

    def step(state: Column, eq: Column) -> Column:
        before = [F.shiftright(state, e * width).bitwiseAND(long(mask)) for e in range(edits + 1)]
        now = before[0].bitwiseAND(eq)
        out = now
        for e in range(1, edits + 1):
            now = before[e].bitwiseAND(eq).bitwiseOR(before[e - 1]).bitwiseOR(F.shiftright(before[e - 1], 1)).bitwiseOR(F.shiftleft(now, 1).bitwiseAND(long(mask)))
            out = out.bitwiseOR(F.shiftleft(now, e * width))
        return out

    first = sum(((1 << (e + 1)) - 1) << (edits + e * width) for e in range(edits + 1))
    last = F.aggregate(F.transform(b, equal), long(first), step)
    at = (F.lit(edits * width + edits) + F.size(a) - F.size(b)).cast("int")
    return (F.abs(F.size(a) - F.size(b)) <= edits) & (F.call_function("shiftright", last, at).bitwiseAND(long(1)) == 1)


def _close(a: str, b: str, edits: int) -> Column:
    """Whether the bits of two lines leave it open that they are within `edits` edits."""
    differ = lambda c: F.bit_count(F.col(c + a).bitwiseXOR(F.col(c + b)))
    return (differ("signs") <= 2 * edits) & (differ("twos") <= 4 * edits)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc (null: the least number), own (hash of the text), pos, line: the lines that take part."""
    node = _node()
    return docs.select(node[0].alias("doc"), node[1].alias("own"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.length("line") >= min_chars)


def _node() -> list[Column]:
    """What makes a row's document."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64("text")]


#: Where a line stands as one number that sorts by document, 31 bits of its text's hash, then place.
PLACE = "CAST(doc AS DECIMAL(20, 0)) * 4611686018427387904 + ((own & 2147483647) * 2147483648 + pos)"


def _shadowed(pairs: DataFrame, known: DataFrame, edits: int) -> DataFrame:
    """id: the later line of each of the pairs(a, b) that are near."""
    both = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = {x: known.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("chars", "first", "signs", "twos")]) for x in "ab"}
    later = F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a"))
    near = _sorted(_sorted(both, side["a"], "a"), side["b"], "b").where(_close("_a", "_b", edits) & within(F.col("chars_a"), F.col("chars_b"), edits))
    return staged(near.select(later.alias("id")).distinct(), "shadowed")


def _hot(groups: DataFrame, room: int) -> DataFrame:
    return groups.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > room).select("key")


def _leaders(groups: DataFrame, known: DataFrame) -> DataFrame:
    """a, b: every line with the earliest line of its key's index, every line of an index with its earliest prober."""
    placed = _sorted(groups, known.select("id", "first"), "id")
    lead = placed.groupBy("key").agg(F.min_by("id", "first").alias("prober"), F.min_by(F.when(F.col("own"), F.col("id")), F.when(F.col("own"), F.col("first"))).alias("holder"))
    # Written first, as Spark splits a large key's rows only where both sides come from a shuffle of their own.
    met = _sorted(groups, staged(lead, "lead"), "key")
    return met.select(F.col("id").alias("a"), F.col("holder").alias("b")).unionByName(met.where("own").select(F.col("id").alias("a"), F.col("prober").alias("b"))).where("a <> b")


def _pairs(groups: DataFrame, known: DataFrame, edits: int) -> DataFrame:
    """a, b: lines under one key whose bits are close; the later one is open."""
    facts = known.select("id", "first", "signs", "twos", "open")
    one, two = (_sorted(rows, facts, "id").select("key", F.col("id").alias(x), *[F.col(c).alias(c + x) for c in ("first", "signs", "twos", "open")]) for x, rows in (("a", groups.where("own")), ("b", groups)))
    matters = (F.col("a") != F.col("b")) & F.when(F.col("firsta") < F.col("firstb"), F.col("openb")).otherwise(F.col("opena"))
    return _sorted(one, two, "key").where(matters & _close("a", "b", edits)).select("a", "b")


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, room: int = ROOM) -> DataFrame:
    """h, g (two hashes of a line), first (its place), shadowed: an earlier line is within `edits` edits."""
    if not 1 <= edits <= MOST_EDITS:
        raise ValueError(f"edits must be 1 to {MOST_EDITS}")
    if min_chars < 2 * edits + DEEPER:
        raise ValueError("min_chars must be at least twice the edits and a segment more, or segments would be empty")
    classes = _lines(docs, min_chars).groupBy("line").agg(F.min(F.expr(PLACE)).alias("first"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("id"), F.length("line").alias("n"), "first", "line", *_hashes()), "lines")
    met = _met(classes, edits, 1)
    ids = met.select("id").unionByName(met.select(F.col("one").alias("id"))).distinct()
    chars = F.transform(F.split("line", ""), lambda c: F.ascii(c))
    known = _sorted(classes.select("id", "n", "first", "line"), ids, "id").withColumn("chars", chars)
    signs, twos = _bits(F.col("chars"))
    known = staged(known.withColumn("signs", signs).withColumn("twos", twos).withColumn("open", F.lit(True)), "known")
    groups = met.where("held > 1").select("key", "id", "own")
    hot = staged(_sorted(groups, _hot(groups, room), "key", "left_semi"), "hot")
    cold = _sorted(groups, hot.select("key").distinct(), "key", "left_anti")
    met_one = met.where("held = 1").select(F.col("id").alias("a"), F.col("one").alias("b"))
    done = _shadowed(met_one.unionByName(_pairs(cold, known, edits)).unionByName(_leaders(hot, known)), known, edits)
    if not hot.isEmpty():
        # Those under a hot key once more, by larger parts of them.
        some = _sorted(_sorted(known, hot.select("id").distinct(), "id", "left_semi").drop("open"), done.withColumn("open", F.lit(False)), "id", "left")
        some = staged(some.withColumn("open", F.coalesce("open", F.lit(True))), "open")
        deep = _met(some, edits, DEEPER)
        again, met_one = deep.where("held > 1").select("key", "id", "own"), deep.where("held = 1").select(F.col("id").alias("a"), F.col("one").alias("b"))
        led = _shadowed(met_one.unionByName(_leaders(again, some)), some, edits)
        some = _sorted(some.drop("open"), done.unionByName(led).distinct().withColumn("open", F.lit(False)), "id", "left").withColumn("open", F.coalesce("open", F.lit(True)))
        rest = _shadowed(_pairs(again, some, edits), some, edits)
        done = done.unionByName(led).unionByName(rest).distinct()
    marked = _sorted(classes.select("id", "h", "g", "first"), done.withColumn("shadowed", F.lit(True)), "id", "left")
    out = staged(marked.select("h", "g", "first", F.coalesce("shadowed", F.lit(False)).alias("shadowed")), "classes")
    for table in (classes, met, known):
        drop_staged(table)
    return out


def removed_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, room: int = ROOM) -> DataFrame:
    """doc, own, gone: the places of the lines that leave each document."""
    classes = line_classes(docs, edits, min_chars, room)
    lines = _lines(docs, min_chars).select("doc", "own", "pos", F.expr(PLACE).alias("place"), *_hashes())
    gone = _sorted(lines, classes, ["h", "g"]).where(F.col("shadowed") | (F.col("first") != F.col("place")))
    return gone.groupBy("doc", "own").agg(F.collect_set("pos").alias("gone"))


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, count: str | None = None, room: int = ROOM) -> DataFrame:
    """docs with repeated lines taken out of text; `count` names a column for how many, if wanted."""
    doc, own, places = fresh([*docs.columns, *([count] if count else [])], "doc", "own", "gone")
    gone = removed_lines(docs, edits, min_chars, room).withColumnsRenamed({"doc": doc, "own": own, "gone": places})
    node = _node()
    joined = docs.join(gone, (node[0] == gone[doc]) & (node[1] == gone[own]), "left")
    stays = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(places), i))
    text = F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(stays, "\n"))
    out = joined.withColumn("text", text)
    columns = list(docs.columns)
    if count:
        out = out.withColumn(count, F.coalesce(F.size(places), F.lit(0)).cast("long"))
        columns = [c for c in columns if c.lower() != count.lower()] + [count]
    return out.select(*columns)


def op3_lines(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_lines(docs, count="n_removed").select("doc_id", "text", "n_removed")


OP3_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), firsts AS (
  SELECT line, min({'d': doc_id, 'p': pos}) AS f, length(line) AS n FROM lines WHERE length(line) >= 40 GROUP BY line
), shadowed AS (
  SELECT DISTINCT b.line FROM firsts a JOIN firsts b ON a.n BETWEEN b.n - 2 AND b.n + 2 AND a.f < b.f
  WHERE (contains(b.line, substr(a.line, 1, (a.n // 3)::INT)) OR contains(b.line, substr(a.line, (a.n // 3 + 1)::INT, (a.n // 3)::INT)) OR contains(b.line, substr(a.line, (2 * (a.n // 3) + 1)::INT)))
    AND levenshtein(a.line, b.line) <= 2
), marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(f.f <> {'d': l.doc_id, 'p': l.pos} OR s.line IS NOT NULL, false) AS gone
  FROM lines l LEFT JOIN firsts f ON f.line = l.line LEFT JOIN shadowed s ON s.line = l.line
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (NOT m.gone), '') END AS text,
  (count(*) FILTER (m.gone))::BIGINT AS n_removed
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""
