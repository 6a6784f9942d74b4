"""Grouping of spelling variants by a trie of letter-group counts.

Words are the distinct results of cutting texts into runs of Latin letters, lower-casing A-Z and deleting a code point from
those runs whose hash says so; those of `shortest` code points and `fewest` occurrences take part. Two words are near if
they differ by exactly one inserted, deleted or replaced code point.

Letters fall into GROUPS groups (code point modulo GROUPS), and a word has a vector of counts by group, the groups of most
variance first. Words hang in a trie by successive counts. An edit adds one to a count (surplus), takes one away (deficit)
or does both, so a word's near ones lie where the path from the root has spent at most one surplus and one deficit. The
search goes down depth first and carries all words that are still within their budget; at a leaf the words themselves
are compared, character by character.

The upper levels are shared by all tasks: while a node holds more than `room` words, its words and its visitors go down a
level more, by joins. A node that is small enough is a subtrie of its own; a task builds it and searches it for a bounded
number of visitors. Words of one vector stay together at any number and are dealt in parts then. A pair is met once: a visitor spends its
surplus first, so it finds words that have more at the first level where they differ, and of words of its own vector the
later ones (by number). A task returns the count and the best of each word's near ones, never its pairs.

A word's form is its near word of the largest count (ties: the least in code-point order) if that count is at least `times`
the word's own; its root is where the forms end, found by doubling steps.

Null texts have no words; rows that repeat a doc_id count each; a null doc_id deletes nothing. Only the named columns are
read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadow.functions.shared import staged
from meadow.llm.common import read

#: Letters of a word, and of which an upper-case one is changed.
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GROUPS, ROOM, VISITORS, STEPS = 12, 8192, 65_536, 2
#: A run loses a code point if this divides its hash.
NOISE = 97
#: Nodes of fewer words are searched at once; words that are longer are compared one by one.
FEW, LONG = 24, 64


def word_counts(docs: DataFrame, shortest: int = 5, fewest: int = 3) -> DataFrame:
    """word, n."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    each = docs.select("doc_id", F.explode(runs).alias("run")).where(F.length("run") >= shortest)
    hashed = each.withColumn("crc", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run"))))
    at = F.pmod(F.col("crc"), F.length("run").cast("long")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.pmod("crc", F.lit(NOISE)) == 0, less).otherwise(F.col("run"))
    counts = hashed.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= fewest)


def _count(group: int) -> Column:
    letters = "".join(map(chr, (c for c in LETTERS if c % GROUPS == group)))
    return (F.length("word") - F.length(F.translate("word", letters, ""))).cast("int")


def _vectors(words: DataFrame) -> DataFrame:
    """id, word, n, counts (by group, those of most variance first)."""
    spread = words.agg(*[F.coalesce(F.var_pop(_count(g)), F.lit(0.0)).alias(f"g{g}") for g in range(GROUPS)]).first()
    order = sorted(range(GROUPS), key=lambda g: (-spread[f"g{g}"], g))
    return staged(words.select(F.monotonically_increasing_id().alias("id"), "word", "n", F.array(*map(_count, order)).alias("counts")), "vectors")


def _down(visitors: DataFrame, depth: int) -> DataFrame:
    """Visitors of nodes of one depth at all their children that leave them within budget."""
    own = F.get("counts", F.lit(depth))

    def child(by: int) -> Column:
        return F.struct((own + by).alias("count"), (F.col("surplus") + int(by > 0)).cast("int").alias("surplus"), (F.col("deficit") + int(by < 0)).cast("int").alias("deficit"))

    ways = F.array(child(0), F.when(F.col("surplus") < 1, child(1)), F.when((F.col("surplus") > 0) & (F.col("deficit") < 1) & (own > 0), child(-1)))
    rows = visitors.withColumn("to", F.explode(F.filter(ways, lambda x: x.isNotNull())))
    return rows.select("id", "word", "n", "counts", F.concat_ws(",", "node", F.col("to.count").cast("string")).alias("node"), "to.surplus", "to.deficit")


def subtries(words: DataFrame, room: int) -> tuple[DataFrame, DataFrame]:
    """Members (node, id, word, n, counts) of nodes that hold `room` words at most (or words of one vector), and their visitors."""
    members = words.withColumn("node", F.lit("r"))
    visitors = members.withColumns({"surplus": F.lit(0), "deficit": F.lit(0)})
    placed, met = [], []
    depth = 0
    while True:
        full = staged(members.groupBy("node").agg(F.count("*").alias("held")).where((F.col("held") > room) & F.lit(depth < GROUPS)).select("node"), "full")
        small = members.join(full, "node", "left_anti")
        placed.append(small.select("node", "id", "word", "n", "counts"))
        met.append(visitors.join(small.select("node").distinct(), "node", "left_semi").select("node", "id", "word", "n", "counts"))
        if full.isEmpty():
            break
        members, visitors = members.join(full, "node", "left_semi"), visitors.join(full, "node", "left_semi")
        for _ in range(min(STEPS, GROUPS - depth)):
            members = members.withColumn("node", F.concat_ws(",", "node", F.get("counts", F.lit(depth)).cast("string")))
            visitors = _down(visitors, depth)
            depth += 1
        members = staged(members, "members")
        visitors = staged(visitors.join(members.select("node").distinct(), "node", "left_semi"), "visitors")
    for more in placed[1:]:
        placed[0] = placed[0].unionByName(more)
    for more in met[1:]:
        met[0] = met[0].unionByName(more)
    return placed[0], met[0]


def _search(trie: np.ndarray, visit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (visitor, member) within budget, surplus first; trie: members' counts in lexicographic order, row by row."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    levels = trie.shape[1]
    stack = [(0, len(trie), 0, np.arange(len(visit)), np.zeros(len(visit), np.int8), np.zeros(len(visit), np.int8))]
    while stack:
        low, high, level, who, surplus, deficit = stack.pop()
        if level == levels or high - low < FEW:
            for m in range(low, high):
                by = trie[m, level:] - visit[who, level:]
                more, less = surplus + np.maximum(by, 0).sum(1), deficit - np.minimum(by, 0).sum(1)
                fits = np.flatnonzero((more <= 1) & (less <= 1))
                fits = fits[((surplus - deficit)[fits, None] + np.cumsum(by[fits], 1) >= 0).all(1)]
                found.append((who[fits], np.full(len(fits), m)))
            continue
        counts = trie[low:high, level]
        starts = np.flatnonzero(np.concatenate([[True], counts[1:] != counts[:-1]])) + low
        own = visit[who, level]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), high]):
            by = int(trie[a, level]) - own
            more, less = surplus + (by == 1), deficit + (by == -1)
            go = (np.abs(by) <= 1) & (more <= 1) & (less <= more)
            if go.any():
                stack.append((a, b, level + 1, who[go], more[go], less[go]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _letters(words: list[bytes], width: int) -> np.ndarray:
    return np.array([w[:width] for w in words], f"S{width}").view(np.uint8).reshape(len(words), width)


def _one_edit(a: bytes, b: bytes) -> bool:
    if len(a) > len(b):
        a, b = b, a
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (len(a) == len(b) and a[p + 1 :] == b[p + 1 :] or len(a) + 1 == len(b) and a[p:] == b[p + 1 :])


def near(one: list[bytes], two: list[bytes], i: np.ndarray, j: np.ndarray, part: int = 1 << 16) -> np.ndarray:
    """Whether one[i] and two[j] differ by exactly one edit."""
    sizes = [np.array([len(w) for w in x]) for x in (one, two)]
    width = min(LONG, max(s.max() for s in sizes)) + 1
    text = [_letters(x, width) for x in (one, two)]
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), part):
        x, y = i[at : at + part], j[at : at + part]
        flip = sizes[0][x] > sizes[1][y]
        a = np.where(flip[:, None], text[1][y], text[0][x])
        b = np.where(flip[:, None], text[0][x], text[1][y])
        la, lb = np.minimum(sizes[0][x], sizes[1][y]), np.maximum(sizes[0][x], sizes[1][y])
        differ = a != b
        same = (la == lb) & (differ.sum(1) == 1)
        tail = np.arange(width - 1)[None, :] >= differ.argmax(1)[:, None]
        longer = (la + 1 == lb) & ~((a[:, :-1] != b[:, 1:]) & tail & (np.arange(width - 1)[None, :] < la[:, None])).any(1)
        ok = same | longer
        for k in np.flatnonzero(lb >= width):
            ok[k] = _one_edit(one[x[k]], two[y[k]])
        out[at : at + part] = ok
    return out


def _subtrie(pdf: pd.DataFrame) -> pd.DataFrame:
    empty = pd.DataFrame({"word": np.empty(0, object), "n_near": np.empty(0, np.int64), "less": np.empty(0, np.int64), "best": np.empty(0, object)})
    members, visitors = pdf[pdf["member"]], pdf[~pdf["member"]]
    if not len(members) or not len(visitors):
        return empty
    counts = np.array(members["counts"].tolist(), np.int16)
    members = members.iloc[np.lexsort(counts.T[::-1])]
    trie, visit = np.array(members["counts"].tolist(), np.int16), np.array(visitors["counts"].tolist(), np.int16)
    i, j = _search(trie, visit)
    once = (visitors["id"].to_numpy()[i] < members["id"].to_numpy()[j]) | (visit[i] != trie[j]).any(1)
    i, j = i[once], j[once]
    if not len(i):
        return empty
    names = [[w.encode("latin-1") for w in x["word"]] for x in (visitors, members)]
    fits = near(*names, i, j)
    i, j = i[fits], j[fits]
    sides = [(visitors, i, members, j), (members, j, visitors, i)]
    pairs = pd.DataFrame({"word": np.concatenate([a["word"].to_numpy()[k] for a, k, _, _ in sides]), "less": np.concatenate([-b["n"].to_numpy()[k] for _, _, b, k in sides]), "best": np.concatenate([b["word"].to_numpy()[k] for _, _, b, k in sides])})
    pairs = pairs.sort_values(["word", "less", "best"])
    sizes = pairs.groupby("word").size()
    out = pairs.drop_duplicates("word").assign(n_near=lambda x: sizes[x["word"]].to_numpy())
    return out[["word", "n_near", "less", "best"]]


def near_words(words: DataFrame, room: int = ROOM, visitors: int = VISITORS) -> DataFrame:
    """word, n_near, best, best_n: words(word, n) that have near ones."""
    members, met = subtries(_vectors(words), room)
    members, met = staged(members, "placed"), staged(met, "met")
    parts = members.groupBy("node").agg(F.ceil(F.count("*") / room).alias("ms")).join(met.groupBy("node").agg(F.ceil(F.count("*") / visitors).alias("vs")), "node")
    parts = staged(parts, "parts")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
    columns = ["node", "m", "v", "id", "word", "n", "counts", "member"]
    held = members.join(parts, "node").withColumn("m", deal("ms", 1)).withColumn("v", every("vs")).withColumn("member", F.lit(True)).select(*columns)
    come = met.join(parts, "node").withColumn("v", deal("vs", 2)).withColumn("m", every("ms")).withColumn("member", F.lit(False)).select(*columns)
    found = held.unionByName(come).groupBy("node", "m", "v").applyInPandas(_subtrie, "word string, n_near long, less long, best string")
    best = staged(found, "near").groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "best")).alias("b"))
    return best.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where forms(word, form) end; each round doubles the steps."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = staged(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "roots")
        now = then.drop("went")
        if then.where("went").isEmpty():
            return now


def spelling_variants(docs: DataFrame, times: int = 2, room: int = ROOM, visitors: int = VISITORS) -> DataFrame:
    """word, n, n_near, form, form_n, root."""
    words = staged(word_counts(docs), "words")
    both = staged(words.join(near_words(words, room, visitors), "word", "left"), "best")
    fits = F.col("best_n") >= times * F.col("n")
    marked = both.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
    roots = _roots(marked.where("form IS NOT NULL"))
    return marked.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_SQL = """
WITH RECURSIVE steps AS (
  SELECT list_transform(range(16), lambda i: list_reduce([i] || range(4), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
  ) WHERE length(run) >= 5 GROUP BY ALL
), halves AS (
  SELECT doc_id, run, n, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c) % 16, unicode(c) // 16]
    ELSE [(192 + unicode(c) // 64) % 16, (192 + unicode(c) // 64) // 16, (128 + unicode(c) % 64) % 16, (128 + unicode(c) % 64) // 16] END)) AS b FROM runs
), hashed AS (
  SELECT doc_id, run, n, xor(list_reduce([4294967295] || list_transform(b, lambda x: x::BIGINT), lambda c, x: xor(c // 16, t[(xor(c, x) % 16) + 1])), 4294967295) AS h FROM halves, steps
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), rests AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), shorter AS (SELECT DISTINCT r.word AS a, w.word AS b FROM rests r JOIN words w ON w.word = r.rest
), pairs AS (
  SELECT x.word AS a, y.word AS b FROM rests x JOIN rests y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT a, b FROM shorter UNION SELECT b, a FROM shorter
), best AS (
  SELECT p.a, count(*) AS n_near, arg_min(w.word, {'n': -w.n, 'w': w.word}) AS form, max(w.n) AS form_n FROM pairs p JOIN words w ON w.word = p.b GROUP BY p.a
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b ON b.a = w.word
), chain AS (
  SELECT word, word AS last, 0 AS k FROM formed UNION ALL SELECT c.word, f.form, c.k + 1 FROM chain c JOIN formed f ON f.word = c.last WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM formed f JOIN (SELECT word, arg_max(last, k) AS root FROM chain GROUP BY word) c ON c.word = f.word
"""
