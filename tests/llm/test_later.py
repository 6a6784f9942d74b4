"""Repeated passages, spelling variants and hard negatives against brute force, on hard rows and in many small parts."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meadow.llm import negatives, spelling, substrings

# op11

TEXTS = "doc_id long, text string, doc string, h int, n long, again string, start int"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 1, "y", 2) for i, t in rows], TEXTS)


def w(*numbers):
    return " ".join(f"w{k}" for k in numbers)


def passages(rows, window):
    """doc_id, words, removed, digest: rows in the order of their ids, nulls last."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def same_rows(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


HARD = [(1, None), (2, ""), (3, " \n\t"), (None, w(*range(30))), (5, w(*range(5, 40))), (6, "a " * 700), (7, "a\x1cb\xa0c " * 21), (8, "é" * 40_000 + " " + w(*range(100, 121))), (9, w(*range(99, 125)) + "\n" + w(*range(5, 30))), (10, "Word word " * 30), (11, w(1, 2, 3)), (-4, w(*range(10, 31)))]


@pytest.mark.parametrize("shard,hot", [(substrings.SHARD, substrings.HOT), (7, substrings.HOT), (40, 1)])
def test_passages_of_hard_rows(spark, shard, hot):
    same_rows(substrings.digest(texts(spark, HARD), shard=shard, hot=hot).collect(), passages(HARD, 20))


def test_passages_of_repeated_rows_and_an_empty_table(spark):
    rows = [(1, w(*range(25)))] * 3 + [(2, w(*range(5)))] * 2 + [(None, None)] * 2
    same_rows(substrings.digest(texts(spark, rows)).collect(), passages(rows, 20))
    assert substrings.digest(texts(spark, rows).limit(0)).count() == 0


def test_passages_of_a_small_alphabet(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("abc"[k] for k in rng.integers(0, 3, rng.integers(0, 120)))) for i in range(80)]
    for window, hot in ((5, 10_000), (9, 2)):
        same_rows(substrings.digest(texts(spark, rows), window, shard=50, hot=hot).collect(), passages(rows, window))


def test_a_passage_of_all_documents(spark):
    """A third of all documents and more share a passage in different surroundings."""
    rows = [(i, w(*range(1000 * i, 1000 * i + 9)) + " " + w(*range(26)) + f" end{i} " + w(*range(7, 30))) for i in range(1, 120)]
    want = passages(rows, 20)
    for hot in (30, 5000):
        same_rows(substrings.digest(texts(spark, rows), hot=hot).collect(), want)


def test_index_gives_matching_statistics():
    rng = np.random.default_rng(1)
    for _ in range(20):
        runs = [rng.integers(0, 3, rng.integers(4, 12)).astype(np.uint64) for _ in range(rng.integers(1, 20))]
        places = rng.permutation(sum(map(len, runs)))
        least, at, where = {}, 0, []
        for r in runs:
            where.append([(tuple(r[j : j + 4].tolist()), int(places[at + j])) for j in range(len(r) - 3)])
            at += len(r)
        for k, p in (x for one in where for x in one):
            least[k] = min(least.get(k, p), p)
        assert substrings.FMIndex(runs, places, 4).repeated().tolist() == [sum((least[k] < p) << j for j, (k, p) in enumerate(one)) for one in where]


def test_long_texts_are_hashed_alike_in_pieces(monkeypatch):
    text = (w(*range(3000)) + " " + "x" * 5000 + "\t\ny").encode()
    whole = substrings.Hasher().of_words(text)
    monkeypatch.setattr(substrings, "PIECE", 100)
    parts = substrings.Hasher().of_words(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(whole[0]) == len(text.split())


# op12


def variants(rows):
    """word: n, n_near, form, form_n, root."""
    import re

    counts = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.UPPER.lower()))
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    counts = {k: n for k, n in counts.items() if n >= 3}
    out = {}
    for a, n in counts.items():
        close = [(-counts[b], b) for b in counts if abs(len(a) - len(b)) <= 1 and spelling._one_edit(a.encode("latin-1"), b.encode("latin-1"))]
        best = min(close, default=(0, None))
        fits = -best[0] >= 2 * n
        out[a] = [n, len(close), best[1] if fits else None, -best[0] if fits else None]
    for a in out:
        root = a
        while out[root][2]:
            root = out[root][2]
        out[a] = tuple(out[a][:4]) + (root,)
    return out


def collected(df):
    rows = df.collect()
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("room,visitors", [(spelling.ROOM, spelling.VISITORS), (5, 40), (1, 3)])
def test_variants(spark, room, visitors):
    rng = np.random.default_rng(room)
    rows = [(i, " ".join("".join("abeéÀ"[k] for k in rng.integers(0, 5, rng.integers(4, 8))) for _ in range(40))) for i in range(60)]
    rows += [(None, "Haus hauser Hauser HAUSER hausér"), (1, None), (2, ""), (3, "x" * 300 + " " + "x" * 301 + " ÉTÉÉÉ étééé ")] + [(4, "x" * 300 + " " + "x" * 301)] * 3 + [(7, "hauser houser hausers")] * 5
    assert collected(spelling.spelling_variants(texts(spark, rows), room=room, visitors=visitors)) == variants(rows)


def test_variants_of_one_vector_are_dealt_in_parts(spark):
    """Many words with the same letters, so that no level of the trie parts them."""
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.permutation(list("abcdef"))) for _ in range(300)}) + ["abcdeg", "abcde"]
    rows = [(k, " ".join(words)) for k in range(4)]
    assert collected(spelling.spelling_variants(texts(spark, rows), room=16, visitors=50)) == variants(rows)


def test_variants_of_an_empty_table(spark):
    assert spelling.spelling_variants(texts(spark, [(1, "a")]).limit(0)).count() == 0
    assert spelling.spelling_variants(texts(spark, [(1, None), (None, "of the")])).count() == 0


def test_chains_of_forms(spark):
    rows = [(1, " ".join(["aaaaa"] * 3 + ["aaaab"] * 7 + ["aaabb"] * 20 + ["aabbb"] * 50 + ["abbbb"] * 60))]
    assert collected(spelling.spelling_variants(texts(spark, rows))) == variants(rows)


# op13

VECTORS = "vec_id long, embedding array<double>, label int, id int, slot string, tree long, windows string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], g, 1, "a", 2, "b") for i, v, g in rows], VECTORS)


def mined(rows, every=5, k=5, m=3):
    fine = [(i, [int(np.floor(256 * x)) for x in v], g) for i, v, g in rows if i is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    fine = [r for r in fine if sum(x * x for x in r[1]) < 1 << 62]
    out = []
    for i, v, g in fine:
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(v, u)), j, h) for j, u, h in fine if len(u) == len(v)]
        for p, j, _ in sorted(s for s in score if s[2] == g and s[1] != i)[:k]:
            p = -p
            close = sorted((s, q) for s, q, h in score if h != g and 50 * p <= -100 * s <= 95 * p)[:m]
            out += [(i, j, r + 1, q, p, -s) for r, (s, q) in enumerate(close)]
    return out


@pytest.mark.parametrize("shard,page", [(negatives.SHARD, negatives.PAGE), (40, 4), (9, 100)])
def test_negatives(spark, shard, page):
    rng = np.random.default_rng(shard)
    rows = [(i, (rng.normal(size=6) + [1, 0, 0, 0, 0, i % 3]).round(2).tolist(), int(i % 4 if i % 3 else 0)) for i in range(300)]
    rows += [(301, None, 1), (302, [1.0, None, 0, 0, 0, 0], 1), (303, [float("nan")] * 6, 1), (304, [float("inf")] * 6, 1), (305, [0.5] * 6, None), (None, [0.5] * 6, 1), (310, [1e300] * 6, 1)]
    rows += [(400, [1.0, 2.0], 0), (401, [0.5, 2.0], 0), (402, [0.3, 2.0], 1), (405, [], 1), (406, [], 1), (407, [], 2), (410, [0.0] * 6, 1)]
    rows += [(415, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 2)] * 2 + [(416, [0.3] * 6, 1)] * 3 + [(420, [2.0**20] * 6, 0), (421, [2.0**20, 1, 1, 1, 1, 1], 0), (422, [2.0**19, 3, 3, 1, 1, 1], 3)]
    got = negatives.hard_negatives(vectors(spark, rows), F.col("label"), every=5, shard=shard, page=page).collect()
    same_rows([(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got], mined(rows))


def test_negatives_of_one_label_and_of_no_rows(spark):
    rows = [(i, [1.0, i / 10], 3) for i in range(40)]
    assert negatives.hard_negatives(vectors(spark, rows), F.col("label"), shard=10, page=3).count() == 0
    assert negatives.hard_negatives(vectors(spark, rows).limit(0), F.col("label")).count() == 0


def test_boxes_are_left_out(spark):
    """Clusters far apart: most pages of a tree are never scored."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(400, 3)) * 2 + 100 * np.eye(3)[k] for k in range(3)]).round().astype(np.int64)
    pages = negatives.tiles(x, 16)
    assert sorted(np.concatenate(pages).tolist()) == list(range(len(x))) and max(map(len, pages)) <= 32
    order = np.concatenate(pages)
    row = {"ids": order.tobytes(), "labels": np.ones(len(x), np.int64).tobytes(), "vecs": x[order].tobytes(), "rows": len(x), "dims": 3, "pages": [len(p) for p in pages]}
    tree, q, opened = negatives.Tree(row), np.array([[5, 1, 0]]), []
    low, high = tree.intervals(q)
    scores = x[order] @ q[0]
    assert all((low[0][n] <= scores[a:b]).all() and (scores[a:b] <= high[0][n]).all() for n, (a, b) in enumerate(tree.pages))
    got = tree.best(lambda n: opened.append(n) or scores[slice(*tree.pages[n])], low[0], high[0], 1, True, None, 5, None)
    assert got == sorted(((int(s), int(i)) for s, i in zip(scores, order)), key=lambda r: (-r[0], r[1]))[:5]
    assert len(opened) < len(pages) / 3
