"""The stages one after the other, each against brute force on what it was given."""

import re

import corpus_pipeline as p
from pyspark.sql import functions as F

from meadow.functions.shared import staged
from meadow.llm.common import WORD
from tests.llm.test_operators import distance, exact_components


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = staged(stage(spark, docs, sf), name)
        rows = docs.collect()
        if name != "pack":
            assert docs.columns == columns
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            kept = {r.doc_id for r in rows}
            assert sum((i in kept) == (q == 1) for i, q in labels.items()) / len(labels) > 0.97
        if name == "lines":
            seen, want = [], {}
            for i in sorted(before):
                left = []
                for line in before[i].text.split("\n"):
                    if len(line) >= 40:
                        near = any(abs(len(x) - len(line)) <= 2 and (x == line or distance(x, line) <= 2) for x in seen)
                        seen.append(line)
                        if near:
                            continue
                    left.append(line)
                want[i] = "\n".join(left)
            got = {r.doc_id: r.text for r in rows}
            assert got == {i: t for i, t in want.items() if t == before[i].text or t.strip(" ")}
        if name == "near":
            want = exact_components([(i, r.text) for i, r in before.items()], 5)
            assert sorted(r.doc_id for r in rows) == sorted(i for i, (_, c) in want.items() if c == i)
        if name == "mix":
            n = {}
            for r in rows:
                n[r.doc_id] = n.get(r.doc_id, 0) + 1
                assert r.text == before[r.doc_id].text and re.search(WORD, r.text)
            assert max(n.values()) <= 2
        if name == "pack":
            fill = {}
            for r in rows:
                fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
            assert max(fill.values()) <= 1024 and {r.doc_id for r in rows} == set(before)


def test_stages_of_hard_rows(spark, sf):
    """Nulls in every column, empty and long texts, repeated rows and ids, a clashing column; then no rows at all."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, _size int, _removed int"
    good = "The committee met on Tuesday and agreed on a plan for the new library, which opens in spring. "
    rows = [
        (1, None, None, None, None, 1, 1), (2, "", "en", "a", 0, 2, 2), (None, good * 3, "en", "a", 9, 3, 3), (None, good * 3, "en", "a", 9, 3, 3), (4, good * 3 + "\nIt was well attended, with many questions from the floor.", None, "b", 9, 4, 4),
        (5, "word " * 60_000, "en", None, 9, 5, 5), (6, "one text of its own under an id that stands twice, about rivers", "en", "a", 9, 6, 6), (6, "another text of its own under the same id, about mountains", "en", "a", 9, 7, 7), (6, "another text of its own under the same id, about mountains", "en", "a", 9, 7, 7),
    ]
    docs = spark.createDataFrame(rows, columns)
    names = [c.split()[0] for c in columns.split(", ")]
    for name, stage in p.STAGES:
        out = staged(stage(spark, docs, sf), name)
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0
        if name == "pack":
            got = out.collect()
            fill = {}
            for r in got:
                fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
            assert max(fill.values()) <= 1024
            continue
        assert out.columns == names == none.columns
        got = out.collect()
        if name == "lines":
            kept = {(r.doc_id, r._size): r.text for r in got}
            assert kept[(1, 1)] is None and kept[(2, 2)] == "" and (6, 6) in kept and (6, 7) in kept and all(r._size == r._removed for r in got)
        if name == "near":
            texts = [r.text for r in got]
            assert len([t for t in texts if t and "mountains" in t]) == 1 and len([t for t in texts if t and "rivers" in t]) == 1 and sum(bool(t) and good in t for t in texts) == 1
        docs = docs if name == "quality" else out  # the classifier judges these as it likes
