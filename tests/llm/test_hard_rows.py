"""Rows that share or lack an id, very large and very small numbers, broken-off compactions, very many matches."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meadow.llm import lines, pii, quality, tokens, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
L, M, N = (f"a line about {x} that is long enough to take part in this" for x in ("rivers and seas", "the many towns", "old clocks"))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


@pytest.mark.parametrize(
    "rows,want",
    [
        ([(1, L), (2, L), (2, M)], {(1, L): 0, (2, ""): 1, (2, M): 0}),
        ([(2, M), (2, L), (1, L)], {(1, L): 0, (2, ""): 1, (2, M): 0}),
        ([(2, f"{M}\n{L}"), (2, f"{N}\n{L}"), (1, L)], {(1, L): 0, (2, M): 1, (2, N): 1}),
    ],
)
def test_only_lines_with_a_copy_leave_rows_of_one_id(spark, rows, want):
    assert {(r.doc_id, r.text): r.gone for r in lines.without_repeated_lines(docs(spark, rows), count="gone").collect()} == want


def test_only_lines_with_a_copy_leave_rows_without_an_id(spark):
    rows = [(None, L), (None, M), (None, f"{L} x\n{M}"), (5, L), (None, N)]
    got = [(r.doc_id, r.text) for r in lines.without_repeated_lines(docs(spark, rows)).collect()]
    text = "\n".join(t for _, t in got)
    # Each line stays once, in one of the rows that hold it; L and L with a sign more are near.
    assert len(got) == 5 and text.count(L) == 1 and text.count(M) == 1 and text.count(N) == 1 and (5, "") in got and (None, N) in got


def test_rows_that_repeat_a_document_share_its_decisions(spark):
    got = sorted((r.doc_id, r.text) for r in lines.without_repeated_lines(docs(spark, [(1, f"{L}\nx")] * 2 + [(3, L)] * 2)).collect())
    assert got == [(1, f"{L}\nx")] * 2 + [(3, "")] * 2


def test_lines_stage_keeps_documents_of_one_id(spark, sf):
    rows = [(1, L), (2, L), (2, M), (None, N), (None, None), (3, "")]
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs(spark, rows), sf).collect() if r.text)
    assert got == [("1", L, len(L)), ("2", M, len(M)), ("None", N, len(N))]


def test_vectors_of_extreme_components(spark):
    rows = [(1, [1e200, 2e200]), (2, [2e200, 4e200]), (3, [1e-200, 2e-200]), (4, [2.0, 0.1]), (5, [5e-324, 0.0]), (6, [1e308, 1e308]), (7, [1.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    # 4 and 5 are at cosine 0.9988, 1 to 3 point one way, and 6 and 7 are at 0.9487 of these.
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}


def test_the_table_goes_through_a_grid(spark, sf, monkeypatch):
    made = []
    grid = vectors.Grid
    monkeypatch.setattr(vectors, "Grid", lambda *a: made.append(grid(*a)) or made[-1])
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in vectors.op2_vectors(spark, sf).collect()}
    assert len(made) == 1 and made[0].k >= 4 and 1 <= made[0].visits <= made[0].k ** 2
    rows = table.collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.95).sum(1) - 1
    assert sum(got[r.vec_id] for r in rows) >= 0.99 * links.sum() and all(got[r.vec_id] <= n for r, n in zip(rows, links))


def counts(spark, rows):
    return spark.createDataFrame([(i, "s", "en", "v", n) for i, n in rows], "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def total(log):
    return [(r.n_docs, r.n_tokens) for r in log.totals().collect()]


def test_compaction_that_breaks_off(spark, tmp_path):
    old, new = tokens.TokenTotals(spark, str(tmp_path / "old")), tokens.TokenTotals(spark, str(tmp_path / "new"))
    old.commit("1", tokens.inserts(counts(spark, [(1, 10)])))
    publish = new._publish

    def breaks(rows, name):
        publish(rows, name)
        raise RuntimeError("lost")

    new._publish = breaks
    with pytest.raises(RuntimeError):
        old.compact(new, "first")
    new._publish = publish
    old.commit("2", tokens.inserts(counts(spark, [(2, 5)])))
    old.compact(new, "first")
    assert total(new) == [(1, 10)] and not new.commit("1", tokens.inserts(counts(spark, [(1, 10)])))
    assert new.commit("2", tokens.inserts(counts(spark, [(2, 5)]))) and total(new) == [(2, 15)]


def test_two_compactions_at_once_and_a_commit_between(spark, tmp_path):
    old, new = tokens.TokenTotals(spark, str(tmp_path / "old")), tokens.TokenTotals(spark, str(tmp_path / "new"))
    old.commit("1", tokens.inserts(counts(spark, [(1, 10)])))
    publish = new._publish

    def other(rows, name):
        done = publish(rows, name)
        if name == "folded":
            new._publish = publish
            old.commit("2", tokens.inserts(counts(spark, [(2, 5)])))
            old.compact(new, "first")
        return done

    new._publish = other
    old.compact(new, "first")
    assert total(new) == [(1, 10)] and new.batches() == ["1", "first"]
    third = tokens.TokenTotals(spark, str(tmp_path / "third"))
    new.compact(third, "second")
    assert total(third) == [(1, 10)] and not third.commit("first", tokens.inserts(counts(spark, [(9, 9)])))


def test_labels_of_repeated_ids_bring_one_row_each(spark):
    good, bad = "the river runs to the sea and the road to the town. " * 5, "zz 11 !! " * 9
    table = docs(spark, [(k, (good, bad)[k % 2] + str(k)) for k in range(40)] + [(0, good)] * 300 + [(1, None)])
    labels = spark.createDataFrame([(k, 1 - k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    seen = []
    real = quality.fit_pairs
    try:
        quality.fit_pairs = lambda a, b, *more, **how: seen.append((len(a), len(b))) or real(a, b, *more, **how)
        quality.fit(table, labels)
    finally:
        quality.fit_pairs = real
    assert seen == [(20, 20)]


def test_context_in_blocks_is_the_plain_one(spark):
    text = " ".join(f"{('phone', 'é', 'card number', 'x' * (k % 60))[k % 4]} +1 202 555 {1000 + k}, m{k}@ex.org" for k in range(600))
    table = spark.createDataFrame([(1, text), (2, "call +1 202 555 0100"), (3, None)], "id long, text string")
    plain = pii.STRIDE
    some = pii.find_spans(table).orderBy("id").select("spans").collect()
    try:
        pii.STRIDE = 10**6
        all_ = pii.find_spans(table).orderBy("id").select("spans").collect()
    finally:
        pii.STRIDE = plain
    assert some == all_ and len(some[0].spans) >= 1200


def test_spans_of_one_text_take_time_in_proportion(spark):
    def took(n):
        table = spark.createDataFrame([(1, "mail a@b.cd or " * n)], "id long, text string")
        began = time.time()
        assert pii.find_spans(table).select(F.size("spans").alias("n")).first().n == n
        return time.time() - began

    took(2000)
    assert took(40_000) < 8 * took(10_000) + 2
