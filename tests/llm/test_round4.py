"""What the driver holds while lines are compared; what a query of a search reads."""

import random

import numpy as np
import pytest

import corpus_pipeline
from meadow.llm import lines, search
from tests.llm.test_hard_rows import docs


def families(each):
    """Three families of documents of a line, whose lines share two thirds and are far from each other; five near copies."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for _ in range(3):
        base = [word(6) for _ in range(15)]
        for _ in range(each):
            own = list(base)
            third = r.randrange(3)
            for k in r.sample(range(third * 5, third * 5 + 5), 2):
                own[k] = word(6)
            rows.append((len(rows), " ".join(own)))
    return rows + [(len(rows) + k, rows[k][1] + "x") for k in range(5)]


def test_no_table_of_lines_goes_through_the_driver(spark, monkeypatch):
    rows = families(20)
    plans, write = [], lines.staged

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(lines, "staged", noted)
    gone = lines.removed_lines(docs(spark, rows), room=8)
    plans.append(("gone", gone._jdf.queryExecution().sparkPlan().toString()))
    assert sorted(x.doc for x in gone.collect()) == list(range(60, 65))
    assert [name for name, _ in plans].count("met") == 2  # the second round took place
    assert not [name for name, plan in plans if "Broadcast" in plan]


def test_the_stage_of_lines_sends_no_table_through_the_driver(spark, monkeypatch):
    rows, plans, write = families(100), [], lines.staged
    monkeypatch.setattr(lines, "staged", lambda df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or write(df, name))
    left = corpus_pipeline.line_dedup(spark, docs(spark, rows), "").select("doc_id").collect()
    assert sorted(x.doc_id for x in left) == list(range(300))
    assert [name for name, _ in plans].count("met") == 2 and not [name for name, plan in plans if "Broadcast" in plan]


def crowd(n=600, seed=6):
    """Counted documents whose words are mostly common ones, and queries of many words."""
    rng = np.random.default_rng(seed)
    counted = []
    for _ in range(n):
        w = np.unique(rng.zipf(1.3, 80).astype(np.uint64) % np.uint64(3000))
        counted.append((w, rng.integers(1, 5, len(w))))
    asked = [(w, 0.01 + rng.random(len(w))) for w in (np.unique(rng.zipf(1.2, 60).astype(np.uint64) % np.uint64(3500)) for _ in range(40))]
    return counted, [*asked, (np.array([], np.uint64), np.array([])), (np.array([3400], np.uint64), np.array([1.0]))]


@pytest.mark.parametrize("window,common", [(256, 1 << 23), (2, 1 << 23), (3, 2000), (1, 0)])
def test_a_batch_of_queries_finds_what_a_loop_finds(monkeypatch, window, common):
    monkeypatch.setattr(search, "WINDOW", window)
    monkeypatch.setattr(search, "COMMON", common)
    counted, asked = crowd()
    shard = search.Shard(list(range(len(counted))), list(counted), 60.0)
    for k in (1, 10, 700):
        for (words, weight), got in zip(asked, shard.best_of(asked, k), strict=True):
            w, scores = dict(zip(words.tolist(), weight)), []
            for i, (t, n) in enumerate(counted):
                x = search.K1 * (1 - search.B + search.B * n.sum() / 60.0)
                if s := sum(w[y] * c * (search.K1 + 1) / (c + x) for y, c in zip(t.tolist(), n.tolist()) if y in w):
                    scores.append((-s, i))
            best = sorted(scores)[:k]
            assert [i for i, _ in got] == [i for _, i in best] and np.allclose([s for _, s in got], [-s for s, _ in best], atol=2e-9)


def test_postings_of_common_words_are_not_walked_for_each_query():
    counted, asked = crowd()
    shard, read = search.Shard(list(range(len(counted))), list(counted), 60.0), []
    plain = shard._score
    shard._score = lambda runs, w: read.append(int((shard.run[runs + 1] - shard.run[runs]).sum())) or plain(runs, w)
    for words, weight in asked:
        shard.best(words, weight, 10)
    there = np.concatenate([w for w, _ in counted])
    assert sum(read) < sum(np.isin(there, words).sum() for words, _ in asked) / 4
