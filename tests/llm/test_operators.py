"""The text operators against brute force, on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meadow.llm import chat, lines, mixing, neardup, packing, pii, quality, queries, search, tokens, vectors
from meadow.llm.common import WORD
from tests.compare import connection, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, n long, copies long, spans string"


def docs(spark, rows):
    """Documents with columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1, 1, "y") for i, t, s in rows], DOCS)


HARD = [(1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "one two", "b"), (4, "one two", "b"), (None, "three", None), (5, "Word " * 5000, "b"), (6, "é" * 3000 + " <|endoftext|> x", "c")]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.ORACLE[name], connection(sf))


# op1


def exact_components(texts, width, num=80, den=100):
    shingles = {}
    for i, t in texts:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = re.findall(WORD, w)
        shingles[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    ids = sorted(shingles)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(shingles[a] & shingles[b])
            if both and den * both >= num * len(shingles[a] | shingles[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(shingles[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, sf, width):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    want = exact_components([(r.doc_id, r.text) for r in table.collect()], width)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table, width).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_crowded_regions_keep_their_links(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(700):
        w = list(base)
        for k in rng.choice(120, 3 if i else 0, replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w), "a"))
    want = exact_components([(i, t) for i, t, _ in rows], 4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows), 4).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_pairs_in_a_crowd_of_common_text(spark):
    """3,000 documents that share 7 of 10 shingles with all others; each has one partner at 0.86."""
    rows = []
    for i in range(3000):
        w = [f"w{k}" for k in range(200)] + [f"p{i // 2}_{k}" for k in range(24)] + [f"x{i}_{k}" for k in range(16)]
        rows.append((i, " ".join(w), "a"))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows), 4).collect()}
    assert got == {i: i - i % 2 for i in range(3000)}


def test_leaves_are_cut_where_prefixes_are_short():
    key = lambda *h: np.array(h, "<u4").tobytes()
    orders = sorted([key(1, 1, k) for k in range(3)] + [key(1, 2, k) for k in range(4)] + [key(2, 0, k) for k in range(2)] + [key(3, 3, 3)] * 9)
    starts = neardup.cut_order(orders, 6)
    assert starts[0] == 0 and all(0 < b - a <= 6 for a, b in zip(starts, [*starts[1:], len(orders)])) and starts[1] == 3
    assert neardup.cut_order(orders[:3], 6) == [0] and neardup.cut_order([key(1)] * 9, 4) == [0, 4, 8]


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark):
    text = " ".join(f"w{k}" for k in range(60))
    other = " ".join(f"v{k}" for k in range(60))
    rows = [(1, text, "a"), (5, text + " end", "a"), (5, other, "b"), (None, other + " x", "c"), (None, other + " x", "c"), (7, "quite another text of its own", "a"), (7, "quite another text of its own", "b")]
    got = sorted((str(r.doc_id), r.text) for r in neardup.without_near_duplicates(docs(spark, rows)).collect())
    assert got == [("1", text), ("5", other), ("7", "quite another text of its own")]


@pytest.mark.parametrize("size", [81, 400])
def test_one_link_between_crowded_families(spark, size):
    """Members of a family are at 0.99, those of two at 0.799; one pair that shares its last word is at 0.807."""
    rows = []
    for i in range(2 * size):
        w = [f"w{k}" for k in range(200)]
        if i >= size:
            for k in (0, 20, 40, 60, 80, 100):
                w[k] = f"b{k}"
        w[199] = "bridge" if i % size == size - 1 else f"x{i}"
        rows.append((i, " ".join(w), "a"))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs(spark, rows), 4).collect()}
    assert got == dict.fromkeys(range(2 * size), 0)


def test_near_duplicates_of_hard_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, HARD), 4).collect()), key=str)
    assert (1, 0, 1, True) in got and (2, 0, 2, True) in got and (None, 1, None, True) in got
    assert got.count((4, 1, 4, True)) == 2 and (5, 1, 5, True) in got and len(got) == len(HARD)
    kept = neardup.without_near_duplicates(docs(spark, HARD + [(9, "one two", "z")]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None"]
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


# op2


def test_near_vectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    check_vectors(spark, table)


def check_vectors(spark, table, **how):
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    close = np.array([[len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95 for _, w in ok] for _, v in ok])
    np.fill_diagonal(close, False)
    low = np.array([i for i, _ in ok])
    while True:
        new = np.array([min([low[k], *low[close[k]]]) for k in range(len(low))])
        if (new == low).all():
            break
        low = new
    want = {i: (1 * n, c) for (i, _), n, c in zip(ok, close.sum(1).tolist(), low.tolist())}
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(table, **how).collect()}
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i] == want.get(i, (0, i))


def test_vectors_that_link_with_nothing(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=8).tolist()
    rows = [(1, base), (2, base), (3, [x * 3 for x in base]), (4, None), (5, [0.0] * 8), (6, [float("nan")] * 8), (7, [None] + base[1:]), (8, [float("inf")] * 8), (9, [-x for x in base])]
    rows += [(10 + k, rng.normal(size=8).tolist()) for k in range(60)]
    check_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=3).tolist()) for k in range(40)] + [(50, [1.0, 2.0]), (51, [1.0, 2.0]), (52, [2.0, 4.0]), (53, [-1.0, 2.0])]
    rows += [(60, [1.0]), (61, [2.0]), (62, [0.5]), (63, [-3.0]), (64, [-4.0]), (70, []), (71, [0.0])]
    check_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), few=10)
    repeated = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0]), (None, [1.0, 0.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(repeated, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (None, 0, None)]


def test_vectors_at_the_threshold(spark):
    """Cosines of exactly 0.95, and of a hair less, in numbers that are exact in double precision."""
    a, b = [1.0, 0.0, 0.0], [0.95, (1 - 0.95**2) ** 0.5, 0.0]
    near = [(1, a), (2, [x * 4 for x in b]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 0.3125, 0.949])]
    check_vectors(spark, spark.createDataFrame(near, "vec_id long, embedding array<double>"))


def test_links_by_a_grid_of_many_cells(spark):
    """5,000 vectors, k of 10: pairs planted at 0.951 and 0.949, links counted on both ends; recall at least 0.999."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    cos = np.where(np.arange(2500) % 5 < 4, 0.951, 0.949)[:, None]
    y = cos * x + np.sqrt(1 - cos * cos) * noise
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    assert vectors.Grid(x, 5000, 0.95, 0.9995, 50).k == 10
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(table, per_cell=50, few=100).collect()}
    want = {k: k for k in range(2500) if k % 5 < 4}
    hit = sum(got[k] == (1, k) and got[k + 2500] == (1, k) for k in want)
    assert hit >= 0.999 * len(want)
    assert all(got[k][0] == got[k + 2500][0] for k in want)
    assert all(got[k] == (0, k) and got[k + 2500] == (0, k + 2500) for k in range(2500) if k % 5 == 4)


def test_grid_visits_the_nearest_cells():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    want = sorted((a[i] + b[j], i, j) for i in range(9) for j in range(7))
    got = vectors.traverse(a, b, 20)
    assert [(i, j) for _, i, j in want[:20]] == got and len(vectors.traverse(a, b, 1000)) == 63


# op3


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(spark):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdefgh éx"), 45 + k)) for k in range(12)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(4):
            line = list(base[rng.integers(12)])
            for _ in range(rng.integers(0, 4)):
                at = rng.integers(len(line))
                line[at : at + rng.integers(0, 2)] = rng.choice(list("xyz"), rng.integers(0, 2)).tolist()
            text.append("".join(line))
        rows.append((i, "\n".join([*text, "short"]), "a"))
    got = {r.doc_id: r.text for r in lines.without_repeated_lines(docs(spark, rows)).collect()}
    seen = []
    for i, text, _ in rows:
        left = []
        for line in text.split("\n"):
            if len(line) >= lines.MIN_CHARS:
                near = any(abs(len(x) - len(line)) <= 2 and distance(x, line) <= 2 for x in seen)
                seen.append(line)
                if near:
                    continue
            left.append(line)
        assert got[i] == "\n".join(left), i


def stays(rows, edits=2, least=40):
    """Which of (doc_id, line) stay, by every pair."""
    c = duckdb.connect()
    c.execute("CREATE TABLE t (i BIGINT, line VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?, ?)", rows)
    sql = "SELECT i FROM t b WHERE length(line) < $2 OR NOT EXISTS (SELECT 1 FROM t a WHERE a.i < b.i AND length(a.line) >= $2 AND abs(length(a.line) - length(b.line)) <= $1 AND levenshtein(a.line, b.line) <= $1)"
    return {r[0] for r in c.execute(sql, [edits, least]).fetchall()}


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_bit_parallel_distance(spark, edits):
    rng = np.random.default_rng(edits)
    rows = [("", ""), ("", "abcd"), ("a", "b"), ("ab", "ba")]
    for _ in range(300):
        a = rng.choice(list("abé😀"), rng.integers(0, 14)).tolist()
        b = list(a)
        for _ in range(rng.integers(0, 6)):
            at = rng.integers(len(b) + 1)
            b[at : at + rng.integers(0, 2)] = rng.choice(list("abx"), rng.integers(0, 2)).tolist()
        rows.append(("".join(a), "".join(b)))
    chars = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", lines.within(chars("a"), chars("b"), edits).alias("near")).collect()
    assert [r.near for r in got] == [distance(r.a, r.b) <= edits for r in got]


def family(rng, n, changes):
    """n variants of one line, some words of each replaced."""
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(18)]
    out = []
    for i in range(n):
        w = list(words)
        for k in rng.choice(len(w), rng.integers(0, changes + 1), replace=False):
            w[k] = "".join(rng.choice(list("abcdefghij"), len(w[k]) + rng.integers(-1, 2)))
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("room", [4, 64])
@pytest.mark.parametrize("changes", [1, 3])
def test_lines_under_hot_keys(spark, room, changes):
    rows = family(np.random.default_rng(changes), 500, changes)
    got = {r.doc_id for r in lines.without_repeated_lines(docs(spark, [(i, t, "a") for i, t in rows]), room=room).collect() if r.text}
    assert got == stays(rows)


def test_near_copies_of_one_line(spark):
    """2,000 lines a letter away from the same one: all but the first are within two edits of it."""
    base = "a line with some words that are all the same but for a letter or two"
    rows = [(k, base[: k % 60] + "xyz"[k % 3] * (1 + k % 2) + base[k % 60 + 1 :] + "qrstuvwxyz"[k // 200 % 10], "a") for k in range(2000)]
    out = lines.line_classes(docs(spark, rows), room=8).collect()
    got = {r.doc_id for r in lines.without_repeated_lines(docs(spark, rows), room=8).collect() if r.text}
    assert len(out) == len({t for _, t, _ in rows}) and got == stays([(i, t) for i, t, _ in rows])


def test_lines_of_hard_rows(spark):
    long = "a line that is long enough to take part in this, twice"
    rows = HARD + [(7, f"{long}\nx\n{long}", "a"), (8, long, "a"), (None, long, None)]
    out = lines.without_repeated_lines(docs(spark, rows), count="gone")
    got = {(r.doc_id, r.source): (r.text, r.gone) for r in out.collect()}
    assert got[(None, None)][0] in (long, "three") and got[(7, "a")] == ("x", 2) and got[(8, "a")] == ("", 1)
    assert got[(1, None)] == (None, 0) and got[(2, "a")] == ("", 0) and out.count() == len(rows)
    assert lines.without_repeated_lines(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        lines.line_classes(docs(spark, []), edits=3, min_chars=6)
    clash = spark.createDataFrame([(1, long, 5, "p", "q"), (2, long, 6, "p", "q")], "doc_id long, text string, _doc int, _gone string, _GONE_ string")
    assert sorted(tuple(r) for r in lines.without_repeated_lines(clash).collect()) == [(1, long, 5, "p", "q"), (2, "", 6, "p", "q")]


# op4


def test_token_totals(spark, tmp_path):
    table = docs(spark, HARD)
    counts = tokens.counted(table, "v1")
    log = tokens.TokenTotals(spark, str(tmp_path / "log"))
    assert log.commit("1", tokens.inserts(counts)) and not log.commit("1", tokens.inserts(counts))
    assert log.commit("2", tokens.deletes(counts.where("doc_id = 5")))
    after = counts.where("doc_id = 6").withColumn("tokenizer", F.lit("v2")).withColumn("n_tokens", F.lit(7).cast("long"))
    assert log.commit("3", tokens.revisions(counts.where("doc_id = 6"), after))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.TOKENIZER)
    want = {}
    for i, text, s in HARD:
        if i not in (5, 6):
            key = (s, "v1")
            n, k = want.get(key, (0, 0))
            want[key] = (n + 1, k + len(t.encode(text or "", add_special_tokens=False).ids))
    want[("c", "v2")] = (1, 7)
    assert {(r.source, r.tokenizer): (r.n_docs, r.n_tokens) for r in log.totals().collect()} == want
    other = tokens.TokenTotals(spark, str(tmp_path / "other"))
    log.compact(other, "0")
    log.compact(other, "0")
    assert {(r.source, r.tokenizer): (r.n_docs, r.n_tokens) for r in other.totals().collect()} == want
    # What was folded is refused, here and in a log that holds it in turn.
    third = tokens.TokenTotals(spark, str(tmp_path / "third"))
    other.compact(third, "again")
    for x in (other, third):
        assert not any(x.commit(b, tokens.inserts(counts)) for b in ("0", "1", "2", "3"))
        assert {(r.source, r.tokenizer): (r.n_docs, r.n_tokens) for r in x.totals().collect()} == want
    assert third.batches() == ["0", "1", "2", "3", "again"]
    none = tokens.TokenTotals(spark, str(tmp_path / "none"))
    assert none.totals().count() == 0 and none.batches() == []
    # Of two writers that both saw no batch, one is first.
    assert none._publish(none.totals(), none._folder("a/b")) and not none._publish(none.totals(), none._folder("a/b")) and none.committed("a/b")
    # Repeated rows and a null text as deletes.
    assert none.commit("in", tokens.inserts(counts)) and none.commit("out", tokens.deletes(counts.where("doc_id IN (1, 4)")))
    left = {r.source: (r.n_docs, r.n_tokens) for r in none.totals().collect()}
    assert left["b"][0] == 1 and left[None] == (1, len(t.encode("three", add_special_tokens=False).ids))


def test_token_totals_of_documents(spark, sf):
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(tokens.TOKENIZER), {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        if n:
            a, b = want.get((r.source, r.lang), (0, 0))
            want[(r.source, r.lang)] = (a + 1, b + n)
    got = tokens.op4_tokens(spark, sf).collect()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in got} == want and {r.tokenizer for r in got} == {"byte_bpe_50k"}


def test_ids_are_the_tokenizers(spark, sf):
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(tokens.TOKENIZER), tokens.encoder()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for text in texts + ["", "a  b", " \n\n x", "it's 12 $$$", "é   x", "x<|endoftext|>y", "a\r\n\tb  "]:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


# op5


def test_search_of_hard_rows(spark):
    table = docs(spark, HARD + [(100, "one three zebra", "a"), (200, None, "a"), (101, "zebra", "a")])
    q = table.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = [(r.query_id, r.rank, r.doc_id) for r in search.top_k(q, table, k=3).orderBy("query_id", "rank").collect()]
    assert got[0] == (100, 1, 100) and len(got) == 3 and all(r[0] == 100 for r in got)
    assert search.top_k(q.limit(0), table).count() == 0 and search.top_k(q, table.limit(0)).count() == 0


def test_search_in_many_shards(spark, sf):
    """Sharding changes nothing: global statistics, ties across shards, repeated documents, repeated query ids, null ids."""
    con = connection(sf)
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    q = table.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    for per_shard in (7, 60):
        same(search.top_k(q, table, per_shard=per_shard).withColumn("score", F.round("score", 6)), search.OP5_SQL, con)
    rows = [(k, "zebra crossing" if k % 3 else "zebra crossing at night", "a") for k in range(60)] + [(None, "zebra crossing", "a")] * 5 + [(7, "zebra crossing", "b")]
    asked = spark.createDataFrame([(1, "zebra"), (1, "crossing"), (2, "night night"), (None, "zebra")], "query_id long, text string")
    one = [tuple(r) for r in search.top_k(asked, docs(spark, rows), k=70).orderBy("query_id", "rank").collect()]
    many = [tuple(r) for r in search.top_k(asked, docs(spark, rows), k=70, per_shard=5).orderBy("query_id", "rank").collect()]
    assert one == many and {r[0] for r in one} == {1, 2} and len([r for r in one if r[0] == 1]) == 66
    ids = [r[2] for r in one if r[0] == 1]
    short = sorted([k for k in range(60) if k % 3] + [7]) + [None] * 5
    assert ids == short + [k for k in range(60) if k % 3 == 0]
    assert [r[2] for r in one if r[0] == 2] == [k for k in range(60) if k % 3 == 0]


def test_pruning_loses_nothing():
    rng = np.random.default_rng(6)
    counted = []
    for _ in range(700):
        w = np.unique(rng.zipf(1.3, 60).astype(np.uint64) % np.uint64(500))
        counted.append((w, rng.integers(1, 5, len(w))))
    shard = search.Shard(list(range(700)), list(counted), 60.0)
    for _ in range(20):
        words = np.unique(rng.integers(0, 500, 30).astype(np.uint64))
        weight = rng.random(len(words))
        w = dict(zip(words.tolist(), weight))
        scores = []
        for i, (t, n) in enumerate(counted):
            k = search.K1 * (1 - search.B + search.B * n.sum() / 60.0)
            s = sum(w[x] * c * (search.K1 + 1) / (c + k) for x, c in zip(t.tolist(), n.tolist()) if x in w)
            if s:
                scores.append((-round(s, 9), i))
        for k in (1, 10, 200):
            got = shard.best(words, weight, k)
            assert [i for i, _ in got] == [i for _, i in sorted(scores)[:k]]
    # Most blocks are skipped for a rare word.
    read = []
    plain = shard._score
    shard._score = lambda runs, w: read.extend(shard.run_block[runs].tolist()) or plain(runs, w)
    shard.best(np.array([1, 400], np.uint64), np.array([0.01, 9.0]), 1)
    assert len(set(read)) < shard.blocks


# op6


def test_packing(spark, sf):
    table = docs(spark, HARD).unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True)
    cut = packing.pieces(table, with_ids=True)
    whole = {}
    for r in cut.collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        whole.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
    encode = tokens.encoder()
    for r in table.where("doc_id > 6").collect():
        got = sorted(whole[r.doc_id])
        assert sum((x[2] for x in got), []) == encode(r.text) + [2]
    rows = packing.packed(packing.pieces(table)).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert len(rows) == cut.count()
    lengths = np.array([r.length for r in rows])
    assert packing.lower_bound(lengths, 1024) <= len(bins) <= packing.lower_bound(lengths, 1024) + 3
    assert packing.packed(packing.pieces(docs(spark, []))).count() == 0


def test_packing_of_documents(spark, sf):
    """The query against the tokenizer itself: ids, cuts, places, and as few sequences as the sum of tokens allows."""
    from tokenizers import Tokenizer

    t, want = Tokenizer.from_file(tokens.TOKENIZER), {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[a : first if k == 0 else a + 1024]
            want[(r.doc_id, k)] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = packing.op6_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = [0]
        for o, n in sorted(b):
            assert o == ends[-1]
            ends.append(o + n)
        assert ends[-1] <= 1024
    assert len(bins) <= 1.01 * sum(r.length for r in rows) / 1024 + 1


def test_packing_in_many_partitions(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), 0, 0, int(n), int(i)) for i, n in enumerate(rng.integers(1, 1025, 3000))]
    got = packing.packed(spark.createDataFrame(rows, packing.PIECES), per_part=300).toPandas()
    fill = got.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 1024 and len(got) == 3000
    bound = packing.lower_bound(np.array([r[3] for r in rows]), 1024)
    assert len(fill) <= bound * 1.02


def test_lower_bound_is_one():
    rng = np.random.default_rng(9)
    for _ in range(50):
        n = rng.integers(1, 60, 40)
        assert packing.lower_bound(n, 60) <= packing.best_fit(np.sort(n)[::-1], 60)[1]
    assert packing.lower_bound(np.array([31] * 7), 60) == 7


# op7


def test_mixing(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.op7_mixing(spark, sf).toPandas()
    again = mixing.op7_mixing(spark, sf).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()
    rows = {r.doc_id: (r.source, len(re.findall(WORD, r.text or ""))) for r in table.collect()}
    size = {}
    for s, n in rows.values():
        size[s] = size.get(s, 0) + n
    names = sorted(size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(size.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > 2 * size[s]}
        if not over:
            target |= {s: weight[s] * unit for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    taken = {}
    for r in got.itertuples():
        s, n = rows[r.doc_id]
        assert r.size == n and r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 * (1 + target[s]) and r.taken <= 2 * n
        taken[s] = taken.get(s, 0) + r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= max(n for x, n in rows.values() if x == s) / 2 + 1e-6


def test_mixing_of_hard_rows(spark):
    out = mixing.mixed(docs(spark, HARD))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert all((r.text or "").strip() for r in out.collect())
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert n.get(5, 0) <= 2 and n.get(4, 0) <= 4
    assert mixing.mixed(docs(spark, [])).count() == 0
    clash = spark.createDataFrame([(k, "a b c", "s", k * 10, "t", -k) for k in range(40)], "doc_id long, text string, source string, _size int, _t string, _COPIES int")
    got = mixing.mixed(clash, share=1.0).collect()
    assert len(got) == 40 and all((r._size, r._t, r._COPIES) == (r.doc_id * 10, "t", -r.doc_id) for r in got)


# op8


def test_quality(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in quality.op8_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    test = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert sum(a == b for a, b in test) / len(test) > 0.95


def test_quality_of_hard_rows(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (6, None), (77, 1)], "doc_id long, quality int")
    out = quality.scored(docs(spark, HARD), labels).collect()
    assert len(out) == len(HARD) and all(0 <= r.score <= 1 for r in out)
    none = quality.scored(docs(spark, HARD), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    clash = docs(spark, HARD).withColumn("score", F.lit("mine")).withColumn("Predicted", F.lit(7))
    assert {r.score for r in quality.scored(clash, labels.limit(0)).collect()} == {0.5}
    long = spark.createDataFrame([(1, "word " * 400_000), (2, "x" * 1_500_000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality.scored(long, labels).collect())


def test_pairwise_fit_is_the_plain_one():
    """Loss, pairs and threshold against gradient descent over the differences of all pairs."""
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.4, 1, (60, 5)), rng.normal(-0.4, 1, (40, 5))
    good[:, 4] = bad[:, 4] = 1
    model = quality.fit_pairs(good, bad, 0.4, max_pairs=10**9, l2=1e-2)
    d = (good[:, None] - bad[None]).reshape(-1, 5)
    # As many pairs as there are, each document as often as the others of its class.
    loss = lambda w, x: np.log1p(np.exp(-x @ w)).mean() + 1e-2 * w @ w
    rng = np.random.default_rng(11)
    n = 2400
    i = np.concatenate([rng.permutation(60) for _ in range(40)])[:n]
    j = np.concatenate([rng.permutation(40) for _ in range(60)])[:n]
    x, w = good[i] - bad[j], np.zeros(5)
    for _ in range(4000):
        w -= 0.5 * (2e-2 * w - x.T @ (1 / (1 + np.exp(x @ w))) / n)
    assert np.abs(model.weights - w).max() < 1e-3 and loss(model.weights, d) < loss(np.zeros(5), d)
    s = np.concatenate([good @ model.weights, bad @ model.weights])
    mass = np.concatenate([np.full(60, 0.6 / 60), np.full(40, 0.4 / 40)])
    assert abs(mass[s < model.threshold].sum() - 0.4) <= 0.01 + 1e-9


# op9


def test_chat_hard_texts(spark):
    nasty = ["<|end|>\n", "\\<|turn|>", "<\\|text|>", "\\\\", "", None, "{{ x }}", "a<|text|>b"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(nasty)] + [(None, 0, None, "x"), (None, 1, "user", "w"), (2, None, "assistant", "z"), (2, 1, "assistant", "y")]
    done = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = {r.conv_id: chat.unframed(r.formatted) for r in done.collect()}
    assert turns[1] == [(("user", "assistant")[k % 2], t or "") for k, t in enumerate(nasty)]
    assert sorted(chat.unframed(r.formatted) for r in done.collect() if r.conv_id is None) == [[("", "x")], [("user", "w")]] and turns[2] == [("assistant", "z"), ("assistant", "y")]
    d = {r.conv_id: r for r in chat.digests(done).collect()}
    said = "".join(t or "" for k, t in enumerate(nasty) if k % 2)
    assert d[1].loss_chars == len(said) and d[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_template_language():
    render = chat.compile_template("{% if a == 'x' %}1{% elif b and not c %}2{% else %}3{% endif %}{{ 'A' + 'b' | upper }}{% for i in xs %}[{% generation %}{{ i.t | trim }}{% endgeneration %}]{% endfor %}")
    assert render({"a": "x", "xs": []}) == ("1AB", [])
    assert render({"b": "y", "xs": [{"t": " q "}]}) == ("2AB[q]", [(4, 5)])
    assert render({}) == ("3AB", [])
    tree = chat.fold(chat.parse("{{ 'a' + 'b' }}c{% if 'x' == 'x' %}d{% else %}e{% endif %}"))
    assert tree.parts == (chat.Node("put", parts=(chat.Node("text", "abcd"),)),)
    assert chat.compile_template("{{ x.__class__ }}{{ x.y }}")({"x": "s"})[0] == ""
    for bad in ("{% if a %}", "{{ a | nope }}", "{{ f(x) }}", "{{ a[0] }}", "{% while a %}{% endwhile %}", "{% for x of y %}{% endfor %}", "{{ 'a }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


# op10


def luhn(x):
    return sum((v * 2 - 9 if v > 4 else v * 2) if k % 2 else v for k, v in enumerate(map(int, reversed(x)))) % 10 == 0


def base_spans(text):
    plain = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for k, (kind, p) in enumerate(plain):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [(kind, a, z) for a, _, kind, z in sorted(out)]


NASTY = [
    None, "", "a@b.c_d@e.f x@y", "a@b.c@d.e", "..@-.-.-", "é a@b.co é 1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.255", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 4111  1111 1111 1111",
    "+1 (555) 010-9999. +33 1 23 45 67 89) +1 +12 345 ++1 555 010 9999", "0" * 19 + " " + "1" * 25, "1.1.1.1 4 4 4 4 4 4 4 4 4 4 4 4 4 4 4", "9" * 9000 + "@x.y", "x" * 9000, "1 " * 4000, "IBAN DE89370400440532013000 and GB82 WEST 1234 5698 7654 32",
    "DE00370400440532013000", "ssn 123-45-6789 or 123-45-6789", "a.b%c+d-e@f-g.h-i.j.", "+" + "1" * 4000, "000001.0002.3.4", "+1-(555)-0109999-",
]


def test_pii(spark):
    table = docs(spark, [(k, t, "a") for k, t in enumerate(NASTY)]).withColumn("_m_email", F.lit("mine")).withColumn("_S_ip", F.lit(3))
    rows = pii.find_spans(table).collect()
    assert {(r._m_email, r._S_ip) for r in rows} == {("mine", 3)}
    found = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in rows}
    for k, t in enumerate(NASTY):
        assert [x for x in found[k] if x[0] in pii.BASE] == base_spans(t or ""), (k, t and t[:80])
    assert [x[0] for x in found[13] if x[0] not in pii.BASE] == ["iban", "iban"] and not [x for x in found[14] if x[0] == "iban"]
    assert [x for x in found[15] if x[0] == "ssn"]
    redacted = pii.redact(table).collect()
    assert {r.spans for r in redacted} == {"y"}
    clean = {r.doc_id: r.text for r in redacted}
    assert clean[2] == "[email][email] x@y" and clean[0] is None and clean[11] == NASTY[11]
    assert pii.find_spans(docs(spark, [])).count() == 0


def test_context_and_proofs_of_spans(spark):
    """(text, kind, score): what proves a span and what stands before it."""
    cases = [
        ("write to a@b.co", "email", 0.9), ("contact: a@b.co", "email", 1.0), ("1.2.3.4", "ip", 0.6), ("host 1.2.3.4", "ip", 1.0), ("4111111111111111", "card", 0.8), ("visa 4111111111111111", "card", 1.0),
        ("+1 555 010 9999", "phone", 0.7), ("call +1 555 010 9999", "phone", 1.0), ("DE89370400440532013000", "iban", 0.8), ("iban DE89370400440532013000", "iban", 1.0), ("DE00370400440532013000", "iban", None),
        ("123-45-6789", "ssn", None), ("ssn 123-45-6789", "ssn", 0.8), ("number 12345678", "id", None), ("passport 12345678", "id", 0.5),
    ]
    table = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "doc_id long, text string")
    found = {r.doc_id: {x.kind: round(x.score, 6) for x in r.spans} for r in pii.find_spans(table).collect()}
    assert [found[k].get(kind) for k, (_, kind, _) in enumerate(cases)] == [s for _, _, s in cases]
    assert not pii.find_spans(table.where("doc_id = 14"), threshold=0.6).first().spans


def test_offsets_of_very_many_spans(spark):
    text = " é a@b.co 1.2.3.4" * 3000
    r = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(x.kind, x.start, x.end) for x in r.spans] == base_spans(text)


def test_pii_of_documents(spark, sf):
    got = {r.doc_id: r for r in pii.op10_pii(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = base_spans(r.text or "")
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in want).encode()).hexdigest()
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(x[0] == k for x in want) for k in pii.BASE]
