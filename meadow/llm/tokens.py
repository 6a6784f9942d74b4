"""Token ids of whole texts by a public byte-level BPE vocabulary, and delta-maintained token totals.

Rollups are kept as a log of signed deltas. A change is +1 (a document arrives), -1 (it goes) or a revision (the old
count goes, the new one arrives). `commit` sums the changes of a batch by source, language and tokenizer version, writes
them to a folder of its own and then renames this to the batch's name, which one writer only can do. A batch that is
there already is left alone, so a commit can be repeated after a failure or sent twice. `totals` adds the deltas up;
`compact` folds all batches into the first one of another log, which keeps the names of those it holds and refuses them.

Null sources and languages are groups of their own; null texts count 0 tokens. Repeated rows count each. Groups whose
documents have all gone disappear from the totals; an empty log has none. Only the named columns are read.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
import public_tokenizers
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from meadow.functions.shared import shared_dir, staged
from meadow.llm.common import n_words, read, small_batches

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SPECIAL = "<|endoftext|>"


def encoder(ranks: str = RANKS, tokenizer: str | None = TOKENIZER, pattern: str = PATTERN) -> Callable[[str], list[int]]:
    """encode(text): the ids that `tokenizer` gives, add_special_tokens=False.

    The ranks hold the same merges and are read by a faster library. Where a text has no two white space signs in a row,
    the look-ahead of the pattern can't matter and is left out, which is faster again. A text with the special token's
    string goes to the tokenizer itself; without one (None) the string is ordinary text.
    """
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"\s+(?!\S)|", ""), mergeable_ranks=table, special_tokens={})
    gaps, exact = re.compile(r"\s\s"), None

    def encode(text: str) -> list[int]:
        nonlocal exact
        if tokenizer and SPECIAL in text:
            if exact is None:
                from tokenizers import Tokenizer

                exact = Tokenizer.from_file(tokenizer)
            return exact.encode(text, add_special_tokens=False).ids
        return (full if gaps.search(text) else plain).encode_ordinary(text)

    return encode


def n_tokens(text: Column, ranks: str = RANKS, tokenizer: str | None = TOKENIZER) -> Column:
    """Token count of a text column; 0 for null."""

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(ranks, tokenizer)
        for b in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in b], dtype="int64")

    return count(text)


DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
KEY = ("source", "lang", "tokenizer")


class TokenTotals:
    """Additive totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    @staticmethod
    def _folder(batch: str) -> str:
        return f"batch={quote(batch, safe='')}"

    def folded(self) -> list[str]:
        """Batches that a compaction put into this log."""
        if not self._there("folded"):
            return []
        return [r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.at}/folded").collect()]

    def batches(self) -> list[str]:
        """Names of all batches that were committed, folded ones included."""
        path, fs = self._path("")
        found = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted({unquote(n.removeprefix("batch=")) for n in found if n.startswith("batch=")} | set(self.folded()))

    def committed(self, batch: str) -> bool:
        return self._there(self._folder(batch)) or batch in self.folded()

    def _publish(self, rows: DataFrame, name: str) -> bool:
        """rows as the folder `name`, all at once; False if another writer was first."""
        attempt, fs = self._path(f"attempt-{uuid.uuid4().hex}")
        rows.write.parquet(attempt.toString())
        target, _ = self._path(name)
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_overwrite = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(attempt, target, no_overwrite)
        except Py4JJavaError as e:
            if not self._there(name):
                raise e
            fs.delete(attempt, True)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """changes(source, lang, tokenizer, sign, n_tokens); False if the batch was there already."""
        if self.committed(batch):
            return False
        signed = F.col("sign") * F.col("n_tokens")
        sums = changes.groupBy(*KEY).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(signed).cast("long").alias("n_tokens"))
        return self._publish(sums.where("n_docs <> 0 OR n_tokens <> 0"), self._folder(batch))

    def deltas(self, only: list[str] | None = None) -> DataFrame:
        """Changes of all batches that have a folder, or of those named in `only`."""
        path, fs = self._path("")
        there = {f.getPath().getName() for f in fs.listStatus(path)} if fs.exists(path) else set()
        names = sorted(n for n in there if n.startswith("batch=") and (only is None or unquote(n.removeprefix("batch=")) in only))
        if not names:
            return self.spark.createDataFrame([], DELTAS)
        return self.spark.read.schema(DELTAS).parquet(*[f"{self.at}/{n}" for n in names])

    def totals(self, only: list[str] | None = None) -> DataFrame:
        sums = self.deltas(only).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, into: "TokenTotals", batch: str) -> None:
        """The totals so far as the first batch of another log, which is to be used once this has returned.

        The names go first, once and for all, and the totals are those of exactly the batches named there. So a compaction
        that breaks off can be repeated, two can run at once, and a batch that arrives meanwhile isn't folded: the new log
        doesn't know it and takes it when it is committed there.
        """
        names = [(b,) for b in self.batches()]
        into._publish(self.spark.createDataFrame(names, "batch string"), "folded")
        into._publish(self.totals(into.folded()), self._folder(batch))


def inserts(counted: DataFrame) -> DataFrame:
    return counted.withColumn("sign", F.lit(1))


def deletes(counted: DataFrame) -> DataFrame:
    return counted.withColumn("sign", F.lit(-1))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts that replace others: the old ones go, the new ones arrive."""
    cols = [*KEY, "sign", "n_tokens"]
    return deletes(before).select(*cols).unionByName(inserts(after).select(*cols))


def counted(docs: DataFrame, version: str, *more: Column, ranks: str = RANKS, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """docs(doc_id, text, source, lang) as doc_id, source, lang, tokenizer, n_tokens and `more` columns."""
    small_batches(docs.sparkSession)
    group = lambda c: F.col(c).cast("string").alias(c)
    return docs.select("doc_id", group("source"), group("lang"), F.lit(version).alias("tokenizer"), n_tokens(F.col("text"), ranks, tokenizer).alias("n_tokens"), *more)


def op4_tokens(spark, sf_dir: str) -> DataFrame:
    """Totals after a history of batches.

    Every document arrives with its words as first count, and this batch is sent twice; the tokenizer's counts replace
    these; documents that labels mark as toxic go and, after review, come back; documents without a token go.
    """
    log = TokenTotals(spark, f"{shared_dir(spark)}/meadow/totals-{uuid.uuid4().hex}")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    both = staged(counted(docs, "byte_bpe_50k", n_words(F.col("text")).alias("n_words")), "counts")
    words, ids = both.withColumn("tokenizer", F.lit("words")).withColumn("n_tokens", F.col("n_words")), both.drop("n_words")
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    marked = ids.join(toxic, "doc_id", "left_semi")
    for batch, changes in (("load", inserts(words)), ("load", inserts(words)), ("recount", revisions(words, ids)), ("review", deletes(marked)), ("reviewed", inserts(marked)), ("empty", deletes(ids.where("n_tokens = 0")))):
        log.commit(batch, changes)
    return log.totals()
