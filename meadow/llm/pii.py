"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust a score.

Everything is built of DataFrame functions. A pattern's matches come from regexp_extract_all and the text between them
from split, so the offset of a match is the length of what stands before it (code points, end exclusive). Only texts
with a match pay for the offsets.

Kinds and their proof: email; ip (parts at most 255); card (14 to 19 digits, Luhn); phone (10 to 15 digits); these four
are reported whatever their score. iban (mod-97), ssn and id (national numbers) are added when their score, raised by
context words before the span, reaches `threshold`.

Null texts count as empty; a text without spans has empty arrays. Rows that repeat are reported each. Only the text
column is read; a column named as `into` gives way to the spans, and helper columns get names that clash with none. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meadow.llm.common import fresh, read

# The patterns find what the plain ones do, from left to right. Possessive quantifiers and the look-behinds keep long
# runs of one class linear: a match can only begin where a run begins, or where the last match ended (\G).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "id": r"(?<![A-Za-z0-9.+-])[0-9]{8,12}(?![A-Za-z0-9.-])",
}
BASE = ("email", "ip", "card", "phone")
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "phone": "+"}
#: Score of a confirmed span without context, and words that raise it when they stand close before it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "id": 0.1}
CONTEXT = {
    "email": r"\b(e-?mail|mail|contact)\b",
    "ip": r"\b(ip|host|server|address)\b",
    "card": r"\b(card|visa|credit|carte|karte|tarjeta)\b",
    "phone": r"\b(phone|tel|call|mobile|fax)\b",
    "iban": r"\b(iban|account|konto|compte|cuenta)\b",
    "ssn": r"\b(ssn|social security)\b",
    "id": r"\b(passport|ssn|national id|id number|licen[cs]e no)\b",
}
RAISE = 0.4


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Remainder of an IBAN, its first four signs moved to the end and letters read as 10 to 35."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v < 58, F.pmod(acc * 10 + v - 48, F.lit(97))).otherwise(F.pmod(acc * 100 + v - 55, F.lit(97)))

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", F.substr(_digits(m), F.lit(1), F.lit(19)))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return _mod97(m) == 1
    return F.lit(True)


def _matches(kind: str, text: Column) -> Column:
    """The matches of one kind, null where there are none."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    look = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(PATTERNS[kind])
    return F.when(look, found)


#: Matches whose offsets are summed in one go; texts with more of a kind are looked up by blocks of so many characters.
STRIDE, BLOCK = 256, 512


def _starts(kind: str, text: Column, m: Column) -> Column:
    """Where each match begins: what stands before it are the gaps and matches before it.

    The sums run over STRIDE matches at a time, so that a text with very many of them copies short arrays only.
    """
    gaps = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(m))
    lengths = F.zip_with(gaps, m, lambda g, x: F.struct(F.length(g).alias("gap"), F.length(x).alias("own")))
    none = F.array().cast("array<long>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        return F.struct((s + x["own"]).alias("at"), F.array_append(acc["starts"], s).alias("starts"))

    def stride(acc: Column, k: Column) -> Column:
        part = F.aggregate(F.slice(lengths, k * STRIDE + 1, F.lit(STRIDE)), F.struct(acc["at"].alias("at"), none.alias("starts")), step)
        return F.struct(part["at"].alias("at"), F.array_append(acc["parts"], part["starts"]).alias("parts"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<long>>").alias("parts"))
    several = F.flatten(F.aggregate(F.sequence(F.lit(0), F.ceil(F.size(m) / STRIDE).cast("int") - 1), begin, stride)["parts"])
    few = F.aggregate(lengths, F.struct(F.lit(0).cast("long").alias("at"), none.alias("starts")), step)["starts"]
    return F.when(F.size(m) > STRIDE, several).when(F.size(m) > 0, few)


def _before(text: Column, blocks: Column, start: Column, chars: int = 40) -> Column:
    """The characters before a place. A substring is found by walking to it, in a text with many matches only from the
    beginning of its block."""
    size, at = F.least(start, F.lit(chars)).cast("int"), F.greatest(start - chars, F.lit(0))
    block, off = F.floor(at / BLOCK).cast("int"), F.pmod(at, F.lit(BLOCK))
    near = F.concat(F.get(blocks, block), F.coalesce(F.get(blocks, block + 1), F.lit("")))
    return F.when(blocks.isNull(), F.substr(text, (at + 1).cast("int"), size)).otherwise(F.substr(near, (off + 1).cast("int"), size))


def _scored(kind: str, text: Column, m: Column, starts: Column, blocks: Column, threshold: float) -> Column:
    """Array of (start, rank, kind, end, score) of the matches that are confirmed."""
    none = F.array().cast("array<struct<start:long,rank:int,kind:string,end:long,score:double>>")
    rank = list(PATTERNS).index(kind)
    pairs = F.filter(F.zip_with(m, starts, lambda x, s: F.struct(x.alias("m"), s.alias("s"))), lambda x: _confirmed(kind, x["m"]))

    def score(x: Column) -> Column:
        before = F.lower(_before(text, blocks, x["s"]))
        sure = F.least(F.lit(SCORES[kind]) + F.when(before.rlike(CONTEXT[kind]), RAISE).otherwise(0.0), F.lit(1.0))
        return F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["s"] + F.length(x["m"])).alias("end"), sure.alias("score"))

    spans = F.transform(pairs, score)
    if kind not in BASE:
        spans = F.filter(spans, lambda x: x["score"] >= threshold)
    return F.when(F.size(m) > 0, spans).otherwise(none)


def find_spans(docs: DataFrame, text: str = "text", threshold: float = 0.5, into: str = "spans") -> DataFrame:
    """docs with an array column of (start, rank, kind, end, score), by start and then kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # One step after the other, so that no pattern runs twice over a text.
    m = dict(zip(PATTERNS, fresh([*docs.columns, into], *[f"m_{k}" for k in PATTERNS])))
    s = dict(zip(PATTERNS, fresh([*docs.columns, into], *[f"s_{k}" for k in PATTERNS])))
    found = docs.withColumns({m[k]: _matches(k, whole) for k in PATTERNS})
    placed = found.withColumns({s[k]: _starts(k, whole, F.col(m[k])) for k in PATTERNS})
    blocks, = fresh([*placed.columns, into], "blocks")
    many = F.greatest(*[F.coalesce(F.size(m[k]), F.lit(0)) for k in PATTERNS]) > STRIDE
    placed = placed.withColumn(blocks, F.when(many, F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    kinds = [_scored(k, whole, F.col(m[k]), F.col(s[k]), F.col(blocks), threshold) for k in PATTERNS]
    return placed.withColumn(into, F.array_sort(F.concat(*kinds))).drop(*m.values(), *s.values(), blocks)


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; spans inside an earlier one vanish with it."""
    spans, = fresh(docs.columns, "spans")
    found = find_spans(docs, text, threshold, spans)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    whole = F.coalesce(F.col(text), F.lit(""))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(whole, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        new = F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), x["kind"], F.lit("]")).alias("out"))
        return F.when(x["start"] < acc["at"], acc).otherwise(new)

    end = F.aggregate(F.col(spans), start, step)
    clean = F.when(F.size(spans) == 0, F.col(text)).otherwise(F.concat(end["out"], F.substr(whole, (end["at"] + 1).cast("int"), F.length(whole))))
    return found.withColumn(text, clean).drop(spans)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def op10_pii(spark, sf_dir: str) -> DataFrame:
    found = find_spans(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
