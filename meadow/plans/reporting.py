"""Queries over report texts, conversations and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from meadow.functions.rounding import half_up, half_up_scaled
from meadow.operators import reports as r
from meadow.plans import bindings as b
from meadow.plans.landing import SUMMARY, a1_u2_flower_summary

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


NUM = r"regexp_extract_all(text, '-?\d+\.?\d*%?')"


@query(rf"SELECT doc_id, len({NUM})::INT AS n, round(coalesce(list_sum([try_cast(rtrim(x, '%') AS DOUBLE) FOR x IN {NUM}]), 0) / 1e6, 4) AS total FROM documents")
def f1_numbers(spark, d):
    t = b.table(spark, d, "documents").select("doc_id", "text", r.numbers_in(F.col("text")).alias("x"))
    return t.select("doc_id", F.when(F.col("text").isNotNull(), F.size("x")).alias("n"), half_up_scaled(F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / 1e6, 4).alias("total"))


F4 = rf"""WITH n AS (SELECT doc_id, list_distinct([try_cast(rtrim(x, '%') AS DOUBLE) FOR x IN {NUM}]) AS said, [n_chars::DOUBLE, (doc_id % 100)::DOUBLE, 0.5, 50.0] AS facts, [doc_id::DOUBLE] AS ids FROM documents),
f AS (SELECT doc_id, [x FOR x IN said IF x IS NOT NULL AND NOT list_contains(ids, x) AND len([y FOR y IN facts IF abs(y - x) <= 0.01]) = 0] AS flagged FROM n)
SELECT doc_id, len(flagged)::INT AS flagged, round(coalesce(list_max(flagged), 0) / 1e6, 4) AS top, len(flagged) = 0 AS passed FROM f"""


@query(F4)
def f2_f3_f4_j20_checked(spark, d):
    t = b.table(spark, d, "documents")
    counts = F.array(F.col("n_chars").cast("double"), (F.col("doc_id") % 100).cast("double"))
    facts = r.fact_numbers(F.array(F.lit(0.5)), F.array().cast("array<string>"), counts)
    rows = t.select("doc_id", "text", facts.alias("facts"), r.identifier_numbers(F.col("doc_id").cast("string")).alias("ids"))
    out = r.checked(rows)
    there = F.col("text").isNotNull()
    return out.select("doc_id", F.when(there, F.size("flagged")).alias("flagged"), half_up_scaled(F.coalesce(F.array_max("flagged"), F.lit(0.0)) / 1e6, 4).alias("top"), F.when(there, F.col("passed")).alias("passed"))


SAID = """WITH t AS (SELECT conv_id, coalesce(text || ' ', '') || 'A ' || ['""" + "', '".join(r.SPECIES) + """'][(turn % 6 + 1)::INT] || ' came.' AS text FROM conversations),
s AS (SELECT conv_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM t),
w AS (SELECT conv_id, unnest([x FOR x IN ['""" + "', '".join(r.SPECIES) + """'] IF x NOT IN ('bee', 'fly') AND regexp_matches(lower(sentence), '\\b' || x || 's?\\b')]) AS species FROM s)
"""


@query(SAID + "SELECT conv_id, species, count(*)::BIGINT AS n FROM w GROUP BY 1, 2")
def f5_f9_j21_species_warnings(spark, d):
    t = b.table(spark, d, "conversations").select("conv_id", F.concat_ws(" ", F.col("text"), F.element_at(F.array(*[F.lit(f"A {s} came.") for s in r.SPECIES]), (F.col("turn") % 6 + 1).cast("int"))).alias("text"), F.array(F.lit("bee"), F.lit("fly")).alias("present"))
    return r.species_warnings(t, "conv_id").groupBy("conv_id", "species").agg(F.count("*").alias("n"))


ROLL = """WITH f AS (SELECT l_suppkey % 7 AS video, l_partkey AS flower_id, sum(l_extendedprice) AS score, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS bee, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS fly FROM lineitem GROUP BY 1, 2),
u AS (SELECT video, count(*)::BIGINT AS flowers, (count(*) FILTER (bee + fly > 0))::BIGINT AS active, avg(score) AS mean_score, max(score) AS max_score, sum(bee)::BIGINT AS bee, sum(fly)::BIGINT AS fly FROM f GROUP BY 1)
"""


def _facts(spark, d):
    li = b.table(spark, d, "lineitem")
    f = li.groupBy((F.col("l_suppkey") % 7).alias("video"), F.col("l_partkey").alias("flower_id")).agg(F.sum("l_extendedprice").alias("score"), F.count_if(F.col("l_returnflag") == "R").alias("bee"), F.count_if(F.col("l_returnflag") == "A").alias("fly"))
    return r.rolled_up(f.select("video", "flower_id", "score", F.create_map(F.lit("bee"), "bee", F.lit("fly"), "fly").alias("visits")), "video")


@query(ROLL + "SELECT video, flowers, active, round(mean_score, 4) AS mean_score, round(max_score, 4) AS max_score, bee, fly, bee + fly AS visits, CASE WHEN bee > fly THEN 'bee' WHEN fly > bee THEN 'fly' WHEN bee > 0 THEN 'bee,fly' ELSE '' END AS dominant FROM u")
def a6_a7_rolled_up(spark, d):
    t = _facts(spark, d)
    return t.select("video", "flowers", "active", F.round("mean_score", 4).alias("mean_score"), F.round("max_score", 4).alias("max_score"), F.col("species_totals")["bee"].alias("bee"), F.col("species_totals")["fly"].alias("fly"), "visits", F.array_join(r.dominant(F.col("species_totals")), ",").alias("dominant"))


@query(ROLL + ", b AS (SELECT *, video / 4.0 AS fs FROM u) SELECT video, CASE WHEN fs NOT BETWEEN 0 AND 1 THEN 1 ELSE 0 END + CASE WHEN fs NOT BETWEEN 0.2 AND 0.9 THEN 1 ELSE 0 END AS issues, CASE WHEN fs NOT BETWEEN 0 AND 1 THEN 1 ELSE 0 END AS broken FROM b")
def f6_f7_issues(spark, d):
    t = _facts(spark, d).select("*", (F.col("video") / 4.0).alias("fruit_set"), F.lit(0.2).alias("lo"), F.lit(0.9).alias("hi")).withColumn("video", F.col("video").cast("string"))
    out = r.schema_issues(r.bounds_issues(t))
    return out.select(F.col("video").cast("long").alias("video"), F.size("issues").alias("issues"), F.size("broken").alias("broken"))


@query("SELECT doc_id, sha256('Write a short pollination report. Use only numbers from these facts.' || chr(10) || '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}') AS prompt FROM documents")
def f8_prompts(spark, d):
    t = r.prompts(b.table(spark, d, "documents").select("doc_id", "lang"))
    return t.select("doc_id", F.sha2("prompt", 256).alias("prompt"))


@query("SELECT conv_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS title FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations GROUP BY 1)")
def f11_titles(spark, d):
    return r.titles(b.table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT p_partkey, round(p_retailprice / 7, 2)::DOUBLE AS x FROM part")
def f12_rounding(spark, d):
    return b.table(spark, d, "part").select("p_partkey", half_up(F.col("p_retailprice") / 7, 2).alias("x"))
