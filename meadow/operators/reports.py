"""Facts behind a generated report, and checks that its text agrees with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"-?\d+\.?\d*%?"
SPECIES = ("honeybee", "bee", "fly", "beetle", "bug", "butterfly")
#: What a model is asked for; {facts} is filled in.
PROMPT = "Write a short pollination report. Use only numbers from these facts.\n{facts}"


def numbers_in(text: Column) -> Column:
    """Numbers of a text, percent signs dropped."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.array_compact(F.transform(found, lambda x: F.rtrim(x, F.lit("%")).try_cast("double")))


def fact_numbers(values: Column, texts: Column, counts: Column | None = None) -> Column:
    """values (array of double) and the numbers inside texts (array of string), and each share in [0, 1] also as percent.

    counts (array of double) are facts that are no shares, whatever their size."""
    inside = F.flatten(F.transform(texts, numbers_in))
    all_ = F.concat(F.array_compact(values), inside)
    more = [] if counts is None else [F.array_compact(counts)]
    return F.array_distinct(F.concat(*more, all_, F.transform(F.filter(all_, lambda x: x.between(0, 1)), lambda x: x * 100)))


def identifier_numbers(name: Column) -> Column:
    """Digits of an identifier; they are no facts and no claims."""
    return F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("double"))


def checked(reports: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """reports(text, facts array<double>, ids array<double>) with flagged (sorted numbers without a fact) and passed."""
    stated = F.array_except(numbers_in(F.col("text")), F.coalesce("ids", F.array().cast("array<double>")))
    loose = F.filter(stated, lambda n: ~F.exists("facts", lambda f: F.abs(n - f) <= tolerance))
    return reports.withColumn("flagged", F.array_sort(loose)).withColumn("passed", F.size("flagged") == 0)


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def species_warnings(reports: DataFrame, key: str, species: tuple[str, ...] = SPECIES) -> DataFrame:
    """key, sentence, species: a sentence names a species (as a word) that the facts (`present`) don't have.

    The species are a fixed short list, so each sentence is tested against an array, not joined."""
    said = reports.select(key, "present", F.explode(sentences(F.col("text"))).alias("sentence"))
    named = F.filter(F.array(*[F.lit(s) for s in species]), lambda s: F.rlike(F.lower("sentence"), F.concat(F.lit(r"\b"), s, F.lit(r"s?\b"))))
    return said.select(key, "sentence", F.explode(F.array_except(named, "present")).alias("species"))


def rolled_up(flowers: DataFrame, by: str) -> DataFrame:
    """Per report: flowers, active ones, visits, per-species totals as a map, mean and top score.

    flowers(by, flower_id, score, visits map<string, bigint>)."""
    one = flowers.groupBy(by).agg(F.count("*").alias("flowers"), F.count_if(F.aggregate(F.map_values("visits"), F.lit(0).cast("long"), lambda a, x: a + x) > 0).alias("active"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))
    per = flowers.select(by, F.explode("visits").alias("species", "n")).groupBy(by, "species").agg(F.sum("n").alias("n"))
    totals = per.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("species", "n")))).alias("species_totals"), F.sum("n").alias("visits"))
    return one.join(totals, by, "left").withColumn("visits", F.coalesce("visits", F.lit(0)))


def dominant(totals: Column) -> Column:
    """All species with the greatest total, in order; none if that is 0."""
    top = F.array_max(F.map_values(totals))
    return F.array_sort(F.map_keys(F.map_filter(totals, lambda k, v: (v == top) & (v > 0))))


def bounds_issues(facts: DataFrame) -> DataFrame:
    """facts with issues: what can't be, one message each."""
    rules = [
        (F.col("flowers") < 0, "negative flower count"),
        (F.col("active") > F.col("flowers"), "more active flowers than flowers"),
        (F.col("visits") < 0, "negative visits"),
        (~F.col("fruit_set").between(0, 1), "fruit set outside 0 and 1"),
        (F.col("lo") > F.col("hi"), "interval upside down"),
        (~F.col("fruit_set").between(F.col("lo"), F.col("hi")), "fruit set outside its interval"),
    ]
    return facts.withColumn("issues", F.array_compact(F.array(*[F.when(c, m) for c, m in rules])))


def schema_issues(facts: DataFrame, species: tuple[str, ...] = SPECIES) -> DataFrame:
    """facts with broken: names of the fields that break a rule; rows with any belong in quarantine."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    rules = {
        "flowers": finite("flowers") & (F.col("flowers") >= 0),
        "visits": finite("visits") & (F.col("visits") >= 0),
        "fruit_set": finite("fruit_set") & F.col("fruit_set").between(0, 1),
        "video": F.length(F.trim(F.coalesce("video", F.lit("")))) > 0,
        "species": F.coalesce(F.forall(F.map_keys("species_totals"), lambda s: s.isin(*species)), F.lit(False)),
        "total": F.coalesce(F.aggregate(F.map_values("species_totals"), F.lit(0).cast("long"), lambda a, x: a + x) == F.col("visits"), F.lit(False)),
    }
    return facts.withColumn("broken", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])))


def prompts(facts: DataFrame, template: str = PROMPT) -> DataFrame:
    """facts with prompt: the template with the row as JSON."""
    before, after = template.split("{facts}")
    return facts.withColumn("prompt", F.concat(F.lit(before), F.to_json(F.struct(*facts.columns)), F.lit(after)))


def titles(messages: DataFrame, key: str, order: str, text: str, most: int = 60) -> DataFrame:
    """key, title: the first message, cut to `most` characters."""
    first = messages.groupBy(key).agg(F.min_by(text, order).alias("t"))
    return first.select(key, F.when(F.length("t") > most, F.concat(F.substring("t", 1, most), F.lit("…"))).otherwise(F.col("t")).alias("title"))


def context_line(summary: DataFrame) -> DataFrame:
    """One line about all flowers, to ground a chat."""
    a = summary.agg(F.count("*").alias("f"), F.coalesce(F.sum("n_real_landings"), F.lit(0)).alias("r"), F.coalesce(F.sum("n_honeybee"), F.lit(0)).alias("h"), F.coalesce(F.round(F.sum("pollination_score"), 1), F.lit(0.0)).alias("s"))
    return a.select(F.format_string("%d flowers, %d real landings, %d by honeybees, score %.1f", "f", "r", "h", "s").alias("line"))
