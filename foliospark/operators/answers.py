"""Extractive answers with a relational form: units of evidence, then filters, joins and first places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import features, numbers
from foliospark.functions.text import significant_tokens

LEAST = 0.2


def units(hits: DataFrame) -> DataFrame:
    """Units of hits (query_id, position, text): lines, sentences and pairs of sentences, with their place."""
    parts = F.filter(F.split("text", r"\n|(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)
    single = hits.select("query_id", "position", F.posexplode(parts).alias("at", "unit"))
    w = Window.partitionBy("query_id", "position").orderBy("at")
    after = F.lead("unit").over(w)
    pairs = single.withColumn("unit", F.when(after.isNotNull(), F.concat_ws(" ", "unit", after))).filter("unit IS NOT NULL")
    return single.withColumn("pair", F.lit(False)).unionByName(pairs.withColumn("pair", F.lit(True)))


def best_units(found: DataFrame, queries: DataFrame, keep: Column | None = None, least: float = LEAST) -> DataFrame:
    """query_id, position, unit, coverage: a query's best covered unit (that ``keep`` admits), with its citation place."""
    scored = found.join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    if keep is not None:
        scored = scored.filter(keep)
    scored = scored.withColumn("coverage", F.round(features.query_coverage(F.col("question"), F.col("unit")), 6)).filter(F.col("coverage") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.length("unit"), "position", "at")
    return scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("query_id", "position", "unit", "coverage")


def date_and_time(found: DataFrame, queries: DataFrame) -> DataFrame:
    shaped = F.col("unit").rlike(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}(?:er)? \p{L}+ \d{4}") & F.col("unit").rlike(r"\b\d{1,2}\s?[:h]\s?\d{2}\b")
    return best_units(found, queries, shaped)


def percentage(found: DataFrame, queries: DataFrame) -> DataFrame:
    return best_units(found, queries, F.col("unit").rlike(r"\d+(?:[.,]\d+)?\s?%"))


def number_anchored(found: DataFrame, queries: DataFrame, least: float = 0.3) -> DataFrame:
    """For questions with just one number of two digits or more: the best unit that holds it."""
    number = F.array_distinct(F.filter(numbers.canonical_numbers(F.col("text")), lambda n: F.length(n) >= 2))
    asked = queries.withColumn("number", F.when(F.size(number) == 1, F.get(number, F.lit(0)))).filter("number IS NOT NULL")
    with_number = found.join(asked.select("query_id", "number"), "query_id")
    return best_units(with_number, asked, F.array_contains(numbers.canonical_numbers(F.col("unit")), F.col("number")), least)


def enumerations(hits: DataFrame, queries: DataFrame, least: float = 0.18) -> DataFrame:
    """query_id, position, items: the best covered hit that lists five items or more."""
    listed = hits.withColumn("items", F.expr(r"greatest(regexp_count(text, '(?m)^\\s*\\d+[.)]\\s'), regexp_count(text, '(?m)^\\s*[-*•]\\s'))")).filter("items >= 5")
    scored = listed.join(queries.select("query_id", F.col("text").alias("question")), "query_id").withColumn("c", features.query_coverage(F.col("question"), F.col("text")))
    w = Window.partitionBy("query_id").orderBy(F.desc("c"), "position")
    return scored.filter(F.col("c") >= least).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("query_id", "position", "items")


def month_thresholds(values: DataFrame, rules: DataFrame) -> DataFrame:
    """query_id, value, months, below: stated durations in months against rules ``less than N months``."""
    return values.join(rules, "query_id").select("query_id", "value", "months", (F.col("value") < F.col("months")).alias("below"))


def scenario(found: DataFrame, queries: DataFrame, share: float = 0.65) -> DataFrame:
    """query_id, position, unit, matched: units that hold two terms and ``share`` of a question's, rare terms first."""
    terms = queries.select("query_id", F.explode(F.array_distinct(significant_tokens(F.col("text"), 4))).alias("term"))
    wanted = terms.groupBy("query_id").agg(F.count("*").alias("wanted"))
    tokens = found.select("query_id", "position", "at", "unit", "pair", F.explode(F.array_distinct(significant_tokens(F.col("unit"), 4))).alias("term"))
    hits = tokens.join(terms, ["query_id", "term"])
    df = hits.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    scored = hits.join(df, ["query_id", "term"]).groupBy("query_id", "position", "at", "pair", "unit").agg(F.count("*").alias("matched"), F.sum(1 / F.col("df")).alias("rarity"))
    enough = scored.join(wanted, "query_id").filter(F.col("matched") >= F.greatest(F.lit(2), F.ceil(F.col("wanted") * share)))
    w = Window.partitionBy("query_id").orderBy(F.desc("matched"), F.length("unit"), F.desc("rarity"), "position", "at")
    return enough.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("query_id", "position", "unit", "matched")


def slots(found: DataFrame, slot_terms: DataFrame, least: float = 0.18) -> DataFrame:
    """query_id, slot, position, unit: the best unit of each slot, for queries whose slots all have one.

    slot_terms: query_id, slot, text. A unit with a colon and a number beside the slot's words is worth more.
    """
    scored = found.filter(~F.col("pair")).join(slot_terms.select("query_id", "slot", F.col("text").alias("wanted")), "query_id")
    c = features.query_coverage(F.col("wanted"), F.col("unit"))
    bonus = F.when(F.col("unit").contains(":"), 0.06).otherwise(0.0) + F.when(F.size(numbers.number_runs(F.col("unit"))) > 0, 0.06).otherwise(0.0)
    scored = scored.withColumn("c", c).filter(F.col("c") >= least).withColumn("score", F.col("c") + bonus)
    w = Window.partitionBy("query_id", "slot").orderBy(F.desc("score"), F.length("unit"), "position", "at")
    best = scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    n = slot_terms.groupBy("query_id").agg(F.countDistinct("slot").alias("n"))
    full = best.groupBy("query_id").agg(F.count("*").alias("k")).join(n, "query_id").filter("k = n").select("query_id")
    return best.join(full, "query_id", "left_semi").select("query_id", "slot", "position", "unit")


def money_anchored(hits: DataFrame, queries: DataFrame, tolerance: int = 0) -> DataFrame:
    """query_id, position, value_minor, raw: for questions with one amount, the first hit with an equal one."""
    def amounts(text):
        found = F.regexp_extract_all(text, F.lit(numbers.MONEY), F.lit(1))
        code = lambda raw: numbers.currency_code(F.regexp_extract(raw, rf"(?i)({numbers.CURRENCY})", 1))
        return F.transform(found, lambda raw: F.struct(numbers.minor_units(F.regexp_replace(raw, rf"(?i)(?:{numbers.CURRENCY})", ""), code(raw)).alias("value_minor"), raw.alias("raw")))

    asked = queries.select("query_id", amounts(F.col("text")).alias("a")).filter(F.size("a") == 1).select("query_id", F.get("a", F.lit(0))["value_minor"].alias("wanted"))
    have = hits.select("query_id", "position", F.explode(amounts(F.col("text"))).alias("m")).select("query_id", "position", "m.*")
    equal = have.join(asked, "query_id").filter(F.abs(F.col("value_minor") - F.col("wanted")) <= tolerance)
    w = Window.partitionBy("query_id").orderBy("position")
    return equal.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("query_id", "position", "value_minor", "raw")
