"""Retrieval, frame and answer metrics over result rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def retrieval_metrics(rows: DataFrame) -> DataFrame:
    """One row of means over queries. rows: query_id, expected array, retrieved array (in order), answerable boolean.

    Recall at 1 (and against its ceiling), 5 and 10, reciprocal rank and nDCG at 10 over answerable queries; the share
    of unanswerable queries that retrieve nothing.
    """
    want, got = F.col("expected"), F.col("retrieved")
    recall = lambda k: F.size(F.array_intersect(want, F.slice(got, 1, k))) / F.size(want)
    hits = F.transform(F.slice(got, 1, 10), lambda x: F.array_contains(want, x))
    first = F.array_position(hits, F.lit(True))
    gains = F.aggregate(
        F.transform(hits, lambda h, i: F.when(h, F.lit(1.0) / F.log2((i + 2).cast("double"))).otherwise(0.0)), F.lit(0.0), lambda t, x: t + x
    )
    best = [sum(1 / math.log2(i + 2) for i in range(n)) for n in range(11)]
    ideal = F.get(F.array(*[F.lit(x) for x in best]), F.least(F.size(want), F.lit(10)))
    per = rows.select(
        "answerable", recall(1).alias("r1"), (F.least(F.lit(1), F.size(want)) / F.size(want)).alias("ceiling"), recall(5).alias("r5"), recall(10).alias("r10"),
        F.when(first > 0, 1.0 / first).otherwise(0.0).alias("rr"), F.when(ideal > 0, gains / ideal).alias("ndcg"), (F.size(got) == 0).alias("silent"),
    )
    mean = lambda c: F.round(F.avg(F.when(F.col("answerable"), F.col(c))), 6)
    return per.agg(
        F.count_if("answerable").alias("queries"), mean("r1").alias("recall_1"), mean("ceiling").alias("recall_1_ceiling"),
        mean("r5").alias("recall_5"), mean("r10").alias("recall_10"), mean("rr").alias("mrr_10"), mean("ndcg").alias("ndcg_10"),
        F.round(F.avg(F.when(~F.col("answerable"), F.col("silent").cast("double"))), 6).alias("negative_precision"),
    )


def judged_metrics(queries: DataFrame, judged: DataFrame) -> DataFrame:
    """The same means as ``retrieval_metrics``, of judged results instead of arrays of expected ids.

    queries: query_id, n_expected, answerable; judged: query_id, rank, right: a row for each result. So a question with
    many right answers carries none of them along.
    """
    top = judged.filter(F.col("rank") <= 10)
    ok, rank = F.col("right"), F.col("rank")
    hits = lambda k: F.count_if(ok & (rank <= k))
    per = top.groupBy("query_id").agg(
        hits(1).alias("h1"), hits(5).alias("h5"), hits(10).alias("h10"), F.min(F.when(ok, rank)).alias("first"),
        F.coalesce(F.sum(F.when(ok, 1 / F.log2(rank + 1))), F.lit(0.0)).alias("gains"),
    )
    ideal = F.get(F.array(*[F.lit(sum(1 / math.log2(i + 2) for i in range(n))) for n in range(11)]), F.least("n_expected", F.lit(10)).cast("int"))
    every = queries.join(per, "query_id", "left").select(
        "answerable", F.col("h1").isNull().alias("silent"), *(F.coalesce(F.col(f"h{k}") / F.col("n_expected"), F.lit(0.0)).alias(f"r{k}") for k in (1, 5, 10)),
        (F.least(F.lit(1), "n_expected") / F.col("n_expected")).alias("ceiling"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(ideal > 0, F.coalesce("gains", F.lit(0.0)) / ideal).alias("ndcg"),
    )
    mean = lambda c: F.round(F.avg(F.when(F.col("answerable"), F.col(c))), 6)
    return every.agg(
        F.count_if("answerable").alias("queries"), mean("r1").alias("recall_1"), mean("ceiling").alias("recall_1_ceiling"),
        mean("r5").alias("recall_5"), mean("r10").alias("recall_10"), mean("rr").alias("mrr_10"), mean("ndcg").alias("ndcg_10"),
        F.round(F.avg(F.when(~F.col("answerable"), F.col("silent").cast("double"))), 6).alias("negative_precision"),
    )


def evidence_recall(expected: DataFrame, retrieved: DataFrame, unit: str = "document_id") -> DataFrame:
    """Over documents: cases, mean share of a case's expected units that it retrieved, and share of complete cases.

    expected, retrieved: query_id and ``unit``; a case without expected units doesn't count.
    """
    want, got = expected.select("query_id", unit).distinct(), retrieved.select("query_id", unit).distinct().withColumn("_got", F.lit(1))
    per = want.join(got, ["query_id", unit], "left").groupBy("query_id").agg((F.count("_got") / F.count("*")).alias("share"))
    return per.agg(
        F.count("*").alias("cases"), F.round(F.avg("share"), 6).alias("evidence_recall"), F.round(F.avg((F.col("share") == 1).cast("double")), 6).alias("complete"),
    )


def first_ranks(rows: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Hit at k and mean reciprocal rank over queries, of (query_id, first_rank or null)."""
    n = F.count("*")
    hit = [F.round(F.count_if(F.col("first_rank") <= k) / n, 6).alias(f"hit_{k}") for k in cuts]
    return rows.agg(n.alias("queries"), *hit, F.round(F.sum(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))) / n, 6).alias("mrr"))


def aggregate_match(expected: DataFrame, actual: DataFrame, on: list[str], value: str) -> DataFrame:
    """cases, matched and their share: rows of ``expected`` whose value ``actual`` has exactly."""
    both = expected.withColumnRenamed(value, "want").join(actual.withColumnRenamed(value, "got"), on, "left")
    return both.agg(F.count("*").alias("cases"), F.count_if(F.col("want").eqNullSafe(F.col("got"))).alias("matched")).withColumn(
        "share", F.round(F.col("matched") / F.greatest("cases", F.lit(1)), 6)
    )


def held_out(df: DataFrame, key: str, buckets: int = 5, held: int = 0) -> DataFrame:
    """Rows with a stable bucket of their key and whether it is held out."""
    bucket = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long") % buckets
    return df.withColumn("bucket", bucket.cast("int")).withColumn("held_out", F.col("bucket") == held)


def parser_metrics(expected: DataFrame, parsed: DataFrame) -> DataFrame:
    """adapter, pairs, bound, orphans, in_order: how well parsers keep labels with their values.

    expected: document_id, place, label, value, in reading order; parsed: adapter, document_id, line, text. A pair is bound
    if one line has its label and, after it, its value; a value that stands on lines without its label alone is an orphan;
    ``in_order`` is the share of neighbouring bound pairs of a document that stand on lines in their order.
    """
    lines = parsed.select("adapter", F.col("document_id").alias("_d"), "line", F.lower("text").alias("_t"))
    label, value = F.lower("label"), F.lower("value")
    met = expected.join(lines, F.col("document_id") == F.col("_d")).filter(F.contains("_t", value))
    has = F.contains("_t", label) & (F.expr("locate(lower(value), _t, locate(lower(label), _t) + length(label))") > 0)
    best = met.groupBy("adapter", "document_id", "place").agg(F.bool_or(has).alias("bound"), F.min(F.when(has, F.col("line"))).alias("line"))
    # Adapters are parsers, named in code.
    names = sorted(r.adapter for r in parsed.select("adapter").distinct().collect())
    each = expected.withColumn("adapter", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")))
    every = each.join(best, ["adapter", "document_id", "place"], "left")
    w = Window.partitionBy("adapter", "document_id").orderBy("place")
    bound = best.filter("bound").withColumn("before", F.lag("line").over(w)).filter("before IS NOT NULL")
    order = bound.groupBy("adapter").agg(F.avg((F.col("line") > F.col("before")).cast("double")).alias("in_order"))
    counted = every.groupBy("adapter").agg(F.count("*").alias("pairs"), F.count_if("bound").alias("bound"), F.count_if(~F.col("bound")).alias("orphans"))
    return counted.join(order, "adapter", "left").select("adapter", "pairs", "bound", "orphans", F.round(F.coalesce("in_order", F.lit(0.0)), 6).alias("in_order"))
