"""Joins, aggregations and windows over documents, chunks and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ready(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("status") == "ready")


def in_documents(df: DataFrame, ids: list | None, column: str = "document_id") -> DataFrame:
    """Rows of the given documents; no list, or an empty one, is no restriction."""
    return df.filter(F.col(column).isin(*ids)) if ids else df


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def neighbours(chunks: DataFrame, anchors: DataFrame, radius: int, group: str = "document_id", seq: str = "seq") -> DataFrame:
    """Chunks within ``radius`` of an anchor in its group. The band is exploded to keys: an equi-join, not a theta join."""
    reach = anchors.select(
        group, F.explode(F.sequence(F.col(seq) - radius, F.col(seq) + radius)).alias(seq)
    ).distinct()
    return chunks.join(reach, [group, seq], "left_semi")


def nearest_anchor(chunks: DataFrame, anchors: DataFrame, distance: int, group: str = "document_id", seq: str = "seq") -> DataFrame:
    """Each chunk with its first ranked anchor within a distance: columns of chunks, anchor_seq, anchor_rank."""
    reach = anchors.select(
        group, F.col(seq).alias("anchor_seq"), F.col("rank").alias("anchor_rank"),
        F.explode(F.sequence(F.col(seq) - distance, F.col(seq) + distance)).alias(seq),
    )
    best = reach.groupBy(group, seq).agg(F.min(F.struct("anchor_rank", "anchor_seq")).alias("best"))
    return chunks.join(best, [group, seq]).select(*chunks.columns, "best.anchor_seq", "best.anchor_rank")


def overlapping(parents: DataFrame, children: DataFrame, on: str = "document_id") -> DataFrame:
    """(parent_id, child_id) of intervals [char_start, char_end] that touch, on the same page or under the same heading."""
    p, c = parents.alias("p"), children.alias("c")
    touch = (F.col("c.char_end") >= F.col("p.char_start")) & (F.col("c.char_start") <= F.col("p.char_end"))
    place = F.when(F.col("p.page").isNotNull(), F.col("p.page") == F.col("c.page")).otherwise(
        F.col("p.heading").eqNullSafe(F.col("c.heading"))
    )
    return p.join(c, (F.col(f"p.{on}") == F.col(f"c.{on}")) & touch & place).select(
        F.col("p.id").alias("parent_id"), F.col("c.id").alias("child_id")
    )


def interval_union(intervals: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Length that the intervals of each group cover together: islands by the running maximum of ends."""
    w = Window.partitionBy(*group).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("opens", (before.isNull() | (F.col(start) > before)).cast("int"))
    islands = marked.withColumn("island", F.sum("opens").over(w)).groupBy(*group, "island").agg(
        F.min(start).alias("lo"), F.max(end).alias("hi")
    )
    return islands.groupBy(*group).agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"), F.count("*").alias("islands"))


def leads(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_counts(df: DataFrame, counted: DataFrame, on: str, name: str) -> DataFrame:
    """``df`` and how many rows of ``counted`` share its key, 0 included."""
    n = counted.groupBy(on).agg(F.count("*").alias(name))
    return df.join(n, on, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def promoted(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with the larger of their own and their parent's score."""
    best = parents.groupBy(F.col("chunk_id").alias("parent_chunk_id")).agg(F.max("score").alias("parent_score"))
    return children.join(best, "parent_chunk_id", "left").withColumn("score", F.greatest("score", "parent_score"))


def repeated_pages(hits: DataFrame, least: int = 2, top: int = 2) -> DataFrame:
    """The ``top`` pages of each query by summed score, of those with ``least`` hits or more."""
    pages = hits.groupBy("query_id", "document_id", "page").agg(
        F.count("*").alias("hits"), F.round(F.sum("score"), 6).alias("score")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "page")
    return pages.filter(F.col("hits") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def capped(df: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def interleaved(lists: DataFrame, ranks: int = 16, most: int = 16) -> DataFrame:
    """Ranked lists (query_id, list_no, rank, chunk_id) taken in turn, first place of each chunk, ``most`` a query."""
    first = leads(lists.filter(F.col("rank") <= ranks), ["query_id", "chunk_id"], ["rank", "list_no"])
    w = Window.partitionBy("query_id").orderBy("rank", "list_no")
    return first.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("query_id", "chunk_id", "place")


def active_versions(messages: DataFrame) -> DataFrame:
    """The latest message of each version group; messages without a group stay, and pass the window by."""
    w = Window.partitionBy("version_group").orderBy(F.desc("created_at"), F.desc("id"))
    grouped = messages.filter("version_group IS NOT NULL").withColumn("_n", F.row_number().over(w))
    return messages.filter("version_group IS NULL").unionByName(grouped.filter("_n = 1").drop("_n"))


def repeated_share(df: DataFrame, key: list[str], item: str) -> DataFrame:
    """How large a share of a group's items repeat an earlier one."""
    return df.groupBy(*key).agg(
        F.count(item).alias("items"), F.countDistinct(item).alias("kinds"),
        F.round(1 - F.countDistinct(item) / F.greatest(F.count(item), F.lit(1)), 6).alias("repeated"),
    )


def wilson(df: DataFrame, successes: str, trials: str, z: float = 1.959963984540054) -> DataFrame:
    """Bounds of the 95 % interval of a share; null without trials."""
    n, p = F.col(trials).cast("double"), F.try_divide(F.col(successes).cast("double"), F.col(trials).cast("double"))
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    below = 1 + z * z / n
    bound = lambda x: F.round(F.when(n > 0, x / below), 6)
    return df.withColumns({"share": F.round(p, 6), "low": bound(middle - spread), "high": bound(middle + spread)})


def nearest_rank(df: DataFrame, group: list[str], value: str, share: float, name: str, blocks: int = 256) -> DataFrame:
    """The value at place ceil(share * n) of the sorted ones, not interpolated; null values don't count.

    Equal values are counted first. Sums over blocks of the range between a group's smallest and largest value tell which
    block holds the place, so that a task sorts the different values of one block, not of a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    span = counts.groupBy(*group).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all"))
    wide = F.col("_hi").cast("double") - F.col("_lo").cast("double")
    at = F.when(wide > 0, F.floor((F.col("_v").cast("double") - F.col("_lo").cast("double")) / wide * blocks)).otherwise(F.lit(0)).cast("long")
    placed = counts.join(span, group).withColumn("_b", at)
    sums = placed.groupBy(*group, "_b").agg(F.sum("_n").alias("_in"), F.first("_all").alias("_all"))
    before = F.sum("_in").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_in")
    wanted = F.ceil(F.col("_all") * share)
    chosen = sums.withColumns({"_before": before, "_want": wanted}).filter("_before < _want AND _want <= _before + _in")
    inside = placed.join(chosen.select(*group, "_b", "_before", "_want"), [*group, "_b"])
    reached = F.col("_before") + F.sum("_n").over(Window.partitionBy(*group, "_b").orderBy("_v"))
    return inside.withColumn("_r", reached).filter("_r >= _want").groupBy(*group).agg(F.min("_v").alias(name))


def unique_tokens(names: DataFrame) -> DataFrame:
    """(token, document_id): tokens of three letters or more, not numbers, that one document's name has alone."""
    words = F.array_distinct(F.filter(F.split(F.lower("name"), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+$")))
    each = names.select("document_id", F.explode(words).alias("token"))
    once = each.groupBy("token").agg(F.count("*").alias("n"), F.min("document_id").alias("document_id"))
    return once.filter("n = 1").select("token", "document_id")


def referenced(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, document_id): documents of which a question has a token that no other document's name has."""
    asked = questions.select("query_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("token"))
    return asked.join(unique_tokens(names), "token").select("query_id", "document_id").distinct()
