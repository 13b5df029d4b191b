"""The second-stage order of fused candidates: a linear model over relevance features, leaders of channels, carriers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import relevance
from foliospark.functions.text import identifier_compatibility

#: Least utility of a channel's leader, its bonus, and how many carriers of a contact come first.
LEADER, BONUS, CARRIERS = 0.35, 0.16, 3


def refined(candidates: DataFrame, top: int = 16) -> DataFrame:
    """query_id, chunk_id, refined (score), place, and the features, the ``top`` of each query.

    candidates: query_id, query, chunk_id, document_name, heading, text, score, channel, rank: a row for each channel
    that found a chunk, of the same score. The score is the fused one and the weighted features, times how well
    identifiers agree; the best of each channel by utility, if that is ``LEADER`` or more, gains ``BONUS`` times it.
    Passages that carry an asked contact come first, three at most, then each channel's best passage with an asked kind
    of number by its scope, then the rest by score. Ties go by chunk. Null texts are empty.
    """
    texts = F.concat_ws("\n", F.coalesce("document_name", F.lit("")), F.coalesce("heading", F.lit("")), F.coalesce("text", F.lit("")))
    one = candidates.dropDuplicates(["query_id", "chunk_id"]).withColumn(
        "f", relevance.feature_columns(F.col("query"), F.col("document_name"), F.col("heading"), F.col("text"))
    )
    linear = F.col("score")
    for name, weight in relevance.WEIGHTS.items():
        linear = linear + F.col(f"f.{name}") * weight
    one = one.withColumn("compatible", identifier_compatibility(F.col("query"), texts)).select(
        "query_id", "chunk_id", (linear * F.col("compatible")).alias("linear"), F.col("f.utility").alias("utility"), "f"
    )
    by_channel = candidates.select("query_id", "chunk_id", "channel").distinct().join(one, ["query_id", "chunk_id"])
    best = Window.partitionBy("query_id", "channel").orderBy(F.desc("utility"), F.desc("linear"), "chunk_id")
    leaders = by_channel.filter(F.col("utility") >= LEADER).withColumn("n", F.row_number().over(best)).filter("n = 1")
    bonus = leaders.groupBy("query_id", "chunk_id").agg((F.max("utility") * BONUS).alias("bonus"))
    scored = one.join(bonus, ["query_id", "chunk_id"], "left").withColumn("refined", F.col("linear") + F.coalesce("bonus", F.lit(0.0)))
    # Carriers of contacts, and of numbers for each channel.
    order = [F.desc("refined"), "chunk_id"]
    contact = Window.partitionBy("query_id").orderBy(*order)
    contacts = scored.filter("f.contact > 0").withColumn("n", F.row_number().over(contact)).filter(F.col("n") <= CARRIERS)
    contacts = contacts.select("query_id", "chunk_id", F.lit(0).alias("tier"), F.lit(0.0).alias("within"))
    typed = scored.filter("f.numeric > 0").join(by_channel.select("query_id", "chunk_id", "channel"), ["query_id", "chunk_id"])
    numeric = Window.partitionBy("query_id", "channel").orderBy(F.desc("f.numeric_scope"), *order)
    numbers = typed.withColumn("n", F.row_number().over(numeric)).filter("n = 1")
    numbers = numbers.select("query_id", "chunk_id", F.lit(1).alias("tier"), (-F.col("f.numeric_scope")).alias("within"))
    first = contacts.unionByName(numbers).groupBy("query_id", "chunk_id").agg(F.min(F.struct("tier", "within")).alias("t"))
    placed = scored.join(first, ["query_id", "chunk_id"], "left").select(
        "query_id", "chunk_id", F.round("refined", 8).alias("refined"), F.coalesce("t.tier", F.lit(2)).alias("tier"),
        F.coalesce("t.within", F.lit(0.0)).alias("within"), "f",
    )
    w = Window.partitionBy("query_id").orderBy("tier", "within", F.desc("refined"), "chunk_id")
    return placed.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("query_id", "chunk_id", "refined", "place", "f.*")
