"""Labelled rows for the classifiers: folds by document id, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import saved


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo ``modulus``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus).cast("int")


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int, more: tuple[str, ...] = ()
) -> DataFrame:
    """text, y and ``more`` of at most ``limit`` labelled documents, those of smallest hash of doc_id.

    ``keep`` tells which ids may be learned from. Null labels and ids are left out, an id that is labelled twice has its
    larger label, and a repeated document is one row; of ids with so many texts that these are more than ``limit``, the rows
    of smallest hash stay. The chosen ids or hashes, ``limit`` of them, are all that is broadcast.
    """
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(keep & F.col("doc_id").isNotNull() & F.col("y").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
        .withColumnRenamed("doc_id", "labelled")
    )
    here = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)
    made = here.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).drop("labelled")
    found = saved(made.dropDuplicates(["doc_id", "text"]), "training")
    if found.count() <= limit:
        return found
    # Ids with many texts: the rows of smallest hash, by keys alone.
    key = F.xxhash64("doc_id", "text")
    kept = found.select(key.alias("key")).distinct().orderBy("key").limit(limit)
    return saved(found.withColumn("key", key).join(F.broadcast(kept), "key").drop("key"), "training")
