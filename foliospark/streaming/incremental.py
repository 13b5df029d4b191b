"""Streaming forms: ingest once by content hash, daily quota, rolling egress, latest version, sessions.

The windows over event time and their watermarks are an extension of this library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_once(files: DataFrame, within: str = "7 days") -> DataFrame:
    """Each content hash once, as long as its copies come within the watermark. files: name, content, ts."""
    hashed = files.withColumn("hash", F.sha2("content", 256)).withWatermark("ts", within)
    return hashed.dropDuplicatesWithinWatermark(["hash"])


def daily_quota(usage: DataFrame, limit: int, late: str = "1 day") -> DataFrame:
    """user_id, day, used, remaining, updated as events come. usage: user_id, cost, ts."""
    made = usage.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.sum("cost").alias("used"))
    return made.select("user_id", F.col("window.start").alias("day"), "used", F.greatest(F.lit(0), F.lit(limit) - F.col("used")).alias("remaining"))


def rolling_egress(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests and bytes by destination over seven days, every day. events: destination, bytes_sent, ts."""
    made = events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", "1 day"), "destination")
    return made.agg(F.count("*").alias("requests"), F.sum("bytes_sent").alias("bytes"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    made = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return made.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def lifecycle(changes: DataFrame) -> DataFrame:
    """The furthest status of each document: received, parsing, chunking, embedding, ready; an error stays.

    Custom state a document: changes that come out of order never take a document back. changes: document_id, status.
    """
    order = ["received", "parsing", "chunking", "embedding", "ready", "error"]

    def advance(key, batches: Iterator[pd.DataFrame], state):
        (at,) = state.get if state.exists else (-1,)
        seen = max([at, *(order.index(s) for pdf in batches for s in pdf.status if s in order)])
        if seen > at:
            state.update((seen,))
            yield pd.DataFrame({"document_id": [key[0]], "status": [order[seen]]})

    return changes.groupBy("document_id").applyInPandasWithState(
        advance, "document_id string, status string", "at int", "update", "NoTimeout"
    )


def keep_current(path: str, merge):
    """A foreachBatch function that merges each batch into a table: read, ``merge(state, batch)``, write a new version.

    The last epoch is written with the state; a batch that is replayed after a failure is merged once.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        from foliospark.sources import exports

        spark = batch.sparkSession
        if exports.current(spark, path) is None:
            state = spark.createDataFrame([], batch.schema)
        else:
            if exports.read_version(spark, path, "epoch").first().epoch >= epoch:
                return
            state = exports.read_version(spark, path, "state")
        exports.write_version({"state": merge(state, batch), "epoch": spark.createDataFrame([(int(epoch),)], "epoch long")}, path)

    return step
