"""Audit ledger and table maintenance: pure functions from a state and a change to the next state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The destination that doesn't leave the machine.
DEVICE = "device"


def egress(events: DataFrame, since=None) -> DataFrame:
    """(destination, requests, bytes) of all destinations, or of events from a time on."""
    kept = events if since is None else events.filter(F.col("created_at") >= since)
    return kept.groupBy("destination").agg(F.count("*").alias("requests"), F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes"))


def cloud_egress(events: DataFrame, device: str = DEVICE) -> DataFrame:
    """One row: requests and bytes that left the machine."""
    kept = events.filter(F.col("destination") != device)
    return kept.agg(F.count("*").alias("requests"), F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes"))


def last_egress(events: DataFrame, by: str, device: str = DEVICE) -> DataFrame:
    return events.filter(F.col("destination") != device).groupBy(by).agg(F.max("created_at").alias("last_at"))


def upserted(state: DataFrame, change: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``state`` with the non-null values of ``change``; rows of ``change`` that are new are added."""
    rest = [c for c in state.columns if c not in on]
    new = change.select(*on, *[F.col(c).alias(f"_new_{c}") if c in change.columns else F.lit(None).alias(f"_new_{c}") for c in rest])
    return state.join(new, on, "full").select(*on, *[F.coalesce(f"_new_{c}", c).alias(c) for c in rest])


def replaced(state: DataFrame, change: DataFrame, on: list[str]) -> DataFrame:
    """``state`` without the rows of the keys in ``change``, and all of ``change``."""
    return state.join(change.select(*on).distinct(), on, "left_anti").select(*state.columns).unionByName(change.select(*state.columns))


def deleted(tables: dict[str, DataFrame], document_ids: DataFrame, on: str = "document_id") -> dict[str, DataFrame]:
    """All tables without the rows of the documents: a cascade."""
    keys = document_ids.select(on).distinct()
    return {name: df.join(keys, on, "left_anti") if on in df.columns else df for name, df in tables.items()}


def inserted_or_ignored(state: DataFrame, change: DataFrame, on: list[str]) -> DataFrame:
    new = change.dropDuplicates(on).join(state.select(*on), on, "left_anti")
    return state.unionByName(new.select(*state.columns))


def settings(state: DataFrame, key: str, value: str | None) -> DataFrame:
    """Key/value rows with one key set, or removed by None."""
    rest = state.filter(F.col("key") != key)
    if value is None:
        return rest
    return rest.unionByName(state.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def missing_runs(documents: DataFrame, runs: DataFrame, version: str) -> DataFrame:
    """Documents without a run of an extractor version."""
    done = runs.filter(F.col("extractor_version") == version).select("document_id").distinct()
    return documents.join(done, "document_id", "left_anti")


def with_runs(facts: DataFrame, documents: DataFrame, extract, version: str, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and run markers after extraction from the documents that lack one: an incremental step."""
    todo = missing_runs(documents, runs, version)
    made = extract(todo).withColumn("extractor_version", F.lit(version))
    marks = todo.select("document_id", F.lit(version).alias("extractor_version"))
    return facts.unionByName(made.select(*facts.columns)), runs.unionByName(marks.select(*runs.columns))
