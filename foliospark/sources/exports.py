"""Writers: the index tables of a workspace as versions swapped by a pointer, JSON export, conversations as Markdown."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(tables: dict[str, DataFrame], root: str) -> str:
    """Writes all tables under a new version and then its pointer, so that readers see all of them or none.

    Versions are numbered; the current one is that of the largest number (of two writers at once, of the larger id).
    """
    version = uuid.uuid4().hex
    spark = None
    for name, df in tables.items():
        df.write.parquet(f"{root}/versions/{version}/{name}")
        spark = df.sparkSession
    if spark is not None:
        number = (_newest(spark, root) or (0, ""))[0] + 1
        spark.createDataFrame([(number, version)], "number long, version string").coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def _newest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    try:
        pointers = spark.read.schema("number long, version string").parquet(f"{root}/pointer")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    row = pointers.agg(F.max(F.struct("number", "version")).alias("m")).first().m
    return (row.number, row.version) if row else None


def current(spark: SparkSession, root: str) -> str | None:
    """The current version; None before the first."""
    newest = _newest(spark, root)
    return newest[1] if newest else None


def read_version(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/versions/{current(spark, root)}/{name}")


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def conversation_markdown(messages: DataFrame, key: str = "chat_id", order: str = "created_at") -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "role", "content"))), lambda m: F.concat(F.lit("**"), m["role"], F.lit("**\n\n"), m["content"]))
    return messages.groupBy(key).agg(F.array_join(parts, "\n\n").alias("markdown"))


def event_stream_deltas(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text deltas of server-sent events, one a line; comments, other fields, the end mark and broken JSON give nothing."""
    data = F.regexp_extract(column, r"^data:\s?(.*)$", 1)
    parsed = F.from_json(data, "choices array<struct<delta:struct<content:string>>>")
    made = lines.filter(F.col(column).startswith("data:") & (data != "[DONE]")).withColumn("delta", F.get(parsed["choices"], F.lit(0))["delta"]["content"])
    return made.filter(F.col("delta").isNotNull())
