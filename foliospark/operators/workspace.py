"""The library and chats of a workspace as relational operators: scans, scopes, details, counts, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliospark.operators.relational import leads

#: Fixed value: the best refined score there is, of which a relevance is a percentage.
BEST_SCORE = 2 / 61 + 0.008


def citable() -> Column:
    """Whether a chunk is a child, which answers may cite, or an unstructured one: parents have paragraph -1."""
    return F.coalesce(F.col("para_index"), F.lit(0)) != -1


def answering() -> Column:
    """Whether a message is part of the talk, not of a search: a null mode is."""
    return F.col("mode").isNull() | (F.col("mode") != "retrieval")


def settings(meta: DataFrame, prefix: str = "setting:") -> DataFrame:
    """(key, value) of the settings among other keys, without their prefix; nulls are left out."""
    kept = meta.filter(F.col("key").startswith(prefix) & F.col("value").isNotNull())
    return kept.select(F.substring("key", len(prefix) + 1, 1 << 20).alias("key"), "value")


def scoped_chunks(chunks: DataFrame, documents: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """All chunks of ready documents in a scope (document_id), with their document's name: no search, no top.

    An empty scope gives no rows; without a scope, all ready documents count. ``place`` is the order in the document.
    """
    ready = documents.filter("status = 'ready'").select("document_id", F.col("name").alias("document_name"))
    if scope is not None:
        ready = ready.join(scope.select("document_id").distinct(), "document_id", "left_semi")
    w = Window.partitionBy("document_id").orderBy("seq", "chunk_id")
    return chunks.join(ready, "document_id").withColumn("place", F.row_number().over(w))


def page_firsts(chunks: DataFrame) -> DataFrame:
    """The first citable chunk of each page."""
    return leads(chunks.filter(citable() & F.col("page").isNotNull()), ["document_id", "page"], ["seq", "chunk_id"])


def attached(chats: DataFrame, chat_documents: DataFrame, documents: DataFrame) -> DataFrame:
    """(chat_id, document_id, title, name, enabled): documents of chats; both must be there."""
    return chat_documents.join(chats.select("chat_id", "title"), "chat_id").join(documents.select("document_id", "name"), "document_id").select(
        "chat_id", "document_id", "title", "name", "enabled"
    )


def of_messages(messages: DataFrame, details: DataFrame) -> DataFrame:
    """Citations, excerpts or methods (``details``: message_id and more) with the chat of their message."""
    return details.join(messages.select("message_id", "chat_id"), "message_id")


def counts(documents: DataFrame, **tables: DataFrame) -> DataFrame:
    """Documents with the number of rows of each table (document_id) as a column, 0 without any."""
    out = documents
    for name, table in tables.items():
        n = table.groupBy("document_id").agg(F.count("*").alias(name))
        out = out.join(n, "document_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def document_detail(documents: DataFrame, chat_documents: DataFrame, egress: DataFrame, versions: DataFrame, latest: int = 20) -> DataFrame:
    """document_id, chats, sent (the ``latest`` times that text of it left, newest first), versions.

    egress: document_id, created_at, destination; what stays on the device isn't egress.
    """
    left = egress.filter("destination <> 'device'").select("document_id", "created_at", "destination").distinct()
    w = Window.partitionBy("document_id").orderBy(F.desc("created_at"), "destination")
    newest = left.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= latest)
    sent = newest.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n", "created_at", "destination"))).alias("sent"))
    counted = counts(documents.select("document_id"), chats=chat_documents, versions=versions)
    return counted.join(sent, "document_id", "left").select("document_id", "chats", F.coalesce(F.size("sent"), F.lit(0)).alias("n_sent"), "sent", "versions")


def merged_confidence(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Least OCR confidence of the blocks that make a chunk; blocks without one don't count."""
    return blocks.groupBy(*by).agg(F.min("ocr_confidence").alias("ocr_confidence"), F.count("*").alias("blocks"))


def evidence_text(page: Column, structure: Column, text: Column) -> Column:
    """What a reader sees of a chunk: its page's and table's context and its text, each different part once, by lines."""
    parts = F.filter(F.array(page, structure, text), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_join(F.array_distinct(parts), "\n")


def relevance_percent(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / BEST_SCORE)) * 100).cast("int")


METHOD = T.StructType([T.StructField("route", T.StringType()), T.StructField("passages", T.IntegerType()), T.StructField("cloud", T.BooleanType())])


def encoded_methods(methods: DataFrame) -> DataFrame:
    """(message_id, summary_json) of the columns of ``METHOD``."""
    return methods.select("message_id", F.to_json(F.struct(*METHOD.names)).alias("summary_json"))


def decoded_methods(rows: DataFrame) -> DataFrame:
    """The columns again; broken JSON gives nulls."""
    return rows.select("message_id", F.from_json("summary_json", METHOD).alias("m")).select("message_id", "m.*")


def retrieval_payload(messages: DataFrame) -> DataFrame:
    """(message_id, query, chunk_ids) of search messages, whose content is JSON; other content gives nothing."""
    kind = "query string, hits array<struct<chunkId:bigint>>"
    parsed = messages.filter(F.col("mode") == "retrieval").withColumn("p", F.from_json("content", kind))
    return parsed.filter("p.query IS NOT NULL").select("message_id", F.col("p.query").alias("query"), F.transform("p.hits", lambda h: h["chunkId"]).alias("chunk_ids"))


def universal_search(chat_hits: DataFrame, document_hits: DataFrame, most: int = 8, looked_at: int = 24) -> DataFrame:
    """(query_id, kind, id, place): each query's chats, by their best message among the first ``looked_at``, and chunks.

    chat_hits: query_id, chat_id, message_id, mode, rank; document_hits: query_id, chunk_id, rank. Search messages don't count.
    """
    order = Window.partitionBy("query_id").orderBy("rank", "message_id")
    heard = chat_hits.filter(answering()).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= looked_at)
    chats = heard.groupBy("query_id", "chat_id").agg(F.min("n").alias("n"))
    parts = (chats.select("query_id", F.lit("chat").alias("kind"), F.col("chat_id").cast("string").alias("id"), "n"),
             document_hits.select("query_id", F.lit("document").alias("kind"), F.col("chunk_id").cast("string").alias("id"), F.col("rank").alias("n")))
    w = Window.partitionBy("query_id", "kind").orderBy("n", "id")
    return parts[0].unionByName(parts[1]).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("n")


def repaired_views(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose search text lacks their document's name, with it before the text; others as they are."""
    named = chunks.join(documents.select("document_id", F.trim("name").alias("_name")), "document_id", "left")
    old = F.coalesce("search_text", "text")
    lacks = (F.coalesce("_name", F.lit("")) != "") & ~F.contains(F.lower(old), F.lower("_name"))
    return named.withColumn("search_text", F.when(lacks, F.concat_ws("\n", "_name", old)).otherwise(old)).drop("_name")


def stored_bytes(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, files, bytes) of tables that are read from files; sizes come from the file system, not from the data."""
    rows, spark = [], None
    for name, df in tables.items():
        spark, files = df.sparkSession, df.inputFiles()
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        rows.append((name, len(files), sum(hadoop(f).getFileSystem(conf).getFileStatus(hadoop(f)).getLen() for f in files)))
    return spark.createDataFrame(rows, "table string, files long, bytes long") if spark else None


def wipe(spark: SparkSession, root: str, confirm: str) -> bool:
    """Deletes a workspace's folder; ``confirm`` must repeat its path. Whether there was one."""
    if confirm != root or not root.strip("/"):
        raise ValueError("the path must be confirmed")
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
