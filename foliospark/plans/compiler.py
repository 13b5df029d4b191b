"""From a frame to a DataFrame: exact aggregation over facts, or retrieval over a corpus."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import search_terms
from foliospark.operators import facts, packing, refine, retrieval
from foliospark.plans.questions import Frame, analyze


def answer(question: str, chunks: DataFrame) -> DataFrame:
    """Rows that answer a question: currency, value_minor, count of an aggregate; else its packed evidence."""
    frame = analyze(question)
    return aggregate(frame, chunks) if frame.route == "aggregate" else retrieve(frame, chunks)


def aggregate(frame: Frame, chunks: DataFrame) -> DataFrame:
    scope = {k: v for k, v in asdict(frame.temporal).items() if v is not None} if frame.temporal else {}
    return facts.aggregate(facts.records(chunks), frame.operation or "sum", frame.role, **scope)


def retrieve(frame: Frame, chunks: DataFrame, top: int = 60, fused: int = 48) -> DataFrame:
    """query_id, position, chunk_id, family of evidence: channels of words and grams, their neighbours, fusion, refinement
    by relevance, and packing, each stage bounded.

    chunks: chunk_id, document_id, text, and page, seq, heading, document_name, para_index, structural_context if known.
    """
    spark, have = chunks.sparkSession, set(chunks.columns)
    col = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    full = chunks.select(
        "chunk_id", "document_id", "text", col("page", "int").alias("page"), col("seq", "int").alias("seq"), col("heading", "string").alias("heading"),
        col("document_name", "string").alias("document_name"), F.coalesce(col("para_index", "int") == -1, F.lit(False)).alias("is_parent"),
        col("structural_context", "string").alias("structure"),
    )
    q = spark.createDataFrame([(0, frame.question)], "query_id long, text string")
    channels = None
    for name, terms in (("words", search_terms(F.col("text"), 4096)), ("grams", _grams(F.col("text")))):
        index, size = retrieval.index(full, "chunk_id", terms)
        hits = retrieval.bm25(index, retrieval.query_terms(q, terms), "chunk_id", size, top).withColumn("channel", F.lit(name))
        channels = hits if channels is None else channels.unionByName(hits)
    best = retrieval.fused(retrieval.channel(channels, "chunk_id"), "chunk_id", fused)
    found = channels.select("query_id", "chunk_id", "channel").distinct().join(best.select("query_id", "chunk_id", "score", "rank"), ["query_id", "chunk_id"])
    named = found.join(full, "chunk_id").withColumn("query", F.lit(frame.question))
    order = refine.refined(named.select("query_id", "query", "chunk_id", "document_name", "heading", "text", "score", "channel", "rank"), 32)
    ranked = order.select("query_id", "chunk_id", F.col("refined").alias("score"), F.col("place").alias("rank")).join(full, "chunk_id")
    reach = 8 if frame.route == "synthesis" or frame.shape == "explanation" else 1
    near = full.alias("n").join(
        ranked.select(F.col("document_id").alias("d"), F.col("seq").alias("s"), "query_id").filter("s IS NOT NULL"),
        F.expr(f"n.document_id = d AND abs(n.seq - s) <= {reach}"),
    ).select("query_id", "n.*").dropDuplicates(["query_id", "chunk_id"])
    beside = near.join(ranked.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    beside = beside.withColumns({"score": F.lit(0.0), "rank": F.lit(None).cast("int")})
    every = ranked.unionByName(beside).withColumn("question", F.lit(frame.question))
    return packing.packed_evidence(every)


def _grams(text):
    from foliospark.functions.text import character_grams

    return F.filter(character_grams(text, 3, 4096), lambda g: ~g.contains("^") & ~g.contains("$"))
