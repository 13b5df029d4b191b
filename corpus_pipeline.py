"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import decontaminate, line_dedup, quality_rules, sentencepieces, simhash
from foliospark.llm.common import saved, table, unused
from foliospark.llm.queries import tokenizer_file

#: The SimHash stage: five-word shingles, 512-bit fingerprints, two random orders of the bits in partitions of 14. Texts of
#: Jaccard similarity s have a cosine of 2 s / (1 + s), and differ in arccos of it / pi of the bits: 15.0 % at 0.8, which
#: is 38 of the 256 that are compared. Up to 64 a pair may be near, over 4 standard deviations more; the shingles decide.
SHINGLE, WORDS64, COMPARED, POSSIBLE = 5, 8, 4, 64
PARTS = simhash.drawn(WORDS64, 14, 2)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject, null and empty texts among them.

    Repeated rows are judged each; rows of null or shared doc_id as any others. An empty table stays empty.
    """
    kept = quality_rules.measure(docs, keep=("doc_id", "text", "lang", "source", "n_chars"))
    return kept.filter("kept").select("doc_id", "text", "lang", "source", "n_chars")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 documents or more share stay at their first occurrence only; every document stays, n_chars follows.

    A null text is an empty one and stays null or becomes empty; rows that repeat doc_id and text are one document and
    keep a row each. An empty table stays empty.
    """
    cut = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs, keep_first=True))
    return cut.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))


def _hashed(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that are, or aren't, among the (doc_id, text_hash) of ``found``, whatever columns they have."""
    own, doc_id, text_hash = (unused(docs, x) for x in ("own_hash", "found_id", "found_hash"))
    found = found.select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text_hash))
    here = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    return here.join(found, F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col(own) == F.col(text_hash)), how)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of smallest doc_id; of repeated ids, that of smallest text hash.

    Texts without words (null and empty ones too) are copies of each other: one of them stays. Groups are of texts: rows
    of the same or of null doc_id and different texts are different documents, and one of null doc_id stays only where
    its group has no other. Of repeated rows one stays. An empty table stays empty.
    """
    made = simhash.similar_groups(docs, SHINGLE, WORDS64, PARTS, COMPARED, POSSIBLE)
    first = (
        made.groupBy("component_id")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"))
        .select("first.doc_id", "first.text_hash")
    )
    kept = _hashed(docs, saved(first.distinct(), "chosen"), "left_semi")
    return kept.dropDuplicates(["doc_id", kept.columns[-1]]).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item.

    Null and empty texts hold none and stay, as do all documents where ``benchmark`` has no words. Repeated rows go or
    stay together.
    """
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    hit = saved(found.filter(F.size("spans") > 0).select("doc_id", "text_hash").distinct(), "contaminated")
    return _hashed(docs, hit, "left_anti").select(*docs.columns)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip of every row that is left; null and empty texts have no tokens."""
    # Workers stay for other stages, so they remember less than in a job of their own.
    return sentencepieces.digest(docs, tokenizer_file("piece_bpe_32k.model"), cache=50_000)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Merging byte pairs isn't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
