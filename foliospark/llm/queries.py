"""The queries of this subpackage for the driver, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from foliospark.llm import decontaminate, license_scan, line_dedup, quality_model, quality_rules, sentencepieces, simhash, token_counts, token_store, toxicity
from foliospark.llm.common import table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, of the package that holds them or of the folder in TOKENIZERS_DIR."""
    if at := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(at, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_dedup.digest(docs, line_dedup.keep_bitmaps(docs))


def op3_token_store(spark, sf_dir):
    """Written and read back within the query; the files are in the session's shared folder."""
    path = token_store.write_store(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_store.digest(token_store.read_store(spark, path))


def op4_sentencepieces(spark, sf_dir):
    return sentencepieces.digest(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_quality_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op6_simhash(spark, sf_dir):
    made = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return made.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark, sf_dir):
    made = quality_rules.measure(table(spark, sf_dir, "documents"))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return made.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (F.col("kept") & ~base_failed).alias("kept"), "failed",
    )


def op7_token_counts(spark, sf_dir):
    lengths = token_counts.token_lengths(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))
    return token_counts.suffix_sums(lengths)


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_line_dedup, op3_token_store, op4_sentencepieces, op5_quality_model,
        op6_simhash, op7_token_counts, op8_toxicity, op9_license_scan, op10_quality_rules,
    )
}
