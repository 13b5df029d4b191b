"""Token counts by an exact length histogram.

Documents are summed by encoded length; all questions about totals are then answered by sums over the histogram from a
length on. A histogram has as many rows as there are different lengths, whatever the number of documents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from foliospark.llm.common import keyed, per_process, saved

#: Lengths in one block of the suffix sums.
BLOCK = 1024


def token_lengths(docs: DataFrame, ranks_file: str) -> DataFrame:
    """doc_id, n_tokens of every text in byte-level BPE. Null and empty texts have 0; repeated rows each their row."""

    def load():
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(
            "counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def run(batches):
        encode = per_process(("token_counts", ranks_file), load)
        for batch in batches:
            n = [len(encode(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"]
            )

    return keyed(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: pre-aggregated in each task before one shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each length that occurs: n_tokens, n_docs, docs_from (documents of that length or more), tokens_from
    (their tokens), docs_before, truncated_tokens (total of all documents cut to that length).

    An empty table gives no rows; a length of 0 is a length. Sums within blocks of lengths and sums of blocks keep any
    one task to a block or to the list of blocks.
    """
    # Texts are encoded once: the histogram, as many rows as there are lengths, is written and read twice.
    h = saved(histogram(lengths), "lengths").withColumn("block", F.floor(F.col("n_tokens") / block))
    tokens = F.col("n_tokens") * F.col("n_docs")
    inner = W.Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    own = h.select(
        "block", "n_tokens", "n_docs", F.sum("n_docs").over(inner).alias("d"), F.sum(tokens).over(inner).alias("t")
    )
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(tokens).alias("bt"))
    later = W.Window.orderBy(F.desc("block")).rowsBetween(W.Window.unboundedPreceding, -1)
    over_all = W.Window.orderBy(F.desc("block")).rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    after = blocks.select(
        F.col("block").alias("b"), F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("later_tokens"), F.sum("bd").over(over_all).alias("all_docs"),
        F.sum("bt").over(over_all).alias("all_tokens"),
    )
    docs_from, tokens_from = F.col("d") + F.col("later_docs"), F.col("t") + F.col("later_tokens")
    return own.join(after, F.col("block") == F.col("b")).select(
        "n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
        (F.col("all_docs") - docs_from).alias("docs_before"),
        (F.col("all_tokens") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_tokens"),
    )


def totals(sums: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens of all documents (0 without any)."""
    return sums.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("n_tokens"),
    )


def quantiles(sums: DataFrame, fractions: list[float]) -> DataFrame:
    """fraction, n_tokens: the least length that at least that fraction of documents doesn't exceed."""
    asked = sums.sparkSession.createDataFrame([(float(f),) for f in fractions], "fraction double")
    reached = F.col("docs_before") + F.col("n_docs")
    n = F.col("docs_before") + F.col("docs_from")
    return sums.join(F.broadcast(asked), reached >= F.col("fraction") * n).groupBy("fraction").agg(
        F.min("n_tokens").alias("n_tokens")
    )


def truncated(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context, n_tokens: total of all documents cut to each context limit, exact for every limit."""
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "context bigint")
    cut = F.least("n_tokens", "context") * F.col("n_docs")
    return sums.join(F.broadcast(asked)).groupBy("context").agg(F.sum(cut).alias("n_tokens"))
