"""What the operators of this subpackage share: table access, shared storage, text classes.

Conventions that every operator keeps:

* an operator selects the input columns it names before it adds its own, so extra columns of the input,
  whatever their names, are neither read nor returned;
* a null text is an empty text;
* a document is known by ``doc_id`` and a 64-bit hash of its text. Rows that repeat both are the same document;
  rows that share only ``doc_id`` (null included) are different documents. Every input row gets its own output row.
"""

from __future__ import annotations

import atexit
import builtins
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, and the ASCII characters that end a word of letters, digits and non-ASCII characters.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The same classes for UTF-8 bytes: A-Z lower-cased, and with it all that isn't part of a word made a blank.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD_BYTES = bytes(x if x >= 128 or chr(x).isalnum() else 32 for x in LOWER_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other characters left alone. Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, though the body uses it within lambda functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, hash of the text, text without nulls, and further columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"), *more)


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def slices(batches, rows: int):
    """Arrow batches cut to at most ``rows`` rows, so that what a task makes of one is small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


#: Bytes of input, by the estimate of the plan, for each partition of a shuffle whose number of partitions is given; and
#: the most partitions, as a shuffle's bookkeeping grows with their number (larger ones are sorted on disk).
PARTITION_BYTES, MOST_PARTITIONS = 128 << 20, 200_000


def partitions_of(df: DataFrame) -> int:
    """Partitions for a shuffle of all of ``df``: more for more bytes, and the session's number at least."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # A plan without statistics claims the largest size there is.
    return max(least, min(MOST_PARTITIONS, -(-estimate // PARTITION_BYTES))) if estimate < 1 << 60 else least


def per_process(key: tuple, make):
    """``make()`` once for each worker process and key: Spark hands its Python workers from task to task."""
    kept = builtins.__dict__.setdefault("_foliospark_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def give_back() -> None:
    """Memory that a worker has freed goes back to the system, where the C library knows how: other stages need it."""
    import ctypes
    import sys

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local sessions that name none, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_written: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the interpreter ends, or at ``release``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release, spark)
    _written.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes all tables that operators have written so far: for long sessions, once no result is needed any more."""
    while _written:
        _forget(spark, _written.pop())


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't got."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def saved(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut and outlives executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Deletes the files of a table from ``saved`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _forget(df.sparkSession, path)


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception as error:  # the gateway may be gone when the interpreter ends
        if "Py4J" not in type(error).__name__ and not isinstance(error, (ConnectionError, AttributeError)):
            raise
