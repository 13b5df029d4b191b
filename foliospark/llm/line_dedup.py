"""Line dedup: lines that many documents share, found by sorted streams of line hashes, returned as keep bitmaps.

1. Each document gives one row for each distinct line key: a 128-bit hash, the document and the places of the line.
2. The rows are range-partitioned by (hash, document) and sorted by it within partitions. A frequent line spreads over
   as many partitions as its rows fill, so no task gets more than its share.
3. Each partition streams its rows. A run of equal hashes inside the partition is decided there. The first and the last
   run of a partition may go on next door: for these, at most two rows a partition with the run's documents and first
   document are summed, and the run's rows are decided by the sum.
4. The dropped places of a document make its keep bitmap, one bit a line, compressed; texts take no part in the shuffle.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import LOWER_BYTES, keyed, partitions_of, same_document, saved

MIN_DOCUMENTS = 10
_STRIP = b" \t\n\x0b\x0c\r"


def _line_keys(batches):
    kind = pa.schema(
        [("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()),
         ("places", pa.list_(pa.int32()))]
    )
    for batch in batches:
        digests, owners, places = [], [], []
        for row, text in enumerate(batch.column("text")):
            seen: dict[bytes, list[int]] = {}
            for i, line in enumerate(text.as_py().encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split(b"\n")):
                key = line.strip(_STRIP)
                if key:
                    seen.setdefault(key, []).append(i)
            digests += [xxhash.xxh3_128_digest(k) for k in seen]
            owners += [row] * len(seen)
            places += seen.values()
        h = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        at = pa.array(owners, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), batch.column("doc_id").cast(pa.int64()).take(at),
             batch.column("text_hash").take(at), pa.array(places, pa.list_(pa.int32()))], schema=kind
        )


_STREAMED = pa.schema(
    [("state", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()),
     ("places", pa.list_(pa.int32())), ("n_docs", pa.int64()), ("leads", pa.bool_())]
)


def _stream(min_documents: int):
    """Streams a sorted partition. Rows out: ``drop`` (decided, and ``leads`` for the first occurrence), ``open`` (of a
    run that touches the partition's edge) and ``edge`` (an open run's documents, and its first one).

    At most ``min_documents`` rows of a run are held back while it is undecided, whatever the run's length.
    """

    def run(batches):
        last_key, first_run, first_row = None, True, None
        n, held, last_doc = 0, [], None

        def rows(state, them, n_docs=0, leads=None):
            leads = leads or [False] * len(them)
            return [(state, *key, doc[0], doc[1], places, n_docs, lead) for (key, doc, places), lead in zip(them, leads)]

        def closed():
            """The run that ended inside the partition, if it is still held back: it is too rare to drop."""
            return rows("edge", [(last_key, first_row, [])], n) if first_run and last_key is not None else []

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("h1", "h2", "doc_id", "text_hash", "places")]
            for h1, h2, doc_id, text_hash, places in zip(*columns):
                key, doc = (h1, h2), (doc_id, text_hash)
                if key != last_key:
                    if last_key is not None:
                        out += closed()
                        first_run = False
                    last_key, first_row, n, held, last_doc = key, doc, 0, [], None
                if doc == last_doc:  # a repeated row of the same document
                    continue
                last_doc, n = doc, n + 1
                row = (key, doc, places)
                if first_run:
                    out += rows("open", [row])
                elif n < min_documents:
                    held.append(row)
                elif n == min_documents:
                    out += rows("drop", [*held, row], leads=[True] + [False] * len(held))
                    held = []
                else:
                    out += rows("drop", [row])
            if out:
                yield _batch(out)
        if last_key is not None:  # the last run may go on in the next partition
            tail = rows("open", held)
            if first_run or n < min_documents:
                yield _batch(tail + rows("edge", [(last_key, first_row, [])], n))
            else:  # frequent already; next door it must count as such
                yield _batch(rows("edge", [(last_key, first_row, [])], n))

    return run


def _batch(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), _STREAMED)], schema=_STREAMED
    )


def dropped_places(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, keep_first: bool = False) -> DataFrame:
    """doc_id, text_hash, places: the lines to drop, for documents that lose some. See ``keep_bitmaps``."""
    keys = saved(
        keyed(docs).mapInArrow(_line_keys, "h1 bigint, h2 bigint, doc_id bigint, text_hash bigint, places array<int>"),
        "line_keys",
    )
    order = ["h1", "h2", "doc_id", "text_hash"]
    streamed = saved(
        keys.repartitionByRange(partitions_of(docs), *order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            _stream(min_documents),
            "state string, h1 bigint, h2 bigint, doc_id bigint, text_hash bigint, places array<int>, n_docs bigint, leads boolean",
        ),
        "line_runs",
    )
    # At most two rows for each partition, so the join below sends that few.
    edges = streamed.filter("state = 'edge'").groupBy("h1", "h2").agg(
        F.sum("n_docs").alias("n_docs"), F.min(F.struct("doc_id", "text_hash")).alias("lead")
    )
    edges = edges.filter(F.col("n_docs") >= min_documents)
    # A run may be decided at its start (drop) and go on as an open run next door; its first document leads either way.
    ended = streamed.filter("state = 'open'").join(F.broadcast(edges), ["h1", "h2"]).select(
        "doc_id", "text_hash", "places",
        (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_hash") == F.col("lead.text_hash"))).alias("leads"),
    )
    drops = streamed.filter("state = 'drop'").select("doc_id", "text_hash", "places", "leads").unionByName(ended)
    if keep_first:
        rest = F.when(F.col("leads"), F.slice("places", F.lit(2), F.size("places"))).otherwise(F.col("places"))
        drops = drops.withColumn("places", rest).filter(F.size("places") > 0)
    return drops.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("places")).alias("places"))


def _bitmaps(batches):
    kind = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()),
         ("keep", pa.binary())]
    )
    for batch in batches:
        maps, dropped = [], []
        for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("places")):
            bits = np.ones(n, dtype=np.uint8)
            if places.is_valid:
                bits[places.values.to_numpy()] = 0
            dropped.append(int(n - bits.sum()))
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), batch.column("n_lines"), pa.array(dropped, pa.int64()),
             pa.array(maps, pa.binary())], schema=kind
        )


def keep_bitmaps(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, keep_first: bool = False) -> DataFrame:
    """One row for each document: doc_id, text_hash, n_lines, n_dropped, keep (zlib of one bit a line, 1: keep).

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys found in ``min_documents`` or more
    documents lose all their lines; with ``keep_first``, the first line in the first document (by doc_id, then text
    hash) stays. Lines without a key (blank ones) always stay. A null or empty text is one empty line. Rows that repeat
    a document count once, and each gets its row; an empty table gives an empty one. A text may have any number of lines.
    """
    lines = keyed(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text_hash",
        (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines"),
    )
    drops = dropped_places(docs, min_documents, keep_first)
    made = lines.join(drops, same_document(lines, drops), "left").select(
        lines["doc_id"], lines["text_hash"], "n_lines", "places"
    )
    return made.mapInArrow(_bitmaps, "doc_id bigint, text_hash bigint, n_lines bigint, n_dropped bigint, keep binary")


def _kept(lines: list, keep: bytes) -> list:
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=len(lines))
    return [line for line, bit in zip(lines, bits.tolist()) if bit]


def apply(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``text`` less its dropped lines; texts that lose none stay as they are."""
    names = docs.columns
    ours = docs.select(
        *(F.col(c).alias(f"in_{i}") for i, c in enumerate(names)),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("doc_id").cast("long").alias("did"),
    )
    cut = bitmaps.filter("n_dropped > 0").dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", "keep")
    text = f"in_{names.index('text')}"
    joined = ours.join(
        cut, ours["did"].eqNullSafe(cut["doc_id"]) & (ours["th"] == cut["text_hash"]), "left"
    ).select(*(c for c in ours.columns if c not in ("th", "did")), "keep")
    schema = joined.drop("keep").schema

    def run(batches):
        for batch in batches:
            texts = []
            for value, keep in zip(batch.column(text).to_pylist(), batch.column("keep").to_pylist()):
                if keep is not None:
                    value = "\n".join(_kept(value.split("\n"), keep))
                texts.append(value)
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array(texts, pa.string())).drop_columns(["keep"])

    out = joined.mapInArrow(run, schema)
    return out.select(*(F.col(f"in_{i}").alias(c) for i, c in enumerate(names)))


def _digests(batches):
    kind = pa.schema(
        [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())]
    )
    for batch in batches:
        made = []
        for text, dropped, keep in zip(*(batch.column(c) for c in ("text", "n_dropped", "keep"))):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            if dropped.as_py():
                raw = b"\n".join(_kept(raw.split(b"\n"), keep.as_py()))
            made.append(hashlib.sha256(raw).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "n_lines", "n_dropped")), pa.array(made, pa.string())], schema=kind
        )


def digest(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the kept lines, joined by a line feed)."""
    ours, maps = keyed(docs), bitmaps.dropDuplicates(["doc_id", "text_hash"])
    joined = ours.join(maps, same_document(ours, maps)).select(maps["doc_id"], "text", "n_lines", "n_dropped", "keep")
    return joined.mapInArrow(_digests, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")
