"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items. A pattern's last words form its suffix block. Walking a text, the
block that ends at the current word is looked up in the shift table: a block that no pattern holds lets the search jump
over all places at which no pattern can end. At shift 0, the bucket of that suffix block (narrowed by the hash of the
words with which a pattern would begin here) gives the test strings, and a direct comparison of all words decides.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import WORD_BYTES, keyed, saved

WINDOW = 10
#: Bytes of item texts searched for at once; more items than that are searched in as many passes as they need.
BLOCK_BYTES = 16_000_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class WuManber:
    """Search for many word sequences. Patterns of one length share a table; short patterns have tables of their own."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
        for item, words in items:
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners[tuple(words[i : i + window])].add(item)
        by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for pattern in owners:
            by_length[len(pattern)].append(pattern)
        self.owners = owners
        self.tables = [self._table(m, ps) for m, ps in sorted(by_length.items())]

    @staticmethod
    def _table(m: int, patterns: list[tuple[bytes, ...]]):
        block = 3 if m >= 6 else 2 if m >= 2 else 1
        shift: dict[tuple[bytes, ...], int] = {}
        buckets: dict[tuple[bytes, ...], dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for p in patterns:
            for end in range(block, m + 1):
                b = p[end - block : end]
                shift[b] = min(shift.get(b, m), m - end)
            buckets[p[m - block :]][hash(p[:2])].append(p)
        return m, block, m - block + 1, shift, {b: dict(x) for b, x in buckets.items()}

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit words as disjoint, sorted [start, end), and the items whose windows occur."""
        spans, items, n = [], set(), len(words)
        for m, block, most, shift, buckets in self.tables:
            end = m
            while end <= n:
                b = tuple(words[end - block : end])
                step = shift.get(b, most)
                if step:
                    end += step
                    continue
                start = end - m
                for p in buckets[b].get(hash(tuple(words[start : start + 2][:m])), ()):
                    if tuple(words[start:end]) == p:
                        spans.append((start, end))
                        items |= self.owners[p]
                end += 1
        merged: list[tuple[int, int]] = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        return merged, items


_SPANS = "array<struct<first:bigint,last:bigint>>"


def _scan(docs: DataFrame, items: list[tuple[str | None, str | None]], window: int) -> DataFrame:
    ids = [i for i, _ in items]
    texts = [t for _, t in items]
    kind = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()),
         ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))]
    )

    def run(batches):
        search = WuManber([(i, words_of(t)) for i, t in enumerate(texts)], window).search
        for batch in batches:
            n_words, spans, found = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                hits, hit_items = search(words)
                n_words.append(len(words))
                spans.append([{"first": s, "last": e} for s, e in hits])
                found.append(sorted({str(ids[i]) if ids[i] is not None else "" for i in hit_items}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(n_words, pa.int64()),
                 pa.array(spans, kind.field("spans").type), pa.array(found, kind.field("items").type)], schema=kind
            )

    return keyed(docs).mapInArrow(run, f"doc_id bigint, text_hash bigint, n_words bigint, spans {_SPANS}, items array<string>")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: doc_id, text_hash, n_words, spans of hit words (last exclusive), items (ids as text).

    A window is ``window`` consecutive words of an item; an item of fewer words, but some, is one window. Items of null
    text have no words; an item of null id marks words and is listed as the empty string; items that repeat an id are
    one item. Null and empty texts have no words and no spans; repeated rows each get their row. An empty benchmark
    marks nothing.

    The benchmark travels to the tasks in blocks of at most ``block_bytes`` of text (and one item at least), each
    searched for in a pass of its own, so what is sent at once doesn't grow with the benchmark.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL")
    sized = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first().n
    passes = max(1, -(-sized // block_bytes))
    if passes == 1:
        return _scan(docs, [tuple(r) for r in items.collect()], window)
    # Items are dealt to blocks by hash; a pass holds one block at a time, on the driver too.
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    parts = [
        saved(_scan(docs, [tuple(r) for r in items.filter(part == k).collect()], window), "decontaminate")
        for k in range(passes)
    ]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    merged = union.groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"), F.count("*").alias("n_rows"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.expr(
        f"""aggregate(spans, cast(array() as {_SPANS}), (a, x) -> if(size(a) > 0 AND x.first <= element_at(a, -1).last,
        concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first,
        'last', greatest(x.last, element_at(a, -1).last)))), concat(a, array(x))))"""
    )
    copies = F.expr(f"explode(sequence(1L, n_rows div {passes}L))")
    return merged.select("doc_id", "text_hash", "n_words", joined.alias("spans"), "items", copies.alias("copy")).drop("copy")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["last"] - x["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
