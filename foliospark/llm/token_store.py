"""Token-id output: canonical length-limited Huffman shards, and their table-driven decoding.

Shard format (little-endian), one binary value a row, documents in ascending order throughout the store:

    magic "FTS1" | n_docs u32 | n_tokens u64 | block u32 | n_bits u64
    n_docs times: has_id u8, doc_id i64, n_tokens u64
    ceil(n_tokens / block) times: bit offset u64 of each block's first token   (the checkpoints)
    bit stream, most significant bit first

Code lengths (one byte for each id of the vocabulary, 0: unused) are the store's codebook; canonical codes follow from
them alone. Blocks decode independently of each other: each starts at its checkpoint.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import fresh_path, give_back, keyed, partitions_of, per_process, saved, slices
from foliospark.llm.runs import Runs

MAX_BITS = 20
BLOCK = 512
#: Tokens after which a shard ends; a longer document is a shard of its own.
SHARD_TOKENS = 2_000_000
#: Header and document record.
_HEAD, _DOC = "<4sIQIQ", "<Bqq"
#: Runs between white space that a worker remembers.
_CACHE_RUNS = 1_000_000
#: How the tokenizer's file splits text into words once white space is gone, restated for characters of
#: which Python's classes agree with it (see ``_plain``).
_WORD_SPLIT = r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    n, levels, packages = len(leaves), [], np.zeros(0)
    for _ in range(max_bits):
        merged = np.concatenate([leaves, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)  # which of the merged list, in order, are leaves
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, lengths = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())  # leaves are chosen from the rarest on
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each length's first code continuing from the shorter ones."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code, last = 0, 0
    per = np.bincount(lengths, minlength=int(lengths.max(initial=0)) + 1)
    for bits in range(1, len(per)):
        code <<= bits - last
        ids = np.flatnonzero(lengths == bits)
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code, last = code + int(per[bits]), bits
    return codes


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, id of each prefix of that many bits, its code length)."""
    bits = max(1, int(lengths.max(initial=0)))
    codes, ids, sizes = canonical_codes(lengths), np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint8)
    order = np.flatnonzero(lengths)
    order = order[np.lexsort((order, lengths[order]))]
    spans = 1 << (bits - lengths[order].astype(np.int64))
    ids[: spans.sum()] = np.repeat(order, spans)
    sizes[: spans.sum()] = np.repeat(lengths[order], spans)
    assert not len(order) or int(codes[order[0]]) == 0
    return bits, ids, sizes


def pack(docs: list[tuple[int | None, int]], ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int = BLOCK) -> bytes:
    """A shard of documents (doc_id, number of tokens) and all their ids in one array."""
    size = lengths[ids].astype(np.int64)
    if len(ids) and not size.min():
        raise ValueError("an id without a code")
    ends = np.cumsum(size)
    at, n_bits = ends - size, int(ends[-1]) if len(ids) else 0
    words = np.zeros(n_bits // 64 + 2, dtype=np.uint64)
    if len(ids):
        code, word, bit = codes[ids], at >> 6, (at & 63).astype(np.int64)
        over = bit + size - 64  # bits that go into the next word
        first = np.where(over > 0, code >> np.maximum(over, 0).astype(np.uint64), code << np.maximum(-over, 0).astype(np.uint64))
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[starts]] |= np.bitwise_or.reduceat(first, starts)
        cross = np.flatnonzero(over > 0)
        words[word[cross] + 1] |= code[cross] << (64 - over[cross]).astype(np.uint64)
    stream = words.astype(">u8").tobytes()[: (n_bits + 7) // 8]
    index = b"".join(struct.pack(_DOC, d is not None, d or 0, n) for d, n in docs)
    return struct.pack(_HEAD, b"FTS1", len(docs), len(ids), block, n_bits) + index + at[::block].astype("<u8").tobytes() + stream


def unpack(shard: bytes, table: tuple[int, np.ndarray, np.ndarray]) -> tuple[list[tuple[int | None, int]], np.ndarray]:
    """The documents and all ids of a shard. Its blocks are decoded side by side, one token of each at a time."""
    magic, n_docs, n_tokens, block, n_bits = struct.unpack_from(_HEAD, shard)
    if magic != b"FTS1":
        raise ValueError("not a token shard")
    head, at = struct.calcsize(_HEAD), struct.calcsize(_HEAD) + struct.calcsize(_DOC) * n_docs
    docs = [(d if has else None, n) for has, d, n in struct.iter_unpack(_DOC, shard[head:at])]
    n_blocks = -(-n_tokens // block)
    offset = np.frombuffer(shard, "<u8", n_blocks, at).astype(np.int64)
    stream = np.frombuffer(shard[at + 8 * n_blocks :] + bytes(8), np.uint8).astype(np.uint64)
    bits, ids, sizes = table
    # Five bytes from each byte on: any code of up to 32 bits is inside.
    n = len(stream) - 4
    ahead = stream[:n] << np.uint64(32) | stream[1 : n + 1] << np.uint64(24) | stream[2 : n + 2] << np.uint64(16) | stream[3 : n + 3] << np.uint64(8) | stream[4 : n + 4]
    out = np.zeros(n_blocks * block, dtype=np.uint32).reshape(n_blocks, block)
    tail = n_tokens - (n_blocks - 1) * block
    mask = np.uint64((1 << bits) - 1)
    for step in range(block if n_blocks else 0):
        if step == tail and n_blocks:
            offset = offset[:-1]
        if not len(offset):
            break
        prefix = (ahead[offset >> 3] >> (40 - bits - (offset & 7)).astype(np.uint64)) & mask
        out[: len(offset), step] = ids[prefix]
        offset = offset + sizes[prefix]
    return docs, out.reshape(-1)[:n_tokens]


def _plain(text: str) -> bool:
    """Only characters for which the restated split and lower-casing are the tokenizer's: ASCII and Latin letters."""
    if text.isascii():
        return not any(c in text for c in "\x1c\x1d\x1e\x1f")
    odd = "\x1c\x1d\x1e\x1f\xd7\xf7İŉ"
    return all(c not in odd and (c < "\x80" or "\xc0" <= c <= "ſ") for c in set(text))


#: Characters of texts that are encoded together, and unknown words that the library gets at once.
_TOGETHER, _WORDS = 1_000_000, 2000


#: White space among the bytes of ``_plain`` texts.
_BLANK = np.array([chr(c) in " \t\n\x0b\x0c\r" for c in range(256)])


class Encoder:
    """From texts to their ids as little-endian bytes of ``width`` (2 or 4).

    No token spans white space, so the ids of a run between white space are kept once the library gave them for its
    words; unknown runs are given to it many at a time. Texts with characters outside of ``_plain`` go to the library
    whole.
    """

    def __init__(self, vocabulary: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab()
        top = max([*names.values(), end_id or 0])
        self.dtype = np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
        self.width = self.dtype.itemsize
        self.ends_word = np.zeros(top + 1, dtype=bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True
        # Words that are split, lower-cased and of plain characters need no more than the merges.
        self.merges = Tokenizer.from_file(vocabulary)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.split = re.compile(_WORD_SPLIT).findall
        self.end = b"" if end_id is None else np.array([end_id], dtype=self.dtype).tobytes()
        self.runs = Runs(self.dtype)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has."""
        ids, sizes = [], []
        for lo in range(0, len(words), _WORDS):
            part = words[lo : lo + _WORDS]
            made = np.array(self.merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.flatnonzero(self.ends_word[made]) + 1
            if len(ends) != len(part):
                each = [self.whole(w) for w in part]
                made, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids.append(made)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, numbers: np.ndarray, names: list[bytes], marks: np.ndarray) -> None:
        """Gives new runs their ids; the words of a run of several are runs of their own."""
        split = list(map(self.split, b" ".join(names).decode().split(" ")))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        alone, several = np.flatnonzero(counts == 1), np.flatnonzero(counts > 1)
        if len(alone):
            self.runs.give(numbers[alone], *self._words([split[k][0] for k in alone.tolist()]))
        if len(several):
            words = " ".join(chain.from_iterable(split[k] for k in several.tolist())).encode()
            ids, size = self.runs.ids(self._numbers(words)[0])
            self.runs.give(numbers[several], ids, np.add.reduceat(size, np.cumsum(counts[several]) - counts[several]))

    def _numbers(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the runs of a text, and where each begins."""
        raw = b"\n" * 8 + text + b"\n" * 8
        blank = _BLANK[np.frombuffer(raw, np.uint8)]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        return self.runs.numbers(raw, edges[::2], edges[1::2], self._learn), edges[::2] - 8

    def encode(self, texts: list[str]) -> list[bytes]:
        out, lo = [], 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _TOGETHER):
                size += len(texts[hi])
                hi += 1
            out += self._together(texts[lo:hi])
            lo = hi
        return out

    def _together(self, texts: list[str]) -> list[bytes]:
        if self.runs.n > _CACHE_RUNS:
            self.runs = self.runs.frequent(_CACHE_RUNS // 4)
        plain = [t.lower().encode() if _plain(t) else None for t in texts]
        numbers, start = self._numbers(b"\n".join(x or b"" for x in plain))
        self.runs.asked[: self.runs.n] += np.bincount(numbers, minlength=self.runs.n)
        ids, size = self.runs.ids(numbers)
        until = np.cumsum([len(x or b"") + 1 for x in plain])
        raw, ends = ids.tobytes(), self.width * np.r_[0, np.cumsum(size, dtype=np.int64)][np.r_[0, np.searchsorted(start, until)]]
        return [
            (self.whole(t).tobytes() if x is None else raw[a:b]) + self.end
            for t, x, a, b in zip(texts, plain, ends[:-1].tolist(), ends[1:].tolist())
        ]


#: The place of the row in which a task reports how often it made each id.
_COUNTS = -1
_TOKENS = "doc_id bigint, width int, ids binary, place bigint, before bigint"


def _tokens(vocabulary: str, end_id: int | None):
    def run(batches):
        encoder = per_process(("token_store", vocabulary, end_id), lambda: Encoder(vocabulary, end_id))
        place, total = 0, np.zeros(len(encoder.ends_word), dtype=np.int64)
        made = 0

        def rows(doc_ids, width, ids, places, before):
            return pa.RecordBatch.from_arrays(
                [doc_ids, pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary()), pa.array(places, pa.int64()),
                 pa.array(before, pa.int64())], names=["doc_id", "width", "ids", "place", "before"],
            )

        for part in slices(batches, 1000):
            ids = encoder.encode(part.column("text").to_pylist())
            total += np.bincount(np.frombuffer(b"".join(ids), dtype=encoder.dtype), minlength=len(total))
            ends = made + np.cumsum([0, *(len(x) // encoder.width for x in ids)])
            yield rows(part.column("doc_id").cast(pa.int64()), encoder.width, ids, range(place, place + len(ids)), ends[:-1])
            place, made = place + len(ids), int(ends[-1])
        encoder.runs = encoder.runs.frequent(_CACHE_RUNS // 16)  # a worker that waits for other tasks keeps little
        give_back()
        yield rows(pa.array([None], pa.int64()), 8, [total.astype("<i8").tobytes()], [_COUNTS], [made])

    return run


def _ids(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{width}").astype(np.uint32)


def _counts(batches):
    for batch in batches:
        for raw in batch.column("ids").to_pylist():
            total = np.frombuffer(raw, dtype="<i8")
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def write_store(docs: DataFrame, vocabulary: str, end_id: int | None = 2, path: str | None = None) -> str:
    """Encodes every text and writes the store; returns its path (``codebook`` and ``shards``, written by Spark).

    Documents are in ascending order of doc_id, nulls first, equal ids by a hash of the text. Null and empty texts have
    the end id only, or nothing with ``end_id`` None. Repeated rows are repeated documents, however many; an empty table
    makes an empty store. Global counts reach the driver as one row for each id of the vocabulary, which bounds them.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token_store")
    # Texts are dealt out by doc_id first, so that ids are made once and already stand in order. The hash spreads an id
    # with many texts, the random tie a document that is repeated many times.
    order = ["doc_id", "text_hash", "tie"]
    rows = keyed(docs).withColumn("tie", F.rand(0))
    ordered = rows.repartitionByRange(partitions_of(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    tokens = saved(
        ordered.mapInArrow(_tokens(vocabulary, end_id), _TOKENS).withColumn("part", F.spark_partition_id()),
        "token_ids",
    )
    counted = tokens.filter(F.col("place") == _COUNTS).select("ids").mapInArrow(_counts, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counted.collect()
    counts = np.zeros(max((r.id for r in rows), default=0) + 1, dtype=np.int64)
    for r in rows:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    packed = lengths.tobytes()

    def shards(batches):
        length = np.frombuffer(packed, dtype=np.uint8)
        codes = canonical_codes(length)
        held, part, first, start, last, n = [], None, 0, 0, 0, 0

        def out():
            ids = np.concatenate([x for _, x in held])
            raw = pack([(d, len(x)) for d, x in held], ids, length, codes)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([start], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())], names=["part", "first", "start", "n_tokens", "data"],
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "place", "before", "doc_id", "width", "ids")]
            for p, place, before, doc_id, width, raw in zip(*columns):
                ids = _ids(raw, width)
                if held and (p != part or place != last + 1 or n + len(ids) > SHARD_TOKENS):
                    yield out()
                    held, n = [], 0
                if not held:
                    part, first, start = p, place, before
                held.append((doc_id, ids))
                last, n = place, n + len(ids)
        if held:
            yield out()

    # However rows are cut into files and tasks, a shard holds a run of one part's rows, and knows the ids before it there.
    tokens.filter(F.col("place") >= 0).mapInArrow(shards, _SHARDS).write.parquet(f"{path}/shards")
    return path


_SHARDS = "part int, first bigint, start bigint, n_tokens bigint, data binary"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit, as binary)."""
    packed = bytes(spark.read.parquet(f"{path}/codebook").first().lengths)
    shards = spark.read.schema(_SHARDS).parquet(f"{path}/shards")
    # One number for each part, of which there are as many as the writer had partitions.
    sizes = {r.part: r.n for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    per_part = np.array([sizes.get(k, 0) for k in range(max(sizes, default=-1) + 1)], dtype=np.int64)
    starts = spark.sparkContext.broadcast(np.cumsum(per_part) - per_part)

    def run(batches):
        table = decode_table(np.frombuffer(packed, dtype=np.uint8))
        for batch in batches:
            for part, before, data in zip(*(batch.column(c) for c in ("part", "start", "data"))):
                docs, ids = unpack(data.as_py(), table)
                n = np.array([k for _, k in docs], dtype=np.int64)
                end = np.cumsum(n)
                raw = ids.astype("<u4").tobytes()
                start = int(starts.value[part.as_py()]) + before.as_py()
                for lo in range(0, len(docs), 2000):
                    hi = min(len(docs), lo + 2000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d for d, _ in docs[lo:hi]], pa.int64()), pa.array(start + end[lo:hi] - n[lo:hi]), pa.array(n[lo:hi]),
                         pa.array([raw[4 * (e - k) : 4 * e] for e, k in zip(end[lo:hi].tolist(), n[lo:hi].tolist())], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return shards.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def digest(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32."""
    return store.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
