"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of the same text class are one representative. Their bits are cut into partitions, correlated bits
together, and each partition i gets a threshold t(i): -1 (not probed), 0 (equal) or 1 (one bit may differ). Two
fingerprints that differ in at most D bits agree within t(i) in some partition whenever the sum of t(i) + 1 is D + 1
or more. Dynamic programming picks the thresholds, and the number of partitions, of least estimated work: signatures
written plus candidates compared, both estimated from bit statistics of all fingerprints. Signatures meet in buckets;
a bucket compares its members' whole fingerprints and returns a spanning forest of the links, not all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import LOWER_BYTES, drop_saved, keyed, saved, slices
from foliospark.llm.components import connected_components
from foliospark.llm.runs import gathered

#: Rows of a bucket that one task compares with each other; larger buckets are dealt out as pairs of blocks.
BUCKET_ROWS = 2000
#: Estimated seconds for one signature row and for one comparison.
SIGNATURE_S, COMPARE_S = 2e-6, 1e-8


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``shingle`` words; of fewer words, of the whole text; none without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    n = max(1, len(words) - shingle + 1) if words else 0
    one, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((one(join(words[i : i + shingle]), 42) for i in range(n)), dtype=np.uint64, count=n)


def fingerprint_bytes(text: str, shingle: int, words64: int = 1, distinct: bool = False) -> bytes:
    """``words64`` 64-bit words, most significant byte first: bit b is 1 if set in over half of the shingles' hashes.

    The first word's hash is XXH64 (seed 42) of the shingle; those of further words are mixed from it. ``distinct``:
    a repeated shingle counts once.
    """
    hashes = shingle_hashes(text, shingle)
    if distinct:
        hashes = np.unique(hashes)
    n = len(hashes)
    ones = np.zeros(64 * words64, dtype=np.int64)
    for lo in range(0, n, 8192):
        h = hashes[lo : lo + 8192]
        for k in range(words64):
            mixed = h if k == 0 else _mix(h + np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF))
            bits = np.unpackbits(mixed.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
            for at in range(0, len(bits), 255):
                ones[64 * k : 64 * k + 64] += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > n).tobytes()


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 3, words64: int = 1, distinct: bool = False) -> DataFrame:
    """doc_id, text_hash, fingerprint (binary) of each row. Null and empty texts: zero. Fewer words: the whole text."""

    def run(batches):
        for batch in batches:
            made = [fingerprint_bytes(t.as_py(), shingle, words64, distinct) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"), pa.array(made, pa.binary())],
                names=["doc_id", "text_hash", "fingerprint"],
            )

    return keyed(docs).mapInArrow(run, "doc_id bigint, text_hash bigint, fingerprint binary")


def _words(column) -> np.ndarray:
    """A binary column of equal lengths as rows of unsigned 64-bit words."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=">u8").astype(np.uint64).reshape(len(raw), -1)


@dataclass(frozen=True)
class Part:
    """Bits (numbered from the first word's most significant) and threshold of one partition."""

    bits: tuple[int, ...]
    threshold: int


def bit_statistics(prints: DataFrame, words64: int) -> tuple[int, np.ndarray]:
    """Rows, and for each word the 64 x 64 counts of bits that are set together, over all fingerprints."""

    def run(batches):
        n, both = 0, np.zeros((words64, 64, 64))
        for batch in batches:
            rows = _words(batch.column("fingerprint"))
            n += len(rows)
            for k in range(words64):
                bits = np.unpackbits(rows[:, k : k + 1].astype(">u8").view(np.uint8), axis=1).astype(np.float32)
                both[k] += bits.T @ bits
        values = np.append(both.ravel(), n)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["slot", "value"]
            )

    # 4096 sums for each word, whatever the number of rows.
    summed = prints.select("fingerprint").mapInArrow(run, "slot int, value double").groupBy("slot").agg(
        F.sum("value").alias("value")
    )
    out = np.zeros(4096 * words64 + 1)
    for r in summed.collect():
        out[r.slot] = r.value
    return int(out[-1]), out[:-1].reshape(words64, 64, 64)


def _agreement(n: int, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chance that two fingerprints agree in a bit, in two bits, and the correlation of bits."""
    n = max(n, 1)
    p11 = both / n
    p = np.diag(p11)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return p**2 + (1 - p) ** 2, p11**2 + p10**2 + p01**2 + p00**2, np.abs((p11 - np.outer(p, p)) / np.outer(spread, spread))


def _grouped(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size; each group grows by the bit most correlated with it."""
    free, out = list(range(len(correlation))), []
    for k in range(parts):
        size = len(free) // (parts - k)
        of_free = correlation[np.ix_(free, free)].sum(1)
        group = [free.pop(int(of_free.argmax()))]
        while len(group) < size:
            group.append(free.pop(int(correlation[np.ix_(group, free)].sum(0).argmax())))
        out.append(group)
    return out


def _pairs_estimate(n: int, group: list[int], one: np.ndarray, two: np.ndarray) -> float:
    """Pairs of n fingerprints that agree in a group of bits: a chain of the pairwise agreements."""
    chance = one[group[0]]
    for a, b in pairwise(group):
        chance *= two[a, b] / max(one[a], 1e-12)
    return n * (n - 1) / 2 * chance


def allocate(options: list[list[tuple[int, float]]], n: int, need: int) -> tuple[float, list[int]]:
    """Thresholds of least work with sum(t + 1) >= need. options: (width, estimated pairs) of each partition."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for width, pairs in options:
        after: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, chosen) in best.items():
            for t in (-1, 0, 1):
                probes = (0, 1, 1 + width)[t + 1]
                total = cost + probes * (n * SIGNATURE_S + pairs * COMPARE_S)
                got = min(need, have + t + 1)
                if got not in after or total < after[got][0]:
                    after[got] = (total, [*chosen, t])
        best = after
    return best.get(need, (float("inf"), []))


def plan(n: int, both: np.ndarray, max_distance: int, parts_per_word: tuple[int, ...]) -> list[Part]:
    """Partitions and thresholds. With one number in ``parts_per_word``, that many partitions, else the cheapest number.

    The guarantee reaches ``max_distance`` bits if the partitions can carry it; else as far as thresholds of 0 reach,
    and beyond that links are found with the chance that any partition agrees.
    """
    best: tuple[float, list[Part]] = (float("inf"), [])
    for count in parts_per_word:
        groups, options = [], []
        for k, counts in enumerate(both):
            one, two, correlation = _agreement(n, counts)
            for g in _grouped(correlation, count):
                groups.append([64 * k + b for b in g])
                options.append((len(g), _pairs_estimate(n, g, one, two)))
        need = min(max_distance + 1, 2 * len(groups)) if max_distance < 2 * len(groups) else len(groups)
        cost, chosen = allocate(options, n, need)
        if cost < best[0]:
            best = (cost, [Part(tuple(g), t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


def drawn(words64: int, width: int, rounds: int, seed: int = 0) -> list[Part]:
    """Partitions of threshold 0: ``rounds`` times, all bits in random order cut into partitions of ``width`` bits."""
    rng, bits = np.random.default_rng(seed), 64 * words64
    orders = [rng.permutation(bits).tolist() for _ in range(rounds)]
    return [Part(tuple(o[i : i + width]), 0) for o in orders for i in range(0, bits - width + 1, width)]


def _signatures(prints: DataFrame, parts: list[Part], words: int | None = None) -> DataFrame:
    """(bucket, node, fingerprint): a row for each partition, and for each of its bits flipped where t is 1.

    With t = 1, values that differ in one bit meet in the bucket of either value. ``words``: so many 64-bit words of the
    fingerprint go along, for comparing.
    """
    parts = list(parts)

    def run(batches):
        for batch in batches:
            rows = _words(batch.column("fingerprint"))
            bits = np.unpackbits(rows.astype(">u8").view(np.uint8), axis=1).reshape(len(rows), -1)
            keys, at = [], []
            every = np.arange(len(rows))
            for k, part in enumerate(parts):
                weights = np.left_shift(np.uint64(1), np.arange(len(part.bits), dtype=np.uint64))
                value = bits[:, list(part.bits)].astype(np.uint64) @ weights
                seed = np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                for flip in [np.uint64(0), *(weights if part.threshold else ())]:
                    keys.append(_mix(_mix(value ^ flip) + seed).view(np.int64))
                    at.append(every)
            if len(rows) and keys:
                where, bucket = np.concatenate(at), np.concatenate(keys)
                sent = batch.column("fingerprint")
                if words is not None:
                    sent = pa.array([r.tobytes() for r in rows[:, :words].astype(">u8")], pa.binary())
                for lo in range(0, len(where), 200_000):
                    take = pa.array(where[lo : lo + 200_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket[lo : lo + 200_000]), batch.column("node").take(take), sent.take(take)],
                        names=["bucket", "node", "fingerprint"],
                    )

    return prints.select("node", "fingerprint").mapInArrow(run, "bucket bigint, node bigint, fingerprint binary")


def _forest(max_distance: int):
    """Streams rows sorted by bucket; returns edges that connect what is linked within each bucket."""

    def near(a, b):
        return np.bitwise_count(a ^ b).sum(axis=-1) <= max_distance

    def links(bucket, node, prints):
        out_u, out_v = [], []
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(bucket)])
        size_of = np.repeat(sizes, sizes)
        few = np.flatnonzero((size_of > 1) & (size_of <= 32))
        if len(few):
            b, rows, ids = bucket[few], prints[few], node[few]
            parent: dict[int, int] = {}

            def root(x):
                while (up := parent.get(x, x)) != x:
                    parent[x] = x = parent.get(up, up)
                return x

            for d in range(1, 32):
                same = np.flatnonzero(b[:-d] == b[d:]) if len(b) > d else np.zeros(0, dtype=np.int64)
                if not len(same):
                    break
                hit = same[near(rows[same], rows[same + d])]
                for x, y in zip(ids[hit].tolist(), ids[hit + d].tolist()):
                    rx, ry = root(x), root(y)
                    if rx != ry:
                        parent[max(rx, ry)] = min(rx, ry)
                        out_u.append(x)
                        out_v.append(y)
        for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
            ids, rows = node[s : s + n], prints[s : s + n]
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], rows[order]
            left = np.ones(n, dtype=bool)
            for first in range(n):
                if not left[first]:
                    continue
                left[first] = False
                todo = [first]
                while todo:
                    x = todo.pop()
                    rest = np.flatnonzero(left)
                    new = rest[near(rows[rest], rows[x])]
                    left[new] = False
                    todo += new.tolist()
                    out_u += [int(ids[first])] * len(new)
                    out_v += ids[new].tolist()
        return out_u, out_v

    def run(batches):
        kept = None
        for batch in batches:
            part = (
                batch.column("bucket").to_numpy(), batch.column("node").to_numpy(), _words(batch.column("fingerprint"))
            )
            if not len(part[0]):
                continue
            part = part if kept is None else tuple(np.concatenate(x) for x in zip(kept, part))
            cut = int(np.searchsorted(part[0], part[0][-1]))  # the last bucket may go on
            kept = tuple(x[cut:] for x in part)
            if cut:
                yield edges(*links(*(x[:cut] for x in part)))
        if kept is not None:
            yield edges(*links(*kept))

    def edges(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def links(
    nodes: DataFrame, max_distance: int, parts: list[Part], bucket_rows: int = BUCKET_ROWS, words: int | None = None
) -> DataFrame:
    """(u, v): edges between linked nodes that connect all linked ones. nodes: node (unique), fingerprint (unique)."""
    return _dealt(_signatures(nodes, parts, words), bucket_rows).mapInArrow(_forest(max_distance), "u bigint, v bigint")


def _dealt(rows: DataFrame, most: int, weight: str | None = None) -> DataFrame:
    """Rows dealt out and sorted by bucket.

    A bucket of more than ``most`` rows (or more in the sum of the column ``weight``) is cut into blocks by node, and each
    pair of blocks compared in a bucket of its own: every pair of rows still meets, and no task gets more than two blocks.
    """
    names = rows.columns[1:]
    total = F.sum(weight) if weight else F.count("*")
    hot = saved(rows.groupBy("bucket").agg(total.alias("total")).filter(F.col("total") > most), "hot_buckets")
    if not hot.isEmpty():
        blocks = F.ceil(F.coalesce(F.col("total"), F.lit(0)) / (most // 2)).cast("long")
        rows = rows.join(hot, "bucket", "left").withColumn("blocks", blocks)
        own = F.pmod(F.xxhash64("node"), F.col("blocks"))
        rows = rows.withColumn("own", F.when(F.col("blocks") > 0, own)).withColumn(
            "other",
            F.explode(F.when(F.col("blocks") > 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(
                F.array(F.lit(-1).cast("long")))),
        )
        paired = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
        rows = rows.select(F.when(F.col("other") < 0, F.col("bucket")).otherwise(paired).alias("bucket"), *names)
    return rows.repartition(F.col("bucket")).sortWithinPartitions("bucket")


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    max_distance: int = 3,
    words64: int = 1,
    parts_per_word: tuple[int, ...] = (2, 3, 4, 5, 6),
) -> DataFrame:
    """One row for each input row: doc_id, text_hash, fingerprint (binary), component_id.

    Fingerprints link at ``max_distance`` or fewer differing bits, and ``component_id`` is the smallest doc_id reachable
    by links, the document's own included. Equal fingerprints are one node, so copies make no pairs. Null and empty
    texts have fingerprint zero and link like others. Rows of null doc_id take part in no link of their own: they get
    the component of documents with the same fingerprint, or null. Repeated rows and ids each keep their row; an empty
    table gives an empty one.
    """
    prints = saved(fingerprints(docs, shingle, words64), "fingerprints")
    classes = saved(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "classes")
    nodes = classes.filter("node IS NOT NULL")
    n, both = bit_statistics(nodes, words64)
    # One document id can have several texts, and so stand for several fingerprints; they share its component.
    parts = plan(n, both, max_distance, parts_per_word)
    found = connected_components(links(nodes, max_distance, parts))
    of_class = saved(
        classes.join(found.withColumnRenamed("node", "found_node"), F.col("node") == F.col("found_node"), "left").select(
            F.col("fingerprint").alias("class_print"), F.coalesce("component", "node").alias("component_id")
        ),
        "components",
    )
    return prints.join(of_class, F.col("fingerprint") == F.col("class_print")).drop("class_print")


#: Shingles of a group whose texts one task compares with each other.
GROUP_SHINGLES = 4_000_000


def similar_pairs(members: list[np.ndarray]) -> list[tuple[int, int]]:
    """(i, j) of sets of numbers whose Jaccard similarity is 0.8 or more, as many as connect all that are linked.

    Each set is compared with all later ones that no link joins to it yet.
    """
    size = np.array([len(m) for m in members])
    _, flat = np.unique(np.concatenate(members), return_inverse=True) if size.sum() else (None, np.zeros(0, np.int64))
    start, class_of, out = np.cumsum(size) - size, np.arange(len(members)), []
    here = np.zeros(flat.max(initial=-1) + 1, np.int32)
    for i in range(len(members) - 1):
        # In whole numbers: shared / (a + b - shared) >= 4 / 5, which sizes further apart than that can't reach.
        rest = size[i + 1 :]
        js = i + 1 + np.flatnonzero((class_of[i + 1 :] != class_of[i]) & (5 * np.minimum(rest, size[i]) >= 4 * np.maximum(rest, size[i])))
        if not len(js) or not size[i]:
            continue
        own = flat[start[i] : start[i] + size[i]]
        here[own] = 1
        shared = np.add.reduceat(here[gathered(flat, start[js], size[js])], np.cumsum(size[js]) - size[js])
        here[own] = 0
        for j in js[9 * shared >= 4 * (size[i] + size[js])].tolist():
            if class_of[j] != class_of[i]:
                out.append((i, j))
                class_of[class_of == class_of[j]] = class_of[i]
    return out


def _verified(batches):
    """Streams rows (bucket, node, shingles) sorted by bucket; returns links that connect what is similar in a bucket."""

    def links(nodes, sets):
        found = similar_pairs(sets)
        return pa.RecordBatch.from_arrays(
            [pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], names=["u", "v"]
        )

    now, nodes, sets = None, [], []
    for batch in batches:
        columns = batch.column("bucket").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles")
        for bucket, node, shingles in zip(*columns):
            if bucket != now:
                if len(nodes) > 1:
                    yield links(nodes, sets)
                now, nodes, sets = bucket, [], []
            nodes.append(node)
            sets.append(shingles.values.to_numpy())
    if len(nodes) > 1:
        yield links(nodes, sets)


def similar_groups(
    docs: DataFrame, shingle: int, words64: int, parts: list[Part], words: int, possible: int,
    bucket_rows: int = BUCKET_ROWS, group_shingles: int = GROUP_SHINGLES,
) -> DataFrame:
    """One row for each input row: doc_id, text_hash, fingerprint (binary, of different shingles), component_id.

    Fingerprints that share a partition and differ in at most ``possible`` of the first 64 * ``words`` bits may be near
    copies; what such pairs connect is a group. Within a group, texts are linked whose different shingles have a Jaccard
    similarity of 0.8 or more, each pair compared that no other link joins; no pair becomes a row. A group of more than
    ``group_shingles`` shingles is compared bucket by bucket of the partitions instead, large buckets in pairs of blocks.
    A node is a fingerprint, known by its hash, whatever ids its rows have; equal fingerprints are copies.
    ``component_id`` is a node's key. Null and empty texts are one node; an empty table gives an empty one.
    """

    def run(batches):
        for batch in batches:
            for part in slices([batch], 500):
                made = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(made, pa.list_(pa.int64()))], names=["node", "shingles"]
                )

    prints = saved(fingerprints(docs, shingle, words64, distinct=True), "fingerprints")
    made = prints.groupBy("fingerprint").agg(F.min("text_hash").alias("text_hash"))
    classes = saved(made.withColumn("node", F.xxhash64("fingerprint")), "classes")
    groups = saved(
        connected_components(links(classes, possible, parts, bucket_rows, words)).withColumnRenamed("component", "bucket"), "groups"
    )
    wanted = classes.select("node", "text_hash").join(groups, "node")
    texts = keyed(docs).select("text_hash", "text").join(wanted, "text_hash").dropDuplicates(["node"]).select("node", "text")
    sets = saved(texts.mapInArrow(run, "node bigint, shingles array<bigint>").withColumn("n", F.size("shingles")), "shingles")
    members = sets.join(groups, "node").select("bucket", "node", "shingles", "n")
    large = saved(members.groupBy("bucket").agg(F.sum("n").alias("total")).filter(F.col("total") > group_shingles).select("bucket"), "large")
    small = members
    found = []
    if not large.isEmpty():
        small = members.join(large, "bucket", "left_anti")
        of_large = classes.join(groups.join(large, "bucket"), "node").select("node", "fingerprint")
        # Buckets with several nodes only, so that few sets are sent.
        probes = _signatures(of_large, parts, 0).select("bucket", "node")
        several = probes.groupBy("bucket").count().filter("count > 1").select("bucket")
        rows = probes.join(several, "bucket").join(sets, "node").select("bucket", "node", "shingles", "n")
        found.append(_dealt(rows, group_shingles, "n"))
    found.append(small.select("bucket", "node", "shingles").repartition(F.col("bucket")).sortWithinPartitions("bucket"))
    linked = [rows.select("bucket", "node", "shingles").mapInArrow(_verified, "u bigint, v bigint") for rows in found]
    found = connected_components(reduce(DataFrame.unionByName, linked))
    for done in (groups, sets, large):
        drop_saved(done)
    of_class = saved(
        classes.join(found, "node", "left").select(
            F.col("fingerprint").alias("class_print"), F.coalesce("component", "node").alias("component_id")
        ),
        "components",
    )
    return prints.join(of_class, F.col("fingerprint") == F.col("class_print")).drop("class_print")
