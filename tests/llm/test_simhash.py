import random

import numpy as np
import xxhash

from foliospark.llm import simhash
from foliospark.llm.components import connected_components


def slow_print(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", low) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprint_definition(odd_docs):
    for r in odd_docs.collect():
        assert int.from_bytes(simhash.fingerprint_bytes(r.text or "", 3), "big") == slow_print(r.text)


def test_links_equal_brute_force_with_hot_buckets(spark):
    rng = random.Random(6)
    centers = [rng.getrandbits(64) for _ in range(40)]
    prints = list({c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for c in centers for _ in range(30)})
    n = len(prints)
    arr = np.array(prints, dtype=np.uint64)
    pairs = [(i, int(j)) for i in range(n) for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 3) + i + 1]
    nodes = spark.createDataFrame([(i, p.to_bytes(8, "big")) for i, p in enumerate(prints)], "node long, fingerprint binary")
    total, both = simhash.bit_statistics(nodes, 1)
    assert total == n
    for parts in ((2,), (3,), (4,), (6,), (2, 3, 4, 5, 6)):
        chosen = simhash.plan(n, both, 3, parts)
        assert sum(p.threshold + 1 for p in chosen) >= 4
        for rows in (10, 2000):
            edges = [(r.u, r.v) for r in simhash.links(nodes, 3, chosen, rows).collect()]
            assert roots(n, edges) == roots(n, pairs)


def test_allocation_prefers_cheap_partitions():
    cost, chosen = simhash.allocate([(16, 1e12), (16, 1.0), (16, 1.0), (16, 1.0)], 1000, 4)
    assert sum(t + 1 for t in chosen) >= 4 and chosen[0] == -1 and cost > 0


def test_components_of_long_paths(spark):
    rng = random.Random(7)
    ids = rng.sample(range(10_000), 300)
    edges = list(zip(ids[:149], ids[1:150])) + [(x, x) for x in ids[:5]] + list(zip(ids[150:299], ids[151:300]))
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {x: min(ids[:150]) for x in ids[:150]} | {x: min(ids[150:]) for x in ids[150:]}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(bytes(r.fingerprint), set()).add(r.component_id)
    assert all(len(x) == 1 for x in by.values()) and by[bytes(8)] == {1}
    assert simhash.near_duplicates(no_docs).count() == 0


def test_near_duplicates_equal_brute_force_end_to_end(spark):
    """Fingerprints and components of whole documents against all pairs, copies, null and repeated ids included."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        texts.append(" ".join(text))
        for _ in range(rng.randint(0, 3)):
            copy = list(text)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [None, "", " ", "one", texts[0], texts[0]]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    prints = [slow_print(t) for t in texts]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root, least = roots(len(rows), pairs), {}
    for (doc, _), r in zip(rows, root):
        least[r] = min(doc, least.get(r, doc))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (int.from_bytes(r.fingerprint, "big"), r.component_id) for r in got} == {
        doc: (p, least[r]) for (doc, _), p, r in zip(rows, prints, root)
    }


def jaccard_roots(texts, k=5):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else {()})
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return pairs, roots(len(sets), pairs)


def test_similar_pairs_connect_what_is_similar():
    rng = np.random.default_rng(3)
    for _ in range(30):
        base = [rng.choice(400, rng.integers(1, 40), replace=False) for _ in range(6)]
        sets = [np.unique(np.r_[b[: max(1, len(b) - rng.integers(0, 6))], rng.integers(0, 400, rng.integers(0, 4))]) for b in base for _ in range(8)]
        want = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
        got = simhash.similar_pairs(sets)
        assert {(max(p), min(p)) for p in got} <= set(want) and roots(len(sets), got) == roots(len(sets), want)


def test_similar_groups_recall_and_precision(spark):
    """A drifting chain, a tight and a loose large group, copies and texts without words, in small and in large groups."""
    rng = random.Random(13)
    words = [f"v{i}" for i in range(2000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    texts = []
    for changes in (1, 2, 3, 5):  # from similar to hardly similar
        base = text(120)
        for _ in range(60):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    chain = text(100)
    for _ in range(30):
        chain = chain[3:] + text(3)
        texts.append(" ".join(chain))
    texts += [" ".join(text(40)) for _ in range(60)] + ["", None, "a b", "a b", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, want = jaccard_roots(texts)
    parts = simhash.drawn(8, 14, 2)
    for limit in (simhash.GROUP_SHINGLES, 400):
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs, 5, 8, parts, 4, 64, group_shingles=limit).collect()}
        assert sum(got[i] == got[j] for i, j in pairs) >= 0.99 * len(pairs)
        apart = {}
        for i, r in enumerate(want):
            apart.setdefault(got[i], set()).add(r)
        assert all(len(x) == 1 for x in apart.values())
    assert simhash.similar_groups(docs.limit(0), 5, 8, parts, 4, 64).count() == 0
