import hashlib
import random
from collections import defaultdict

from foliospark.llm import decontaminate, line_dedup
from foliospark.llm.line_dedup import _stream

import pyarrow as pa


def brute_hits(text, items, window):
    w, hit, found = decontaminate.words_of(text), set(), set()
    for item, t in items:
        p = decontaminate.words_of(t)
        for i in range(max(1, len(p) - window + 1) if p else 0):
            g = p[i : i + window]
            for k in range(len(w) - len(g) + 1):
                if w[k : k + len(g)] == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(item)
    return len(w), len(hit), found


def test_wu_manber_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        word = lambda: rng.choice("a b c dd e".split())
        items = [(i, " ".join(word() for _ in range(rng.randint(0, 14)))) for i in range(6)]
        text = " ".join(word() for _ in range(300)) + " " + items[0][1]
        search = decontaminate.WuManber([(i, decontaminate.words_of(t)) for i, t in items], 5).search
        spans, found = search(decontaminate.words_of(text))
        n, hit, want = brute_hits(text, items, 5)
        assert (sum(e - s for s, e in spans), found) == (hit, want)


def test_decontaminate_in_blocks(spark, odd_docs, no_docs):
    bench = spark.createDataFrame(
        [(1, "Same LINE"), (2, None), (None, "no id at all"), (3, ""), (4, "number 7 same line"), (1, "same line")], "item_id long, text string"
    )
    one = decontaminate.digest(decontaminate.find(odd_docs, bench)).collect()
    many = decontaminate.digest(decontaminate.find(odd_docs, bench, block_bytes=30)).collect()
    assert sorted(map(str, one)) == sorted(map(str, many)) and len(one) == odd_docs.count()
    by = {r.doc_id: r for r in one}
    assert by[107].n_items == 2 and by[107].items_sha256 == hashlib.sha256(b"1,4").hexdigest() and by[None].contaminated
    assert decontaminate.find(no_docs, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.digest(decontaminate.find(odd_docs, bench.limit(0))).collect())


def brute_lines(rows, least):
    docs, keys = set(rows), defaultdict(set)
    norm = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x).strip(" \t\n\x0b\x0c\r")
    for i, t in docs:
        for x in (t or "").split("\n"):
            keys[norm(x)].add((i, t or ""))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not norm(x) or len(keys[norm(x)]) < least]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["hot", " HOT ", "b", f"u{rng.randint(0, 30)}", ""]) for _ in range(rng.randint(1, 9)))) for i in range(300)]
    for docs, rows in ((odd_docs, [(r.doc_id, r.text) for r in odd_docs.collect()]), (spark.createDataFrame(rows, "doc_id long, text string"), rows)):
        for least in (2, 10):
            got = line_dedup.digest(docs, line_dedup.keep_bitmaps(docs, least)).collect()
            assert sorted([tuple(r) for r in got], key=str) == brute_lines(rows, least)
    assert line_dedup.keep_bitmaps(no_docs).count() == 0


def test_first_occurrence_stays(spark):
    docs = spark.createDataFrame([(i, "same\nsame\nown %d" % i, "de") for i in range(40)], "doc_id long, text string, keep string")
    got = {r.doc_id: r.text for r in line_dedup.apply(docs, line_dedup.keep_bitmaps(docs, 10, keep_first=True)).collect()}
    assert got[0] == "same\nown 0" and all(got[i] == f"own {i}" for i in range(1, 40))


def test_runs_over_partition_edges():
    """Any cut of the sorted rows into partitions decides alike."""
    rows = [(h, h, d, 0, [0]) for h in range(4) for d in range(h * 4)]
    cols = lambda part: pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*part), [pa.int64()] * 4 + [pa.list_(pa.int32())])], names=["h1", "h2", "doc_id", "text_hash", "places"]
    )
    for cut in range(1, len(rows)):
        for cut2 in range(cut, len(rows) + 1, 3):
            out, edges, open_ = set(), defaultdict(int), []
            for part in (rows[:cut], rows[cut:cut2], rows[cut2:]):
                for b in _stream(6)(iter([cols(part)] if part else [])):
                    for r in b.to_pylist():
                        if r["state"] == "drop":
                            out.add((r["h1"], r["doc_id"]))
                        elif r["state"] == "edge":
                            edges[r["h1"]] += r["n_docs"]
                        else:
                            open_.append((r["h1"], r["doc_id"]))
            out |= {x for x in open_ if edges[x[0]] >= 6}
            assert out == {(h, d) for h in (2, 3) for d in range(h * 4)}
