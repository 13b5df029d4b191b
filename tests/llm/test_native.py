import random
import re
from collections import Counter

from foliospark.llm import license_scan, quality_rules

SPACE = "[\x20\x09-\x0d]"


def brute_quality(text):
    text = text or ""
    w = [x for x in re.split(SPACE + "+", text) if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(odd_docs, no_docs):
    got = quality_rules.measure(odd_docs, keep=("doc_id", "text")).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(r.text)
        assert r.kept == (r.failed == "")
    assert quality_rules.measure(no_docs).count() == 0


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def test_license_places(spark, odd_docs, no_docs):
    got = license_scan.scan(odd_docs).collect()
    assert len(got) == odd_docs.count()
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = Counter()
    for i, t in texts:
        w = words(t)
        at = [k for p, _ in license_scan.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word) for r in got) == want
    assert license_scan.scan(no_docs).count() == 0


def license_rows(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r) for r in license_scan.scan(docs).orderBy("doc_id").select("labels", "base_labels", "n_base", "score").collect()]


def test_license_method_allows_missing_words(spark):
    text = "x Permission is hereby granted, free of any charge, to any person obtaining a copy of this software y"
    row = license_rows(spark, [text])[0]
    assert row[:3] == ("mit", "", 0) and 0 < row[3] < 0.2


def test_whole_texts_and_notices_get_one_label(spark):
    """Each template is found whole, under its own label; of overlapping licenses the longest span stands."""
    texts = [f"start {t} end" for t, _ in license_scan.TEMPLATES]
    for (label, base, _, score), (_, want) in zip(license_rows(spark, texts), license_scan.TEMPLATES):
        assert set(label.split(",")) - set(filter(None, base.split(","))) <= {want} and want in label and score == 1
    agpl = next(t for t, label in license_scan.TEMPLATES if label == "agpl")
    share = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"
    both = agpl + " " * 3 + " and ".join(["filler"] * 30) + " Released under the MIT License"
    got = license_rows(spark, [agpl.replace("version 3", "version 3 only"), share, both, "Licensed under CC BY-NC 4.0", "five words of no license"])
    assert [r[:2] for r in got] == [("agpl", ""), ("cc-by-sa", ""), ("agpl,mit", "mit"), ("cc-by,cc-by-nc", "cc-by"), ("", "")]


def test_license_spans_equal_brute_force(spark):
    """Votes by diagonal, islands, verification and overlaps, in plain Python, on texts with edits, cuts and repeats."""
    rng, texts = random.Random(2), []
    for _ in range(60):
        out = []
        for _ in range(rng.randint(1, 4)):
            w = license_scan.template_words(rng.choice(license_scan.TEMPLATES)[0])
            a = rng.randrange(len(w))
            w = w[a : a + rng.randint(3, 60)]
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [rng.choice(["x", "the", "license"])] * rng.randint(0, 2) or ["y"]
            out += w + ["gap"] * rng.randint(0, 5)
        texts.append(" ".join(out))
    k, every = license_scan.K, license_scan.phrases()

    def brute(w):
        spans = []
        for n, exact, label, size, t in every:
            by = {}
            for i in range(len(w) - size + 1):
                for j in range(len(t) - size + 1):
                    if w[i : i + size] == t[j : j + size]:
                        by.setdefault(i - j, set()).add(j)
            islands, last = [], None
            for d in sorted(by):
                if exact or last is None or d - last > license_scan.SLACK:
                    islands.append([])
                islands[-1].append(d)
                last = d
            total = len(t) - size + 1
            for ds in islands:
                found = len(set().union(*(by[d] for d in ds)))
                lo, hi = min(d + min(by[d]) for d in ds), max(d + max(by[d]) for d in ds) + size - 1
                if found == total if exact else found >= min(license_scan.GRAMS, total) and found >= license_scan.DENSITY * (hi - lo - size + 2):
                    spans.append((exact, found, found / total, -n, label, lo, hi))
        better = lambda t, s: not t[0] and t[5] <= s[6] and s[5] <= t[6] and t[1:4] > s[1:4]
        kept = [s for s in spans if s[0] or not any(better(t, s) for t in spans)]
        return sorted((s[4], s[0], s[5], s[6], s[1]) for s in kept)

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in license_scan.spans(docs).collect():
        got.setdefault(r.doc_id, []).append((r.label, r.exact, r.first_word, r.last_word, r.n_found))
    assert k == 5 and {i: sorted(got.get(i, [])) for i in range(len(texts))} == {i: brute(t.split()) for i, t in enumerate(texts)}
