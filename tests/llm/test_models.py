import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from foliospark.llm import labelled as labelled_rows
from foliospark.llm import quality_model, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    common, bad = [f"w{i}" for i in range(60)], ["grimble", "snorfing", "blathurst"]
    rows, labels = [], []
    for i in range(900):
        toxic, good = i % 4 == 0, i % 3 != 0
        w = [rng.choice(common) for _ in range(rng.randint(20, 60))]
        if toxic:
            w[5:5] = rng.sample(bad, 2)
        if not good:
            w = [x + "###" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), int(toxic)))
    labels += [(None, 1, 1), (0, None, None), (5000, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def right(scores, labels, name):
    truth = {r.doc_id: r[name] for r in labels.collect() if r[name] is not None}
    held = [(r.predicted, truth[r.doc_id]) for r in scores.collect() if r.held_out]
    return sum(a == b for a, b in held) / len(held)


def test_quality_model(labelled, odd_docs, no_docs):
    docs, labels = labelled
    model = quality_model.train(docs, labels)
    assert right(quality_model.score(docs, model), labels, "quality") > 0.95
    got = quality_model.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_model.score(no_docs, quality_model.train(no_docs, labels)).count() == 0
    blank = quality_model.train(docs, labels.limit(0))
    assert {r.score for r in quality_model.score(docs.limit(3), blank).collect()} == {0.5}


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    width = len(quality_model.features("", None)[2])
    total = quality_model.BUCKETS + width
    m = quality_model.Model(0.1, rng.normal(0, 0.1, total), rng.normal(0, 0.1, (total, 4)), np.zeros(width), np.ones(width))
    at, x = m.row("a b c a", 7)
    z = 0.1 + m.weights[at] @ x + sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(m.score("a b c a", 7) - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity(labelled, odd_docs, no_docs):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    assert b"grimble" in model.toxic and b"grimble" not in model.ordinary
    assert right(toxicity.score(docs, model), labels, "toxic") > 0.9
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(no_docs, model).count() == 0
    blank = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs.limit(3), blank).collect()} == {0.5}


def test_share_of_non_ascii_bytes_at_every_size():
    for words in (10, 700, 1200, 1300, 5000, 30_000):
        text = "été abc " * words + "é" * words
        raw = text.encode()
        assert abs(quality_model.features(text, None)[2][10] - sum(b >= 128 for b in raw) / len(raw)) < 1e-9


def test_toxicity_windows():
    assert [w.split() for w in toxicity.windows(" ".join("abcdefghijklm"))] == [list(x.encode()[i : i + 1] for i in range(len(x))) for x in ("abcdef", "ghijkl", "m")]


def test_toxicity_against_brute_force(labelled, odd_docs):
    """Every window of every text compressed afresh, with compressors made here from the model's two dictionaries."""
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    assert model.toxic.endswith(model.ordinary[-2000:]) and len(model.toxic) > len(model.ordinary)

    def length(dictionary, window):
        held = zstandard.ZstdCompressionDict(dictionary)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    both = docs.select("doc_id", "text").limit(40).unionByName(odd_docs.select("doc_id", "text"))
    want = []
    for r in both.collect():
        words = (r.text or "").encode().lower().split()
        gains = [length(model.ordinary, w) - length(model.toxic, w) for w in (b" " + b" ".join(words[i : i + 6]) + b" " for i in range(0, len(words), 6))]
        over = [sum(min(g, toxicity.SLOTS) >= t for g in gains) for t in model.thresholds]
        n = max(len(gains), 1)
        row = [min(max([0, *gains]), toxicity.SLOTS), sum(gains) / n, *(math.log(1 + x) for x in over), *((x / n) ** 0.5 for x in over)]
        want.append((r.doc_id, round(model.score(row), 9)))
    got = [(r.doc_id, round(r.score, 9)) for r in toxicity.score(both, model).collect()]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert order(got) == order(want)


def test_training_sample_is_bounded(spark):
    """An id with many texts gives at most ``limit`` rows, always the same ones."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    made = [sorted(r.text for r in labelled_rows.training_sample(docs, labels, "toxic", F.lit(True), n).collect()) for n in (10, 10, 100)]
    assert len(made[0]) == 10 and made[0] == made[1] and len(made[2]) == 51


def test_factorisation_machine_learns_interactions():
    """A label that is one word or the other but not both: no weights of single words can tell it, pairs can."""
    rng = np.random.default_rng(1)
    width = len(quality_model.features("", None)[2])

    def row():
        a, b = rng.integers(0, 2, 2)
        return np.array([10 + a, 20 + b]), np.full(2, 2**-0.5), rng.normal(0, 0.01, width), int(a != b)

    model = quality_model.fit([row() for _ in range(3000)])
    right = 0
    for at, x, dense, y in (row() for _ in range(300)):
        at, x = np.r_[at, quality_model.BUCKETS + np.arange(width)], np.r_[x, np.clip((dense - model.mean) / model.spread, -4, 4) / 2]
        pairs = sum(model.factors[i] @ model.factors[j] * x[p] * x[q] for p, i in enumerate(at) for q, j in enumerate(at) if p < q)
        right += (model.bias + model.weights[at] @ x + pairs > 0) == bool(y)
    assert right > 285
