"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); by the sum-of-squares identity, the pairs are
half the sum over factors of (sum v_if x_i)^2 - sum (v_if x_i)^2, so a document takes time linear in its features.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import WORD_BYTES
from foliospark.llm.labelled import fold, training_sample

#: At most so many labelled documents are learned from.
TRAIN_ROWS = 6000
BUCKETS, FACTORS, EPOCHS, RATE, DECAY = 1 << 15, 8, 5, 0.1, 1e-5
_SYMBOLS, _MARKS, _DIGITS, _CAPITALS = b"#*$%&|<>", b".,;:!?", b"0123456789", bytes(range(65, 91))
_NON_ASCII = bytes(range(128, 256))


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and weights of the words (of length 1 together), and the dense statistics."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(WORD_BYTES).split()
    counts = Counter(words)
    at = np.fromiter((zlib.crc32(w) & (BUCKETS - 1) for w in counts), dtype=np.int64, count=len(counts))
    weight = 1 + np.log(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    if len(at):
        weight /= np.sqrt((weight**2).sum())
    n, tokens, lines = max(len(raw), 1), raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    share = lambda chars: 1 - len(raw.translate(None, chars)) / n if raw else 0.0
    m = max(len(words), 1)
    dense = np.array(
        [
            np.log1p(len(words)), np.log1p(len(text) if n_chars is None else max(n_chars, 0)), sum(map(len, words)) / m,
            len(counts) / m, max(counts.values(), default=0) / m, sum(len(w) <= 3 for w in words) / m, share(_SYMBOLS),
            share(_MARKS), share(_DIGITS), share(_CAPITALS), share(_NON_ASCII),
            len(set(lines)) / max(len(lines), 1), np.log1p(len(tokens) / max(len(lines), 1)),
            len(set(zip(tokens, tokens[1:]))) / max(len(tokens) - 1, 1),
        ]
    )
    return at, weight, dense


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def row(self, text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        at, weight, dense = features(text, n_chars)
        scaled = np.clip((dense - self.mean) / self.spread, -4, 4) / 2
        return np.r_[at, BUCKETS + np.arange(len(scaled))], np.r_[weight, scaled]

    def score(self, text: str, n_chars: int | None = None) -> float:
        at, x = self.row(text, n_chars)
        terms = self.factors[at] * x[:, None]
        pairs = 0.5 * ((terms.sum(0) ** 2) - (terms**2).sum(0)).sum()
        z = self.bias + float(self.weights[at] @ x) + float(pairs)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], seed: int = 0) -> Model:
    """Logistic loss by Adagrad over batches of 64. rows: buckets, weights and statistics, and the label.

    Without any row, or with labels of one class only, the score is the smoothed share of label 1.
    """
    y = np.array([r[3] for r in rows], dtype=np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    width = len(features("", None)[2])
    dense = np.array([r[2] for r in rows]).reshape(-1, width)
    rng = np.random.default_rng(seed)
    total = BUCKETS + width
    mean, spread = (dense.mean(0), dense.std(0) + 1e-6) if len(rows) else (np.zeros(width), np.ones(width))
    model = Model(float(np.log(share / (1 - share))), np.zeros(total), np.zeros((total, FACTORS)), mean, spread)
    if len(set(y.tolist())) < 2:
        return model
    model.factors = rng.normal(0, 0.02, (total, FACTORS))
    scaled = np.clip((dense - mean) / spread, -4, 4) / 2
    at = [np.r_[r[0], BUCKETS + np.arange(width)] for r in rows]
    x = [np.r_[r[1], s] for r, s in zip(rows, scaled)]
    seen_w, seen_v, seen_b = np.full(total, 1e-6), np.full((total, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            batch = order[lo : lo + 64]
            index, value = np.concatenate([at[i] for i in batch]), np.concatenate([x[i] for i in batch])
            size = np.array([len(at[i]) for i in batch])
            start = np.cumsum(size) - size
            v = model.factors[index]
            terms = v * value[:, None]
            sums = np.add.reduceat(terms, start)
            z = model.bias + np.add.reduceat(model.weights[index] * value, start)
            z += 0.5 * (sums**2 - np.add.reduceat(terms**2, start)).sum(1)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]
            each = np.repeat(error, size)
            slots, where = np.unique(index, return_inverse=True)
            grad_w = np.bincount(where, each * value, len(slots)) + DECAY * model.weights[slots]
            of_v = each[:, None] * value[:, None] * (np.repeat(sums, size, axis=0) - terms)
            grad_v = np.stack([np.bincount(where, of_v[:, f], len(slots)) for f in range(FACTORS)], axis=1)
            grad_v += DECAY * model.factors[slots]
            seen_w[slots] += grad_w**2
            seen_v[slots] += grad_v**2
            seen_b += error.sum() ** 2
            model.weights[slots] -= RATE * grad_w / np.sqrt(seen_w[slots])
            model.factors[slots] -= RATE / 2 * grad_v / np.sqrt(seen_v[slots])
            model.bias -= RATE * error.sum() / np.sqrt(seen_b)
    return model


def _with_n_chars(docs: DataFrame) -> DataFrame:
    return docs if "n_chars" in docs.columns else docs.withColumn("n_chars", F.lit(None).cast("long"))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """Fitted on at most ``limit`` labelled rows whose fold of three isn't 1, featurised by the executors."""
    sample = training_sample(_with_n_chars(docs), labels, "quality", fold(3) != 1, limit, ("n_chars",))

    def run(batches):
        for batch in batches:
            made = [features(t.as_py(), n.as_py()) for t, n in zip(batch.column("text"), batch.column("n_chars"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("y").cast(pa.int32()),
                 pa.array([m[0].astype("<i4").tobytes() for m in made], pa.binary()),
                 pa.array([m[1].astype("<f4").tobytes() for m in made], pa.binary()),
                 pa.array([m[2].tobytes() for m in made], pa.binary())], names=["doc_id", "y", "at", "weight", "dense"]
            )

    # ``limit`` rows of at most one entry for each bucket.
    rows = sample.mapInArrow(run, "doc_id bigint, y int, at binary, weight binary, dense binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.at), bytes(r.weight)))
    return fit(
        [(np.frombuffer(r.at, "<i4").astype(np.int64), np.frombuffer(r.weight, "<f4").astype(np.float64), np.frombuffer(r.dense), r.y) for r in rows]
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted.

    Null and empty texts have no words and zero statistics, and a score of their own; a null ``n_chars`` counts as the
    length of the text. Repeated rows each have their row. A text takes time and memory linear in its length.
    """
    # 2.4 MB, whatever the data; plain arrays, which workers read without this package.
    parts = (model.bias, model.weights, model.factors, model.mean, model.spread)
    sent = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        model = Model(*sent.value)
        for batch in batches:
            made = [
                model.score(t.as_py() or "", n.as_py()) for t, n in zip(batch.column("text"), batch.column("n_chars"))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(made, pa.float64())],
                names=["doc_id", "held_out", "score"],
            )

    ready = _with_n_chars(docs).select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), (fold(3) == 1).alias("held_out"))
    made = ready.mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
