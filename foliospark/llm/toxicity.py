"""Toxicity by compression distance: windows of text compressed with a dictionary of ordinary and one of toxic text.

zstandard trains both dictionaries: the ordinary one on all windows of ordinary documents, the toxic one on the toxic
passages of toxic documents. (All text of toxic documents is mostly ordinary; trained on that, or on the windows which a
first pair of dictionaries separates best, the pair told documents apart with an area under the curve of 0.6 to 0.83.
Passages are runs of byte grams that documents of toxic text hold far more often.) The toxic compressor has the toxic
dictionary before the ordinary one and the same entropy tables, so ordinary text finds the same matches at the same
price in both, and only toxic text is shorter with it. How many windows gain more than each of some thresholds, which
are quantiles of the gains of ordinary windows, is what a logistic regression weighs.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import LOWER_BYTES, keyed, per_process
from foliospark.llm.labelled import fold, training_sample

#: At most so many labelled documents are learned from, whole texts of them.
TRAIN_ROWS = 8000
WINDOW_WORDS, LEVEL, GRAM = 6, 12, 7
#: Sizes of the dictionaries, and of the segments of which the trainer makes them; of the toxic ones, the best is taken.
ORDINARY_BYTES, ORDINARY_SEGMENT, TOXIC_BYTES, TOXIC_SEGMENTS = 32_768, 64, 4096, (64, 96, 128, 192)
#: Least documents and log-likelihood ratio of a gram that marks toxic text.
GRAM_DOCUMENTS, GRAM_RATIO = 4, 20.0
#: Shares of the ordinary windows below each threshold; gains beyond the last slot count as that.
QUANTILES, SLOTS = (0.9, 0.97, 0.99, 0.997, 0.999, 0.9997), 15
_REMEMBERED = 200_000
#: Fixed value: the three repeat offsets that end the header of a trained dictionary, as its trainer writes them.
_HEADER_END = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def windows(text: str) -> list[bytes]:
    """Consecutive words, A-Z lower-cased, ``WINDOW_WORDS`` at a time, blanks at both ends."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    return [b" ".join([b"", *words[i : i + WINDOW_WORDS], b""]) for i in range(0, len(words), WINDOW_WORDS)]


def _joined(text: str) -> bytes:
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()) + b" "


def compressor(dictionary: bytes):
    """Compresses a window with a dictionary, trained (with its header) or plain content."""
    kind = zstandard.DICT_TYPE_FULLDICT if _HEADER_END in dictionary[:1024] else zstandard.DICT_TYPE_RAWCONTENT
    made = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False
    ).compress


class _Gains(dict):
    """Bytes that a window is shorter with the toxic dictionary, measured once while it is remembered."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic)

    def __missing__(self, window: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[window] = gain = len(self.ordinary(window)) - len(self.toxic(window))
        return gain


@dataclass
class Model:
    """``ordinary`` and ``toxic`` dictionaries; without both classes to learn from, ``share`` alone."""

    share: float
    ordinary: bytes = b""
    toxic: bytes = b""
    thresholds: tuple[int, ...] = ()
    center: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None

    def compressors(self) -> _Gains:
        return _Gains(self.ordinary, self.toxic)

    @staticmethod
    def counts(text: str, gains: _Gains) -> list[int]:
        """Windows, total of their gains, largest gain, and windows of each gain from 1 to ``SLOTS`` (or more)."""
        gain = np.array([gains[w] for w in windows(text)], dtype=np.int64)
        slots = np.bincount(np.minimum(gain[gain > 0], SLOTS), minlength=SLOTS + 1)[1:]
        return [len(gain), int(gain.sum()), int(gain.max(initial=0)), *slots.tolist()]

    def features(self, counts: list[int]) -> list[float]:
        n, total, most, *slots = counts
        over = [sum(slots[t - 1 :]) for t in self.thresholds]
        n = max(n, 1)
        return [min(most, SLOTS), total / n, *(np.log1p(x) for x in over), *((x / n) ** 0.5 for x in over)]

    def score(self, row: list[float]) -> float:
        z = np.append((np.array(row) - self.center) / self.spread, 1.0) @ self.weights
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def ratio(k1: np.ndarray, k0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-likelihood ratio of a gram in k1 of n1 toxic and k0 of n0 ordinary documents; 0 where it isn't more toxic."""
    p1, p0, p = (k1 + 0.5) / (n1 + 1), (k0 + 0.5) / (n0 + 1), (k1 + k0 + 0.5) / (n1 + n0 + 1)
    value = 2 * (
        k1 * np.log(p1 / p) + k0 * np.log(p0 / p) + (n1 - k1) * np.log((1 - p1) / (1 - p)) + (n0 - k0) * np.log((1 - p0) / (1 - p))
    )
    return np.where(p1 > p0, value, 0.0)


def _grams(batches):
    """Documents with each gram, of this task: pre-aggregated before they are dealt out."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        for y, counts in enumerate(seen):
            keys = list(counts)
            for lo in range(0, len(keys), 50_000):
                part = keys[lo : lo + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([y] * len(part), pa.int32()), pa.array([counts[k] for k in part], pa.int64())],
                    names=["gram", "y", "n"],
                )
            counts.clear()

    for batch in batches:
        for text, y in zip(batch.column("text"), batch.column("y").to_pylist()):
            raw = _joined(text.as_py())
            seen[int(y > 0)].update({raw[i : i + GRAM] for i in range(len(raw) - GRAM + 1)})
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield from out()
    yield from out()


def _passages(weights: dict[bytes, float]):
    """Maximal runs of marked grams in toxic documents, cut to whole words where they hold some."""

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column("text"):
                raw, out = _joined(text.as_py()), []
                i, end = 0, len(raw) - GRAM
                while i <= end:
                    if raw[i : i + GRAM] in weights:
                        j = i
                        while raw[j : j + GRAM] in weights:
                            j += 1
                        part = raw[i : j + GRAM - 1]
                        if part.count(b" ") > 1:
                            part = part[part.find(b" ") : part.rfind(b" ") + 1]
                        if len(part) >= GRAM:
                            out.append(part)
                        i = j
                    i += 1
                found.append(out)
            yield _rows(batch, found)

    return run


def _windows(batches):
    for batch in batches:
        yield _rows(batch, [windows(t.as_py()) for t in batch.column("text")])


def _rows(batch, samples: list[list[bytes]]):
    made = [batch.column("doc_id").cast(pa.int64()), pa.array([b"\n".join(x) for x in samples], pa.binary())]
    return pa.RecordBatch.from_arrays(made, names=["doc_id", "samples"])


def _samples(docs: DataFrame, of) -> list[bytes]:
    """What ``of`` makes of each document, on the driver, in order of the documents: trainers read samples as a stream.

    Samples hold no line feeds, as all white space in them is a blank.
    """
    rows = [(r.doc_id, bytes(r.samples)) for r in docs.select("doc_id", "text").mapInArrow(of, "doc_id bigint, samples binary").collect()]
    return [x for _, part in sorted(rows) for x in part.split(b"\n") if x]


def _trained(samples: list[bytes], size: int, segment: int, gram: int = 6) -> tuple[bytes, bytes]:
    """Header and content of a dictionary that zstandard trains; of too few samples, no header and the samples."""
    try:
        made = zstandard.train_dictionary(size, samples, k=segment, d=gram).as_bytes()
    except zstandard.ZstdError:
        return b"", (b"".join(samples) + bytes(range(32, 127)))[-size:]
    at = made.index(_HEADER_END) + len(_HEADER_END)
    return made[:at], made[at:]


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """Fitted on at most ``limit`` labelled rows whose fold of five isn't 0.

    The executors count grams, find passages, cut and measure windows; the driver gets marked grams, and the passages,
    windows and counts of the sample. Nulls and repeated rows are as ``training_sample`` leaves them.
    """
    sample = training_sample(docs, labels, "toxic", fold(5) != 0, limit)
    n = {r.y: r.n for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    share = (n1 + 1) / (n1 + n0 + 2)
    if not n1 or not n0:
        return Model(share)
    counted = sample.mapInArrow(_grams, "gram binary, y int, n bigint").groupBy("gram").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("k1"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("k0"),
    )
    # Marked grams only: far over their share in ordinary text.
    marked = counted.filter((F.col("k1") >= GRAM_DOCUMENTS) & (F.col("k1") * n0 > 2 * F.col("k0") * n1)).collect()
    value = ratio(np.array([r.k1 for r in marked], float), np.array([r.k0 for r in marked], float), n1, n0)
    weights = {bytes(r.gram): float(v) for r, v in zip(marked, value) if v >= GRAM_RATIO}
    header, base = _trained(_samples(sample.filter("y <= 0"), _windows), ORDINARY_BYTES, ORDINARY_SEGMENT)
    passages = _samples(sample.filter("y > 0"), _passages(weights))
    tried = dict.fromkeys(_trained(passages, TOXIC_BYTES, segment)[1] for segment in TOXIC_SEGMENTS)
    fitted = []
    for toxic in tried:
        model = Model(share, header + base, header + toxic + base)
        rows = _counted(sample, model, ("doc_id", "y"), "doc_id bigint, y int").collect()
        rows.sort(key=lambda r: (r.doc_id, r.counts))
        loss = _calibrated(model, [r.counts for r in rows], np.array([float(r.y > 0) for r in rows]))
        fitted.append((loss, len(fitted), model))
    return min(fitted)[2]


def _calibrated(model: Model, counts: list[list[int]], y: np.ndarray) -> float:
    """Gives the model thresholds of the gains, and weights by Newton steps of a logistic regression; its mean loss."""
    ordinary = np.array([c for c, label in zip(counts, y) if not label])
    per_slot = np.r_[ordinary[:, 0].sum() - ordinary[:, 3:].sum(), ordinary[:, 3:].sum(0)]
    below = np.cumsum(per_slot) / max(per_slot.sum(), 1)
    model.thresholds = tuple(sorted({min(SLOTS, max(1, int(np.searchsorted(below, q)))) for q in QUANTILES}))
    x = np.array([model.features(c) for c in counts])
    model.center, model.spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - model.center) / model.spread, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], 0.1), 0.0]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    model.weights = w
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _counted(docs: DataFrame, model: Model, keep: tuple[str, ...], kind: str) -> DataFrame:
    ordinary, toxic = model.ordinary, model.toxic

    def run(batches):
        gains = per_process(("toxicity", ordinary, toxic), lambda: _Gains(ordinary, toxic))
        for batch in batches:
            made = [Model.counts(t.as_py(), gains) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(made, pa.list_(pa.int64()))], names=[*keep, "counts"]
            )

    return docs.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in kind.split(", "))), "text").mapInArrow(
        run, f"{kind}, counts array<bigint>"
    )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted.

    Every window of the whole text counts. Null and empty texts have no windows and the score of no gain at all;
    repeated rows each have their row. Without labels of both classes, the score is the smoothed share of label 1.
    """
    ready = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold(5) == 0).alias("held_out"))
    if model.weights is None:
        made = ready.select("doc_id", "held_out", F.lit(float(model.share)).alias("score"))
    else:
        rows = _counted(ready, model, ("doc_id", "held_out"), "doc_id bigint, held_out boolean")
        at = lambda i: F.get("counts", F.lit(i)).cast("double")
        n = F.greatest(at(0), F.lit(1.0))
        over = [sum((at(k) for k in range(3 + t, 3 + SLOTS)), start=at(2 + t)) for t in model.thresholds]
        parts = [F.least(at(2), F.lit(float(SLOTS))), at(1) / n, *(F.log1p(x) for x in over), *(F.sqrt(x / n) for x in over)]
        z = F.lit(float(model.weights[-1]))
        for part, c, s, w in zip(parts, model.center, model.spread, model.weights):
            z = z + (part - float(c)) / float(s) * float(w)
        made = rows.select("doc_id", "held_out", (1 / (1 + F.exp(-z))).alias("score"))
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
