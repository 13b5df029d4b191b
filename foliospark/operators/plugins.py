"""Models as callbacks: embedding, re-ranking, rewriting. Batches go to the callback; what it returns is checked."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

Embed = Callable[[list[str]], np.ndarray]


def hashing_embedder(dims: int = 256) -> Embed:
    """Our stand-in without a model: signed hashed words, of length 1."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for k, text in enumerate(texts):
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[k, h % dims] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def embedded(texts: DataFrame, embed: Embed, dims: int, column: str = "text", prefix: str = "", batch: int = 32) -> DataFrame:
    """``texts`` and their ``embedding``; a callback that returns another shape, or no number, fails the job."""
    schema = T.StructType([*texts.schema, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches):
        for b in batches:
            rows = []
            values = [prefix + (t or "") for t in b.column(column).to_pylist()]
            for lo in range(0, len(values), batch):
                got = np.asarray(embed(values[lo : lo + batch]), dtype=np.float32)
                if got.shape != (len(values[lo : lo + batch]), dims) or not np.isfinite(got).all():
                    raise ValueError(f"the embedder returned {got.shape} for {len(values[lo:lo + batch])} texts of {dims} dimensions")
                rows += got.tolist()
            yield b.append_column("embedding", pa.array(rows, pa.list_(pa.float32())))

    return texts.mapInArrow(run, schema)


def reranked(candidates: DataFrame, score: Callable[[str, list[str]], list[float]], pool: int = 32, keep: int = 8) -> DataFrame:
    """The first ``pool`` of each query (query_id, question, rank, chunk_id, text) by the callback's score, ``keep`` of them.

    Ties, and passages that the callback gives no finite score, keep their order after the others.
    """
    kinds = dict(candidates.dtypes)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").head(pool)
        got = np.array(score(pdf.question.iloc[0], pdf.text.tolist()), dtype=float)
        got = np.where(np.isfinite(got), got, -np.inf)
        best = np.argsort(-got, kind="stable")[:keep]
        return pd.DataFrame({"query_id": pdf.query_id.to_numpy()[best], "chunk_id": pdf.chunk_id.to_numpy()[best], "position": np.arange(1, len(best) + 1)})

    return candidates.groupBy("query_id").applyInPandas(of, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, position int")


def rewritten(queries: DataFrame, rewrite: Callable[[str], str]) -> DataFrame:
    """``queries`` and ``rewritten``: the callback's text if it keeps the numbers and codes of the question, else the question."""

    @F.pandas_udf(T.StringType())
    def one(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hard = lambda t: set(re.findall(r"\S*\d\S*", t))
        for s in texts:
            made = [rewrite(t) if t else t for t in s]
            yield pd.Series([m if m and t and hard(t.rstrip("?.! ")) <= hard(m) | {x.rstrip("?.!") for x in hard(m)} else t for t, m in zip(s, made)])

    return queries.withColumn("rewritten", one("text"))


def prototypes(vectors: DataFrame, labelled: DataFrame, floor: float = 0.62, margin: float = 0.02) -> DataFrame:
    """query_id, label, score: the class of largest cosine, null below the floor or within the margin of the next."""
    from foliospark.operators.retrieval import nearest

    best = nearest(labelled, vectors, "id", 1, also="label", each=1)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "label")
    first = best.withColumns({"n": F.row_number().over(w), "next": F.lead("score").over(w)}).filter("n = 1")
    sure = (F.col("score") >= floor) & (F.coalesce(F.col("score") - F.col("next"), F.lit(1.0)) >= margin)
    return first.select("query_id", F.when(sure, F.col("label")).alias("label"), "score")


def recognised(pages: DataFrame, recognise: Callable[[list[bytes | None]], list[list[tuple[str, float]]]], batch: int = 8) -> DataFrame:
    """document_id, page, line, text, confidence: what a recogniser reads on images of pages, ``batch`` at a time.

    The callback returns a list of (text, confidence) for each image; another number of lists fails the job.
    """
    kind = pa.schema([("document_id", pa.string()), ("page", pa.int32()), ("line", pa.int32()), ("text", pa.string()), ("confidence", pa.float64())])

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            for lo in range(0, len(rows), batch):
                part = rows[lo : lo + batch]
                found = recognise([r["image"] for r in part])
                if len(found) != len(part):
                    raise ValueError(f"the recogniser returned {len(found)} lists for {len(part)} images")
                out = [(str(r["document_id"]), r["page"], k, text, float(c)) for r, lines in zip(part, found) for k, (text, c) in enumerate(lines)]
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, x)) for x in out], schema=kind)

    return pages.select("document_id", "page", "image").mapInArrow(run, "document_id string, page int, line int, text string, confidence double")


def harness(cases: DataFrame, **steps: Callable[[str], object]) -> DataFrame:
    """case_id, kind, result (JSON), seconds: each case run by the callable of its kind: retrieve, aggregate or generate.

    cases: case_id, question, kind; a kind without a callable fails the job, a null question is empty.
    """
    kind = dict(cases.dtypes)["case_id"]

    def run(batches):
        import json
        import time

        for b in batches:
            out = []
            for r in b.to_pylist():
                began = time.perf_counter()
                result = json.dumps(steps[r["kind"]](r["question"] or ""), ensure_ascii=False)
                out.append((r["case_id"], r["kind"], result, time.perf_counter() - began))
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], b.schema.field("case_id").type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.float64())],
                names=["case_id", "kind", "result", "seconds"],
            )

    return cases.select("case_id", "question", "kind").mapInArrow(run, f"case_id {kind}, kind string, result string, seconds double")


def parsed_by(files: DataFrame, adapters: dict[str, Callable[[bytes], list[str]]]) -> DataFrame:
    """adapter, document_id, line, text, error: every file by every adapter, so that parsers can be compared.

    A file that an adapter can't read is a row with the error; it doesn't fail the job.
    """
    kind = pa.schema([("adapter", pa.string()), ("document_id", pa.string()), ("line", pa.int32()), ("text", pa.string()), ("error", pa.string())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                out = []
                for name, parse in adapters.items():
                    try:
                        out += [(name, str(r["document_id"]), k, text, None) for k, text in enumerate(parse(bytes(r["content"] or b"")))]
                    except Exception as e:  # an adapter's failure is its result
                        out.append((name, str(r["document_id"]), None, None, f"{type(e).__name__}: {e}"))
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, x)) for x in out], schema=kind)

    return files.select("document_id", "content").mapInArrow(run, "adapter string, document_id string, line int, text string, error string")
