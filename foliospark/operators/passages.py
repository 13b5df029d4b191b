"""Where a passage stands in a text, snippets, degenerate and refusing answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import normalize

PREFIX, RUN, LEAST = 160, 12, 0.5
#: What an answer says when it has none.
REFUSALS = r"\b(?:i (?:cannot|can t|could not)|not (?:found|mentioned|stated|specified)|no information|je ne (?:peux|trouve)|pas (?:mentionne|precise|indique)|aucune information)\b"


def contains_passage(text: Column, passage: Column) -> Column:
    """1 if the normalised passage stands in the text, .5 and up if its first 160 characters or long runs do, else 0."""
    t, p = normalize(text), normalize(passage)
    runs = F.filter(F.transform(F.split(passage, r"[\n.;:]+"), lambda r: normalize(r)), lambda r: F.length(r) >= RUN)
    found = F.aggregate(F.filter(runs, lambda r: F.contains(t, r)), F.lit(0), lambda s, r: s + F.length(r))
    whole = F.aggregate(runs, F.lit(0), lambda s, r: s + F.length(r))
    share = F.coalesce(F.try_divide(found.cast("double"), whole.cast("double")), F.lit(0.0))
    return (
        F.when(F.length(p) == 0, 0.0).when(F.contains(t, p), 1.0)
        .when((F.length(p) > PREFIX) & F.contains(t, F.substring(p, 1, PREFIX)), F.greatest(share, F.lit(LEAST)))
        .when(share >= LEAST, share).otherwise(0.0)
    )


def snippets(hits: DataFrame, size: int = 12) -> DataFrame:
    """``hits`` (text, terms) and ``snippet``: the ``size`` words with the most different terms, the earliest of equals."""
    schema = T.StructType([*hits.schema, T.StructField("snippet", T.StringType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for text, terms in zip(b.column("text").to_pylist(), b.column("terms").to_pylist()):
                words = (text or "").split()
                keys = [re.sub(r"\W+", "", w).lower() for w in words]
                wanted = set(terms or ())
                best = max(range(max(1, len(words) - size + 1)), key=lambda i: (len(wanted & set(keys[i : i + size])), -i))
                out.append(("…" if best else "") + " ".join(words[best : best + size]) + ("…" if best + size < len(words) else ""))
            yield b.append_column("snippet", pa.array(out, pa.string()))

    return hits.mapInArrow(run, schema)


def degenerate(text: Column, share: float = 0.5, least: int = 4) -> Column:
    """Whether half of a text's lines, or of its sentences, repeat an earlier one (of ``least`` or more)."""

    def repeats(parts):
        full = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")
        return (F.size(full) >= least) & (F.size(full) - F.size(F.array_distinct(full)) >= F.size(full) * share)

    return F.coalesce(repeats(F.split(text, "\n")) | repeats(F.split(text, r"(?<=[.!?])\s+")), F.lit(False))


def refuses(text: Column) -> Column:
    return F.coalesce(normalize(text).rlike(REFUSALS), F.lit(False))


def answer_oracle(answers: DataFrame) -> DataFrame:
    """answer_id, right: every group of alternatives is met by one that stands in the answer, and nothing forbidden does.

    answers: answer_id, answer, groups array<array<string>>, forbidden array<string>.
    """
    t = F.concat(F.lit(" "), normalize(F.col("answer")), F.lit(" "))
    has = lambda x: F.contains(t, F.concat(F.lit(" "), normalize(x), F.lit(" ")))
    met = F.forall("groups", lambda g: F.exists(g, has))
    return answers.select("answer_id", (met & ~F.exists(F.coalesce("forbidden", F.array().cast("array<string>")), has)).alias("right"))
