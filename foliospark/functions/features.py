"""Coverage features of a passage for a query, from 0 to 1, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import let, significant_tokens, tokens


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    return _share(part, whole)


def weighted_share(wanted: Column, found: Column) -> Column:
    """Share of different terms that are found, those with digits or of six letters or more counting twice."""

    def weight(ts):
        return F.aggregate(ts, F.lit(0), lambda s, t: s + F.when(t.rlike("[0-9]") | (F.length(t) >= 6), 2).otherwise(1))

    return let(F.array_distinct(wanted), lambda w: _share(weight(F.array_intersect(w, found)), weight(w)))


def query_coverage(query: Column, passage: Column) -> Column:
    """Weighted share of the query's significant tokens in the passage; digits and tokens of six letters count twice."""
    def weight(ts):
        return F.aggregate(ts, F.lit(0), lambda s, t: s + F.when(t.rlike("[0-9]") | (F.length(t) >= 6), 2).otherwise(1))

    return let(
        F.array_distinct(significant_tokens(query)),
        lambda wanted: _share(weight(F.array_intersect(wanted, tokens(passage))), weight(wanted)),
    )


def bigram_coverage(query: Column, passage: Column) -> Column:
    def pairs(text):
        def of(t):
            at = F.when(F.size(t) > 1, F.sequence(F.lit(0), F.size(t) - 2)).otherwise(F.array().cast("array<int>"))
            return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.get(t, i), F.get(t, i + 1))))

        return let(significant_tokens(text), of)

    return let(pairs(query), lambda wanted: _share(F.size(F.array_intersect(wanted, pairs(passage))), F.size(wanted)))


def similarity(distance: Column) -> Column:
    """Cosine of two unit vectors from their Euclidean distance."""
    return 1 - distance * distance / 2
