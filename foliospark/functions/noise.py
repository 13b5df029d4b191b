"""Deterministic noise for tests of search: lost accents, swapped and dropped letters, changed case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import ACCENTED, BASE


_CAPITAL = [(c.upper(), b.upper()) for c, b in zip(ACCENTED, BASE) if len(c.upper()) == 1 and c.upper() != c]


def without_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED + "".join(c for c, _ in _CAPITAL), BASE + "".join(b for _, b in _CAPITAL))


def _long_words(text: Column, change) -> Column:
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.when(F.length(w) >= 5, change(w)).otherwise(w)), " ")


def swapped(text: Column) -> Column:
    """The third and fourth letter of each word of five or more change places."""
    return _long_words(text, lambda w: F.concat(F.substring(w, 1, 2), F.substring(w, 4, 1), F.substring(w, 3, 1), F.substring(w, 5, 10_000)))


def dropped(text: Column) -> Column:
    """The third letter of each word of five or more is lost."""
    return _long_words(text, lambda w: F.concat(F.substring(w, 1, 2), F.substring(w, 4, 10_000)))
