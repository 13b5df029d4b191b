"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import SPACE, SPACE_RUN, let

#: Frequent function words of English, French, German and Spanish. Texts in other languages hold few of them
#: and fail the rule ``stop_words``; for such corpora, give ``measure`` a table of rules without it.
STOP_WORDS = (
    "the of and to in is that for it with as was on are by this be or an at "
    "le la les de des du et en un une est que qui dans pour il elle "
    "der die das und in zu den von mit ist nicht ein eine sich auf "
    "el los las y que es del por con una no se su"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails if the value of ``ratio`` (a SQL expression over the counts) is outside [least, most]."""

    name: str
    ratio: str
    least: float | None = None
    most: float | None = None


#: Production thresholds. Counts are of the whole text; see ``counts`` for their names.
RULES = (
    Rule("short", "n_words", least=50),
    Rule("repeated_passages", "n_repeat_words / n_words", most=0.5),
    Rule("mean_word_length", "word_chars / n_words", least=2.0, most=12.0),
    Rule("symbols", "n_symbols / n_words", most=0.2),
    Rule("stop_words", "n_stop_words / n_words", least=0.03),
    Rule("repeated_lines", "n_dup_lines / n_lines", most=0.5),
)


def counts(text: Column) -> dict[str, Column]:
    """Counts of one text, each a built-in expression; a null text has none of anything and no lines."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE_RUN), "")
    full = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(full).cast("long"),
        "n_dup_lines": let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_stop_words": F.size(
            F.filter(words, lambda w: (F.length(w) <= 5) & F.lower(w).isin(*sorted(set(STOP_WORDS))))
        ).cast("long"),
        "n_repeat_words": let(words, _repeat_words).cast("long"),
    }


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more.

    Each window carries its place as a suffix; sorted, equal windows stand together, so a window is compared with its
    neighbours only (n log n, no pairs). The repeated places, sorted, then count 3 words each, less what overlaps.
    """
    windows = F.transform(
        F.when(F.size(words) > 2, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat_ws(
            " ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2), F.lpad(i.cast("string"), 10, "0")
        ),
    )

    def repeated(sorted_windows: Column) -> Column:
        keys = F.transform(sorted_windows, lambda x: F.substring(x, F.lit(1), F.length(x) - 11))
        return let(
            keys,
            lambda k: F.sort_array(
                F.array_compact(
                    F.transform(
                        k,
                        lambda x, i: F.when(
                            (x == F.get(k, i + 1)) | (x == F.get(k, i - 1)),
                            F.right(F.get(sorted_windows, i), F.lit(10)).cast("int"),
                        ),
                    )
                )
            ),
        )

    return let(
        let(F.sort_array(windows), repeated),
        lambda at: F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
            F.lit(0),
            lambda total, x: total + x,
        ),
    )


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the counts, ``failed`` (names of failed rules, comma-joined) and ``kept``.

    One row for each input row: repeated rows and ties stay, an empty table gives an empty one. Null and empty texts
    count zero words and fail ``short``; a ratio over zero words or lines is 0, so that no other rule sees a null.
    Text of any length works: all arrays are those of one document. Columns in ``keep`` are returned as they are, and
    win over a count of the same name.
    """
    made = docs.select(*(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)), F.col("text").alias("text_in"))
    made = made.select("*", *(e.alias(f"c_{k}") for k, e in counts(F.col("text_in")).items()))
    names = [c[2:] for c in made.columns if c.startswith("c_")]
    ratio = {r.name: _ratio(r.ratio) for r in rules}
    failed = [F.when(_fails(ratio[r.name], r), F.lit(r.name)) for r in rules]
    return made.select(
        *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)),
        *(F.col(f"c_{c}").alias(c) for c in names if c not in keep),
        F.array_join(F.array_compact(F.array(*failed)), ",").alias("failed"),
        (F.size(F.array_compact(F.array(*failed))) == 0).alias("kept"),
    )


def _ratio(text: str) -> Column:
    above, _, below = text.partition(" / ")
    if not below:
        return F.col(f"c_{above}").cast("double")
    return F.coalesce(F.try_divide(F.col(f"c_{above}").cast("double"), F.col(f"c_{below}").cast("double")), F.lit(0.0))


def _fails(value: Column, rule: Rule) -> Column:
    out = F.lit(False)
    if rule.least is not None:
        out = out | (value < F.lit(float(rule.least)))
    if rule.most is not None:
        out = out | (value > F.lit(float(rule.most)))
    return out
