"""Text functions as built-in column expressions; Python only for what they can't say (edit distance, full NFKD)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _compatible() -> tuple[str, str]:
    """Lower-case characters, in the blocks of Latin, sub- and superscripts and wide forms, that stand for one other."""
    found = {}
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0xFF01, 0xFF5F)):
        c = chr(code).lower()
        base = fold_accents(c)
        if len(c) == len(base) == 1 and c != base:
            found[c] = base
    return "".join(found), "".join(found.values())


def fold_accents(text: str) -> str:
    """Compatibility decomposition without marks, lower case."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


ACCENTED, BASE = _compatible()
#: Ligatures of type and what they stand for.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
#: Function words by which a language is told, as written.
FRENCH_MARKERS = (
    "le la les un une des du de et est sont dans pour que qui pas sur avec ce cette ses son sa mais ou où donc car ne se au aux par plus "
    "sans être avoir été fait comme tout tous elle il ils nous vous leur leurs"
).split()
ENGLISH_MARKERS = (
    "the a an and is are in for that which not on with this these its his her but or so because no be have been done as all every she he "
    "they we you their of to from at by it was were will would can could"
).split()
#: Common function words, without accents.
FRENCH_STOPS = (
    "le la les un une des du de et est en que qui dans pour sur par avec au aux ce cette ces il elle nous vous ils "
    "elles son sa ses leur leurs ne pas plus ou mais donc se quel quelle quels quelles mon ma mes ton ta tes"
).split()
ENGLISH_STOPS = (
    "the a an of and to in is are was were for on with at by from this that these those it its as be been or but not "
    "what which who how when where do does did has have had will would can could my your his her our their"
).split()
STOPS = sorted(set(FRENCH_STOPS) | set(ENGLISH_STOPS))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body or its lambdas use it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def normalize(text: Column) -> Column:
    """Lower case without accents, ligatures or punctuation; words by single blanks. Hyphenated line ends are joined."""
    out = F.regexp_replace(text, "[œŒ]", "oe")
    out = F.regexp_replace(out, "[æÆ]", "ae")
    out = F.regexp_replace(out, "­", "")
    out = F.regexp_replace(out, r"([\p{L}\p{N}])-[ \t\r\x0B\f]*\n\s*([\p{L}\p{N}])", "$1$2")
    out = F.regexp_replace(F.lower(out), "[ﬀﬁﬂﬃﬄ]", "\x01$0")
    for ligature, plain in LIGATURES:
        out = F.replace(out, F.lit("\x01" + ligature), F.lit(plain))
    out = F.translate(out, ACCENTED, BASE)
    out = F.regexp_replace(out, r"\p{M}", "")
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def fold_full(text: str) -> str:
    """``normalize`` of one string, with the whole compatibility decomposition."""
    text = re.sub("[œŒ]", "oe", re.sub("[æÆ]", "ae", text)).replace("\u00ad", "")
    text = re.sub(r"([^\W_])-\s*\n\s*([^\W_])", r"\1\2", text)
    return " ".join("".join(c if c.isalnum() else " " for c in fold_accents(text)).split())


@F.pandas_udf(T.StringType())
def normalize_full(texts: pd.Series) -> pd.Series:
    """``normalize`` with the whole compatibility decomposition (all scripts, fractions and symbols too)."""
    return texts.map(lambda text: None if text is None else fold_full(text))


def normalize_question(text: Column) -> Column:
    """Like ``normalize`` but digits and punctuation stay; apostrophes and hyphens between letters become blanks."""
    out = F.regexp_replace(F.regexp_replace(text, "[œŒ]", "oe"), "[æÆ]", "ae")
    out = F.translate(F.lower(out), ACCENTED, BASE)
    out = F.regexp_replace(out, "['’‘`´]", " ")
    out = F.regexp_replace(out, r"(?<=\p{L})-(?=\p{L})", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def tokens(text: Column, least: int = 1) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda t: F.length(t) >= least)


def significant_tokens(text: Column, least: int = 2) -> Column:
    """Tokens that aren't stop words, or that are written in capitals or with digits; all tokens if none is left."""
    shouted = F.transform(
        F.regexp_extract_all(text, F.lit(r"\b([\p{Lu}\d][\p{Lu}\d._/-]+)\b"), F.lit(1)), lambda t: normalize(t)
    )

    def kept(every):
        fine = let(shouted, lambda loud: F.filter(every, lambda t: ~t.isin(*STOPS) | F.array_contains(loud, t)))
        return let(fine, lambda some: F.when(F.size(some) > 0, some).otherwise(every))

    return let(tokens(text, least), kept)


def grams_of(word: Column, size: int = 3) -> Column:
    padded = F.concat(F.lit("^"), word, F.lit("$"))
    return F.when(F.length(padded) <= size, F.array(padded)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - size + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(size)))
    )


def character_grams(text: Column, size: int = 3, limit: int = 768) -> Column:
    """Ordered set of grams of each word and of the text without blanks, ``^`` and ``$`` at the ends."""
    def of(n):
        views = F.filter(F.concat(F.split(n, " "), F.array(F.replace(n, F.lit(" "), F.lit("")))), lambda w: w != "")
        return F.slice(F.array_distinct(F.flatten(F.transform(views, lambda w: grams_of(w, size)))), 1, limit)

    return let(normalize(text), of)


def heading_grams(text: Column) -> Column:
    inner = F.filter(character_grams(text), lambda g: g.rlike(r"^[\p{L}\p{N}]{3}$"))
    return F.transform(inner, lambda g: F.concat(F.lit("h"), g))


def query_grams(text: Column, per_token: int = 6, limit: int = 96) -> Column:
    """Up to ``per_token`` inner grams of each significant token, so that late tokens keep theirs."""

    def of(token):
        whole = F.filter(character_grams(token), lambda g: F.length(g) == 3)
        inner = F.filter(whole, lambda g: ~g.contains("^") & ~g.contains("$"))
        return F.slice(F.when(F.size(inner) > 0, inner).otherwise(whole), 1, per_token)

    found = F.transform(F.array_distinct(significant_tokens(text, 3)), of)
    return F.slice(F.array_distinct(F.flatten(found)), 1, limit)


def identifiers(text: Column) -> Column:
    """Upper-cased codes with a digit and a letter or separator, and file names without their ending."""
    found = F.filter(
        F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z0-9]+(?:[./_-][A-Z0-9]+)*)\b"), F.lit(1)),
        lambda v: (F.length(v) >= 3) & v.rlike("[0-9]") & v.rlike("[A-Z./_-]"),
    )
    base = F.transform(found, lambda v: F.regexp_replace(v, r"\.(?:PDF|DOCX?|TXT|MD|MARKDOWN)$", ""))
    return F.array_distinct(F.concat(found, base))


def aliases(text: Column) -> Column:
    """Long names followed by their short form in parentheses; both."""
    pattern = r"\b(\p{L}[\p{L}'’-]*(?:\s+\p{L}[\p{L}'’-]*){1,8})\s*\(([A-Z][A-Z0-9-]{1,10})\)"
    both = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2)]
    return F.array_distinct(F.concat(*both))


def identifier_compatibility(query: Column, candidate: Column) -> Column:
    wanted, found = identifiers(query), identifiers(candidate)
    return (
        F.when(F.size(wanted) == 0, 1.0)
        .when(F.arrays_overlap(wanted, found), 1.0)
        .when(F.size(found) > 0, 0.0)
        .otherwise(0.25)
    )


def osa(left: str, right: str, most: int) -> int:
    """Restricted Damerau-Levenshtein distance, ``most`` + 1 beyond ``most``."""
    if abs(len(left) - len(right)) > most:
        return most + 1
    two, one = None, list(range(len(right) + 1))
    for i, a in enumerate(left, 1):
        row = [i]
        for j, b in enumerate(right, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (a != b))
            if i > 1 and j > 1 and a == right[j - 2] and left[i - 2] == b:
                best = min(best, two[j - 2] + (a != b))
            row.append(best)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def osa_distance(left: Column, right: Column, most: int = 4) -> Column:
    """``osa`` of normalised texts. The built-in distance, at most twice as large, keeps far pairs from Python."""

    @F.pandas_udf("int")
    def exact(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else osa(x, y, most) for x, y in zip(a, b)], dtype="Int32")

    a, b = normalize(left), normalize(right)
    near = F.levenshtein(a, b, 2 * most) >= 0
    return F.when(a.isNull() | b.isNull(), None).when(near, exact(F.when(near, a), F.when(near, b))).otherwise(most + 1)


def language(text: Column, sample: int = 2500) -> Column:
    """``fr`` or ``en`` by function words in the first 2,500 characters, else null.

    Ten words at least, of which a twentieth must be function words, and those of one language over 1.3 times the other's.
    """
    words = F.filter(F.split(F.lower(F.substring(text, 1, sample)), r"[^\p{L}']+"), lambda w: w != "")

    def of(ws):
        count = lambda markers: F.size(F.filter(ws, lambda w: w.isin(*markers)))
        n, fr, en = F.size(ws), count(FRENCH_MARKERS), count(ENGLISH_MARKERS)
        few = (n < 10) | (fr + en < n * 0.05)
        return F.when(few, F.lit(None).cast("string")).when(fr > en * 1.3, "fr").when(en > fr * 1.3, "en")

    return let(words, of)


def text_quality(text: Column) -> Column:
    """Class of a text layer: sparse, unmapped, joined or usable.

    Joined: hardly any blanks, and a fifth of the letters in runs of 24 or more, or a run of 64; but not in scripts that
    write without blanks.
    """

    def of(t):
        n, letters = F.length(t), F.regexp_count(t, F.lit(r"\p{L}"))
        runs = F.transform(F.regexp_extract_all(t, F.lit(r"(\p{L}{24,})"), F.lit(1)), lambda w: F.length(w))
        in_long, longest = F.aggregate(runs, F.lit(0), lambda a, k: a + k), F.coalesce(F.array_max(runs), F.lit(0))
        odd, blank = F.regexp_count(t, F.lit("[\\x00\\x{FFFD}]")), F.regexp_count(t, F.lit(r"[\s\p{Z}]"))
        unspaced = F.regexp_count(t, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"))
        share = lambda part, whole: part / F.greatest(whole, F.lit(1))
        joined = (letters >= 50) & (share(unspaced, letters) < 0.2) & (share(blank, n) < 0.06) & ((share(in_long, letters) >= 0.2) | (longest >= 64))
        return (
            F.when(n < 50, "sparse").when((odd >= 3) & (share(odd, n) >= 0.005), "unmapped").when(joined, "joined").otherwise("usable")
        )

    return let(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), of)


def clean(text: Column, most: int | None = None) -> Column:
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return out if most is None else F.substring(out, 1, most)


def clauses(text: Column) -> Column:
    """Parts of a question at semicolons, commas and question marks, of three characters or more."""
    return F.filter(F.transform(F.split(text, r";|, |\? "), lambda c: F.trim(c)), lambda c: F.length(c) >= 3)


def related_questions(text: Column) -> Column:
    """Up to three different lines of 9 to 159 characters, without bullets or numbers."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: F.length(x).between(9, 159))), 1, 3)


def html_text(html: Column) -> Column:
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?i)<(?:br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for code, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def search_terms(text: Column, most: int = 24) -> Column:
    """The words of a full-text query: different normalised tokens, at most 24."""
    return F.slice(F.array_distinct(tokens(text)), 1, most)


def stemmed(text: str) -> list[str]:
    """Both languages' stems of a text's significant words, marked by language, where they differ from the word."""
    from foliospark.functions import stems
    from foliospark.functions.relevance import significant

    out = {}
    for w in significant(text):
        for mark, stem in (("frstem", stems.french), ("enstem", stems.english)):
            s = fold_full(stem(w))
            if len(s) >= 3 and s != w:
                out[mark + s] = None
    return list(out)


@F.pandas_udf(T.StringType())
def lexical_index_text(texts: pd.Series) -> pd.Series:
    """A text with its stems below, for an index of words; a null stays null."""
    return texts.map(lambda t: None if t is None else "\n".join(x for x in (t, " ".join(stemmed(t))) if x))
