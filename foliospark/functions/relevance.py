"""How much of what a question asks for a passage carries: coverage features from 0 to 1.

A question is read once into what it asks (terms, numbers, kinds of value, roles); a passage into what it holds. Each
feature compares the two. They need edit distances and word stems, so they run in Arrow batches over candidate pairs
(some tens for each question), never over questions times passages.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import stems
from foliospark.functions.text import ENGLISH_STOPS, FRENCH_STOPS, fold_accents, fold_full, osa
from foliospark.plans.questions import analyze

STOPS = frozenset(FRENCH_STOPS) | frozenset(ENGLISH_STOPS)

#: All constants from here to the first function are fixed values. Weights of the linear model over a fused score:
WEIGHTS = {
    "exact": 0.008, "phrase": 0.04, "heading": 0.02, "approximate": 0.03, "names": 0.08, "party": 0.04, "identity": 0.08,
    "temporal": 0.08, "enumeration_scoped": 0.1, "numeric": 0.08, "label": 0.08, "proximity": 0.16, "constraint": 0.12, "clauses": 0.08,
}
#: Question words and value shapes by kind of number; the shapes are looked for in the text as written:
KINDS = {
    "duration": r"\b(?:combien de temps|pendant combien|how long|duree|duration|delai|deadline|prescription)\b"
    r"|\bcombien de [a-z]{2,6}\s+(?:gard|conserv|dur|rest|maint)|\bhow [a-z]{2,6}\s+(?:keep|retain|last|remain)",
    "money": r"\b(?:prime|cotisation|premium|prix|price|cost|cout|montant|amount|honoraire|fee)\b"
    r"|\b(?:combien|montant|valeur|quelle? est|what is)\b.{0,32}\b(?:franchise|deductible)\b",
    "percentage": r"\b(?:taux|rate|pourcentage|percentage)\b",
    "area": r"\b(?:superficie|surface|area)\b",
    "count": r"\b(?:combien de (?!temps\b)|how many|nombre de|count)\b",
    "generic": r"\b(?:combien|how much|plafond|limit|limite)\b",
}
NEAR_WORDS = {
    "duration": ("temps", "duree", "duration"),
    "money": ("prime", "cotisation", "premium", "prix", "montant", "mensuel", "mensuelle", "monthly"),
}
CEILING = r"\b(?:plafonds?|franchises?|deductible)\b"
POLAR = (
    r"\b(?:est|sont|peut|peuvent|doit|dois|a-t|suis|ai)[ -](?:il|elle|ils|elles|on|je|tu|nous|vous)\b"
    r"|^(?:est ce que|is|are|does|do|can|did)\b"
)
EFFECT_DATE = r"\b(?:date d effet|prise d effet|entree en vigueur|effective date|entry into force)\b"
NUMBER_WORDS = {
    "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "onze": 11,
    "douze": 12, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11,
    "twelve": 12,
}
UNITS = (("an", r"ans?\b|ann[eé]es?\b|years?\b"), ("jour", r"jours?\b|days?\b"), ("mois", r"mois\b|months?\b"),
         ("semaine", r"semaines?\b|weeks?\b"), ("heure", r"heures?\b|hours?\b"))
MONEY_SHAPE = r"\d[\d\s.,]*\s*(?:€|eur\b|euros?\b|usd\b|dollars?\b)|(?:€|eur\b|usd\b)\s*\d"
_SPELLED = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
SHAPES = {
    "duration": rf"(?:\d[\d\s.,]*\)?\s*(?:\([^)]*\)\s*)?|(?:{_SPELLED})\s+)(?:ans?\b|ann[eé]es?\b|jours?\b|mois\b|years?\b|months?\b|days?\b|hours?\b|heures?\b)",
    "money": MONEY_SHAPE,
    "percentage": r"\d[\d\s.,]*\s*%",
    "area": r"\d[\d\s.,]*\s*(?:m2\b|m²\b|ca\b|hectares?\b|sq\.?\s*ft\b)",
    "count": r"\b\d[\d\s.,]*\b",
    "generic": r"\d[\d\s.,]*\s*(?:€|eur\b|%|m2\b|m²\b|km\b|cv\b|ans?\b|ann[eé]es?\b|jours?\b|mois\b|years?\b|months?\b|days?\b)|(?:€|eur\b)\s*\d",
}
MONEY_LABELS = (
    ("cotisation", "prime", "premium", "paiement", "payment"), ("mensuel", "mensuelle", "monthly", "mois"),
    ("prix", "price", "cost", "cout", "montant", "amount"), ("franchise", "deductible"),
)
CONSTRAINTS = (
    r"\b(?:plus de|more than|over)\b", r"\b(?:moins de|less than|under)\b", r"\b(?:au moins|at least)\b", r"\b(?:au plus|at most)\b",
    r"\b(?:avant|before)\b", r"\b(?:apres|after)\b",
)
SCOPE_NOISE = (
    r"\b(?:combien de temps|pendant combien|how long|duree|duration|jusqu a quel montant|quel montant|how much|amount"
    r"|combien|quelle?|quels?|quelles?|what|how|many|much|long)\b"
)
_MONTHS = (
    "janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre"
    "|january|february|march|april|may|june|july|august|september|october|november|december"
)
DATE = rf"\b(?:\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}|\d{{4}}[./-]\d{{1,2}}[./-]\d{{1,2}}|(?:premier|\d{{1,2}}(?:er|re|e|ème|eme)?)\s+(?:{_MONTHS})\s+\d{{4}})\b"
TIME = r"\b(?:[01]?\d|2[0-3])(?::|h)[0-5]\d\b"
DURATION = r"\b(?:\d+|un|une|one|a|an|\p{L}+\s*\(\d+\))\s*(?:ans?|ann[eé]es?|jours?|mois|heures?|minutes?|years?|months?|days?|hours?)\b"
WEEKDAY = r"\b(?:lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
IDENTITY_ASKED = (
    r"^(?:qui est|qui sont|who is|who are|identifie|identifier|nomme|nommer|identify|name)\b"
    r"|^(?:quel(?:le)?|which)\s+(?:souscripteur|assure|assuree|cohabitant|compagnon|compagne|subscriber|insured|companion)\b"
    r"|^(?:donne|donner|give)\b.*\b(?:nom|name)\b"
)
COMPANION_ASKED = r"\b(?:avec qui|with whom|cohabitant|compagnon|compagne|partenaire|companion|partner)\b"
PERSON_ASKED = r"\b(?:qui est|who is|souscripteur|assure|assuree|subscriber|insured|nom|name|nomme|named)\b"
COMPANION = r"\b(?:partenaire|conjoint|conjointe|epoux|epouse|compagnon|compagne|partner|spouse|husband|wife)\b"
PERSON_NAME = r"\b\p{Lu}[\p{L}'’-]+(?:\s+\p{Lu}[\p{L}'’-]+)+\b"
PARTIES = {
    "buyer": ("acheteur", "acquereur", "buyer", "purchaser"),
    "seller": ("vendeur", "vendeurs", "cedant", "cedants", "seller", "sellers", "vendor"),
}
TITLES = "monsieur|madame|mademoiselle|mr|mrs|ms|mme|mlle"
CONTACTS = (
    (r"\b(?:mail|e-?mail|courriel|email)\b", r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}{2,}"),
    (r"\b(?:telephone|numero (?:de |du )?(?:telephone|portable|mobile|fixe)|phone number|mobile number)\b",
     r"\+\d[\d\s.-]{6,}\d|\b0\d(?:[\s.-]?\d{2}){4}\b"),
    (r"\b(?:url|site (?:web|internet)|adresse (?:du site|web)|lien vers|website)\b", r"https?://[^\s)]+|\bwww\.[^\s)]+"),
    (r"\b(?:numeros? d(?:e la |e |u )?(?:demandes?|dossiers?|references?)|references? d(?:e la |e |u )?(?:demandes?|dossiers?)"
     r"|(?:request|application|file|reference) numbers?)\b", r"\b(?=[A-Za-z]*\d)(?=\d*[A-Za-z])[A-Za-z0-9]{8,}\b|\b\d{6,}\b"),
)


def _has(pattern: str, text: str) -> bool:
    return regex.search(pattern, text, regex.I) is not None


@lru_cache(20_000)
def folded_words(text: str) -> tuple[str, ...]:
    return tuple(fold_full(text).split())


@lru_cache(20_000)
def significant(text: str, least: int = 3) -> tuple[str, ...]:
    """Words that aren't stop words, or are written in capitals, with digits or as parts of a compound; else all words."""
    words = [w for w in folded_words(text) if len(w) >= least]
    loud = {fold_full(x) for x in regex.findall(r"\b[\p{Lu}\d][\p{Lu}\d._/-]+\b", text)}
    for compound in regex.findall(r"[\p{L}\p{N}]+(?:[-‐‑‒–—][\p{L}\p{N}]+)+", text):
        parts = fold_full(compound).split()
        if all(len(p) >= 3 for p in parts):
            loud.update(parts)
    kept = tuple(w for w in words if w not in STOPS or w in loud)
    return kept or tuple(words)


def forms(word: str) -> set[str]:
    return {f for f in _stemmed(word) if len(f) >= 3}


@dataclass(frozen=True)
class Held:
    """What a text holds."""

    text: str
    folded: str
    words: frozenset[str]
    terms: frozenset[str]
    stems: frozenset[str]
    listed: tuple[str, ...]
    sizes: np.ndarray
    letters: np.ndarray

    def near(self, word: str, most: int):
        """(word, distance) of the words of three letters or more within ``most`` edits.

        An edit changes the counts of letters by two at most, which rules out nearly all words without comparing them.
        """
        fine = np.abs(self.sizes - len(word)) <= most
        fine[fine] = np.abs(self.letters[fine] - _letters(word)).sum(1) <= 2 * most
        for k in np.flatnonzero(fine).tolist():
            if (d := osa(word, self.listed[k], most)) <= most:
                yield self.listed[k], d


def _letters(word: str) -> np.ndarray:
    """Counts of characters, in 32 classes."""
    return np.bincount([ord(c) & 31 for c in word], minlength=32).astype(np.int16)


@lru_cache(4_000)
def held(text: str) -> Held:
    words = frozenset(folded_words(text))
    terms = significant(text)
    listed = tuple(sorted(w for w in words if len(w) >= 3))
    letters = np.array([_letters(w) for w in listed], dtype=np.int16).reshape(-1, 32)
    stemmed = frozenset(f for t in terms for f in forms(t))
    return Held(text, " ".join(folded_words(text)), words, frozenset(terms), stemmed, listed, np.array([len(w) for w in listed], dtype=np.int64), letters)


def exact_coverage(query: str, text: Held) -> float:
    """Share of the question's terms, those with digits or of six letters counting twice."""
    weight = {t: 2 if len(t) >= 6 or any(c.isdigit() for c in t) else 1 for t in significant(query)}
    return sum(w for t, w in weight.items() if t in text.terms) / sum(weight.values()) if weight else 0.0


def approximate_coverage(query: str, text: Held) -> float:
    """Mean over words of four letters or more of the best edit similarity, up to two edits."""
    return _approximate(query, text.text)


@lru_cache(20_000)
def _approximate(query: str, of: str) -> float:
    text = held(of)
    wanted = [w for w in folded_words(query) if len(w) >= 4]
    if not wanted or not text.listed:
        return 0.0

    def best(word):
        if word in text.words:
            return 1.0
        return max((1 - d / max(len(word), len(other)) for other, d in text.near(word, 2)), default=0.0)

    similarity = {w: best(w) for w in set(wanted)}
    return sum(similarity[w] for w in wanted) / len(wanted)


def stemmed_coverage(query: str, text: Held) -> float:
    wanted = significant(query)
    return sum(not forms(t).isdisjoint(text.stems) for t in wanted) / len(wanted) if wanted and text.stems else 0.0


@lru_cache(100_000)
def _stemmed(word: str) -> tuple[str, str, str]:
    return word, fold_full(stems.french(word)), fold_full(stems.english(word))


@lru_cache(4_000)
def neighbours(text: str) -> tuple[frozenset, ...]:
    """Neighbouring terms: plain, by the French and by the English stemmer."""
    columns = zip(*map(_stemmed, significant(text)))
    return tuple(frozenset(zip(words, words[1:])) for words in columns) or (frozenset(),) * 3


def phrase_coverage(query: str, text: Held) -> float:
    """Share of the question's neighbouring terms that are neighbours in the text, plain or by either stemmer."""
    out = 0.0
    for wanted, found in zip(neighbours(query), neighbours(text.text)):
        out = max(out, len(wanted & found) / len(wanted) if wanted else 0.0)
    return out


def scope_coverage(query: str, text: Held) -> float:
    return max(exact_coverage(query, text), approximate_coverage(query, text), stemmed_coverage(query, text))


def name_coverage(query: str, text: Held) -> float:
    """Share of the question's capitalised words, if there are two, that the text has with an edit or two."""
    names = [w for w in map(fold_full, regex.findall(r"\b\p{Lu}[\p{L}'’.-]{2,}", query)) if len(w) >= 3 and w not in STOPS]
    if len(names) < 2:
        return 0.0
    allowed = lambda n: min(2, max(1, len(n) // 4))
    found = {n: n in text.terms or any(w in text.terms for w, _ in text.near(n, allowed(n))) for n in set(names)}
    return sum(found[n] for n in names) / len(names)


def _near_any(text: str, words: tuple[str, ...]) -> bool:
    """Whether a text has one of some words, longer ones with an edit or two."""
    for word in words:
        most = 0 if len(word) <= 4 else min(2, len(word) // 4)
        if any(t == word or most and osa(t, word, most) <= most for t in folded_words(text)):
            return True
    return False


@lru_cache(20_000)
def numeric_kinds(query: str) -> tuple[str, ...]:
    """Kinds of number that a question asks for."""
    q = " ".join(folded_words(query))
    money = _has(KINDS["money"], q) or (_has(CEILING, q) and not _has(POLAR, q)) or (not _has(EFFECT_DATE, q) and _near_any(q, NEAR_WORDS["money"]))
    asked = {
        "duration": _has(KINDS["duration"], q) or _near_any(q, NEAR_WORDS["duration"]), "money": money,
        "percentage": _has(KINDS["percentage"], q), "area": _has(KINDS["area"], q),
    }
    asked["count"] = _has(KINDS["count"], q) and not asked["duration"]
    found = tuple(k for k, yes in asked.items() if yes)
    return found or (("generic",) if _has(KINDS["generic"], q) else ())


def numeric_coverage(query: str, text: Held) -> float:
    """Share of the asked kinds of number that the text has; less where it has none of the question's numbers."""
    kinds = numeric_kinds(query)
    found = sum(_has(SHAPES[k], text.text) for k in kinds)
    if not found:
        return 0.0
    numbers = regex.findall(r"\b\d[\d ]*\b", " ".join(folded_words(query)))
    digits = "".join(c for c in text.folded if c.isdigit())
    fine = not numbers or any(n.replace(" ", "") in digits for n in numbers)
    return found / len(kinds) * (1.0 if fine else 0.6)


def label_coverage(query: str, text: str) -> float:
    """Share of the asked kinds of money label that a text has."""
    if "money" not in numeric_kinds(query):
        return 0.0
    asked = [g for g in MONEY_LABELS if _near_any(query, g)]
    return sum(_near_any(text, g) for g in asked) / len(asked) if asked else 0.0


def proximity_coverage(query: str, text: str, reach: int = 96) -> float:
    """``label_coverage`` of the best surroundings of an amount."""
    if "money" not in numeric_kinds(query):
        return 0.0
    spans = [m.span() for m in regex.finditer(MONEY_SHAPE, text, regex.I)]
    return max((label_coverage(query, text[max(0, a - reach) : b + reach]) for a, b in spans), default=0.0)


def constraint_coverage(query: str, text: Held) -> float:
    """Of a question with numbers, all of which the text has: 0.7, and 0.3 for its bounds (more than, before...)."""
    q = " ".join(folded_words(query))
    numbers = regex.findall(r"\b\d+(?:[.,]\d+)?\b", q)
    if not numbers or not all(n in text.folded for n in numbers):
        return 0.0
    asked = [c for c in CONSTRAINTS if _has(c, q)]
    return 0.7 + 0.3 * sum(_has(c, text.folded) for c in asked) / len(asked) if asked else 1.0


def numeric_scope(query: str, text: Held) -> float:
    """``scope_coverage`` of what is left of a question without its words for amounts."""
    rest = " ".join(regex.sub(SCOPE_NOISE, " ", " ".join(folded_words(query))).split())
    return scope_coverage(rest, text) if rest else 0.0


def temporal_coverage(query: str, text: Held) -> float:
    """1 if the text has a date or time of the asked shape."""
    q = " ".join(folded_words(query))
    date, time, when = (_has(p, q) for p in (r"\b(?:date|jour exact|calendar date)\b", r"\b(?:heure|horaire|time)\b", r"\b(?:quand|when)\b"))
    dated, timed = _has(DATE, text.text) or _has(DATE, text.folded), _has(TIME, text.text)
    if date or time:
        return float((dated or not date) and (timed or not time))
    return float(when and (dated or timed or _has(DURATION, text.folded) or _has(WEEKDAY, text.folded)))


def enumeration_coverage(query: str, text: Held) -> float:
    """For questions that ask for a list: numbered or bulleted items, three at least and eight being all."""
    if analyze(query).operation != "list":
        return 0.0
    numbered = {int(n) for n in regex.findall(r"(?m)^\s*(\d{1,2})\s*[.)-]\s*\p{L}", text.text)}
    items = max(len(numbered), len(regex.findall(r"(?m)^\s*[-•✓!✗]\s*\p{L}", text.text)))
    return min(1.0, items / 8) if items >= 3 else 0.0


def asks_identity(query: str) -> bool:
    return _has(IDENTITY_ASKED, _plain(query).strip())


def _plain(text: str) -> str:
    return regex.sub(r"\s+", " ", regex.sub("[’']", " ", fold_accents(text)))


def identity_coverage(query: str, text: Held) -> float:
    """Share of what an identity question asks for, a person's name or a companion, that the text has."""
    if not asks_identity(query):
        return 0.0
    q = " ".join(folded_words(query))
    companion = _has(COMPANION_ASKED, q)
    person = not companion or _has(PERSON_ASKED, q)
    met = (person and regex.search(PERSON_NAME, text.text) is not None) + (companion and _has(COMPANION, text.folded))
    return met / (person + companion)


def names_party(text: str, role: str) -> bool:
    """Whether a text binds a person's name to a party: after the role, after a title, or before a designation of it."""
    who, name = f"(?:{'|'.join(PARTIES[role])})", r"[a-z]{2,}(?:[ -]+[a-z]{2,})+"
    title, link = f"(?:{TITLES})", r"(?:\s*[,:;—-]\s*|\s+(?:est|sont|is|are|denomme\w*|designe\w*|appele\w*|nomme\w*)\s+)"
    named = rf"ci-?apres\s+(?:denomme|designe|appele|nomme)\w*\s+(?:l[ae]?\s+)?{who}\b"
    ways = (
        rf"\b{who}\b\s+(?:l[ae]?\s+)?{title}\s+{name}", rf"\b{who}\b{link}(?:{title}\s+)?{name}",
        rf"{title}\s+{name}.{{0,80}}?{named}", rf"{title}\s+{name}\s*,\s*(?:l[ae]?\s+)?{who}\b",
    )
    plain = _plain(text)
    return any(regex.search(w, plain, regex.S) for w in ways)


def party_coverage(query: str, text: Held) -> float:
    """Share of the parties that an identity question names, buyer or seller, whose person the text gives."""
    asked = [r for r, words in PARTIES.items() if any(_has(rf"\b{w}\b", _plain(query)) for w in words)] if asks_identity(query) else []
    return sum(names_party(text.text, r) for r in asked) / len(asked) if asked else 0.0


def contact_coverage(query: str, text: Held) -> float:
    """1 if the text has a mail address, phone number, link or reference, whichever the question asks for."""
    q = " ".join(folded_words(query))
    return float(any(_has(asked, q) and regex.search(shape, text.text) is not None for asked, shape in CONTACTS))


def query_clauses(query: str) -> list[str]:
    parts = [p.strip() for p in regex.split(r";|,\s+|\?+\s+", query)]
    parts = [p for p in parts if significant(p)]
    return parts if len(parts) > 1 else []


def clause_coverage(query: str, text: Held) -> float:
    """For questions that compare or explain: share of their clauses that a fifth of the text's terms cover."""
    first = query.split("\n", 1)[0]
    parts = query_clauses(first) if analyze(first).route == "synthesis" else []
    return sum(scope_coverage(p, text) >= 0.2 for p in parts) / len(parts) if parts else 0.0


def duration_mentions(text: str) -> dict[str, str]:
    """Different durations ("3 mois") and how each is written first."""
    out: dict[str, str] = {}
    unit = "|".join(u for _, u in UNITS)
    pattern = rf"\b(\d{{1,4}}|{_SPELLED})\s*(?:\(\s*\d{{1,4}}\s*\))?\s+({unit})(\s+ouvrables?|\s+ouvr[eé]s?|\s+calendaires?|\s+francs?)?"
    for m in regex.finditer(pattern, text, regex.I):
        number = m[1].lower()
        value = int(number) if number.isdigit() else NUMBER_WORDS[number]
        key = next(k for k, u in UNITS if regex.match(u, m[2], regex.I))
        out.setdefault(f"{value} {key}", m[0].strip())
    return out


def durations_asked(query: str) -> int:
    """How many durations a question asks for, clause by clause; a short clause after one repeats it."""

    def asks(part):
        return "duration" in numeric_kinds(part) or "delais" in folded_words(part)

    if not asks(query):
        return 0
    parts = query_clauses(query.split("\n", 1)[0])
    if not parts:
        return max(1, len(regex.findall(r"\p{L}+(?:-t)?-(?:il|elle|ils|elles|on)\b", query, regex.I)))
    n = 0
    for part in parts:
        n += asks(part) or (n > 0 and len(set(significant(part))) <= 2 and not numeric_kinds(part))
    return n


def grounding_coverage(query: str, text: Held) -> float:
    """How well a sentence is grounded in a passage: exact, approximate, stemmed and phrase coverage, blended."""
    return 0.3 * exact_coverage(query, text) + 0.25 * approximate_coverage(query, text) + 0.25 * stemmed_coverage(query, text) + 0.2 * phrase_coverage(query, text)


FEATURES = (
    "exact", "approximate", "stemmed", "phrase", "heading", "names", "party", "identity", "temporal", "enumeration", "enumeration_scoped",
    "numeric", "label", "proximity", "constraint", "clauses", "numeric_scope", "contact", "grounding", "scope", "utility",
)


def features(query: str | None, name: str | None, heading: str | None, passage: str | None) -> dict[str, float]:
    """All features of a passage (with its document's name and its heading) for a question; nulls are empty texts."""
    query, passage, heading = query or "", passage or "", heading or ""
    whole, own = held("\n".join(x for x in (name, heading, passage) if x)), held(passage)
    scope = scope_coverage(query, whole)
    out = {
        "exact": exact_coverage(query, whole), "approximate": approximate_coverage(query, whole), "stemmed": stemmed_coverage(query, whole),
        "phrase": phrase_coverage(query, whole), "heading": exact_coverage(query, held(heading)) if heading else 0.0,
        "names": name_coverage(query, whole), "party": party_coverage(query, whole), "identity": identity_coverage(query, own),
        "temporal": temporal_coverage(query, own), "enumeration": enumeration_coverage(query, own), "numeric": numeric_coverage(query, own),
        "label": label_coverage(query, whole.text), "proximity": proximity_coverage(query, whole.text),
        "constraint": constraint_coverage(query, whole), "clauses": clause_coverage(query, whole),
        "numeric_scope": max(numeric_scope(query, held(f"{heading}\n{passage}")), proximity_coverage(query, passage)),
        "contact": contact_coverage(query, own), "grounding": grounding_coverage(query, own), "scope": scope,
    }
    out["enumeration_scoped"] = out["enumeration"] * scope
    out["utility"] = max(
        scope, out["phrase"], out["names"], out["party"], out["identity"], out["temporal"], out["enumeration_scoped"],
        out["numeric"] * max(scope, 0.2), out["proximity"], out["constraint"], out["clauses"],
    )
    return {k: round(out[k], 9) for k in FEATURES}


_KIND = T.StructType([T.StructField(f, T.DoubleType()) for f in FEATURES])


def feature_columns(query: Column, name: Column, heading: Column, passage: Column) -> Column:
    """``features`` as a struct column, in Arrow batches."""

    @F.pandas_udf(_KIND)
    def of(q: pd.Series, n: pd.Series, h: pd.Series, p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(*x) for x in zip(q, n, h, p)], columns=list(FEATURES))

    return of(query, name, heading, passage)
