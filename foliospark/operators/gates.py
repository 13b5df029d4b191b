"""Gates before an answer: whether the evidence bears on what is asked at all, and whether a part of it is still missing."""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliospark.functions import relevance as R
from foliospark.functions.text import fold_accents, osa
from foliospark.operators.extract import Passage, by_question
from foliospark.plans.questions import identifiers

#: All constants from here to the first function are fixed values. Words that ask but say nothing of the subject; that wrap a request; words that stand for each other.
FILLER = frozenset(
    "quel quelle quels quelles est sont etait etre qui que quoi dans pour avec sans les des une leur leurs tout tous toute toutes elle et le la de du "
    "who what which where when how tell answer about has have that this the and document documents reponse resoudre savoir artificiellement".split()
)
WRAPPERS = frozenset("historique history liste list resume summary synthese synthesis information informations detail details overview".split())
SAME = tuple(
    frozenset(words.split())
    for words in (
        "cout coute cost prix price", "superficie surface contenance area", "maison bien immeuble logement house home property",
        "pret emprunt financement loan mortgage", "acheteur acquereur buyer purchaser", "vendeur vendeurs cedant cedants seller sellers vendor",
        "commentaire commentaires comment comments", "attendu attendus expected due", "contenu content", "reponse response", "negatif negative",
        "transfere transfer transfers", "entree effective", "vigueur effective", "signifie means", "effet effect", "planification planning",
        "vehicule vehicules vehicle vehicles", "horaire hourly hour", "augmente increase increases", "description descriptions decrit describes",
        "divergence divergent diverge",
    )
)
REQUIRED = ("passeport passport", "telephone phone mobile", "email courriel", "securite social ssn", "iban bic", "pdg ceo", "directeur directrice manager director",
            "acheteur acquereur buyer purchaser", "vendeur vendeurs cedant cedants seller sellers vendor")
EXACT = r"^(?:quel(?:le)? est|quels? sont|what is|what are).*\b(?:numero|number|telephone|phone|mobile|email|courriel|iban|bic)\b"
LABELLED = r"\b(?:numero|number|telephone|phone|mobile|email|courriel|iban|bic)[^\n:]{0,80}(?::|=|n[°o]|\b(?:est|is)\b)\s*[+A-Z0-9][A-Z0-9@+._/ -]{2,}"
QUANTIFIED = (
    r"\b(?:combien|how much|how many|plafond|limit|limite|montant|amount|prix|price|cost|cout|prime|premium|cotisation|franchise|deductible|superficie"
    r"|surface|area|duree|duration|taux|rate|pourcentage|percentage|nombre|count)\b"
)
VALUE = (
    r"\d[\d\s.,]*\s*(?:€|eur\b|euros?\b|usd\b|dollars?\b|%|m2\b|m²\b|ca\b|ans?\b|ann[eé]es?\b|jours?\b|mois\b|heures?\b|minutes?\b|years?\b|months?\b"
    r"|days?\b|hours?\b)|(?:€|eur\b|usd\b)\s*\d"
)
PRECISE = r"\b(?:exact|exacte|precis|precise|marque|brand|specific)\b"
STATED = r"(?:^|\n)[^\n:]{2,100}:\s*(?:oui|non|yes|no|aucun|aucune|none)\b"
OF = r"\b(?:du|de la|de l|des|of(?: the)?)\s+(.+?)(?:\?|$)"
SMALL_WORDS = frozenset("le la les de du des un une et ou au aux en ce ces sur par pour the and or of in on for to".split())
ASKS_PERSON = (
    r"\b(?:qui\s+(?:est|sont|sera|serait|occupe|dirige|signe)|quel(?:le)?s?\s+(?:est|sont)|comment\s+s\s*appelle|who\s+(?:is|are|heads|leads|signs)"
    r"|what\s+is\s+(?:my|the|your))\b"
)
ORGANISATION = (
    r"\b(?:societe|caisse|banque|credit|mutuel(?:le)?|assurances?|groupe|agence|cabinet|etablissement|sarl|selarl|sasu?|eurl|sci|scp|rcs|siren|siret|france)\b"
)
HONORIFIC = r"^(?:m\.|mr\.?|mme|mlle|dr\.?|me|ma[iî]tre|monsieur|madame|mademoiselle)\s+"


def tokens(text: str) -> list[str]:
    return regex.findall(r"[a-z0-9]+", fold_accents(text))


def stands_for(term: str, found: frozenset[str]) -> bool:
    """Whether a term, or a word that stands for it, is among words: by its first five letters, or an edit or two."""
    if term in found:
        return True
    group = next((g for g in SAME if any(osa(term, w, 2) <= 2 for w in g)), frozenset([term]))

    def near(a, b):
        if len(a) >= 6 and b.startswith(a[:5]):
            return True
        shorter = min(len(a), len(b))
        return shorter >= 4 and osa(a, b, 1 if shorter == 4 else 2) <= (1 if shorter == 4 else 2)

    return any(near(a, b) for a in group for b in found)


def subject(question: str) -> list[str]:
    """Words of what a question is about, after ``of``."""
    found = regex.search(OF, " ".join(tokens(question)))
    return [t for t in tokens(found[1]) if len(t) >= 4 and t not in FILLER and not regex.fullmatch("exacte?s?", t)] if found else []


def bears(question: str, passages: list[tuple[str, str]]) -> bool:
    """Whether passages (name and heading, text) carry an answer to a question.

    They must have the question's identifier, its acronyms, a labelled value or a date where these are asked for, and one
    of the words that an attribute goes by; then a bound quantity, a stated yes or no, a named person or half of the
    question's attributes settles it.
    """
    q = " ".join(tokens(question))
    codes = identifiers(question)
    joined = lambda t: R.fold_full(t).replace(" ", "")
    kept = [p for p in passages if not codes or any(joined(c) in joined("\n".join(p)) for c in codes)]
    letters = regex.sub(r"[^\p{L}]", "", question)
    acronyms = [] if letters == letters.upper() else [a for a in regex.findall(r"\b[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ0-9-]{1,9}\b", question) if a.lower() not in SMALL_WORDS]
    if not kept or not all(any(regex.search(rf"\b{regex.escape(a)}\b", t, regex.I) for _, t in kept) for a in acronyms):
        return False
    words = [frozenset(tokens("\n".join(p))) for p in kept]
    every = frozenset().union(*words)
    wanted = [t for t in subject(question) if len(t) >= 5 and t not in ("assurance", "contrat", "contract", "personnel")]
    if regex.search(EXACT, q) and not any(_labelled(fold_accents(f"{n}\n{t}"), wanted) for n, t in kept):
        return False
    asks_time = regex.search(r"\b(?:date|jour exact|calendar date|heure|horaire|time|quand|when)\b", q)
    if asks_time and not any(R.temporal_coverage(question, R.held(t)) == 1 for _, t in kept):
        return False
    if _stated(question, q, kept) or _quantified(question, q, kept, words):
        return True
    asked = set(tokens(question))
    for group in map(str.split, REQUIRED):
        if "telephone" in group and not regex.search(EXACT, q):
            continue
        if asked & set(group) and not every & set(group):
            return False
    if R.asks_identity(question):
        parties = [r for r, names in R.PARTIES.items() if asked & set(names)]
        if parties:
            return all(any(R.names_party("\n".join(p), r) for p in kept) for r in parties)
        if regex.search(R.COMPANION_ASKED, q):
            return R.identity_coverage(question, R.held("\n".join(t for _, t in kept))) == 1
        if regex.search(r"\b(?:devis|contrat|police|quote|policy)\b", q):
            return any(regex.search(R.PERSON_NAME, t) for _, t in kept)
        return any(len(t) >= 3 and t in every for t in asked)
    if codes:
        return True
    attribute = [t for t in tokens(regex.split(r"\b(?:de|du|des)\b", q)[0]) if len(t) >= 4 and t not in FILLER and t not in WRAPPERS]
    if regex.match(r"quel(?:le)?s?\b", q) and attribute:
        about = subject(question)
        return any(any(stands_for(t, w) for t in attribute) and (not about or any(stands_for(t, w) for t in about)) for w in words)
    attributes = [t for t in tokens(question) if len(t) >= 4 and t not in FILLER and not any(c.isdigit() for c in t)]
    met = sum(stands_for(t, every) for t in attributes)
    return met > 0 and met >= 0.5 * len(attributes)


def _labelled(text: str, wanted: list[str]) -> bool:
    """Whether a text has a labelled value, with one of the wanted words within 180 characters."""
    m = regex.search(LABELLED, text, regex.I)
    if not m:
        return False
    near = frozenset(tokens(text[max(0, m.start() - 180) : m.end() + 180]))
    return not wanted or any(stands_for(t, near) for t in wanted)


def _stated(question: str, q: str, kept: list[tuple[str, str]]) -> bool:
    """For a question after something exact: a labelled yes, no or none beside two of its words, or one and its number."""
    if not regex.search(PRECISE, q):
        return False
    terms = [t for t in tokens(question) if len(t) >= 5 and t not in FILLER and not regex.fullmatch(PRECISE, t)]
    numbers = [n.replace(" ", "") for n in regex.findall(r"\b\d[\d ]*\b", q)]
    for _, text in kept:
        if regex.search(STATED, text, regex.I):
            found = frozenset(tokens(text))
            met = sum(stands_for(t, found) for t in terms)
            if met >= 2 or met and any(n in regex.sub(r"\D", "", text) for n in numbers):
                return True
    return False


def _quantified(question: str, q: str, kept: list[tuple[str, str]], words: list[frozenset[str]]) -> bool:
    """For a question after a quantity: a passage with a value, and two words of what it is a quantity of."""
    about = subject(question)
    fits = lambda w: not about or sum(stands_for(t, w) for t in about) >= min(2, len(about))
    return bool(regex.search(QUANTIFIED, q)) and any(regex.search(VALUE, t, regex.I) and fits(w) for (_, t), w in zip(kept, words))


def person_of_role(question: str, text: str) -> str | None:
    """The person that a passage gives for the role that a question asks for: in the role's line, or the one beside it."""
    q = " ".join(R.folded_words(question))
    asked = regex.search(ASKS_PERSON, q)
    role = [w for w in regex.split(r"\bet\b", q[asked.end() :])[0].split() if len(w) >= 4] if asked else []
    if not role:
        return None
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    fold = lambda x: " ".join(R.folded_words(x))
    around = fold(" ".join(x for x in lines if regex.search(ORGANISATION, fold(x))))

    def is_name(line):
        plain = regex.sub(HONORIFIC, "", line.strip(), flags=regex.I)
        parts = plain.split()
        fine = not regex.search(r"\d|[:;,!?()«»]", plain) and 2 <= len(parts) <= 4 and not regex.search(ORGANISATION, fold(plain))
        return fine and all(regex.match(r"(?:d'|l'|d’|l’)?\p{Lu}[\p{L}'’-]*$|(?:de|du|des|le|la)$", w) for w in parts)

    def named(line):
        runs = regex.findall(r"\p{Lu}[\p{L}'’-]+(?:\s+(?:(?:de|du|des|le|la)\s+)?\p{Lu}[\p{L}'’-]+){1,3}", line)
        return next((r for r in runs if is_name(r) and not set(fold(r).split()) & set(role)), None)

    for k, line in enumerate(lines):
        plain = fold(line)
        if role[0] not in plain or not all(t in plain or t in around for t in role[1:]):
            continue
        if found := named(line):
            return found
        if len(line.split()) > 8 or regex.search(r"\d|[.!?;]\s*$", line):
            continue
        for other in lines[max(0, k - 1) : k] + lines[k + 1 : k + 2]:
            if is_name(other) or named(other):
                return other if is_name(other) else named(other)
    return None


def missing_duration(question: str, draft: str, passages: list[Passage]) -> tuple[int, str] | None:
    """(place, duration) of the passage that covers a question best among those with a duration that its draft lacks."""
    asked, stated = R.durations_asked(question), R.duration_mentions(draft)
    if asked < 2 or len(stated) >= asked:
        return None
    found = [(R.scope_coverage(question, R.held(p.text)), -p.place, next(v for k, v in R.duration_mentions(p.text).items() if k not in stated))
             for p in passages if set(R.duration_mentions(p.text)) - set(stated)]
    best = max(found, default=None)
    return (-best[1], best[2]) if best else None


def answerable(hits: DataFrame) -> DataFrame:
    """query_id, bears, person: whether each question's evidence bears on it, and the person it gives for an asked role.

    hits: query_id, question, position, name, text. Null texts are empty; repeated rows count once.
    """
    kind = T.StructType([T.StructField("bears", T.BooleanType()), T.StructField("person", T.StringType())])

    def of(question, rows):
        passages = list(dict.fromkeys((r["name"] or "", r["text"] or "") for r in rows))
        return [(bears(question, passages), next((p for _, t in passages if (p := person_of_role(question, t))), None))]

    return by_question(hits.select("query_id", "question", "position", "name", "text"), "position", kind, of)
