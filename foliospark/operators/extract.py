"""Extractive answers over a question's packed evidence: facts of labels and values, and one function for each shape of answer.

A question has some tens of passages at most (what packing lets through), so each is answered as a whole, in one group.
An answer is lines of text, each with the places of the passages that it cites; a shape that doesn't fit gives none.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliospark.functions import relevance
from foliospark.functions.numbers import NUMBER_WORDS
from foliospark.plans.questions import analyze, folded

#: All constants from here to the first class are fixed values: words that tell what a question or a passage is about.
BULLET = r"[-•●✓✗!]"
YES_NO = r"(?:oui|non|yes|no)"
COMPARES = r"\b(?:coherent|coherence|difference|ecart|contradiction|compare)\w*\b"
CHOSEN = r"\b(?:ajoute|ajoutee|selectionne|selectionnee|inclus|incluse|oui|non|added|selected|included|yes|no|not)\b"
ADVISES = r"\b(?:conseill|recommand|recommend|advis)\w*\b"
DENIED = r"\b(?:non|pas|not|no)\b"
CALCULATES = r"\b(?:calcul|calcule|calculate|compute|font elles|do they equal)\b"
PAYMENTS = r"(?:mensualites?|versements?|paiements?|payments?|installments?)"
ANNUAL = r"\b(?:prime|cotisation)\s+annuelle[^\d]{0,30}(\d+(?:[.,]\d+)?)\s*(?:€|euros?|eur\b)"
ASKS_ACTION = r"\bque (?:dois|devons|faut)[- ]?(?:je|nous|il)\b|\bwhat (?:should|must) (?:i|we) do\b"
ACTION = r"\b(?:obligations?|tenu|avertiss\w*|alert\w*|signal\w*|prenez|prendre|fourniss\w*|devez|doit|notify|report|provide|must|required)\b"
DUTY = r"\b(?:obligations?|tenu|required|must)\b"
ASKS_EFFECT = r"\b(?:consequences?|entraine\w*|result\w*|happens?|effect)\b"
EFFECT = r"\b(?:entraine\w*|consequence|results? in|leads? to)\b"
ALL = r"\b(?:tous|toutes|all|exhaustif|exhaustive)\b"
LIMITS = r"\b(?:montant|plafond|limite|amount|limit)\w*\b"
LIMIT_VALUE = r"\d[\d\s.,]*\s*(?:€|eur\b|euros?\b)|\billimit\w*\b|\bunlimited\b"
MISSING = (("name", r"\b(?:nom|name)\b"), ("brand", r"\b(?:marque|brand)\b"), ("item", r"\b(?:objet precis|specific (?:object|item))\b"))
ABSENT = rf"^{YES_NO}(?:\s|$)|\b(?:non ajoute|not added|absent|none)\b"
ASKS_RIGHTS = r"\b(?:droits?|rights?|obligations?|duties)\b"
RIGHT = r"\b(?:droit|acceder|retirer|rectifier|supprimer|restreindre|obtenir|plainte|opposer|access|withdraw|rectif|delete|restrict|obtain|complain|object)\w*\b"
MEASURE = rf"\b(?:\d+|{'|'.join(NUMBER_WORDS)})\s*(?:\(\s*\d+\s*\)\s*)?(?:%|€|eur|jours?|mois|ans?|annees?|days?|months?|years?)\b|\+?\d[\d  ]{{7,}}\d"


@dataclass(frozen=True)
class Passage:
    place: int
    document: str
    page: int | None
    seq: int | None
    score: float
    text: str


@dataclass(frozen=True)
class Fact:
    passage: Passage
    label: str
    value: str

    @property
    def line(self) -> str:
        return f"{self.label}: {self.value}"


Answer = list[tuple[str, tuple[int, ...]]]


def _has(pattern: str, text: str) -> bool:
    return regex.search(pattern, text, regex.I) is not None


@lru_cache(20_000)
def coverage(query: str, text: str) -> float:
    return relevance.scope_coverage(query, relevance.held(text))


def logical_lines(text: str) -> list[str]:
    """Lines, those joined that a line break cuts within a sentence."""
    out: list[str] = []
    for line in (x.strip() for x in text.split("\n")):
        if not line:
            continue
        joins = out and not regex.search(r"[.!?;:]$", out[-1]) and regex.match(r"[\p{Ll}(]", line)
        out[-1:] = [f"{out[-1]} {line}"] if joins else [*out[-1:], line]
    return out


def units(passages: list[Passage]) -> list[tuple[Passage, str]]:
    """Logical lines, their sentences, and neighbouring sentences in pairs."""
    out = []
    for p in passages:
        for line in logical_lines(p.text):
            sentences = [s.strip() for s in regex.split(r"(?<=[.!?])\s+", line) if s.strip()]
            out += [(p, u) for u in dict.fromkeys([line, *sentences, *(f"{a} {b}" for a, b in zip(sentences, sentences[1:]))])]
    return out


def label_facts(passages: list[Passage]) -> list[Fact]:
    """Labels with their values: ``label: value``, ``question? value``, a label whose value is the next line, or the next
    passage of the page if that says yes or no. Equal facts stand once; an area of ``m`` is one of square metres."""
    found: list[Fact] = []
    for p in passages:
        lines = [x.strip() for x in p.text.split("\n") if x.strip()]
        for row in dict.fromkeys([*logical_lines(p.text), *(x for x in lines if len(x) >= 4)]):
            plain = regex.sub(rf"^{BULLET}\s*", "", row).strip()
            if regex.search(rf"\s{BULLET}\s+", plain):
                continue  # several marks in a row: not one value
            m = regex.match(r"(.{3,180}?)\s*:\s*(\S.{0,220})$", plain) or regex.match(r"(.{3,180}\?)\s+(\S.{0,160})$", plain)
            if m:
                found.append(Fact(p, m[1].strip(), m[2].strip()))
        for label, value in zip(lines, lines[1:]):
            m = regex.match(rf"(?:{BULLET}\s*)?(.{{3,180}}?)\s*:$", label)
            if m and len(value) <= 220 and not regex.search(rf"[:：]$|^{BULLET}\s|^\d{{1,3}}[.)]\s", value):
                found.append(Fact(p, m[1].strip(), value))
    ordered = sorted((p for p in passages if p.seq is not None), key=lambda p: p.seq)
    for p in ordered:
        last = (logical_lines(p.text) or [""])[-1]
        if not last.endswith(":"):
            continue
        near = (q for q in ordered if (q.document, q.page) == (p.document, p.page) and 0 < q.seq - p.seq <= 2)
        answer = next((m[0] for q in near if (m := regex.match(rf"{YES_NO}\b", q.text.strip(), regex.I))), None)
        if answer:
            found.append(Fact(p, regex.sub(rf"^{BULLET}\s*|\s*:$", "", last), answer))
    unique = {(folded(f.label), folded(f.value)): f for f in reversed(found)}
    facts = sorted(unique.values(), key=found.index)
    return [replace(f, value=regex.sub(r"\s*m$", " m²", f.value)) if regex.match(r"\d+(?:[.,]\d+)?\s*m$", f.value, regex.I) else f for f in facts]


def comparison(question: str, passages: list[Passage]) -> Answer | None:
    """Options marked as not chosen that a recommendation names: their states, and the passage that recommends them."""
    if not _has(COMPARES, folded(question)):
        return None
    facts = [f for f in label_facts(passages) if _has(CHOSEN, folded(f.value))]
    advice = [(sum(coverage(f.label, u) >= 0.7 for f in facts), -p.place, p, u) for p, u in units(passages) if _has(ADVISES, folded(u))]
    if len(facts) < 2 or not advice:
        return None
    _, _, adviser, text = max(advice, key=lambda a: a[:2])
    wrong = [f for f in facts if _has(DENIED, folded(f.value)) and coverage(f.label, text) >= 0.7]
    if not wrong:
        return None
    places = {f.passage.place for f in wrong}
    states = [(f.line, (f.passage.place,)) for f in facts if f.passage.place in places]
    return [*states, (", ".join(f.label for f in wrong), (adviser.place, wrong[0].passage.place))]


def product_check(question: str, passages: list[Passage]) -> Answer | None:
    """``n`` payments of an amount, both of the question, against the annual amount of the evidence."""
    q = folded(question)
    n = regex.search(rf"\b(\d+|{'|'.join(NUMBER_WORDS)})\s+{PAYMENTS}\b", q)
    each = regex.search(rf"{PAYMENTS}[^\d]{{0,20}}(\d+(?:[.,]\d+)?)", q)
    stated = next(((p, m) for p, u in units(passages) if (m := regex.search(ANNUAL, u, regex.I))), None)
    if not (_has(CALCULATES, q) and n and each and stated):
        return None
    number = lambda x: float(x.replace(",", "."))
    times = NUMBER_WORDS.get(n[1]) or int(n[1])
    total, annual = times * number(each[1]), number(stated[1][1])
    gap = abs(annual - total)
    text = f"{times} × {number(each[1]):g} = {total:g}; {annual:g}" + ("" if gap < 0.005 else f"; difference {gap:g}")
    return [(text, (stated[0].place,))]


def obligations(question: str, passages: list[Passage]) -> Answer | None:
    """What one has to do: the passage that covers the question best, and up to three others of its page near it."""
    if not _has(ASKS_ACTION, folded(question)):
        return None
    acting = [p for p in passages if _has(ACTION, p.text)]
    worth = lambda p: coverage(question, p.text) + (0.8 if _has(DUTY, p.text) else 0.2)
    anchor = max(acting, key=lambda p: (worth(p), -p.place), default=None)
    if anchor is None or worth(anchor) < 0.35:
        return None
    near = lambda p: anchor.seq is None or p.seq is None or abs(p.seq - anchor.seq) <= 4
    return [(p.text.strip(), (p.place,)) for p in acting if (p.document, p.page) == (anchor.document, anchor.page) and near(p)][:4]


def duration_sequence(question: str, passages: list[Passage]) -> Answer | None:
    """For three clauses or more: the two to four neighbouring sentences with two durations that cover the question best."""
    clauses = len(relevance.query_clauses(question))
    if clauses < 3:
        return None
    best = None
    for p in passages:
        text = regex.sub(r"\s*\n\s*", " ", p.text)
        sentences = [s.strip() for s in regex.split(r"(?<=[.!?])\s+(?=[\p{Lu}«“\"'])", text) if len(s.strip()) >= 20]
        for n in range(2, min(4, clauses) + 1):
            for window in (" ".join(sentences[i : i + n]) for i in range(len(sentences) - n + 1)):
                if len(relevance.duration_mentions(window)) >= 2:
                    offered = (coverage(question, window), -len(window), -p.place, window, p.place)
                    best = offered if best is None or offered[:3] > best[:3] else best
    return [(best[3], (best[4],))] if best and best[0] >= 0.3 else None


def together(question: str, passages: list[Passage]) -> Answer | None:
    """For several clauses: the passage that has the last long word of each, with the most different measures."""
    slots = relevance.query_clauses(question)
    if len(slots) < 2:
        return None
    ends = [next((w for w in reversed(relevance.folded_words(s)) if len(w) >= 4), None) for s in slots]
    fits = lambda p: all(e in folded(p.text) if e else coverage(s, p.text) >= 0.12 for s, e in zip(slots, ends))
    measures = lambda p: len(set(regex.findall(MEASURE, p.text, regex.I)))
    found = [p for p in passages if fits(p) and measures(p) >= min(2, len(slots))]
    best = max(found, key=lambda p: (measures(p), p.score, -p.place), default=None)
    return [(best.text.strip(), (best.place,))] if best else None


def labelled_number(question: str, passages: list[Passage]) -> Answer | None:
    """A long number after ``label n°``, of a label that the question covers and that leaves little of it unsaid."""
    if analyze(question).route != "targeted":
        return None
    label = r"(\p{L}[\p{L}'’.-]*(?:\s+\p{L}[\p{L}'’.-]*){0,5})\s+(?:n\s*[°ºo]|№)\s*$"
    for p in passages:
        for m in regex.finditer(r"\b\d[\d ]{5,}\d\b", p.text):
            before = regex.search(label, p.text[max(0, m.start() - 100) : m.start()], regex.I)
            if not before:
                continue
            words = before[1].split()
            named = max((" ".join(words[i:]) for i in range(len(words))), key=lambda x: (coverage(x, question), -len(x)))
            rest = " ".join(w for w in relevance.folded_words(question) if w not in relevance.folded_words(named))
            number = m[0].replace(" ", "")
            said = f"le numero demande est {number}" if analyze(question).locale == "fr" else f"the requested number is {number}"
            if coverage(named, question) >= 0.75 and coverage(rest, said) >= 0.8:
                return [(f"{named} {number}", (p.place,))]
    return None


def numbered_identity(question: str, passages: list[Passage]) -> Answer | None:
    """A number after ``label n°`` with the name in capitals that follows it within 180 characters."""
    if analyze(question).route != "synthesis" or len(relevance.query_clauses(question)) > 2:
        return None
    name = r"\b\p{Lu}{2,}(?:[-'’]\p{Lu}+)?(?:\s+\p{Lu}{2,}(?:[-'’]\p{Lu}+)?){1,4}\b"
    for p in passages:
        for m in regex.finditer(r"\b\d[\d ]{7,}\d\b", p.text) if coverage(question, p.text) >= 0.18 else ():
            label = regex.search(r"(?:\p{L}[\p{L}'’.-]*\s+){0,3}(?:n[°ºo]|№)\s*$", p.text[max(0, m.start() - 60) : m.start()], regex.I)
            who = regex.search(name, p.text[m.end() : m.end() + 180])
            if label and who:
                return [(f"{' '.join(label[0].split()[-3:])} {m[0].replace(' ', '')} {who[0].strip()}", (p.place,))]
    return None


def consequence(question: str, passages: list[Passage]) -> Answer | None:
    """The best covered passage that tells an effect, and the next one of its document if it is cut within a sentence."""
    telling = [p for p in passages if _has(EFFECT, folded(p.text))] if _has(ASKS_EFFECT, folded(question)) else []
    best = max(telling, key=lambda p: (coverage(question, p.text), -p.place), default=None)
    if best is None or coverage(question, best.text) < 0.2:
        return None
    cut = best.seq is not None and not regex.search(r"[.!?;:]$", best.text.strip())
    after = [p for p in passages if cut and p.document == best.document and p.seq == best.seq + 1]
    return [(p.text.strip(), (p.place,)) for p in [best, *after[:1]]]


def all_limits(question: str, passages: list[Passage]) -> Answer | None:
    """All amounts of a form: the page with most of them and its neighbours, four labels or more."""
    q = folded(question)
    facts = [f for f in label_facts(passages) if f.passage.page is not None and _has(LIMIT_VALUE, f.value)] if _has(ALL, q) and _has(LIMITS, q) else []
    pages = [f.passage.page for f in facts]
    seed = max(pages, key=lambda x: (pages.count(x), -pages.index(x)), default=None)
    kept = [f for f in facts if abs(f.passage.page - seed) <= 1]
    if not kept or pages.count(seed) < 2 or len(kept) < 4:
        return None
    return [(f.line, (f.passage.place,)) for f in {folded(f.label): f for f in reversed(kept)}.values()][::-1]


def form_slots(question: str, passages: list[Passage]) -> Answer | None:
    """For two clauses or more: each clause's fact, given out greedily from the best pair of clause and label down."""
    slots = relevance.query_clauses(question)[:8]
    concrete = rf"\d|\b{YES_NO}\b|m²|m2|€"
    facts = [f for f in label_facts(passages) if len(f.value) <= 60 or _has(concrete, f.value)]
    if len(slots) < 2 or len(facts) < 2 or _has(COMPARES, folded(question)):
        return None
    exact = lambda s, f: relevance.exact_coverage(s, relevance.held(f.label))
    pairs = [(coverage(s, f.label) + 0.5 * exact(s, f), -i, -k) for i, s in enumerate(slots) for k, f in enumerate(facts) if coverage(s, f.label) >= 0.3]
    given: dict[int, int] = {}
    for _, i, k in sorted(pairs, reverse=True):
        if -i not in given and -k not in given.values():
            given[-i] = -k
    if len(given) < 2:
        return None
    return [(facts[k].line, (facts[k].passage.place,)) for k in sorted(given.values())]


def missing_attribute(question: str, passages: list[Passage]) -> Answer | None:
    """A name, brand or item that is asked for, of which the documents only say yes, no or absent."""
    asked = next((name for name, pattern in MISSING if _has(pattern, folded(question))), None)
    facts = [f for f in label_facts(passages) if _has(ABSENT, folded(f.value))] if asked else []
    worth = lambda f: coverage(question, f"{f.label} {f.value}")
    best = max(facts, key=lambda f: (worth(f), -f.passage.place), default=None)
    return [(best.line, (best.passage.place,)), (f"{asked}: not specified", ())] if best and worth(best) >= 0.25 else None


def rights(question: str, passages: list[Passage]) -> Answer | None:
    """Three to twelve different bulleted rights; one that holds another of 40 characters or more stands for both."""
    if not _has(ASKS_RIGHTS, folded(question)):
        return None
    kept: list[tuple[Passage, str]] = []
    for p, u in units(passages):
        if not regex.match(BULLET, u) or coverage(question, u) < 0.18 or not _has(RIGHT, folded(u)):
            continue
        same = lambda a, b: a == b or min(len(a), len(b)) >= 40 and (a in b or b in a)
        if not any(same(folded(u), folded(v)) for _, v in kept):
            kept.append((p, u))
    return [(regex.sub(rf"^{BULLET}\s*", "", u).strip(), (p.place,)) for p, u in kept[:12]] if len(kept) >= 3 else None


def numbered_explanation(question: str, passages: list[Passage]) -> Answer | None:
    """For an explanation with one number: the passages that have it and their neighbours on the page, two to four."""
    numbers = set(regex.findall(r"\d+(?:[.,]\d+)?", question))
    if len(numbers) != 1 or not _has(r"\b(?:explique\w*|pourquoi|comment|explain|why|how)\b", folded(question)):
        return None
    number = next(iter(numbers))
    core = [p for p in passages if regex.search(rf"(?<!\d){regex.escape(number)}(?!\d)", p.text) and coverage(question, p.text) >= 0.2]
    near = [q for q in passages for p in core if (q.document, q.page) == (p.document, p.page) and None not in (q.seq, p.seq) and abs(q.seq - p.seq) <= 1]
    kept = sorted({p.place: p for p in [*core, *near]}.values(), key=lambda p: (p.document, p.seq or 0, p.place))
    return [(p.text.strip(), (p.place,)) for p in kept[:4]] if core and len(kept) >= 2 else None


#: The order in which shapes are tried.
SHAPES = (
    comparison, product_check, missing_attribute, form_slots, all_limits, obligations, duration_sequence, labelled_number, numbered_identity,
    consequence, rights, numbered_explanation, together,
)


_COLUMNS = ("query_id", "question", "position", "document_id", "page", "seq", "score", "text")


def by_question(rows: DataFrame, order: str, kind: T.StructType, of) -> DataFrame:
    """``of(question, rows)``, as rows of ``kind``, for each query_id: its rows, as dictionaries, in one task and in order."""
    dealt = rows.repartition("query_id").sortWithinPartitions("query_id", order)
    full = T.StructType([rows.schema["query_id"], *kind.fields])
    arrow = to_arrow_schema(full)

    def run(batches):
        now, held = None, []

        def made():
            return [dict(zip(arrow.names, (now[0], *row))) for row in of(held[0]["question"] or "", held)]

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None or r["query_id"] != now[0]:
                    out += made() if held else []
                    now, held = (r["query_id"],), []
                held.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist(made(), schema=arrow)

    return dealt.mapInArrow(run, full)


def _passages(rows: list[dict]) -> list[Passage]:
    return [Passage(r["position"], str(r["document_id"]), r["page"], r["seq"], float(r["score"] or 0), r["text"] or "") for r in rows]


def _kind(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)


def answers(hits: DataFrame, shapes: tuple = SHAPES) -> DataFrame:
    """query_id, shape, line, text, places: each question's answer of the first shape that fits, by lines.

    hits: query_id, question, position, document_id, page, seq, score, text, as packing leaves them: some tens for each
    question. Questions that no shape fits give no rows; null texts are empty.
    """

    def of(question, rows):
        passages = _passages(rows)
        for shape in shapes:
            if made := shape(question, passages):
                return [(shape.__name__, i, text, list(places)) for i, (text, places) in enumerate(made)]
        return []

    return by_question(hits.select(*_COLUMNS), "position", _kind("shape string, line int, text string, places array<int>"), of)


def facts(hits: DataFrame) -> DataFrame:
    """query_id, position, label, value: the label facts of each question's passages."""
    of = lambda _, rows: [(f.passage.place, f.label, f.value) for f in label_facts(_passages(rows))]
    return by_question(hits.select(*_COLUMNS), "position", _kind("position int, label string, value string"), of)
