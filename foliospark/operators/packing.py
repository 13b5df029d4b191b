"""Evidence packing: which of a question's ranked passages, and of those around them, go before a reader, and in which order.

Passages are offered by families: carriers of what the question asks for, the passages around the best ones, the best of
each clause, of each document, and so on. Families are offered one after the other, in an order that depends on the kind
of question; a passage is taken unless it repeats one that is taken, its place has its share, or the budget is spent. A
question has some tens of candidates (what ranking leaves), so each is packed as a whole, in one group.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliospark.functions import relevance as R
from foliospark.operators.evidence import BUDGET, OVERHEAD, SIMILAR
from foliospark.operators.extract import by_question
from foliospark.operators.grounding import canonical, runs
from foliospark.plans.questions import analyze, folded

#: Words that go on from a sentence before; of coverage; of first and last in a series.
CONTINUES = r"^(?:ce|cet|cette|ces|seulement|si|lorsque|apres|avant|toutefois|mais|oui|non)\b"
COVERS = r"\b(?:couvert\w*|assure\w*|eligible|autorise\w*|permis|covered|insured|allowed)\b"
FIRST, LAST = r"\b(?:premier|premiere|first)\b", r"\b(?:dernier|derniere|last|final)\b"
SERIES = r"\b(?:echeance|mensualite|versement|paiement|payment|instal?lment)\w*\b"
LONG = 140


@dataclass(frozen=True)
class Hit:
    """A passage; ``rank`` is null for one that was only found beside another."""

    question: str
    chunk: int
    document: str
    name: str
    heading: str
    page: int | None
    seq: int | None
    score: float
    rank: int | None
    parent: bool
    structure: str
    text: str

    @cached_property
    def words(self) -> R.Held:
        return R.held(self.text)

    @cached_property
    def whole(self) -> R.Held:
        return R.held("\n".join(x for x in (self.heading, self.structure, self.text) if x))

    @cached_property
    def named(self) -> float:
        return R.name_coverage(self.question, R.held(f"{self.name}\n{self.whole.text}"))

    @cached_property
    def identity(self) -> float:
        return R.identity_coverage(self.question, self.words)

    @cached_property
    def temporal(self) -> float:
        return R.temporal_coverage(self.question, self.words)

    @cached_property
    def constraint(self) -> float:
        return R.constraint_coverage(self.question, self.words)

    @cached_property
    def numeric(self) -> float:
        return R.numeric_coverage(self.question, self.words)

    @cached_property
    def numeric_scope(self) -> float:
        return R.numeric_scope(self.question, self.whole)

    @cached_property
    def contact(self) -> float:
        return R.contact_coverage(self.question, self.words)

    @cached_property
    def proximity(self) -> float:
        return R.proximity_coverage(self.question, self.text)

    @cached_property
    def coherent(self) -> bool:
        return R.clause_coverage(self.question, self.whole) == 1

    @cached_property
    def utility(self) -> float:
        return (
            R.scope_coverage(self.question, self.whole) + 0.75 * R.phrase_coverage(self.question, self.whole) + 0.5 * self.coherent
            + 2 * self.constraint + 0.4 * self.proximity + self.numeric_scope + 0.15 * self.temporal
        )

    @property
    def place(self) -> tuple:
        return (self.document, self.page if self.page is not None else self.heading or self.chunk)

    @property
    def unfinished(self) -> bool:
        return not regex.search(r"[.!?;:…]$", self.text.strip())

    @property
    def goes_on(self) -> bool:
        return regex.match(CONTINUES, " ".join(R.folded_words(self.text))) is not None


def with_scores(question: str, ranked: list[Hit], beside: list[Hit], reach: int) -> list[Hit]:
    """Ranked hits and the neighbours within reach of one, scored by it, its distance and what they cover; best first."""
    out = {h.chunk: h for h in ranked}
    for n in beside:
        near = [h for h in ranked if h.document == n.document and None not in (h.seq, n.seq) and 1 <= abs(h.seq - n.seq) <= reach]
        if n.chunk in out or not near:
            continue
        exact, rough = R.exact_coverage(question, n.words), R.approximate_coverage(question, n.words)
        share = 0.55 if exact or rough else 0.45
        out[n.chunk] = replace(n, score=near[0].score * share / abs(near[0].seq - n.seq) + 0.008 * exact + 0.02 * rough)
    return sorted(out.values(), key=lambda h: (-h.score, h.chunk))


def families(question: str, hits: list[Hit], route: str, kind: str, reach: int) -> dict[str, list[Hit]]:
    """Candidates by family, each best first. hits: best first."""
    children = [h for h in hits if not h.parent]
    best = lambda of, key, most=None: sorted((h for h in of if key(h)), key=lambda h: (*(-x for x in _tuple(key(h))), -h.score))[:most]
    after = lambda a: [h for h in children if h.document == a.document and None not in (h.seq, a.seq) and h.seq == a.seq + 1][:1]
    out = {
        "contact": [h for h in hits if h.contact][:3], "named": [h for h in hits if h.named], "identity": best(hits, lambda h: h.identity),
        "temporal": best(hits, lambda h: h.temporal), "constraint": best(hits, lambda h: h.constraint),
        "numeric": [h for h in sorted(hits, key=lambda h: (-h.numeric, -h.proximity, -h.numeric_scope, -h.score)) if h.numeric],
        "coherent": [h for h in hits if h.coherent], "scoped": sorted(hits, key=lambda h: (-h.utility, -h.score))[:2],
        "structural": best((h for h in hits if h.structure and h.utility >= 0.2), lambda h: h.utility, 3),
        "documents": list({h.document: h for h in reversed(hits)}.values())[::-1], "all": hits,
    }
    out["series"] = _series(question, children)
    out["around"] = _around(question, children, route, kind, reach) if kind == "explanation" or route == "synthesis" else []
    out["clauses"] = [h for part in R.query_clauses(question.split("\n", 1)[0]) for h in _of_clause(part, hits, 2 if route == "synthesis" else 1)]
    covering = out["scoped"] if regex.search(COVERS, folded(question)) else []
    out["covering"] = [x for h in covering for x in (h, *(after(h) if h.unfinished else ()))]
    cut = [h for h in dict.fromkeys([*out["coherent"], *out["scoped"]]) if h.seq is not None and h.unfinished]
    out["unfinished"] = [x for h in cut[:2] for x in after(h)]
    cut = [h for h in dict.fromkeys([*out["around"], *hits[:8]]) if not h.parent and h.seq is not None and h.unfinished]
    out["synthesis_goes_on"] = [x for h in cut[:2] for x in after(h)] if route == "synthesis" else []
    gaps = list(dict.fromkeys([*out["constraint"], *out["scoped"]]))[:2] if kind == "explanation" and route != "synthesis" else []
    out["gaps"] = [x for a in gaps for x in _gap(a, children)]
    return out


def _tuple(x):
    return x if isinstance(x, tuple) else (x,)


def _series(question: str, hits: list[Hit]) -> list[Hit]:
    """For the first or last payment: the passages of the most extreme date among two or more."""
    q = folded(question)
    way = 1 if regex.search(FIRST, q) else -1 if regex.search(LAST, q) else 0
    if not way or not regex.search(SERIES, q):
        return []
    found = []
    for h in hits:
        dates = {f"{y}{m}{d}" for d, m, y in regex.findall(r"\b(\d{2})[./](\d{2})[./](\d{4})\b", h.text)}
        if len(dates) >= 2:
            found.append((int(min(dates) if way > 0 else max(dates)) * way, h))
    return [h for _, h in sorted(found, key=lambda x: x[0])[:2]]


def _around(question: str, hits: list[Hit], route: str, kind: str, reach: int) -> list[Hit]:
    """The passage whose surroundings cover the question best, and up to three of them."""
    pool = [h for h in hits if h.seq is not None][:64]
    near = lambda a: [h for h in hits if h.document == a.document and h.seq is not None and abs(h.seq - a.seq) <= reach]

    def worth(a):
        window = sorted(near(a), key=lambda h: abs(h.seq - a.seq))[:12]
        text = R.held("\n".join(h.whole.text for h in window))
        return (
            R.scope_coverage(question, text) + 0.75 * R.phrase_coverage(question, text) + R.clause_coverage(question, text)
            + 2 * R.constraint_coverage(question, text) + R.numeric_scope(question, text) + 0.35 * R.numeric_coverage(question, text)
        )

    if not pool:
        return []
    anchor = max(pool, key=lambda h: (worth(h), h.utility, h.score))
    tells = [h for h in near(anchor) if h is anchor or len(h.text.strip()) >= LONG or abs(h.seq - anchor.seq) <= 1 or h.goes_on]
    order = lambda h: (h is not anchor, -h.utility if route == "synthesis" else 0, abs(h.seq - anchor.seq), -len(h.text), -h.score)
    return sorted(tells, key=order)[:4]


def _of_clause(part: str, hits: list[Hit], most: int) -> list[Hit]:
    """The best of a clause by coverage and by evidence of its type; of a clause that asks for a number, a carrier at least."""
    rows = []
    for h in hits:
        scope = R.scope_coverage(part, h.whole)
        number = R.numeric_coverage(part, h.words)
        typed = max(
            R.temporal_coverage(part, h.words) * max(scope, 0.25), R.identity_coverage(part, h.words) * max(scope, 0.25),
            number * max(R.numeric_scope(part, h.whole), R.proximity_coverage(part, h.text), 0.25) if number else 0.0,
        )
        rows.append((scope + 0.75 * typed, h.score, scope, typed, number, h))
    rows.sort(key=lambda r: (-r[0], -r[1]))
    chosen = [r for r in rows if r[2] >= 0.2 or r[3] >= 0.25][:most]
    if R.numeric_kinds(part) and not any(r[4] for r in chosen):
        chosen += [r for r in rows if r[4]][:1]
    return [r[-1] for r in chosen]


def _gap(anchor: Hit, hits: list[Hit]) -> list[Hit]:
    near = [h for h in hits if h.chunk != anchor.chunk and h.document == anchor.document and None not in (h.seq, anchor.seq) and abs(h.seq - anchor.seq) <= 2]
    near = [h for h in near if h.goes_on or len(h.text.strip()) >= LONG]
    return sorted(near, key=lambda h: (not h.goes_on, h.seq < anchor.seq, abs(h.seq - anchor.seq)))[:1]


#: The order of families for each route.
OFFERED = {
    "synthesis": "contact series structural around synthesis_goes_on clauses named identity constraint temporal coherent numeric documents all".split(),
    "targeted": "contact series structural coherent covering unfinished around gaps constraint temporal numeric scoped all".split(),
}


def repeats(a: Hit, b: Hit, route: str) -> bool:
    """Whether a passage adds nothing to another: of one document, with nearly the same terms."""
    x, y = a.words.terms, b.words.terms
    if a.document != b.document or not x or not y or len(x & y) / min(len(x), len(y)) < SIMILAR:
        return False
    claims = lambda h: {c for c in map(canonical, runs(h.text)) if "." in c or len(c) >= 3}
    if route == "synthesis" and claims(a) and claims(b) and claims(a) != claims(b):
        return False
    return route != "aggregate" or (a.page, a.heading) == (b.page, b.heading)


def pack(question: str, ranked: list[Hit], beside: list[Hit], top: int = 16, budget: int = BUDGET, route: str | None = None) -> list[tuple[str, Hit]]:
    """(family, passage) of the evidence, in order."""
    route, kind = route or analyze(question).route, analyze(question).shape
    reach = 8 if kind == "explanation" or route == "synthesis" else 1
    share = 6 if kind == "explanation" or route == "synthesis" else 4
    hits = with_scores(question, ranked, beside, reach)
    if route == "aggregate":
        offered = [("ranked", h) for h in sorted(ranked, key=lambda h: h.rank or 0)] + [("all", h) for h in hits]
    else:
        found = families(question, hits, route, kind, reach)
        offered = [(name, h) for name in OFFERED["synthesis" if route == "synthesis" else "targeted"] for h in found[name]]
    taken: list[tuple[str, Hit]] = []
    used, places = 0, {}
    for name, h in offered:
        cost = len(h.text) + len(h.name) + OVERHEAD
        if h.parent or any(h.chunk == k.chunk or repeats(k, h, route) for _, k in taken):
            continue
        if places.get(h.place, 0) >= share or taken and used + cost > budget:
            continue
        taken.append((name, h))
        used += cost
        places[h.place] = places.get(h.place, 0) + 1
        if len(taken) == top:
            break
    return taken


_COLUMNS = "query_id question chunk_id document_id document_name heading page seq score rank is_parent structure text".split()


def packed_evidence(candidates: DataFrame, top: int = 16, budget: int = BUDGET) -> DataFrame:
    """query_id, position, chunk_id, family: each question's evidence in order.

    candidates: query_id, question, chunk_id, document_id, document_name, heading, page, seq, score, rank (null: a
    neighbour of a ranked one), is_parent, structure, text. Null texts are empty; parents are never taken; repeated rows
    count once; an empty table gives an empty one.
    """

    def of(question, rows):
        made = [
            Hit(question, r["chunk_id"], str(r["document_id"]), r["document_name"] or "", r["heading"] or "", r["page"], r["seq"], float(r["score"] or 0),
                r["rank"], bool(r["is_parent"]), r["structure"] or "", r["text"] or "") for r in {r["chunk_id"]: r for r in rows}.values()
        ]
        ranked = sorted((h for h in made if h.rank is not None), key=lambda h: h.rank)
        taken = pack(question, ranked, [h for h in made if h.rank is None], top, budget)
        return [(i + 1, h.chunk, name) for i, (name, h) in enumerate(taken)]

    kind = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("chunk_id", candidates.schema["chunk_id"].dataType), T.StructField("family", T.StringType())])
    return by_question(candidates.select(*_COLUMNS), "chunk_id", kind, of)
