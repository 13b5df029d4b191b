"""Whether the numbers of an answer stand in its evidence: as they are, as dates, by one step, or by arithmetic it shows."""

from __future__ import annotations

import re
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import relevance
from foliospark.functions.numbers import DATE_OR_TIME, NUMBER_RUN, calendar_dates
from foliospark.plans.questions import folded, locale

#: Signs of a computation in an answer; integers that need no evidence; rounding.
SHOWS_WORK = r"[×÷*=]|(?:^|[^\W\d_]*\W)(?:diff[ée]rence|[ée]cart|gap)(?=$|\W)"
SMALL = frozenset(map(str, range(21)))
TOLERANCE = 0.005
_STEPS = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b if b else float("nan")}
_SIGNS = {"+": "+", "-": "-", "×": "*", "*": "*", "÷": "/", "/": "/"}


def canonical(run: str) -> str:
    """The value that a run of digits denotes; see ``numbers.canonical_number``."""
    decimal = re.match(r"^(.*)[.,](\d+)$", run)
    if re.match(DATE_OR_TIME, run) or re.match(r"^\d{1,3}(?:,\d{3}){2,}$", run) or not decimal:
        return re.sub(r"\D", "", run)
    whole, fraction = re.sub(r"\D", "", decimal[1]), decimal[2].rstrip("0")
    return f"{whole}.{fraction}" if fraction else whole


def runs(text: str) -> list[str]:
    return re.findall(NUMBER_RUN, text)


def without_known_dates(answer: str, evidence: list[str]) -> str:
    """The answer with dates blanked that the evidence has too, however either writes them."""
    known = {key for passage in evidence for _, _, keys in calendar_dates(passage) for key in keys}
    for start, end, keys in calendar_dates(answer):
        if known.intersection(keys):
            answer = answer[:start] + " " * (end - start) + answer[end:]
    return answer


def one_step(value: float, pool: list[float]) -> bool:
    """Whether two numbers add up, subtract, multiply, divide or make a percentage to a value."""
    steps = (*_STEPS.values(), lambda a, b: 100 * a / b if b else float("nan"))
    return any(abs(step(a, b) - value) <= TOLERANCE for a, b in product(pool, pool) for step in steps)


def shown_results(answer: str, supported: set[str]) -> set[str]:
    """Results of chains ``a + b + c = d`` that are right and whose operands are supported; a chain has one operator."""
    number = f"({NUMBER_RUN})"
    out = set()
    for m in re.finditer(rf"{number}((?:\s*[+\-×*÷/]\s*{number})+)\s*=\s*{number}", re.sub(r"\s*[€$£%]", "", answer)):
        signs = {_SIGNS[s] for s in re.findall(r"[+\-×*÷/]", re.sub(NUMBER_RUN, "0", m[2]))}
        operands = [canonical(r) for r in [m[1], *runs(m[2])]]
        result = canonical(runs(m[0])[-1])
        if len(signs) != 1 or not all(o in supported for o in operands):
            continue
        value = float(operands[0])
        for o in operands[1:]:
            value = _STEPS[next(iter(signs))](value, float(o))
        if abs(value - float(result)) <= TOLERANCE:
            out.add(result)
    return out


def unsupported(answer: str | None, evidence: list[str] | None) -> list[str]:
    """Different numbers of an answer, in order, that its evidence doesn't carry."""
    passages = [p for p in (evidence if evidence is not None else ()) if p]
    text = without_known_dates(answer or "", passages)
    held = {canonical(r) for p in passages for r in runs(p)} | SMALL
    pool = [float(canonical(r)) for p in passages for r in runs(p) if not re.match(DATE_OR_TIME, r)]
    held |= shown_results(text, held)
    works = re.search(SHOWS_WORK, text, re.I) is not None
    missing = dict.fromkeys(canonical(r) for r in runs(text))
    return [n for n in missing if n not in held and not (works and one_step(float(n), list(dict.fromkeys(pool))))]


def verdicts(answers: DataFrame, refusal: str = "") -> DataFrame:
    """answer_id, unsupported, grounded, text: the answer, or the refusal where a number isn't grounded.

    answers: answer_id, answer, evidence (array of passages). Null answers are grounded and stay null; without evidence
    only small integers are.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def missing(answer: pd.Series, evidence: pd.Series) -> pd.Series:
        return pd.Series([unsupported(a, e) for a, e in zip(answer, evidence)])

    made = answers.withColumn("unsupported", missing("answer", "evidence"))
    fine = F.size("unsupported") == 0
    return made.select("answer_id", "unsupported", fine.alias("grounded"), F.when(fine, F.col("answer")).otherwise(F.lit(refusal)).alias("text"))


def rebound(answers: DataFrame, least: float = 0.3) -> DataFrame:
    """answer_id, place, sentence, marker, bound: each marked sentence with the passage that grounds it best.

    answers: answer_id, answer, evidence (array). ``bound`` is the marker if it names a passage that grounds the sentence
    (``least`` of the blend of coverages), else the best passage that does, else null.
    """
    kind = "array<struct<place:int,sentence:string,marker:int,bound:int>>"

    @F.pandas_udf(kind)
    def of(answer: pd.Series, evidence: pd.Series) -> pd.Series:
        return pd.Series([_rebound(a or "", [p or "" for p in (e if e is not None else ())], least) for a, e in zip(answer, evidence)])

    return answers.select("answer_id", F.explode(of("answer", "evidence")).alias("s")).select("answer_id", "s.*")


def _rebound(answer: str, passages: list[str], least: float) -> list[dict]:
    out = []
    for place, sentence in enumerate(re.split(r"(?<=[.!?\]])\s+(?=[^\[\s])", answer)):
        plain = re.sub(r"\s*\[\d+\]", "", sentence).strip()
        if not plain:
            continue
        scores = [relevance.grounding_coverage(plain, relevance.held(p)) for p in passages]
        for m in re.findall(r"\[(\d{1,3})\]", sentence):
            marker, best = int(m), max(range(len(scores)), key=lambda i: (scores[i], -i), default=None)
            fine = 1 <= marker <= len(scores) and scores[marker - 1] >= least
            bound = marker if fine else best + 1 if best is not None and scores[best] >= least else None
            out.append({"place": place, "sentence": plain, "marker": marker, "bound": bound})
    return out


def completeness(pairs: DataFrame, least: float = 0.2) -> DataFrame:
    """answer_id, clauses, covered, complete: clauses of a question that an answer covers. pairs: answer_id, question, answer."""

    @F.pandas_udf("struct<clauses:int,covered:int>")
    def of(question: pd.Series, answer: pd.Series) -> pd.DataFrame:
        rows = []
        for q, a in zip(question, answer):
            parts, text = relevance.query_clauses(q or "") or [q or ""], relevance.held(a or "")
            rows.append((len(parts), sum(relevance.scope_coverage(p, text) >= least for p in parts)))
        return pd.DataFrame(rows, columns=["clauses", "covered"])

    return pairs.withColumn("c", of("question", "answer")).select("answer_id", "c.*", (F.col("c.covered") == F.col("c.clauses")).alias("complete"))


def follows_grammar(text: Column, excerpts: Column, refusal: str) -> Column:
    """Whether an answer is the refusal, or sentences that each end in markers of its excerpts and a full stop."""
    sentence = r"[^\[\]\n]+\[\d+\](?: ?\[\d+\])*\."
    plain = F.trim(text)
    marks = F.transform(F.regexp_extract_all(plain, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.try_cast("int"))
    cited = plain.rlike(rf"^{sentence}(?:[ \n]{sentence})*$") & F.forall(marks, lambda m: F.coalesce(m.between(1, excerpts), F.lit(False)))
    return F.coalesce((plain == refusal.strip()) | cited, F.lit(False))


#: What a model may leave in its answer, and words of a gap, of agreement, of a but, and of the asker's own.
LEAKED = r"(?:^|\n+)\s*(?:Structured evidence inventory|Internal evidence facts)[^:\n]*:.*"
THOUGHT = r"<think>.*?(?:</think>|$)|\s*</?answer>\s*$"
GAP = r"(?:[ée]cart|difference|diff[ée]rence)\s+(?:est|is|:)?\s*(?:de|of)?\s*([-−]?\d+(?:[.,]\d+)?)"
AGREES, BUT = r"\b(?:coherent\w*|coherence|consistent|consistency)\b", r"\b(?:cependant|toutefois|or|however|but)\b"
DISAGREES = r"\b(?:ecart|contradiction|incoherent|discrepancy|inconsistent|non ajoute\w*|not selected)\b"
OWN = (("Mon|Ma", "Votre"), ("Mes", "Vos"), ("My", "Your"))


def with_invariants(question: str | None, answer: str | None) -> str | None:
    """An answer without what a model left in it, and without contradicting itself.

    Thoughts, answer tags and listed evidence go; a stated gap other than zero doesn't follow a yes; ``(a - b)`` after a gap
    stands in the order that gives it; what is said to agree and then not to doesn't agree; the asker's own is theirs.
    """
    if answer is None:
        return None
    question, text = question or "", re.sub(THOUGHT, "", answer, flags=re.S | re.I)
    text = re.sub(LEAKED, "", text, flags=re.S | re.I).strip()
    number = lambda x: float(x.replace(",", ".").replace("−", "-"))
    if (gap := re.search(GAP, text, re.I)) and abs(number(gap[1])) > 1e-9:
        no = "No" if locale(question) == "en" else "Non"
        text = re.sub(r"^(\s*(?:\d+[.)]\s*)?)(?:oui|yes)\b", rf"\g<1>{no}", text, flags=re.I)
        formula = r"\(\s*(\d+(?:[.,]\d+)?)\s*([-−])\s*(\d+(?:[.,]\d+)?)\s*\)"

        def turned(m):
            a, b = number(m[1]), number(m[3])
            swap = abs(b - a - number(gap[1])) < 1e-9 <= abs(a - b - number(gap[1]))
            return f"({m[3]} {m[2]} {m[1]})" if swap else m[0]

        text = re.sub(formula, turned, text, count=1)
    said = folded(text)
    if re.search(AGREES, folded(question)) and re.search(BUT, said) and re.search(DISAGREES, said):
        text = re.sub(r"\best coh[ée]rent(e)?\b", r"n'est pas cohérent\1", text, flags=re.I)
        text = re.sub(r"\bis consistent\b", "is not consistent", text, flags=re.I)
    if re.search(r"\b(?:mon|ma|mes|my)\b", folded(question)):
        for own, yours in OWN:
            text = re.sub(rf"(^|[.!?]\s+|\n)(?:{own})(?=\s+[^\W\dA-ZÀ-Þ_])", rf"\g<1>{yours}", text)
    return text


def looping(text: str, span: int = 24, times: int = 3) -> bool:
    """Whether a text ends in the same ``span`` characters or more, ``times`` in a row: a stream that has gone into a loop."""
    tail = text[-2000:]
    return any(len(tail) >= n * times and tail.endswith(tail[-n:] * times) for n in range(span, len(tail) // times + 1))


def stopped_streams(deltas: DataFrame) -> DataFrame:
    """stream_id, text, looped: the text of each stream up to where it goes into a loop. deltas: stream_id, seq, delta."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        text = ""
        for delta in pdf.sort_values("seq").delta:
            text += delta or ""
            if looping(text):
                return pd.DataFrame({"stream_id": [pdf.stream_id.iloc[0]], "text": [text], "looped": [True]})
        return pd.DataFrame({"stream_id": [pdf.stream_id.iloc[0]], "text": [text], "looped": [False]})

    return deltas.groupBy("stream_id").applyInPandas(cut, f"stream_id {dict(deltas.dtypes)['stream_id']}, text string, looped boolean")
