"""Numbers, money, dates and durations in text, as column expressions. Money is integer minor units and a currency."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import fold_accents, let, normalize_question

#: Blanks that separate thousands; the grammar of number runs, dates and times; currencies and amounts.
GAP = "[   ]"
NUMBER_RUN = (
    r"\d{1,4}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}[:h]\d{2}|\d{1,3}(?:,\d{3}){2,}"
    rf"|\d{{1,3}}(?:{GAP}\d{{3}})*[.,]\d+|\d{{1,4}}(?:{GAP}\d{{3}})+|\d+"
)
DATE_OR_TIME = r"^(\d{1,4}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}[:h]\d{2})$"
CURRENCY = r"EUR|USD|GBP|CHF|GNF|€|\$|£"
AMOUNT = "(?:\\(|[-−])?\\d+(?:[\\s  .,]\\d+)*\\)?"
MONEY = rf"(?i)((?:{CURRENCY})\s*{AMOUNT}|{AMOUNT}\s*(?:{CURRENCY}))"
#: Months of both languages, without accents.
MONTHS = {
    "janvier": 1, "january": 1, "fevrier": 2, "february": 2, "mars": 3, "march": 3, "avril": 4, "april": 4, "mai": 5,
    "may": 5, "juin": 6, "june": 6, "juillet": 7, "july": 7, "aout": 8, "august": 8, "septembre": 9, "september": 9,
    "octobre": 10, "october": 10, "novembre": 11, "november": 11, "decembre": 12, "december": 12,
}
#: Roles of an amount by words of its label, the first that matches.
ROLES = (
    ("received", r"\b(montant recu|recu par|amount received|received amount|beneficiary receives?)\b"),
    ("fee", r"\b(frais|commission|fees?|charges?)\b"),
    ("debited", r"\b(total debite|total preleve|total charged|debited total)\b"),
    ("total_ttc", r"\b(ttc|net a payer|amount due|total due|grand total)\b"),
    ("subtotal", r"\b(total ht|sous total|subtotal)\b"),
    ("tax", r"\b(tva|vat|taxe|tax)\b"),
    ("total", r"\btotal\b"),
    ("amount", r"\b(montant|amount)\b"),
)
#: Units of duration and number words.
NUMBER_WORDS = {
    "une": 1, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9, "dix": 10, "onze": 11,
    "douze": 12, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
}
UNITS = {"jours?|days?": "day", "semaines?|weeks?": "week", "mois|months?": "month", "ans?|annees?|years?": "year"}


def number_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NUMBER_RUN})"), F.lit(1))


def canonical_number(run: Column) -> Column:
    """The value that a run denotes: dates, times and grouped integers keep their digits, decimals lose their zeros."""
    digits = F.regexp_replace(run, r"\D", "")
    fraction = F.regexp_replace(F.regexp_extract(run, r"^.*[.,](\d+)$", 1), "0+$", "")
    whole = F.regexp_replace(F.regexp_extract(run, r"^(.*)[.,]\d+$", 1), r"\D", "")
    return (
        F.when(run.rlike(DATE_OR_TIME) | run.rlike(r"^\d{1,3}(?:,\d{3}){2,}$") | ~run.rlike(r"[.,]\d+$"), digits)
        .when(fraction != "", F.concat_ws(".", whole, fraction))
        .otherwise(whole)
    )


def canonical_numbers(text: Column) -> Column:
    return F.transform(number_runs(text), canonical_number)


def numeric_values(text: Column) -> Column:
    """Quantities without dates and times."""
    runs = F.filter(number_runs(text), lambda r: ~r.rlike(DATE_OR_TIME))
    return F.transform(runs, lambda r: canonical_number(r).cast("double"))


def currency_code(token: Column) -> Column:
    named = F.create_map(*[F.lit(x) for x in ("€", "EUR", "$", "USD", "£", "GBP")])
    return F.coalesce(F.element_at(named, token), F.upper(token))


def minor_units(raw: Column, currency: Column) -> Column:
    """Minor units of an amount literal. Two digits after the last separator are a fraction, but not for GNF."""
    return let(F.regexp_replace(raw, r"[^0-9.,]", ""), lambda value: _minor(value, raw.rlike(r"[-−(]"), currency))


def _minor(value: Column, negative: Column, currency: Column) -> Column:
    digits = F.regexp_replace(value, "[.,]", "").cast("long")
    amount = F.when((currency == "GNF") | value.rlike(r"[.,]\d\d$"), digits).otherwise(digits * 100)
    return F.when(negative, -amount).otherwise(amount)


def money_role(label: Column) -> Column:
    return _role_of(normalize_question(label))


def money_candidates(text: Column) -> Column:
    """Array of (value_minor, currency, kind, label, confidence, raw): amounts with a currency and a role in their line.

    The label of an amount is what stands before it in the line, from the previous amount on, at most 80 characters.
    """

    def in_line(line: Column) -> Column:
        found = F.regexp_extract_all(line, F.lit(MONEY), F.lit(1))
        # Labels: the line cut at its amounts; the part before the k-th amount is its label.
        labels = F.split(F.regexp_replace(line, MONEY, "\x01"), "\x01")

        def one(raw, i):
            code = currency_code(F.regexp_extract(raw, rf"(?i)({CURRENCY})", 1))
            label = F.trim(F.get(labels, i))
            label = F.right(label, F.lit(80))
            kind = money_role(label)
            amount = F.trim(F.regexp_replace(raw, rf"(?i)(?:{CURRENCY})", ""))
            return F.struct(
                minor_units(amount, code).alias("value_minor"), code.alias("currency"), kind.alias("kind"), label.alias("label"),
                F.when(kind == "total_ttc", 0.98).when(kind == "amount", 0.85).otherwise(0.92).alias("confidence"),
                raw.alias("raw"),
            )

        return F.filter(F.transform(found, one), lambda m: m["kind"].isNotNull() & m["value_minor"].isNotNull())

    return F.flatten(F.transform(F.split(text, "\n"), in_line))


#: Fixed value: what the lines around an amount say of one that was received, where a column wraps its label.
RECEIVED = r"\b(montant recu|recu par|amount received|received amount|beneficiary receives?)\b"


def money_rows(df: DataFrame, text: str, at: str = "place") -> DataFrame:
    """``df`` with a row for each amount that has a currency and a role, as plain columns instead of an array.

    Adds value_minor, currency, kind, label, confidence, raw, and ``at``: (line, number) in order. An amount without a
    role in its line is ``received`` if its line with those around it says so. Only lines with an amount are looked at.
    """
    lines = df.withColumn("_lines", F.split(text, "\n")).select("*", F.posexplode("_lines").alias("_line_no", "_line"))
    lines = lines.filter(F.col("_line").rlike(MONEY))
    around = lambda k: F.coalesce(F.get("_lines", F.col("_line_no") + k), F.lit(""))
    labels = F.split(F.regexp_replace("_line", MONEY, "\x01"), "\x01")

    # All that regular expressions make of an amount is made before it is exploded: a filter on plain columns of the
    # rows would be pushed down with the expressions in it, and work them out again.
    def amount(raw, i):
        code = currency_code(F.regexp_extract(raw, rf"(?i)({CURRENCY})", 1))
        label = F.right(F.trim(F.get(labels, i)), F.lit(80))
        digits = F.regexp_replace(raw, rf"(?i)(?:{CURRENCY})", "")
        value = let(F.regexp_replace(digits, r"[^0-9.,]", ""), lambda v: _minor(v, digits.rlike(r"[-−(]"), code))
        return let(normalize_question(label), lambda q: F.struct(
            raw.alias("raw"), label.alias("label"), code.alias("currency"), value.alias("value_minor"), _role_of(q).alias("kind")))

    def roles(m):
        near = normalize_question(F.trim(F.concat_ws(" ", around(-1), m["label"], around(1))))
        return m.withField("kind", F.coalesce(m["kind"], F.when(m["kind"].isNull() & near.rlike(RECEIVED), "received")))

    raws = F.regexp_extract_all("_line", F.lit(MONEY), F.lit(1))
    found = F.filter(F.transform(F.transform(raws, amount), roles), lambda m: m["kind"].isNotNull() & m["value_minor"].isNotNull())
    each = lines.select(*df.columns, "_line_no", F.posexplode(found).alias("_no", "_m"))
    sure = F.when(F.col("_m.kind") == "total_ttc", 0.98).when(F.col("_m.kind") == "amount", 0.85).otherwise(0.92)
    return each.select(
        *df.columns, "_m.value_minor", "_m.currency", "_m.kind", "_m.label", sure.alias("confidence"), "_m.raw",
        F.struct(F.col("_line_no").alias("line"), F.col("_no").alias("number")).alias(at),
    )


def _role_of(question: Column) -> Column:
    out = F.when(question.rlike(ROLES[0][1]), ROLES[0][0])
    for name, pattern in ROLES[1:]:
        out = out.when(question.rlike(pattern), name)
    return out


def _iso(day: Column, month: Column, year: Column) -> Column:
    fine = year.between(1900, 2200) & month.between(1, 12) & day.between(1, 31)
    return F.when(fine, F.format_string("%d-%02d-%02d", year, month, day))


def record_date(text: Column) -> Column:
    """The first numeric date, day first, as an ISO string; if it isn't valid, null. Else a date with a month's name."""
    return let(normalize_question(text), _record_date)


def _record_date(q: Column) -> Column:
    numeric = r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b"
    part = lambda pattern, k: F.regexp_extract(q, pattern, k).try_cast("int")
    any_named = r"\b\d{1,2}\s+(?:" + "|".join(MONTHS) + r")\s+\d{4}\b"
    out = F.when(q.rlike(numeric), _iso(part(numeric, 1), part(numeric, 2), part(numeric, 3))).when(~q.rlike(any_named), F.lit(None).cast("string"))
    # Of several dates with a month's name, the one whose month comes first in the table of months.
    for name, month in MONTHS.items():
        named = rf"\b(\d{{1,2}})\s+{name}\s+(\d{{4}})\b"
        out = out.when(q.rlike(named), _iso(part(named, 1), F.lit(month), part(named, 2)))
    return out


def record_id(text: Column) -> Column:
    """A labelled reference with a hyphen, else a transaction or invoice code."""
    labelled = r"(?i)\b(?:n[°o]|no|numero|reference|ref|id)\s*[:#-]?\s*([A-Z]{0,5}-[A-Z0-9-]{4,})\b"
    coded = r"(?i)\b((?:T|TX|TRX|INV|FACT|REC)-[A-Z0-9-]{4,})\b"
    pick = lambda p: F.nullif(F.upper(F.regexp_extract(text, p, 1)), F.lit(""))
    return F.coalesce(pick(labelled), pick(coded))


def durations(text: Column) -> Column:
    """Different (value, unit) keys, such as ``10 day``."""
    q = normalize_question(text)
    spelled = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    digits_or_word = rf"\d+|{'|'.join(NUMBER_WORDS)}"

    def of(pattern, unit):
        values = F.regexp_extract_all(q, F.lit(rf"\b({digits_or_word})\s+(?:{pattern})\b"), F.lit(1))
        return F.transform(values, lambda n: F.concat(F.coalesce(n.try_cast("long"), F.element_at(spelled, n)).cast("string"), F.lit(f" {unit}")))

    found = [of(pattern, unit) for pattern, unit in UNITS.items()]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def schedule_rows(text: Column) -> Column:
    """Rows ``rank date amount ...``: (rank, date as ISO, amounts as minor units), in order of their lines."""
    pattern = rf"^\s*(\d{{1,3}})\s+(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})\s+(.*)$"
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(pattern))

    def row(line):
        part = lambda k: F.regexp_extract(line, pattern, k)
        amounts = F.regexp_extract_all(part(5), F.lit(rf"(\d{{1,3}}(?:{GAP}\d{{3}})*,\d{{2}})"), F.lit(1))
        return F.struct(
            part(1).cast("int").alias("rank"), _iso(part(2).cast("int"), part(3).cast("int"), part(4).cast("int")).alias("date"),
            F.transform(amounts, lambda a: F.regexp_replace(a, r"\D", "").cast("long")).alias("amounts"),
        )

    return F.transform(lines, row)


def labelled_cells(text: Column) -> Column:
    """``label: value`` cells between pipes."""
    cells = F.filter(F.transform(F.split(text, r"\s*\|\s*"), lambda c: F.trim(c)), lambda c: c.rlike(r"^[^:]+:\s*\S"))
    return F.transform(
        cells,
        lambda c: F.struct(
            F.trim(F.regexp_extract(c, r"^([^:]+):", 1)).alias("label"), F.trim(F.regexp_extract(c, r"^[^:]+:\s*(.*)$", 1)).alias("value")
        ),
    )


def cost_units(input_tokens: Column, output_tokens: Column, input_price: float, output_price: float) -> Column:
    """Whole units, at least one, of a price for each million tokens."""
    return F.greatest(F.lit(1), F.ceil((input_tokens * input_price + output_tokens * output_price) / 1e6)).cast("long")


def in_scope(date: Column, start: str | None = None, end: str | None = None, year: int | None = None, month: int | None = None) -> Column:
    """Whether an ISO date string is in a temporal scope; without a date, only if there is no scope."""
    if start is None and end is None and year is None and month is None:
        return F.lit(True)
    out = date.isNotNull()
    if start is not None:
        out &= date >= start
    if end is not None:
        out &= date <= end
    if year is not None:
        out &= F.substring(date, 1, 4).cast("int") == year
    if month is not None:
        out &= F.substring(date, 6, 2).cast("int") == month
    return F.coalesce(out, F.lit(False))


def canonical_amounts(literal: str) -> list[str]:
    """The value of an amount as written, its last separator being the decimal one; without a fraction of zeros."""
    found = re.search(r"\d[\d\s.,]*", literal)
    if not found:
        return []
    whole, _, fraction = re.sub(r"[.,](?=[^.,]*$)", "#", found[0].strip(), count=1).partition("#")
    whole, fraction = (re.sub(r"[\s.,]", "", x) for x in (whole, fraction))
    value = f"{whole}.{fraction}".rstrip("0") if fraction.strip("0") else whole
    return [value] if value else []


#: Fixed value: an amount with its currency, as answers write it.
MONEY_AMOUNT = r"(?:\d[\d \t.,]*[ \t]*(?:€|eur\b|euros?\b|usd\b|dollars?\b))(?:[ \t]*(?:ht|ttc))?"


def joined_amounts(text: str) -> str:
    """Amounts whose digits aren't grouped by three, joined: ``1 2 34,50 €`` becomes ``1234,50 €``."""

    def one(match):
        digits = re.search(r"\d[\d\s.,]*", match[0])[0].strip()
        cut = max(digits.rfind("."), digits.rfind(","))
        whole, fraction = (digits[:cut], digits[cut:]) if cut >= 0 else (digits, "")
        groups = [g for g in re.split(r"[\s.]", whole) if g]
        regular = len(groups) > 1 and len(groups[0]) <= 3 and all(len(g) == 3 for g in groups[1:])
        suffix = re.sub(r"^[\d\s.,]+", "", match[0]).strip()
        return f"{whole if regular else ''.join(groups)}{fraction} {suffix}".strip()

    return re.sub(MONEY_AMOUNT, one, text, flags=re.I)


def calendar_dates(text: str) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, ISO dates) of each date in a text; one that can be read day first or month first has both."""
    found: dict[tuple[int, int], tuple[str, ...]] = {}

    def add(match, *dates):
        keys = [f"{y}-{m:02d}-{d:02d}" for d, m, y in dates if 1000 <= y <= 9999 and 1 <= m <= 12 and 1 <= d <= 31]
        if keys:
            found.setdefault(match.span(), tuple(dict.fromkeys(keys)))

    for m in re.finditer(r"\b(\d{1,4})[./-](\d{1,2})[./-](\d{2,4})\b", text):
        a, b, c = map(int, m.groups())
        year = 2000 + c if len(m[3]) == 2 else c
        add(m, *([(c, b, a)] if len(m[1]) == 4 else [(a, b, year), (b, a, year)]))
    for m in re.finditer(r"\b(\d{1,2})(?:er|re|e|eme|ème)?\s+([^\W\d_]+)\s+(\d{4})\b", text, re.I):
        if month := MONTHS.get(fold_accents(m[2])):
            add(m, (int(m[1]), month, int(m[3])))
    for m in re.finditer(r"\b([^\W\d_]+)\s+(\d{1,2})(?:st|nd|rd|th)?(?:,\s*|\s+)(\d{4})\b", text, re.I):
        if month := MONTHS.get(fold_accents(m[1])):
            add(m, (int(m[2]), month, int(m[3])))
    return [(a, b, keys) for (a, b), keys in found.items()]


def formatted_money(minor: Column, currency: Column) -> Column:
    """Minor units as ``1234.50 EUR``; GNF has no minor unit."""
    cents = F.concat(F.when(minor < 0, "-").otherwise(""), F.floor(F.abs(minor) / 100).cast("string"), F.lit("."), F.lpad((F.abs(minor) % 100).cast("string"), 2, "0"))
    return F.concat_ws(" ", F.when(currency == "GNF", minor.cast("string")).otherwise(cents), currency)
