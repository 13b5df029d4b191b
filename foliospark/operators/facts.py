"""Typed facts from text, and exact aggregation over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.functions import numbers
from foliospark.functions.text import normalize_question

#: Roles in the order in which one stands for its record, and in which a plain total is looked for.
REPRESENTATIVE = ("sent", "total_ttc", "debited", "total", "amount", "received", "fee")
TOTALS = ("total_ttc", "total", "subtotal", "amount")
#: OCR confidence below which a chunk takes no part in arithmetic.
RELIABLE = 0.78
#: Words of a transfer, and those that begin a record.
_TRANSFER = r"\b(expediteur|beneficiaire|transfert|transaction|sender|recipient|beneficiary|exchange rate|taux de change)\b"
_SEGMENT = r"(?im)(?=^(?:transaction|transfert|transfer|facture|invoice|re[cç]u|receipt)\b)"


def reliable(confidence: Column) -> Column:
    return confidence.isNull() | (confidence >= RELIABLE)


def records(chunks: DataFrame) -> DataFrame:
    """Facts of chunks: document_id, chunk_id, record_key, record_date, record_id, kind, value_minor, currency, label.

    chunks: document_id, chunk_id, text, and page, heading, seq, ocr_confidence if known. A location is a page, else a
    heading, else a chunk. A segment without its own date or id takes the location's if there is only one. A record is
    known by its id, else by its location and segment. In texts of transfers, an amount is what was sent and a total
    what was debited.
    """
    have = set(chunks.columns)
    col = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    base = chunks.select(
        "document_id", "chunk_id", "text", col("page", "int").alias("page"), col("heading", "string").alias("heading"),
        col("seq", "long").alias("seq"), col("ocr_confidence", "double").alias("ocr"),
    ).filter(reliable(F.col("ocr")))
    place = F.coalesce(
        F.concat(F.lit("page:"), F.col("page").cast("string")), F.concat(F.lit("heading:"), F.col("heading")),
        F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")),
    )
    cut = F.split("text", _SEGMENT)
    parts = base.withColumn("place", place).select(
        "document_id", "chunk_id", "place", "seq", "text", F.posexplode(F.filter(cut, lambda s: F.trim(s) != "")).alias("segment", "part")
    )
    parts = parts.withColumns({"own_date": numbers.record_date(F.col("part")), "own_id": numbers.record_id(F.col("part"))})
    at = Window.partitionBy("document_id", "place")
    only = lambda c: F.when(F.min(c).over(at) == F.max(c).over(at), F.min(c).over(at))
    parts = parts.withColumns(
        {
            "record_date": F.coalesce("own_date", only("own_date")), "record_id": F.coalesce("own_id", only("own_id")),
            "transfer": F.max(normalize_question(F.col("text")).rlike(_TRANSFER)).over(at),
        }
    )
    doc = F.col("document_id").cast("string")
    fallback = F.concat_ws(":", doc, "place", F.col("segment").cast("string"), F.when(F.col("record_date").isNotNull(), F.concat(F.lit("date:"), "record_date")))
    key = F.when(F.col("record_id").isNotNull(), F.concat_ws(":", doc, F.lit("id"), "record_id")).otherwise(fallback)
    keyed = parts.select("document_id", "chunk_id", key.alias("record_key"), "record_date", "record_id", "transfer", "part")
    facts = numbers.money_rows(keyed, "part")
    in_transfer = {"amount": "sent", "total": "debited"}
    kind = F.col("kind")
    for plain, meant in in_transfer.items():
        kind = F.when(F.col("transfer") & (F.col("kind") == plain), meant).otherwise(kind)
    return facts.select(
        "document_id", "chunk_id", "record_key", "record_date", "record_id", kind.alias("kind"), "value_minor", "currency", "label", "confidence"
    ).dropDuplicates(["record_key", "kind", "currency", "value_minor"])


#: Rows that a document's schedule has at least.
SCHEDULE_ROWS = 12


def schedule_records(chunks: DataFrame) -> DataFrame:
    """One fact for each row of an amortisation schedule: document_id, chunk_id, record_key, record_date, kind, value_minor, currency.

    A schedule has ``SCHEDULE_ROWS`` rows or more over a document's reliable chunks, a column whose value repeats (the
    instalment), and the euro somewhere in the document. Documents without these give no rows.
    """
    have = set(chunks.columns)
    ocr = F.col("ocr_confidence") if "ocr_confidence" in have else F.lit(None).cast("double")
    fine = chunks.filter(reliable(ocr)).select("document_id", "chunk_id", "text")
    rows = fine.select("document_id", "chunk_id", F.explode(numbers.schedule_rows(F.col("text"))).alias("r")).select("document_id", "chunk_id", "r.*")
    euro = fine.groupBy("document_id").agg(F.bool_or(F.col("text").rlike(r"(?iu)€|\beuros?\b")).alias("euro"))
    counted = rows.groupBy("document_id").agg(F.count("*").alias("n")).filter(F.col("n") >= SCHEDULE_ROWS)
    wanted = counted.join(euro.filter("euro"), "document_id").select("document_id")
    kept = rows.join(wanted, "document_id", "left_semi")
    column = installment_column(kept).select("document_id", "column")
    return kept.join(column, "document_id").filter(F.col("date").isNotNull() & (F.size("amounts") > F.col("column"))).select(
        "document_id", "chunk_id", F.concat_ws(":", F.col("document_id").cast("string"), F.lit("schedule"), "date").alias("record_key"),
        F.col("date").alias("record_date"), F.lit("amount").alias("kind"), F.get("amounts", F.col("column")).alias("value_minor"), F.lit("EUR").alias("currency"),
    )


def labelled_schedule(rows: DataFrame, context: DataFrame) -> DataFrame:
    """(document_id, date, label, value_minor): a schedule row's cells by the labelled line that has its printed date.

    rows: document_id, date; context: document_id, line (cells ``label: value`` between pipes).
    """
    written = F.date_format(F.to_date("date"), "dd.MM.yyyy")
    named = rows.select("document_id", "date", written.alias("written")).distinct()
    line = F.regexp_extract("line", r"\b(\d{2}\.\d{2}\.\d{4})\b", 1)
    lines = context.select("document_id", line.alias("written"), "line").filter("written <> ''")
    cells = named.join(lines, ["document_id", "written"]).select("document_id", "date", F.explode(numbers.labelled_cells(F.col("line"))).alias("c"))
    amount = r"^\d{1,3}(?:[\s  ]\d{3})*,\d{2}(?:\s*€)?$"
    return cells.filter(F.col("c.value").rlike(amount)).select(
        "document_id", "date", F.col("c.label").alias("label"), F.regexp_replace("c.value", r"\D", "").cast("long").alias("value_minor")
    )


def representatives(facts: DataFrame) -> DataFrame:
    """One fact for each record, by the order of roles."""
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(REPRESENTATIVE)], F.lit(len(REPRESENTATIVE)))
    w = Window.partitionBy("record_key").orderBy(order, "value_minor", "currency")
    return facts.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def chosen_facts(facts: DataFrame, role: str | None) -> DataFrame:
    """Records with their one fact of the role, or flagged ambiguous: record_key, ambiguous, value_minor, currency.

    Without a role: the first of the plain totals that a record has, else its only role. Records with none, or more
    than one, different candidates are ambiguous (if they had a candidate, or several facts and no role was asked).
    """
    if role is not None:
        wanted = F.col("kind") == role
        marked = facts.withColumn("desired", wanted)
    else:
        w = Window.partitionBy("record_key")
        rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(TOTALS)], F.lit(None).cast("int"))
        marked = facts.withColumn("r", rank).withColumn("least", F.min("r").over(w)).withColumn("kinds", F.size(F.collect_set("kind").over(w)))
        marked = marked.withColumn("desired", F.coalesce(F.col("r") == F.col("least"), F.lit(False)) | (F.col("least").isNull() & (F.col("kinds") == 1)))
    grouped = marked.groupBy("record_key").agg(
        F.collect_set(F.when(F.col("desired"), F.struct("value_minor", "currency", "kind"))).alias("found"), F.count("*").alias("n")
    )
    size = F.size("found")
    several = (size != 1) & ((size > 0) | (F.lit(role is None) & (F.col("n") > 1)))
    one = F.get("found", F.lit(0))
    return grouped.select(
        "record_key", several.alias("ambiguous"), F.when(size == 1, one["value_minor"]).alias("value_minor"), F.when(size == 1, one["currency"]).alias("currency")
    )


def aggregate(facts: DataFrame, operation: str = "sum", role: str | None = None, **scope) -> DataFrame:
    """(currency, value_minor, count) of the records in scope; currencies are never added up.

    average is rounded half up; ``list`` gives the sum too. ``count`` gives one row: its count, null currency and value.
    """
    facts = facts.filter(numbers.in_scope(F.col("record_date"), **scope))
    if operation == "count":
        kept = representatives(facts) if role is None else chosen_facts(facts, role).filter("value_minor IS NOT NULL")
        return kept.agg(F.count("*").alias("count")).select(
            F.lit(None).cast("string").alias("currency"), F.lit(None).cast("long").alias("value_minor"), "count"
        )
    value = {
        "average": F.floor(F.sum("value_minor") / F.count("*") + 0.5), "minimum": F.min("value_minor"), "maximum": F.max("value_minor")
    }.get(operation, F.sum("value_minor"))
    kept = chosen_facts(facts, role).filter("value_minor IS NOT NULL")
    return kept.groupBy("currency").agg(value.cast("long").alias("value_minor"), F.count("*").alias("count"))


def schedule(texts: DataFrame, least_rows: int = 1) -> DataFrame:
    """(document_id, rank, date, amounts) of schedule rows, in documents with ``least_rows`` or more."""
    rows = texts.select("document_id", F.explode(numbers.schedule_rows(F.col("text"))).alias("r")).select("document_id", "r.*")
    if least_rows <= 1:
        return rows
    w = Window.partitionBy("document_id")
    return rows.withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= least_rows).drop("_n")


def installment_column(rows: DataFrame, least_share: float = 0.6) -> DataFrame:
    """(document_id, column, value_minor, share): the amount column whose most frequent value fills most of its rows.

    Of columns with ``least_share`` or more, the one of largest count, then the leftmost.
    """
    cells = rows.select("document_id", F.posexplode("amounts").alias("column", "value_minor"))
    n = rows.groupBy("document_id").agg(F.count("*").alias("n"))
    counts = cells.groupBy("document_id", "column", "value_minor").agg(F.count("*").alias("k"))
    best = counts.join(n, "document_id").filter(F.col("k") >= F.col("n") * least_share)
    w = Window.partitionBy("document_id").orderBy(F.desc("k"), "column", "value_minor")
    return best.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(
        "document_id", "column", "value_minor", F.round(F.col("k") / F.col("n"), 6).alias("share")
    )


def typical_value(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """The most frequent value without the first and the last row, if it fills 2 rows and a quarter; ties: earliest."""
    w = Window.partitionBy(group).orderBy(order)
    inner = rows.withColumn("_a", F.lag(order).over(w)).withColumn("_b", F.lead(order).over(w)).filter("_a IS NOT NULL AND _b IS NOT NULL")
    counts = inner.groupBy(group, value).agg(F.count("*").alias("support"), F.min(order).alias("first"))
    total = inner.groupBy(group).agg(F.count("*").alias("n"))
    best = counts.join(total, group).filter(F.col("support") >= F.greatest(F.lit(2), F.ceil(F.col("n") * 0.25)))
    r = Window.partitionBy(group).orderBy(F.desc("support"), "first")
    return best.withColumn("_r", F.row_number().over(r)).filter("_r = 1").select(group, value, "support")


def extreme_rows(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    return rows.groupBy(group).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))


def quota(usage: DataFrame, limit: int, user: str, day: Column, cost: Column) -> DataFrame:
    """(user, day, used, remaining): costs of a day, and what is left of ``limit``, 0 at least."""
    made = usage.groupBy(F.col(user), day.alias("day")).agg(F.sum(cost).alias("used"))
    return made.withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used")))


def bound_amounts(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """Each amount's closest term in its line, and of the amounts of a term, the closest.

    lines: line_id, amounts array<struct<at, value_minor>>; terms: line_id, term, at.
    """
    pairs = lines.select("line_id", F.explode("amounts").alias("a")).join(terms, "line_id")
    pairs = pairs.withColumn("distance", F.abs(F.col("a.at") - F.col("at")))
    by_amount = Window.partitionBy("line_id", "a.at").orderBy("distance", "at", "term")
    by_term = Window.partitionBy("line_id", "term").orderBy("distance", "a.at")
    best = pairs.withColumn("_r", F.row_number().over(by_amount)).filter("_r = 1").withColumn("_t", F.row_number().over(by_term))
    return best.filter("_t = 1").select("line_id", "term", F.col("a.value_minor").alias("value_minor"), "distance")


def extreme_series_date(rows: DataFrame, group: str, date: str) -> DataFrame:
    """(group, first_date, last_date) of groups with two different dates or more."""
    made = rows.filter(F.col(date).isNotNull()).groupBy(group).agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.countDistinct(date).alias("n")
    )
    return made.filter("n >= 2").drop("n")
