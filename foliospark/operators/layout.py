"""Page layout from positioned text: lines, column gutters, reading order, header binding, form rows, priced rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINES = "document_id string, page int, line int, text string, context string"
#: Share of the page's width that counts as a gap between columns, and how much of the lines must leave it free.
GAP, FREE = 0.02, 0.9


def rows_of(items: list[dict], tolerance: float = 3.0) -> list[list[dict]]:
    """Items on a common base line, top to bottom, left to right. y grows downwards."""
    out: list[list[dict]] = []
    for item in sorted(items, key=lambda i: (i["y"], i["x"])):
        if out and abs(out[-1][0]["y"] - item["y"]) <= tolerance:
            out[-1].append(item)
        else:
            out.append([item])
    return [sorted(r, key=lambda i: i["x"]) for r in out]


def gutters(rows: list[list[dict]], width: float, bins: int = 200) -> list[tuple[float, float]]:
    """Vertical bands inside the page that nine of ten rows with text on both sides leave free of ink."""
    ink = [0] * bins
    for row in rows:
        taken = {b for i in row for b in range(max(0, int(i["x"] / width * bins)), min(bins, int((i["x"] + i["width"]) / width * bins) + 1))}
        for b in taken:
            ink[b] += 1
    most = max(1.0, (1 - FREE) * len(rows))
    out, start = [], None
    first, last = next((b for b in range(bins) if ink[b] > most), bins), next((b for b in range(bins - 1, -1, -1) if ink[b] > most), -1)
    for b in range(first, last + 1):
        if ink[b] <= most and start is None:
            start = b
        elif ink[b] > most and start is not None:
            if (b - start) / bins >= GAP:
                out.append((start / bins * width, b / bins * width))
            start = None
    return out


def ordered(items: list[dict], width: float) -> list[tuple[str, str | None]]:
    """(text, context) lines in reading order: tables by row with their header's names, columns one after another."""
    rows = rows_of(items)
    table = [k for k, r in enumerate(rows) if sum(any(c.isdigit() for c in i["text"]) for i in r) >= 1 and len(r) >= 3]
    if len(table) >= 3:
        header = rows[table[0] - 1] if table[0] > 0 and len(rows[table[0] - 1]) >= 0.6 * len(rows[table[0]]) else None
        out = []
        for k, row in enumerate(rows):
            named = None
            if header and k in table:
                near = lambda i: min(header, key=lambda h: abs(h["x"] + h["width"] / 2 - i["x"] - i["width"] / 2))["text"]
                named = " | ".join(f"{near(i)}: {i['text']}" for i in row)
            out.append((" ".join(i["text"] for i in row), named))
        return out
    cuts = gutters(rows, width) if len(rows) >= 8 else []
    if not cuts:
        return [(" ".join(i["text"] for i in r), None) for r in rows]
    middle = max(cuts, key=lambda c: c[1] - c[0])
    out, left, right = [], [], []

    def flush():
        # Each column is ordered by itself, and cut again where it has columns of its own.
        for side, begin, wide in ((left, 0.0, middle[0]), (right, middle[1], width - middle[1])):
            if left and right:
                out.extend(ordered([{**i, "x": i["x"] - begin} for r in side for i in r], wide))
            else:
                out.extend((" ".join(i["text"] for i in r), None) for r in side)
        left.clear()
        right.clear()

    for row in rows:
        if any(i["x"] < middle[0] and i["x"] + i["width"] > middle[1] for i in row):  # a line across both columns
            flush()
            out.append((" ".join(i["text"] for i in row), None))
            continue
        for side, part in ((left, [i for i in row if i["x"] < middle[0]]), (right, [i for i in row if i["x"] >= middle[0]])):
            if part:
                side.append(part)
    flush()
    return out


def lines(pages: DataFrame) -> DataFrame:
    """Lines of pages: document_id, page, page_width, items array<struct<text, x, y, width>>. One page is one row."""
    kind = pa.schema([("document_id", pa.string()), ("page", pa.int32()), ("line", pa.int32()), ("text", pa.string()), ("context", pa.string())])

    def run(batches):
        for batch in batches:
            rows = [
                {"document_id": p["document_id"], "page": p["page"], "line": k, "text": text, "context": context}
                for p in batch.to_pylist()
                for k, (text, context) in enumerate(ordered(p["items"] or [], p["page_width"] or 1.0))
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    ready = pages.select(F.col("document_id").cast("string").alias("document_id"), F.col("page").cast("int").alias("page"), "page_width", "items")
    return ready.mapInArrow(run, LINES)


def priced_groups(lines_: DataFrame, slack: float = 1.5) -> DataFrame:
    """document_id, page, group, text: lines joined while their gap is at most ``slack`` times the page's modal gap."""
    w = Window.partitionBy("document_id", "page").orderBy("y")
    gapped = lines_.withColumn("gap", F.round(F.col("y") - F.lag("y").over(w), 0))
    modal = gapped.groupBy("document_id", "page").agg(F.mode("gap", True).alias("modal"))
    marked = gapped.join(modal, ["document_id", "page"]).withColumn("opens", (F.col("gap").isNull() | (F.col("gap") > F.col("modal") * slack)).cast("int"))
    grouped = marked.withColumn("group", F.sum("opens").over(w)).groupBy("document_id", "page", "group")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "text"))), lambda r: r["text"]), " ")
    return grouped.agg(text.alias("text"))


def form_pairs(items: DataFrame, near: float = 0.04) -> DataFrame:
    """document_id, page, label, value: each value with the nearest label above it, within a share of the page's width.

    items: document_id, page, page_width, text, x, width, row; labels have no digits, values stand one row below.
    """
    digit = F.col("text").rlike(r"\d|^(?i:oui|non|yes|no)$")
    mid = F.col("x") + F.col("width") / 2
    base = items.withColumn("mid", mid)
    labels = base.filter(~digit).select("document_id", "page", (F.col("row") + 1).alias("row"), F.col("text").alias("label"), F.col("mid").alias("at"))
    values = base.filter(digit).select("document_id", "page", "page_width", "row", F.col("text").alias("value"), "mid")
    pairs = values.join(labels, ["document_id", "page", "row"]).withColumn("d", F.abs(F.col("mid") - F.col("at"))).filter(F.col("d") <= F.col("page_width") * near)
    best = pairs.groupBy("document_id", "page", "row", "value", "mid").agg(F.min_by("label", "d").alias("label"))
    return best.select("document_id", "page", "label", "value")


#: Empty and ticked boxes, how far a tick may lie from its box, and a value at the end of a table's row.
EMPTY_BOXES, TICKED = "☐□❏❐❑❒", "☑☒✔✓"
TICK_X, TICK_Y, BOX_WIDTH = 2.0, 6.0, 8.0
VALUE_CELL = r"^\s*(?:[*_`]*\s*)?(?:[<>≤≥~≈]\s*)?\d(?:[\d\s.,]*\d)?(?:\s|$)"


def prefers_markdown(markdown: Column) -> Column:
    """Whether a fifth of a page's table rows or more end in a value: then its Markdown replaces the order by position."""
    rows = F.filter(F.split(markdown, "\n"), lambda x: F.contains(x, F.lit("|")))

    def priced(row):
        cells = F.filter(F.transform(F.split(row, r"\|"), lambda c: F.trim(c)), lambda c: (c != "") & ~c.rlike("^[-: ]+$"))
        return (F.size(cells) >= 2) & F.element_at(cells, -1).rlike(VALUE_CELL)

    priced_rows = F.filter(rows, lambda r: F.coalesce(priced(r), F.lit(False)))
    return (F.size(rows) > 0) & (F.size(priced_rows) * 5 >= F.size(rows))


def form_marks(items: DataFrame) -> DataFrame:
    """Boxes of forms as ``☐`` or ``☑``: a box with a mark of one or two characters on it is ticked, and the mark goes.

    items: document_id, page, item_id, text, x, y, width. A glyph of a font's private area counts as a box where, in its
    document, some box of that glyph is ticked. Ticked glyphs of Unicode are ``☑``. Marks and boxes meet by page and by
    cells of the page that are as high as a mark may be off, so no page's items are compared with each other all.
    """
    glyph = F.length(F.trim("text")) == 1
    private = glyph & F.trim("text").rlike("^[\\x{E000}-\\x{F8FF}]$")
    box = glyph & (F.trim("text").isin(*EMPTY_BOXES) | private)
    marked = items.withColumns({"box": F.coalesce(box, F.lit(False)), "private": F.coalesce(private, F.lit(False)), "band": F.floor(F.col("y") / TICK_Y)})
    boxes = marked.filter("box").select(
        "document_id", "page", F.col("item_id").alias("box_id"), F.col("text").alias("glyph"), F.col("x").alias("bx"), F.col("y").alias("by"),
        F.when(F.col("width") > 0, F.col("width")).otherwise(BOX_WIDTH).alias("bw"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"),
    )
    short = marked.filter(~F.col("box") & F.length(F.trim("text")).between(1, 2) & ~F.col("text").rlike(f"[{EMPTY_BOXES}\\x{{E000}}-\\x{{F8FF}}]"))
    on = short.join(boxes, ["document_id", "page", "band"]).filter(
        F.col("x").between(F.col("bx") - TICK_X, F.col("bx") + F.col("bw") + TICK_X) & (F.abs(F.col("y") - F.col("by")) <= TICK_Y)
    )
    first = Window.partitionBy("document_id", "page", "item_id").orderBy("box_id")
    ticks = on.withColumn("n", F.row_number().over(first)).filter("n = 1").select("document_id", "page", "item_id", "box_id", "glyph")
    ticked = ticks.select("document_id", "page", F.col("box_id").alias("item_id"), F.lit(True).alias("ticked")).distinct()
    used = ticks.select("document_id", "page", "item_id")
    glyphs = ticks.select("document_id", F.trim("glyph").alias("glyph"), F.lit(True).alias("known")).distinct()
    made = marked.join(used, ["document_id", "page", "item_id"], "left_anti").join(ticked, ["document_id", "page", "item_id"], "left")
    made = made.withColumn("glyph", F.when(F.col("box"), F.trim("text"))).join(glyphs, ["document_id", "glyph"], "left")
    text = (
        F.when(F.col("ticked"), "☑").when(F.col("box") & (~F.col("private") | F.col("known")), "☐")
        .when(glyph & F.trim("text").isin(*TICKED), "☑").otherwise(F.col("text"))
    )
    return made.withColumn("text", text).select(*items.columns)


#: The bands of a page in which chrome stands, its least score, and the share of ink that must be chrome.
CHROME_BAND, ASIDE_BAND, CHROME_SCORE, CHROME_INK = 0.18, 0.10, 0.5, 0.7


def page_chrome(items: DataFrame, regions: DataFrame) -> DataFrame:
    """Items with ``chrome``: header, footer or aside where most of their region's ink lies in that band, else null.

    items: page_id, item_id, x, y, width, height (y down, in shares of the page); regions: page_id, region_id, kind, score,
    and a box left, top, right, bottom. A region counts as a header or footer if its score is half or more and 70 % of the
    ink of its items lies in the outer 18 % of the page's height; as an aside in the outer 10 % of its width.
    """
    r = regions.filter((F.col("score") >= CHROME_SCORE) & F.col("kind").isin("header", "footer", "aside"))
    middle_x, middle_y = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    inside = items.join(r, "page_id").filter(middle_x.between(F.col("left"), F.col("right")) & middle_y.between(F.col("top"), F.col("bottom")))
    ink = F.col("width") * F.col("height")
    band = (
        F.when(F.col("kind") == "header", middle_y <= CHROME_BAND).when(F.col("kind") == "footer", middle_y >= 1 - CHROME_BAND)
        .otherwise((middle_x <= ASIDE_BAND) | (middle_x >= 1 - ASIDE_BAND))
    )
    w = Window.partitionBy("page_id", "region_id")
    most = inside.withColumn("share", F.sum(F.when(band, ink).otherwise(0.0)).over(w) / F.sum(ink).over(w)).filter(F.col("share") >= CHROME_INK)
    of = most.groupBy("page_id", "item_id").agg(F.min_by("kind", F.struct(-F.col("score"), "region_id")).alias("chrome"))
    return items.join(of, ["page_id", "item_id"], "left")
