"""Files to blocks: format by name and type, plain text, Markdown, DOCX, HTML; page text layers."""

from __future__ import annotations

import html.parser
import io
import re
import zipfile
from types import SimpleNamespace
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.text import text_quality

BLOCKS = "document_id string, document_name string, block_index int, text string, heading string, char_start int, char_end int, context string, error string"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_NUMBERED = re.compile(r"\d+(?:\.\d+)*\.?\s+\S.{0,70}$")


def format_of(name: Column, mime: Column) -> Column:
    """pdf, docx, markdown, text or unsupported."""
    n, m = F.lower(name), F.coalesce(F.lower(mime), F.lit(""))
    return (
        F.when(n.endswith(".pdf") | (m == "application/pdf"), "pdf")
        .when(n.endswith(".docx") | m.contains("wordprocessingml"), "docx")
        .when(n.endswith(".md") | n.endswith(".markdown") | (m == "text/markdown"), "markdown")
        .when(n.endswith(".html") | (m == "text/html"), "html")
        .when(n.endswith(".txt") | m.startswith("text/"), "text")
        .otherwise("unsupported")
    )


def parse_text(raw: str, markdown: bool) -> list[dict]:
    """Paragraphs at blank lines, each with the breadcrumb of its headings. Plain text takes short numbered lines as headings."""
    out, trail, at = [], [], 0
    for part in re.split(r"\n[ \t]*\n", raw.replace("\r\n", "\n")):
        text = part.strip()
        start = raw.find(text, at) if text else at
        at = start + len(text)
        if not text:
            continue
        first, _, rest = text.partition("\n")
        mark = re.match(r"(#{1,6})\s+(.*)", first) if markdown else None
        if mark:
            trail = trail[: len(mark[1]) - 1] + [mark[2].strip()]
            text = rest.strip()
            if not text:
                continue
        elif not markdown and not rest and len(text) <= 80 and _NUMBERED.match(text):
            trail = [text]
        out.append({"text": text, "heading": " > ".join(trail) or None, "char_start": start, "char_end": at, "context": None})
    return out


def labelled_row(header: list[str], cells: list[str]) -> str:
    return " | ".join(f"{h}: {c}" if h else c for h, c in zip(header + [""] * len(cells), cells) if c)


def parse_docx(content: bytes) -> list[dict]:
    """Paragraphs and table rows; a row's context names its cells by the header row."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_WORD}t")).strip()
    out, trail, at = [], [], 0
    for e in body if body is not None else ():
        if e.tag == f"{_WORD}p" and text(e):
            style = e.find(f"{_WORD}pPr/{_WORD}pStyle")
            level = re.match(r"(?i)heading\s*(\d)", style.get(f"{_WORD}val", "")) if style is not None else None
            if level:
                trail = trail[: int(level[1]) - 1] + [text(e)]
            out.append((text(e), None, " > ".join(trail) or None))
        elif e.tag == f"{_WORD}tbl":
            rows = [[text(c) for c in r.findall(f"{_WORD}tc")] for r in e.findall(f"{_WORD}tr")]
            for r in rows[1:] if len(rows) > 1 else rows:
                out.append((" | ".join(r), labelled_row(rows[0], r) if len(rows) > 1 else None, " > ".join(trail) or None))
    made = []
    for t, context, heading in out:
        made.append({"text": t, "heading": heading, "char_start": at, "char_end": at + len(t), "context": context})
        at += len(t) + 1
    return made


class _Html(html.parser.HTMLParser):
    """Text by block elements, scripts and styles left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.buffer, self.skip, self.trail, self.level = [], [], 0, [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript"):
            self.skip += 1
        elif tag in ("p", "div", "li", "tr", "br", "section", "article", "nav", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush()
            self.level = int(tag[1]) if re.fullmatch("h[1-6]", tag) else None

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("p", "div", "li", "tr", "section", "article", "nav", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.buffer.append(data)

    def flush(self):
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text and self.level:
            self.trail = self.trail[: self.level - 1] + [text]
        if text:
            self.blocks.append((text, " > ".join(self.trail) or None))
        self.level = None


def parse_html(raw: str) -> list[dict]:
    made, at = _Html(), 0
    made.feed(raw)
    made.flush()
    out = []
    for text, heading in made.blocks:
        out.append({"text": text, "heading": heading, "char_start": at, "char_end": at + len(text), "context": None})
        at += len(text) + 1
    return out


def blocks(files: DataFrame) -> DataFrame:
    """Blocks of files (document_id, name, mime, content), parsed where they are read; a file that can't be parsed is one
    row with its error and no text. Unreadable content is an error of its row, not of the job."""

    kind = pa.schema(
        [(c.split()[0], {"string": pa.string(), "int": pa.int32()}[c.split()[1]]) for c in BLOCKS.split(", ")]
    )

    def run(batches):
        for batch in batches:
            rows = []
            for r in (SimpleNamespace(**x) for x in batch.to_pylist()):
                try:
                    if r.format == "docx":
                        made = parse_docx(r.content)
                    elif r.format in ("markdown", "text", "html"):
                        raw = r.content.decode("utf-8", "replace")
                        made = parse_html(raw) if r.format == "html" else parse_text(raw, r.format == "markdown")
                    else:
                        raise ValueError("unsupported_format")
                    rows += [{"document_id": r.document_id, "document_name": r.name, "block_index": i, "error": None, **b} for i, b in enumerate(made)]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append({"document_id": r.document_id, "document_name": r.name, "block_index": 0, "error": str(e)[:80] or "parse_failed"})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    ready = files.select(F.col("document_id").cast("string").alias("document_id"), "name", "content", format_of(F.col("name"), F.col("mime")).alias("format"))
    return ready.mapInArrow(run, BLOCKS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder by content hash: copies are one document."""
    raw = spark.read.format("binaryFile").load(path)
    named = raw.select(F.sha2("content", 256).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(None).cast("string").alias("mime"), "content")
    return named.dropDuplicates(["document_id"])


def chosen_layers(native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Per page, the native text unless its layer is unusable and OCR is better; either side may be missing.

    OCR is better if its own text is usable at a confidence of half, or at 0.78 is not sparse and has a third of the native
    characters (50 at most). Unusable native text that stays has confidence 0: it can be found, and no sum relies on it.
    """
    n = native.select("document_id", "page", F.col("text").alias("native"))
    o = ocr.select("document_id", "page", F.col("text").alias("ocr"), "ocr_confidence")
    both = n.join(o, ["document_id", "page"], "full").withColumns({"n_class": text_quality(F.col("native")), "o_class": text_quality(F.col("ocr"))})
    enough = F.length(F.trim("ocr")) >= F.least(F.lit(50.0), F.length("native") * 0.35)
    sure = F.coalesce("ocr_confidence", F.lit(0.0))
    better = ((F.col("o_class") == "usable") & (sure >= 0.5)) | ((sure >= 0.78) & (F.col("o_class") != "sparse") & enough)
    unusable = F.col("native").isNotNull() & (F.col("n_class") != "usable")
    use_ocr = F.coalesce((F.trim(F.coalesce("ocr", F.lit(""))) != "") & (F.col("native").isNull() | (unusable & better)), F.lit(False))
    return both.select(
        "document_id", "page", F.when(use_ocr, F.col("ocr")).otherwise(F.col("native")).alias("text"),
        F.when(use_ocr, F.col("ocr_confidence")).when(unusable, 0.0).alias("ocr_confidence"),
    )


def is_heading(line: Column) -> Column:
    """A line that looks like a section heading: short, no sentence end, capitals or a number in front."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: F.length(w) > 3)
    titled = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    shaped = (upper >= letters * 0.75) | (titled >= F.size(words) * 0.7) | line.rlike(r"^\s*\d+(\.\d+)*\.?\s+\p{Lu}")
    return (F.length(F.trim(line)).between(3, 90)) & (letters >= 3) & ~line.rlike(r"[.;:,]\s*$") & shaped


def needs_ocr(raster_share: Column, ink_share: Column) -> Column:
    return (raster_share >= 0.8) & (ink_share < 0.08)
