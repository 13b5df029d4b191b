"""From parsed blocks to chunks: sections, clause cuts, greedy packing and overlapping parents."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

PLAIN, STRUCTURED, CARRY, PARENT, PARENT_FROM, LEAST = 650, 450, 80, 1500, 900, 20
SCHEMA = (
    "document_id string, seq int, para_index int, page int, heading string, text string, search_text string, "
    "char_start int, char_end int, n_blocks int"
)
_CLAUSE = re.compile(r"(?m)^(?=\s*(?:article|clause|section|§)\s*\d+\b)", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def target(text: str) -> int:
    """450 characters for text of rows (four lines or more, a third of them with a separator or digits), else 650."""
    lines = [x for x in text.split("\n") if x.strip()]
    rows = sum(bool(re.search(r"[|:;\t]|\d", x)) for x in lines)
    return STRUCTURED if len(lines) >= 4 and rows >= max(3, 0.35 * len(lines)) else PLAIN


def sentences(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, cut at sentence ends, else at blanks, never before 40 % of the room."""
    if len(text) <= most:
        return [text]
    out, buffer = [], ""
    for part in _SENTENCE.split(text):
        while len(part) > most:
            at = part.rfind(" ", int(most * 0.4), most)
            at = at if at > 0 else most
            out += [x for x in (buffer, part[:at].strip()) if x]
            buffer, part = "", part[at:].strip()
        if buffer and len(buffer) + 1 + len(part) > most:
            out.append(buffer)
            buffer = part
        else:
            buffer = f"{buffer} {part}".strip()
    return out + [buffer] if buffer else out


def chunk_document(blocks: list[dict]) -> list[dict]:
    """Chunks of one document's blocks (block_index order): children, then the parents of each section."""
    sections: list[list[dict]] = []
    for b in sorted(blocks, key=lambda b: b["block_index"]):
        key = (b.get("page"), b.get("region"), b.get("heading"))
        if sections and (sections[-1][-1].get("page"), sections[-1][-1].get("region"), sections[-1][-1].get("heading")) == key:
            sections[-1].append(b)
        else:
            sections.append([b])
    out: list[dict] = []
    for section in sections:
        first = section[0]
        children, buffer, size, room = [], [], 0, PLAIN

        def flush(carry: bool):
            nonlocal buffer, size, room
            if buffer:
                children.append(list(buffer))
                last = buffer[-1]
                buffer = [last] if carry and len(last[0]) <= CARRY and len(buffer) > 1 else []
                size, room = sum(len(p[0]) + 1 for p in buffer), PLAIN

        for b in section:
            most, at = target(b["text"]), b.get("char_start") or 0
            for clause in [c for c in _CLAUSE.split(b["text"]) if c.strip()]:
                opens = bool(_CLAUSE.match(clause)) and clause is not b["text"]
                for piece in sentences(clause.strip(), most):
                    if opens:
                        flush(carry=False)
                        opens = False
                    elif buffer and size + len(piece) > min(most, room):
                        flush(carry=True)
                    buffer.append((piece, at, at + len(piece)))
                    size, room = size + len(piece) + 1, min(room, most)
                    at += len(piece) + 1
        flush(carry=False)
        head = first.get("heading")
        row = lambda pieces, para: {
            "document_id": first["document_id"], "seq": len(out), "para_index": para, "page": first.get("page"), "heading": head,
            "text": "\n".join(p[0] for p in pieces), "search_text": "\n".join(x for x in (first.get("document_name"), head, *(p[0] for p in pieces)) if x),
            "char_start": pieces[0][1], "char_end": pieces[-1][2], "n_blocks": len(pieces),
        }
        for i, pieces in enumerate(children):
            out.append(row(pieces, i))
        lengths = [sum(len(p[0]) + 1 for p in c) for c in children]
        if len(children) >= 2 and sum(lengths) >= PARENT_FROM:
            start = 0
            while start < len(children) - 1:
                end, total = start, 0
                while end < len(children) and (end - start < 2 or total + lengths[end] <= PARENT):
                    total += lengths[end]
                    end += 1
                out.append(row([p for c in children[start:end] for p in c], -1))
                if end >= len(children):
                    break
                start = max(start + 1, end - 1)
    return [c for c in out if len(c["text"].strip()) >= LEAST]


def chunks(blocks: DataFrame) -> DataFrame:
    """Chunks of every document. blocks: document_id, document_name, block_index, text, page, heading, region, char_start."""

    kind = pa.schema(
        [(c.split()[0], {"string": pa.string(), "int": pa.int32()}[c.split()[1]]) for c in SCHEMA.split(", ")]
    )

    def of(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(chunk_document(table.to_pylist()), schema=kind)

    return blocks.groupBy("document_id").applyInArrow(of, SCHEMA)
