"""Texts cut into chunks: sections by heading in the JVM, then paragraphs packed up to a size."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import each
from .markup import page

#: Characters a chunk, and those repeated from the chunk before.
SIZE, OVERLAP = 1200, 150


def fill(parts: Iterable[str], glue: str, size: int, carry: Callable[[str], str]) -> Iterator[str]:
    """Parts joined as long as they fit; what follows a full one begins with `carry` of it."""
    held = ""
    for part in parts:
        if held and len(held) + len(glue) + len(part) > size:
            yield held
            held = carry(held)
        held = f"{held}{glue}{part}" if held else part
    if held:
        yield held


def pack(section: str, size: int, overlap: int) -> list[str]:
    """Chunks of a section: whole paragraphs, else whole sentences, else cuts. A repeated tail starts at a word and comes on top of the size."""
    if len(section) <= size:
        return [section]

    def tail(text: str) -> str:
        end = text[-overlap:] if overlap else ""
        return end if len(text) <= overlap or " " not in end else end.split(" ", 1)[1]

    def paragraphs() -> Iterator[str]:
        for p in re.split(r"\n\s*\n", section):
            if len(p) <= size:
                yield p
            else:
                cuts = (s[i : i + size] for s in re.split(r"(?<=[.!?])\s+", p) for i in range(0, len(s), size))
                yield from fill(cuts, " ", size, lambda _: "")

    return [c.strip() for c in fill(paragraphs(), "\n\n", size, tail) if c.strip()]


def chunked(docs: DataFrame, text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The other columns of docs with ordinal (from 0, gapless), heading and content of each chunk; no shuffle.

    Headings without a body, null and blank texts give no chunks.
    """
    _checked(size, overlap)

    def packed(bodies: Column) -> Column:
        return each(bodies, lambda sections: [pack(s, size, overlap) for s in sections], "array<array<string>>", pa.list_(pa.list_(pa.string())))

    trimmed: Callable[[Column], Column] = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    head = r"^#{1,6}\s+([^\n]*)"
    sections = F.split(F.coalesce(trimmed(F.col(text)), F.lit("")), r"(?m)^(?=#{1,6}\s+)")
    split = F.transform(sections, lambda s: F.struct(F.when(s.rlike(head), trimmed(F.regexp_extract(s, head, 1))).alias("heading"), trimmed(F.regexp_replace(s, head, "")).alias("body")))
    found = docs.withColumn("sections_", F.filter(split, lambda s: s["body"] != ""))
    pieces = F.arrays_zip(F.col("sections_.heading").alias("heading"), packed(F.col("sections_.body")).alias("pieces"))
    flat = F.flatten(F.transform(pieces, lambda s: F.transform(s["pieces"], lambda c: F.struct(s["heading"].alias("heading"), c.alias("content")))))
    others = [c for c in docs.columns if c != text]
    return found.select(*others, F.posexplode(flat).alias("ordinal", "chunk_")).select(*others, "ordinal", "chunk_.heading", "chunk_.content")


def pack_blocks(blocks: Iterable[dict], size: int, overlap: int) -> list[tuple[str | None, str]]:
    """Heading and content of each chunk of parsed blocks.

    A table is one chunk whatever its size, a longer block than `size` is cut by `pack`, others are packed as
    long as they fit. A heading ends what is open and stands over what follows it.
    """
    out: list[tuple[str | None, str]] = []
    held: list[str] = []
    over = None

    def close() -> None:
        content = "\n\n".join(held).strip()
        if content:
            out.append((over, content))
        held.clear()

    for b in blocks:
        content, heading = b["content"], b["heading"]
        if b["kind"] == "heading":
            close()
            over = content
        elif b["kind"] == "table" or len(content) > size:
            close()
            out += [(heading, c) for c in ([content] if b["kind"] == "table" else pack(content, size, overlap))]
        else:
            if len("\n\n".join([*held, content])) > size:
                close()
            if not held:
                over = heading or over
            held.append(content)
    close()
    return out


def _checked(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")


def _chunks(value: Column, blocks_of: Callable[[Any], Iterable[dict]], size: int, overlap: int) -> Column:
    one = lambda v: [{"heading": h, "content": c} for h, c in pack_blocks(blocks_of(v), size, overlap)]
    return each(value, one, "array<struct<heading: string, content: string>>", pa.list_(pa.struct({"heading": pa.string(), "content": pa.string()})))


def _numbered(docs: DataFrame, source: str, chunks: Column) -> DataFrame:
    others = [c for c in docs.columns if c != source]
    return docs.select(*others, F.posexplode(chunks).alias("ordinal", "chunk_")).select(*others, "ordinal", "chunk_.heading", "chunk_.content")


def chunked_blocks(docs: DataFrame, blocks: str = "blocks", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The other columns of docs with ordinal, heading and content of each chunk of its parsed blocks; no shuffle, and no blocks give no chunks."""
    _checked(size, overlap)
    return _numbered(docs, blocks, _chunks(F.col(blocks), lambda r: r or [], size, overlap))


def chunked_html(docs: DataFrame, html: str = "html", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The same of pages that are parsed on the way: one worker a task does both."""
    _checked(size, overlap)
    return _numbered(docs, html, _chunks(F.col(html), lambda h: page(h)["blocks"], size, overlap))
