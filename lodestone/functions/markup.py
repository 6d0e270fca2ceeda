"""Blocks of HTML pages and Markdown texts: headings, paragraphs, lists and tables, each with the heading that it stands under."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column

from .batches import each

#: Elements that are left out, those that hold the main part (first found wins), those that make blocks, and those without an end.
CHROME = ("script", "style", "nav", "header", "footer", "aside", "noscript", "form")
ROOTS = ("main", "article", "body")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
KINDS = {**dict.fromkeys(HEADINGS, "heading"), "p": "paragraph", "pre": "paragraph", "ul": "list", "ol": "list", "table": "table"}
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Heading line, table row and list item of Markdown.
HEADING, TABLE_ROW, LIST_ITEM = re.compile(r"^(#{1,6})\s+(.*)$"), re.compile(r"^\s*\|.*\|\s*$"), re.compile(r"^\s*(?:[-*+]|\d+\.)\s+")
BLOCK = "struct<kind: string, content: string, level: int, heading: string>"
PAGE = f"struct<title: string, blocks: array<{BLOCK}>>"
_PAGE = pa.struct({"title": pa.string(), "blocks": pa.list_(pa.struct({"kind": pa.string(), "content": pa.string(), "level": pa.int32(), "heading": pa.string()}))})


class _Tree(HTMLParser):
    """Elements as lists of their children: [tag, child, ...]; texts are strings."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top: list = ["document"]
        self.path = [self.top]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        names = [e[0] for e in self.path]
        if tag in KINDS and "p" in names and not set(names) & {"table", "ul", "ol"}:
            self.handle_endtag("p")  # a paragraph ends where the next block begins
        elif tag == "li" and "li" in names and max(k for k, n in enumerate(names) if n == "li") > max((k for k, n in enumerate(names) if n in ("ul", "ol")), default=0):
            self.handle_endtag("li")
        elif tag in ("td", "th", "tr"):
            inner = names[max((k for k, n in enumerate(names) if n == "table"), default=0) :]
            for open_ in ("td", "th", *(("tr",) if tag == "tr" else ())):
                if open_ in inner:
                    self.handle_endtag(open_)
        element = [tag]
        self.path[-1].append(element)
        if tag not in VOID:
            self.path.append(element)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.path) - 1, 0, -1):
            if self.path[k][0] == tag:
                del self.path[k:]
                return
            if self.path[k][0] in ROOTS:
                return

    def handle_data(self, data: str) -> None:
        self.path[-1].append(data)


def _all(element: list, tags: tuple[str, ...], within: tuple[str, ...] = ()) -> list[list]:
    """Elements of these tags in order, not looking into chrome, nor below what is in `within`."""
    found = []
    for child in element[1:]:
        if isinstance(child, list) and child[0] not in CHROME:
            if child[0] in tags:
                found.append(child)
            if child[0] not in within:
                found += _all(child, tags, within)
    return found


def _text(element: list) -> str:
    """The texts of an element, each stripped, with a space between."""
    parts = [c.strip() if isinstance(c, str) else _text(c) for c in element[1:] if isinstance(c, str) or c[0] not in CHROME]
    return " ".join(p for p in parts if p)


def _content(element: list) -> str:
    if element[0] == "table":
        rows = [[_text(cell) for cell in _all(row, ("td", "th"))] for row in _all(element, ("tr",))]
        return "\n".join(" | ".join(cells) for cells in rows if any(cells))
    if element[0] in ("ul", "ol"):
        return "\n".join(f"- {item}" for item in (_text(c) for c in element[1:] if isinstance(c, list) and c[0] == "li") if item)
    return _text(element)


def page(html: str | None) -> dict:
    """Title and blocks of a page. Text outside blocks is dropped; blocks inside tables and lists are part of them; an empty or null page has none."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    titles = _all(tree.top, ("title",))
    root = next((e[0] for e in (_all(tree.top, (r,)) for r in ROOTS) if e), tree.top)
    blocks, heading = [], None
    for element in _all(root, tuple(KINDS), ("table", "ul", "ol")):
        content = _content(element)
        if content:
            level = int(element[0][1]) if element[0] in HEADINGS else None
            heading = content if level else heading
            blocks.append({"kind": KINDS[element[0]], "content": content, "level": level, "heading": heading})
    return {"title": " ".join(_text(titles[0]).split()) if titles else None, "blocks": blocks}


def markdown(text: str | None) -> dict:
    """Blocks of Markdown or plain text: a run of table rows is one block, a paragraph with a list item a list. The title is the first heading."""
    blocks, heading = [], None
    held: list[tuple[str, str]] = []  # kind and text of the lines of the block that is open

    def close() -> None:
        kinds, content = {k for k, _ in held}, "\n".join(line for _, line in held).strip()
        if content:
            kind = next(k for k in ("table", "list", "paragraph") if k in kinds)
            blocks.append({"kind": kind, "content": content, "level": None, "heading": heading})
        held.clear()

    for line in (text or "").splitlines():
        kind = "table" if TABLE_ROW.match(line) else "list" if LIST_ITEM.match(line) else "paragraph"
        head = HEADING.match(line) if kind != "table" else None
        if head or not line.strip() or (held and (held[-1][0] == "table") != (kind == "table")):
            close()
        if head:
            heading = head[2].strip()
            blocks.append({"kind": "heading", "content": heading, "level": len(head[1]), "heading": heading})
        elif line.strip():
            held.append((kind, line))
    close()
    return {"title": next((b["content"] for b in blocks if b["kind"] == "heading"), None), "blocks": blocks}


def html_page(html: Column) -> Column:
    return each(html, page, PAGE, _PAGE)


def markdown_page(text: Column) -> Column:
    return each(text, markdown, PAGE, _PAGE)
