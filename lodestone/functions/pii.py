"""Personal data and secrets in texts: spans by kind, and texts with typed placeholders."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import each

#: Kinds in the order in which they claim characters, with their patterns.
PATTERNS = {
    "api_key": r"\b(?:sk-[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|ghp_[A-Za-z0-9]{36}|AKIA[0-9A-Z]{16})\b",
    "email": r"\b[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    "ssn": r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "credit_card": r"\b(?:\d[ -]?){12,18}\d\b",
    "phone": r"(?:\+\d{1,3}[ -]?)?\(?\d{3}\)?[ -]\d{3}[ -]\d{4}\b",
    "ip_address": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])",
}
_COMPILED = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
SPANS = "array<struct<kind: string, start: int, stop: int>>"
_SPANS = pa.list_(pa.struct({"kind": pa.string(), "start": pa.int32(), "stop": pa.int32()}))


def checksum_ok(number: str) -> bool:
    """Whether 13 or more digits pass the Luhn check."""
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return len(digits) >= 13 and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


_ACCEPT = {"credit_card": checksum_ok, "ip_address": lambda quad: all(int(part) < 256 for part in quad.split("."))}


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """kind, start and stop of what the text holds, by position; an earlier kind keeps its characters."""
    if not text:
        return []
    taken, found = bytearray(len(text)), []
    for kind, pattern in _COMPILED.items():
        accept = _ACCEPT.get(kind, lambda _: True)
        for m in pattern.finditer(text):
            a, b = m.span()
            if not any(taken[a:b]) and accept(m[0]):
                taken[a:b] = b"\1" * (b - a)
                found.append((kind, a, b))
    return sorted(found, key=lambda s: s[1])


def may_hold(text: Column) -> Column:
    """Whether a text can hold any of the kinds: all of them have a digit of some script, an @, or the beginning of a key. It stays in the JVM."""
    return F.coalesce(F.rlike(text, F.lit(r"[\p{Nd}@]|sk-|xox|ghp_|AKIA")), F.lit(False))


def pii_spans(text: Column) -> Column:
    """An array of (kind, start, stop) in characters; empty for null. Python's word characters are Unicode's, so this runs in Python."""
    return each(text, lambda t: [{"kind": k, "start": a, "stop": b} for k, a, b in spans(t)], SPANS, _SPANS)


def without(text: str | None) -> str | None:
    """The text with [KIND] in place of each span."""
    if text is None:
        return None
    pieces, at = [], 0
    for kind, a, b in spans(text):
        pieces += text[at:a], f"[{kind.upper()}]"
        at = b
    return "".join([*pieces, text[at:]])


def redacted(text: Column) -> Column:
    """The text with [KIND] in place of each span; null stays null."""
    return each(text, without, "string", pa.string())
