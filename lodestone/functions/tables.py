"""Parsers and chunkers as table functions of SQL: SELECT ... FROM documents, LATERAL parse_blocks(text)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .chunks import OVERLAP, SIZE, pack_blocks
from .markup import markdown, page

_BLOCK = "title string, place int, kind string, content string, level int, heading string"


class _Markdown:
    parse = staticmethod(markdown)

    def eval(self, text: str) -> Iterator[tuple]:
        parsed = self.parse(text)
        for place, b in enumerate(parsed["blocks"]):
            yield parsed["title"], place, b["kind"], b["content"], b["level"], b["heading"]


class _Html(_Markdown):
    parse = staticmethod(page)


class _Chunks:
    def eval(self, html: str) -> Iterator[tuple]:
        for ordinal, (heading, content) in enumerate(pack_blocks(page(html)["blocks"], SIZE, OVERLAP)):
            yield ordinal, heading, content


def register(spark: SparkSession) -> None:
    """parse_blocks (Markdown), parse_html_blocks and chunk_html, for a null or empty text none."""
    spark.udtf.register("parse_blocks", udtf(_Markdown, returnType=_BLOCK))
    spark.udtf.register("parse_html_blocks", udtf(_Html, returnType=_BLOCK))
    spark.udtf.register("chunk_html", udtf(_Chunks, returnType="ordinal int, heading string, content string"))
