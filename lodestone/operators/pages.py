"""Texts of pages put together as blocks: page furniture out, table runs whole, headings over what follows, in the order of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import table
from .documents import _PAGES_SQL, COLUMN_GAP, HEADING_LINE, NOT_AT_END, REPEATED, page_chrome

#: Lines of a table at least, and pages over which a document's own name is its title.
TABLE_LINES, SHORT = 2, 3


def assembled(pages: DataFrame) -> DataFrame:
    """pages (document, page, text) as document, block, page, kind, content, heading.

    A block ends with its page. Null texts and blank lines give nothing. Lines are dealt by document and sorted there,
    with spilling; only a block is ever one value.
    """
    text = F.regexp_replace("text", "\r\n?", "\n")
    split = pages.select("document", "page", F.posexplode(F.split(text, "\n")).alias("place", "line")).withColumn("line", F.rtrim("line")).where("line != ''")
    furniture = page_chrome(pages, "document", "page", "text").select("document", F.col("line").alias("trimmed"))
    lines = split.withColumn("trimmed", F.trim("line")).join(furniture, ["document", "trimmed"], "left_anti")
    here, whole = Window.partitionBy("document", "page").orderBy("place"), Window.partitionBy("document").orderBy("page", "place")
    gap = F.rlike("line", F.lit(COLUMN_GAP))
    lines = lines.withColumn("gap", gap).withColumn("island", F.sum(F.when(F.col("gap"), 0).otherwise(1)).over(here))
    run = F.count_if("gap").over(Window.partitionBy("document", "page", "island"))
    heading = (F.length("trimmed") <= 80) & ~F.rlike("trimmed", F.lit(NOT_AT_END)) & F.rlike("trimmed", F.lit(HEADING_LINE))
    kind = F.when(F.col("gap") & (run >= TABLE_LINES), "table").when(heading, "heading").otherwise("paragraph")
    lines = lines.withColumn("kind", kind)
    begins = (F.row_number().over(here) == 1) | (F.col("kind") == "heading") | (F.col("kind") != F.lag("kind").over(here))
    lines = lines.withColumn("begins", begins.cast("int")).withColumn("over", F.last(F.when(F.col("kind") == "heading", F.col("trimmed")), True).over(whole))
    lines = lines.withColumn("block", F.sum("begins").over(whole) - 1)
    blocks = lines.groupBy("document", "block", "page", "kind", F.col("over").alias("heading")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("own"))
    content = F.when(F.col("kind") == "table", F.array_join("own", "\n")).otherwise(F.trim(F.array_join("own", " ")))
    return blocks.select("document", "block", "page", "kind", content.alias("content"), "heading")


def titles(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """document, title: the first heading of a document of few pages, else the document's name."""
    size = pages.groupBy("document").agg(F.count(F.lit(1)).alias("pages"))
    first = blocks.where("kind = 'heading'").groupBy("document").agg(F.min_by("content", "block").alias("first"))
    return size.join(first, "document", "left").select("document", F.when(F.col("pages") <= SHORT, F.col("first")).alias("first")).select("document", F.coalesce("first", F.col("document").cast("string")).alias("title"))


_GAPPED_SQL = f"g AS (SELECT document, page, CASE WHEN document % 2 = 0 THEN replace(text, ', ', '   ') ELSE text END AS text FROM ({_PAGES_SQL}))"
_BLOCKS_SQL = rf"""{_GAPPED_SQL}, s AS (SELECT document, page, rtrim(line) AS line, trim(line) AS trimmed, place FROM (SELECT document, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM (SELECT document, page, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM g))),
 c AS (SELECT document, count(*) AS pages FROM g GROUP BY document),
 f AS (SELECT document, trimmed FROM s JOIN c USING (document) WHERE pages >= 3 AND trimmed <> '' GROUP BY document, trimmed, pages HAVING count(DISTINCT page) >= greatest(2, floor({REPEATED} * pages)) OR regexp_matches(trimmed, '^[0-9]+$')),
 l AS (SELECT *, regexp_matches(line, '{COLUMN_GAP}') AS gap FROM s ANTI JOIN f ON f.document = s.document AND f.trimmed = s.trimmed WHERE line <> ''),
 i AS (SELECT *, sum(CASE WHEN gap THEN 0 ELSE 1 END) OVER (PARTITION BY document, page ORDER BY place) AS island FROM l),
 k AS (SELECT *, CASE WHEN gap AND count(*) FILTER (WHERE gap) OVER (PARTITION BY document, page, island) >= {TABLE_LINES} THEN 'table' WHEN length(trimmed) <= 80 AND NOT regexp_matches(trimmed, '{NOT_AT_END}') AND regexp_matches(trimmed, '{HEADING_LINE}') THEN 'heading' ELSE 'paragraph' END AS kind FROM i),
 b AS (SELECT *, CASE WHEN kind = 'heading' OR lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS begins, last_value(CASE WHEN kind = 'heading' THEN trimmed END IGNORE NULLS) OVER (PARTITION BY document ORDER BY page, place) AS heading FROM k WINDOW w AS (PARTITION BY document, page ORDER BY place)),
 n AS (SELECT *, sum(begins) OVER (PARTITION BY document ORDER BY page, place) - 1 AS block FROM b),
 block AS (SELECT document, CAST(block AS BIGINT) AS block, page, kind, CASE kind WHEN 'table' THEN string_agg(line, chr(10) ORDER BY place) ELSE trim(string_agg(line, ' ' ORDER BY place)) END AS content, heading FROM n GROUP BY document, block, page, kind, heading)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four documents in a row are the pages of one, each with a header and its number; commas part columns in every second one."""
    text = F.concat(F.lit("Handbook\n"), F.coalesce("text", F.lit("")), F.lit("\n"), (F.col("doc_id") % 4).cast("string"))
    pages = table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("document"), (F.col("doc_id") % 4).alias("page"), text.alias("text"))
    return pages.withColumn("text", F.when(F.col("document") % 2 == 0, F.replace("text", F.lit(", "), F.lit("   "))).otherwise(F.col("text")))


@query("pdf_pages", f"WITH {_BLOCKS_SQL} SELECT document, block, page, kind, sha256(content) AS content_hash, heading FROM block")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembled(_pages(spark, sf_dir)).select("document", "block", "page", "kind", F.sha2("content", 256).alias("content_hash"), "heading")


@query("page_titles", f"WITH {_BLOCKS_SQL}, t AS (SELECT document, arg_min(content, block) AS first FROM block WHERE kind = 'heading' GROUP BY document) SELECT c.document, coalesce(CASE WHEN pages <= {SHORT} THEN first END, CAST(c.document AS VARCHAR)) AS title FROM c LEFT JOIN t ON t.document = c.document")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return titles(pages, assembled(pages))
