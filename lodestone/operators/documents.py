"""The document pipeline: parsing, chunks, personal data, text flags and ingest counters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.chunks import chunked, chunked_html
from ..functions.markup import html_page, markdown_page
from ..functions.pii import PATTERNS, may_hold, pii_spans, redacted
from ..plans.registry import query
from ..plans.views import DOCUMENT_SQL, document
from ..session import shared_dir, table
from ..sources import files


def blocks_of(parsed: DataFrame, id_: str) -> DataFrame:
    return parsed.select(id_, "page.title", F.posexplode("page.blocks").alias("place", "block")).select(id_, "title", "place", "block.*")


@query("parse_html")
def parse_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(table(spark, sf_dir, "pages").select("page_id", html_page(F.col("html")).alias("page")), "page_id")


@query("parse_markdown")
def parse_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every document, read as Markdown."""
    return blocks_of(table(spark, sf_dir, "documents").select("doc_id", markdown_page(F.col("text")).alias("page")), "doc_id")


@query("parse_lateral")
def parse_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of `parse_markdown`, from a table function called in SQL."""
    tables.register(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spark.sql("SELECT d.doc_id, b.title, b.place, b.kind, b.content, b.level, b.heading FROM {docs} d, LATERAL parse_blocks(d.text) b", docs=docs)


@query("chunk_blocks")
def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every page by its blocks: tables stay whole."""
    return chunked_html(table(spark, sf_dir, "pages").select("page_id", "html"))


@query("chunk_text")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("chunk_ordinals")
def chunk_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document, and whether their ordinals are gapless from 0."""
    per = chunk_text(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("ordinal").alias("last"), F.count_distinct("ordinal").alias("different"))
    return per.select("doc_id", "chunks", ((F.col("last") == F.col("chunks") - 1) & (F.col("different") == F.col("chunks"))).alias("gapless"))


@query("pii_find")
def pii_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").where(may_hold(F.col("text"))).select("doc_id", F.explode(pii_spans(F.col("text"))).alias("s"))
    return found.select("doc_id", "s.kind", "s.start", "s.stop")


@query("pii_summary")
def pii_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind of each document, as a map; counts, never values, leave the task that reads the text."""
    counts = lambda spans: F.map_from_entries(F.transform(F.array_distinct(F.transform(spans, lambda s: s["kind"])), lambda k: F.struct(k, F.size(F.filter(spans, lambda s: s["kind"] == k)))))
    found = table(spark, sf_dir, "documents").where(may_hold(F.col("text"))).select("doc_id", pii_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)
    return found.select("doc_id", counts(F.col("spans")).alias("counts"))


@query("pii_total")
def pii_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, never values: what a listing shows beside each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(pii_spans(F.col("text"))).cast("long").alias("found"))


@query("pii_redact")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", redacted(F.col("text")).alias("text"))


#: The kinds whose patterns mean the same in every regular-expression engine on ASCII text; addresses without the word boundary.
_KEY, _IBAN, _EMAIL = PATTERNS["api_key"], PATTERNS["iban"], r"[A-Za-z0-9_.%+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}"


@query("pii_simple", f"SELECT doc_id, len(regexp_extract_all(t, '{_KEY}')) AS api_keys, len(regexp_extract_all(t, '{_IBAN}')) AS ibans, len(regexp_extract_all(t, '{_EMAIL}')) AS emails FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def pii_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda pattern: F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", count(_KEY).alias("api_keys"), count(_IBAN).alias("ibans"), count(_EMAIL).alias("emails"))


@query("preview", "SELECT doc_id, substring(text, 1, 600) AS preview, length(text) > 600 AS shortened FROM documents")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 600).alias("preview"), (F.length("text") > 600).alias("shortened"))


@query("token_est", "SELECT conv_id, turn, CAST(greatest(1, coalesce(length(text), 0) // 4) AS BIGINT) AS tokens FROM conversations")
def token_est(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.greatest(F.lit(1).cast("long"), F.expr("coalesce(length(text), 0) div 4")).alias("tokens"))


@query("csv_labels", "SELECT c_custkey, array_to_string(list_filter(list_transform(string_split(c_mktsegment || ', ,' || c_name || ' ', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS labels FROM customer")
def csv_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("c_mktsegment", F.lit(", ,"), "c_name", F.lit(" "))
    labels = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(labels, "|").alias("labels"))


#: What a heading line of a page looks like, what it must not end in, and a gap between columns.
HEADING_LINE, NOT_AT_END, COLUMN_GAP = r"^\s*(?:\d+(?:\.\d+)*\.?\s+)?[A-Z][^.!?]{2,80}$", "[.,;:]$", r"\S {2,}\S"


@query("heading_flag", f"SELECT doc_id, length(l) <= 80 AND NOT regexp_matches(l, '{NOT_AT_END}') AND regexp_matches(l, '{HEADING_LINE}') AS heading FROM (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS l FROM documents)")
def heading_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's first line looks like a heading: a capital, three characters or more without the end of a sentence, 80 at most."""
    line = F.trim(F.split("text", "\n", 2)[0])
    return table(spark, sf_dir, "documents").select("doc_id", ((F.length(line) <= 80) & ~line.rlike(NOT_AT_END) & line.rlike(HEADING_LINE)).alias("heading"))


#: Fixed value: share of a document's pages on which a line must stand to be chrome.
REPEATED = 0.6


def page_chrome(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """document, line: lines that stand on most pages of a document of three pages or more, and lines of digits only.

    Each distinct line counts once a page. Page numbers differ from page to page, so they are found by their digits.
    """
    own = pages.select(F.col(document).alias("document"), F.col(page).alias("page"), F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.trim(x))).alias("lines"))
    count = own.groupBy("document").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 3")
    lines = own.select("document", F.explode("lines").alias("line")).where("line <> ''").groupBy("document", "line").agg(F.count(F.lit(1)).alias("n"))
    common = (F.col("n") >= F.greatest(F.lit(2), F.floor(REPEATED * F.col("pages")))) | F.col("line").rlike("^[0-9]+$")
    return lines.join(count, "document").where(common).select("document", "line", "n")


_PAGES_SQL = "SELECT doc_id // 4 AS document, doc_id % 4 AS page, 'Handbook' || chr(10) || coalesce(text, '') || chr(10) || (doc_id % 4) AS text FROM documents"


@query("chrome_lines", f"WITH p AS ({_PAGES_SQL}), l AS (SELECT DISTINCT document, page, trim(unnest(string_split(text, chr(10)))) AS line FROM p), c AS (SELECT document, count(*) AS pages FROM p GROUP BY document HAVING count(*) >= 3) SELECT document, sha256(line) AS line_hash, count(*) AS n FROM l JOIN c USING (document) WHERE line <> '' GROUP BY document, line, pages HAVING count(*) >= greatest(2, floor({REPEATED} * pages)) OR regexp_matches(line, '^[0-9]+$')")
def chrome_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page furniture; four documents in a row are the pages of one, each with a derived header and page number."""
    text = F.concat(F.lit("Handbook\n"), F.coalesce("text", F.lit("")), F.lit("\n"), (F.col("doc_id") % 4).cast("string"))
    pages = table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("document"), (F.col("doc_id") % 4).alias("page"), text.alias("text"))
    return page_chrome(pages, "document", "page", "text").select("document", F.sha2("line", 256).alias("line_hash"), "n")


_LINES_SQL = "SELECT page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM (SELECT doc_id AS page_id, replace(coalesce(text, ''), ', ', CASE WHEN doc_id % 2 = 0 THEN '   ' ELSE ', ' END) AS text FROM documents)"


@query("table_runs", rf"WITH l AS (SELECT page_id, place, regexp_matches(line, '{COLUMN_GAP}') AS gap FROM ({_LINES_SQL})), g AS (SELECT page_id, place, place - row_number() OVER (PARTITION BY page_id ORDER BY place) AS island FROM l WHERE gap) SELECT page_id, min(place) AS first_line, count(*) AS lines FROM g GROUP BY page_id, island HAVING count(*) >= 2")
def table_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more lines with gaps between columns, as islands of line numbers; only lines with a gap are shuffled."""
    wide = F.when(F.col("doc_id") % 2 == 0, "   ").otherwise(", ")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(", "), wide)
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    gaps = lines.where(F.rlike("line", F.lit(COLUMN_GAP))).select("page_id", "place")
    island = F.col("place") - F.row_number().over(Window.partitionBy("page_id").orderBy("place"))
    runs = gaps.withColumn("island", island).groupBy("page_id", "island").agg(F.min("place").cast("long").alias("first_line"), F.count(F.lit(1)).alias("lines"))
    return runs.where("lines >= 2").select("page_id", "first_line", "lines")


@query("ingest_summary", f"WITH {DOCUMENT_SQL}, s AS (SELECT row_number() OVER (PARTITION BY tenant_id, sha256(text) ORDER BY doc_id) > 1 AS skipped, row_number() OVER (PARTITION BY tenant_id, source_path ORDER BY doc_id) > 1 AS again, tenant_id FROM document) SELECT tenant_id, count(*) FILTER (WHERE NOT skipped AND NOT again) AS created, count(*) FILTER (WHERE skipped) AS skipped, count(*) FILTER (WHERE NOT skipped AND again) AS superseded FROM s GROUP BY tenant_id")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one ingest run counts: texts seen before are skipped, known paths superseded, others created."""
    docs = document(spark, sf_dir).select("tenant_id", "source_path", "doc_id", F.sha2("text", 256).alias("hash"))
    # firsts are aggregates, so that copies are combined before the shuffle
    by_text = docs.groupBy("tenant_id", "hash").agg(F.min("doc_id").alias("first_text"))
    by_path = docs.groupBy("tenant_id", "source_path").agg(F.min("doc_id").alias("first_path"))
    firsts = docs.join(by_text.select("tenant_id", F.col("first_text").alias("doc_id"), F.lit(False).alias("copy")), ["tenant_id", "doc_id"], "left").join(by_path.select("tenant_id", F.col("first_path").alias("doc_id"), F.lit(False).alias("known")), ["tenant_id", "doc_id"], "left")
    skipped, again = F.coalesce("copy", F.lit(True)), F.coalesce("known", F.lit(True))
    return firsts.groupBy("tenant_id").agg(F.count_if(~skipped & ~again).alias("created"), F.count_if(skipped).alias("skipped"), F.count_if(~skipped & again).alias("superseded"))


@query("scan_files", "SELECT 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '.md' ELSE '.HTML' END AS file, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS bytes FROM pages WHERE page_id % 3 < 2")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of a folder, found again by their suffixes, with their sizes; what has another suffix is not seen."""
    folder = f"{shared_dir(spark)}/pages-{uuid.uuid4()}"
    kind = F.when(F.col("page_id") % 3 == 0, ".md").when(F.col("page_id") % 3 == 1, ".HTML").otherwise(".bin")
    saved = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), kind).alias("name"), F.col("html").alias("text"))
    files.save(saved, folder)
    return files.found(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes")
