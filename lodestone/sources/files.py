"""Files of a folder as documents: found by suffix, read as bytes, parsed by what their suffix says."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import PAGE, html_page, markdown_page

#: Suffixes by parser.
SUFFIXES = {"markdown": (".md", ".markdown", ".txt"), "html": (".html", ".htm")}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def found(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = sum(SUFFIXES.values(), ())) -> DataFrame:
    """path, bytes and content of the files below a folder with a wanted suffix, in any case; contents are read only where selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(suffix(F.col("path")).isin(*suffixes)).select("path", F.col("length").alias("bytes"), "content")


def save(texts: DataFrame, folder: str) -> None:
    """Texts (name, text) as files of a folder, by tasks, in any store that Arrow reads; a rerun writes the same."""

    def run(rows: Iterator[Row]) -> None:
        store, base = pafs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        store.create_dir(base, recursive=True)
        for r in rows:
            with store.open_output_stream(f"{base}/{r['name']}") as f:
                f.write((r["text"] or "").encode())

    texts.select("name", "text").foreachPartition(run)


def parsed(files: DataFrame) -> DataFrame:
    """path, title (else the file's name), blocks, and error where no parser takes the suffix; bytes that are no UTF-8 are replaced."""
    text, kind = F.decode("content", "UTF-8"), suffix(F.col("path"))
    html, plain = kind.isin(*SUFFIXES["html"]), kind.isin(*SUFFIXES["markdown"])
    page = F.when(html, html_page(F.when(html, text))).when(plain, markdown_page(F.when(plain, text))).otherwise(F.lit(None).cast(PAGE))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    rows = files.select("path", page.alias("page"), F.when(~html & ~plain, F.concat(F.lit("no parser for "), kind)).alias("error"))
    return rows.select("path", F.coalesce("page.title", stem).alias("title"), "page.blocks", "error")
