"""Append-only sinks of traces and audit entries, and of documents with their chunks, as partitioned Parquet."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import chunked_blocks
from ..functions.embed import embedded
from . import versioned

log = logging.getLogger(__name__)


def append(rows: DataFrame, path: str, at: str = "ts") -> None:
    """Rows added to a sink, by day; a failure is the caller's, as an audit must not lose an entry."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def append_traces(spans: DataFrame, path: str) -> bool:
    """Spans added to a sink; a failure is logged and swallowed, as a trace must not fail what it traces."""
    try:
        append(spans, path)
    except Exception:
        log.exception("spans were not written to %s", path)
        return False
    return True


_DOCUMENT = "document_id string, path string, title string, bucket int"
_CHUNK = "document_id string, ordinal int, heading string, content string, embedding array<double>, bucket int"


def write_documents(parsed: DataFrame, folder: str, dimension: int = 64) -> None:
    """Parsed files (path, title, blocks) as documents and their embedded chunks, keyed by a digest of the path.

    A file that was written before is replaced with its chunks, all others stay. Files are parsed once, and only the
    partitions of their paths are written; a rerun writes the same rows, and a killed run is finished by the next.
    """
    spark = parsed.sparkSession
    versioned.recover(spark, folder)
    bucket = F.pmod(F.xxhash64("path"), F.lit(versioned.BUCKETS)).cast("int")
    run = f"{folder}/_run/{uuid.uuid4()}"
    parsed.where("blocks IS NOT NULL").select("path", "title", "blocks", F.sha2("path", 256).alias("document_id"), bucket.alias("bucket")).write.parquet(run)
    keyed = spark.read.parquet(run)
    touched = keyed.select("bucket").distinct()
    chunks = chunked_blocks(keyed.select("document_id", "blocks", "bucket")).withColumn("embedding", embedded(F.col("content"), dimension))
    tables = {}
    for name, rows, schema in (("document", keyed, _DOCUMENT), ("chunk", chunks.withColumn("ordinal", F.col("ordinal").cast("int")), _CHUNK)):
        there = versioned._read(spark, folder, name, schema).join(F.broadcast(touched), "bucket", "left_semi").join(keyed.select("document_id"), "document_id", "left_anti")
        columns = [c.split()[0] for c in schema.split(", ")]
        tables[name] = there.select(*columns).unionByName(rows.select(*columns))
    if not touched.isEmpty():
        versioned._change(spark, folder, tables, touched)
    versioned._Files(spark, folder).delete("_run")
