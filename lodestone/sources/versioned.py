"""Versioned documents with their chunks, and stores of dated rows, changed in place partition by partition.

A change is staged whole, marked ready, and only then moved over the partitions that it touches. A run that is killed before
the mark has changed nothing; one that is killed after it is finished by whoever comes next (`recover`). So a reader's
tables never stay half changed, and a rerun of the same input changes no file. One writer at a time.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import chunked
from ..functions.embed import embedded

#: Parts that a tenant's paths are dealt over; rows that one pass of a policy deletes at most.
BUCKETS, AT_ONCE = 16, 10_000
DOCUMENT = "document_id string, source_path string, version int, content_hash string, text string, labels array<string>, superseded_by string, superseded_at timestamp, tenant_id long, bucket int"
CHUNK = "document_id string, ordinal int, heading string, content string, embedding array<float>, tenant_id long, bucket int"
PARTS = ["tenant_id", "bucket"]


@dataclass(frozen=True)
class Policy:
    """Rows of a store older than `days` by `at` go; a row is told by `key`."""

    store: str
    days: int
    at: str = "created_at"
    key: str = "id"


#: How long each kind of record is kept.
POLICIES = (Policy("trace_span", 30), Policy("conversation_message", 90), Policy("conversation", 90), Policy("agent_run", 90), Policy("ingest_job", 30), Policy("connector_audit", 365), Policy("approval_request", 365))


class _Files:
    """The file system of a folder, whichever it is."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.path = lambda *parts: spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((folder, *parts)))
        self.fs = self.path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.path(*parts))

    def names(self, *parts: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(*parts))) if self.exists(*parts) else []

    def mark(self, *parts: str) -> None:
        self.fs.create(self.path(*parts), True).close()

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    if not _Files(spark, folder).exists(name):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "document", DOCUMENT)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "chunk", CHUNK)


def _change(spark: SparkSession, folder: str, tables: dict[str, DataFrame], touched: DataFrame) -> None:
    """Put tables in place of the partitions `touched` (whose columns are the partition's); a partition without rows goes."""
    files, stage = _Files(spark, folder), f"_stage/{uuid.uuid4()}"
    parts = touched.columns
    touched.write.parquet(f"{folder}/{stage}/_touched")
    for name, rows in tables.items():
        rows.write.partitionBy(*parts).parquet(f"{folder}/{stage}/{name}")
    files.mark(stage, "_ready")
    _finish(spark, folder, stage)


def _finish(spark: SparkSession, folder: str, stage: str) -> None:
    files = _Files(spark, folder)
    touched = spark.read.parquet(f"{folder}/{stage}/_touched").distinct()
    parts = touched.columns
    wanted = {"/".join(f"{p}={r[p]}" for p in parts) for r in touched.collect()}  # partitions of one change
    for name in [n for n in files.names(stage) if not n.startswith("_")]:
        for part in sorted(wanted):
            if not files.exists(stage, name, part):
                files.delete(name, part)
        if any(n.startswith(f"{parts[0]}=") for n in files.names(stage, name)):
            staged = spark.read.parquet(f"{folder}/{stage}/{name}")
            staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{folder}/{name}")
    files.delete(stage)


def recover(spark: SparkSession, folder: str) -> None:
    """Finish what was ready and drop what was not."""
    files = _Files(spark, folder)
    for stage in files.names("_stage"):
        if files.exists("_stage", stage, "_ready"):
            _finish(spark, folder, f"_stage/{stage}")
        else:
            files.delete("_stage", stage)


def _number(condition: str) -> Column:
    """How many rows meet a condition, in a form that may be observed."""
    return F.coalesce(F.sum(F.expr(f"CAST({condition} AS BIGINT)")), F.lit(0))


def ingest(docs: DataFrame, folder: str, at: str, dimension: int = 64) -> dict[str, int]:
    """Bring documents (tenant_id, source_path, text, labels) into the store, and count created, skipped, superseded and chunks.

    A text that a tenant has live already is skipped; a known path gets its next version, and the one before is superseded
    by it and keeps its row and chunks; any other is created. Of rows of one path the one of smallest hash counts, and of
    paths with one new text the first; the others are skipped. A null text is an empty one, a null path an error. Only
    partitions of changed paths are read whole and written; counters are taken in the writes.
    """
    spark = docs.sparkSession
    recover(spark, folder)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("tenant_id", "source_path", text.alias("text"), "labels", F.sha2(text, 256).alias("content_hash"), F.pmod(F.xxhash64("source_path"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    known = documents(spark, folder)
    live = known.where("superseded_by IS NULL").select("tenant_id", "content_hash", F.lit(True).alias("live"))
    # one row a path: an aggregate, so that many rows of one path are combined before the shuffle
    one = rows.groupBy("tenant_id", "bucket", "source_path").agg(F.min(F.struct("content_hash", "text", "labels")).alias("d"), F.count(F.lit(1)).alias("n")).select("tenant_id", "bucket", "source_path", "d.*", "n")
    held = one.join(live.distinct(), ["tenant_id", "content_hash"], "left")
    firsts = held.where("live IS NULL").groupBy("tenant_id", "content_hash").agg(F.min("source_path").alias("source_path"), F.lit(True).alias("new"))
    told = held.join(firsts, ["tenant_id", "content_hash", "source_path"], "left").withColumn("new", F.coalesce("new", F.lit(False))).drop("live")
    run = f"_run/{uuid.uuid4()}"
    counted = Observation()
    told.observe(counted, F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), _number("new").alias("new")).write.parquet(f"{folder}/{run}")
    told = spark.read.parquet(f"{folder}/{run}")
    counts = {"created": 0, "skipped": counted.get["rows"] - counted.get["new"], "superseded": 0, "chunks": 0}
    try:
        fresh = told.where("new").drop("new", "n")
        if counted.get["new"]:
            touched = fresh.select(*PARTS).distinct()
            before = known.join(F.broadcast(touched), PARTS, "left_semi")  # no more than the store's partitions
            last = before.groupBy(*PARTS, "source_path").agg(F.max("version").alias("last"))
            versioned = fresh.join(last, [*PARTS, "source_path"], "left").withColumn("version", (F.coalesce("last", F.lit(0)) + 1).cast("int"))
            versioned = versioned.withColumn("document_id", F.sha2(F.concat_ws("\n", F.col("tenant_id").cast("string"), "source_path", F.col("version").cast("string")), 256))
            seen = Observation()
            added = versioned.observe(seen, _number("version = 1").alias("created"), _number("version > 1").alias("superseded"))
            by = versioned.select("tenant_id", "source_path", F.col("document_id").alias("by"))
            old = before.join(by, ["tenant_id", "source_path"], "left")
            gone = F.col("superseded_by").isNull() & F.col("by").isNotNull()
            old = old.withColumn("superseded_at", F.when(gone, F.lit(at).cast("timestamp")).otherwise(F.col("superseded_at"))).withColumn("superseded_by", F.when(gone, F.col("by")).otherwise(F.col("superseded_by"))).drop("by")
            names = [c.split()[0] for c in DOCUMENT.split(", ")]
            added = added.withColumn("superseded_by", F.lit(None).cast("string")).withColumn("superseded_at", F.lit(None).cast("timestamp"))
            _change(spark, folder, {"document": old.select(*names).unionByName(added.select(*names))}, touched)
            counts |= {k: seen.get[k] for k in ("created", "superseded")}
        counts["chunks"] = _chunk_missing(spark, folder, told.select(*PARTS).distinct(), dimension)
    finally:
        _Files(spark, folder).delete(run)
    return counts


def _chunk_missing(spark: SparkSession, folder: str, touched: DataFrame, dimension: int) -> int:
    """Chunks of the live documents of some partitions that have none yet, also of a run that was killed before it made them."""
    here = documents(spark, folder).join(F.broadcast(touched), PARTS, "left_semi").where("superseded_by IS NULL AND trim(text) != ''")
    have = chunks(spark, folder).join(F.broadcast(touched), PARTS, "left_semi")
    missing = here.join(have.select("document_id").distinct(), "document_id", "left_anti")
    parts = missing.select(*PARTS).distinct()
    if parts.isEmpty():
        return 0
    made = chunked(missing.select("document_id", "text", *PARTS)).withColumn("embedding", embedded(F.col("content"), dimension))
    counted = Observation()
    names = [c.split()[0] for c in CHUNK.split(", ")]
    made = made.select(F.col("document_id"), F.col("ordinal").cast("int"), "heading", "content", F.col("embedding").cast("array<float>").alias("embedding"), *PARTS).observe(counted, F.count(F.lit(1)).alias("chunks"))
    _change(spark, folder, {"chunk": have.join(F.broadcast(parts), PARTS, "left_semi").select(*names).unionByName(made.select(*names))}, parts)
    return counted.get["chunks"]


def delete(ids: DataFrame, folder: str) -> None:
    """Documents of these ids (document_id) and their chunks go; only their partitions are written."""
    spark = ids.sparkSession
    recover(spark, folder)
    ids = ids.select("document_id").distinct()
    touched = documents(spark, folder).join(ids, "document_id", "left_semi").select(*PARTS).distinct()
    if touched.isEmpty():
        return
    left = {name: rows.join(F.broadcast(touched), PARTS, "left_semi").join(ids, "document_id", "left_anti") for name, rows in (("document", documents(spark, folder)), ("chunk", chunks(spark, folder)))}
    _change(spark, folder, left, touched)


def append(rows: DataFrame, folder: str, policy: Policy) -> None:
    """Rows into the store of a policy, by day; a key that is there already is not added again."""
    spark = rows.sparkSession
    recover(spark, folder)
    dated = rows.withColumn("day", F.to_date(policy.at))
    if _Files(spark, folder).exists(policy.store):
        days = dated.select("day").distinct()
        there = spark.read.parquet(f"{folder}/{policy.store}").join(F.broadcast(days), "day", "left_semi").select(policy.key)
        dated = dated.join(there, policy.key, "left_anti")
    dated.write.mode("append").partitionBy("day").parquet(f"{folder}/{policy.store}")


def retain(spark: SparkSession, folder: str, now: str, policies: tuple[Policy, ...] = POLICIES, at_once: int = AT_ONCE, dry_run: bool = False) -> dict[str, int]:
    """One pass of each policy: how many rows of its store went (or would). The oldest go first, `at_once` at most; only their days are written."""
    recover(spark, folder)
    out = {}
    for p in policies:
        if not _Files(spark, folder).exists(p.store):
            out[p.store] = 0
            continue
        rows = spark.read.parquet(f"{folder}/{p.store}")
        limit = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {p.days} DAYS")
        old = rows.where((F.col("day") <= F.to_date(limit)) & (F.col(p.at) < limit))
        if dry_run:
            out[p.store] = old.count()
            continue
        gone = old.orderBy(p.at, p.key).limit(at_once).select(p.key, "day")
        out[p.store] = gone.count()
        if out[p.store]:
            days = gone.select("day").distinct()
            left = rows.join(F.broadcast(days), "day", "left_semi").join(F.broadcast(gone.select(p.key)), p.key, "left_anti")
            _change(spark, folder, {p.store: left}, days)
    return out
