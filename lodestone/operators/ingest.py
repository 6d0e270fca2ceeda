"""Ingest into the versioned store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import DOCUMENT_SQL, document
from ..session import shared_dir
from ..sources import versioned

_AT = "2024-02-01 00:00:00"
_FIRST_SQL = "SELECT tenant_id, source_path, min(content_hash) AS content_hash FROM d WHERE doc_id % 2 = {} GROUP BY ALL"
_RUNS_SQL = f"""WITH {DOCUMENT_SQL}, d AS (SELECT doc_id, tenant_id, source_path, sha256(coalesce(text, '')) AS content_hash FROM document),
 one AS (SELECT tenant_id, content_hash, min(source_path) AS source_path FROM ({_FIRST_SQL.format(0)}) GROUP BY ALL),
 two AS (SELECT tenant_id, content_hash, min(source_path) AS source_path FROM ({_FIRST_SQL.format(1)}) f WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.tenant_id = f.tenant_id AND one.content_hash = f.content_hash) GROUP BY ALL)"""
_STORE_SQL = f"""{_RUNS_SQL}
 SELECT tenant_id, source_path, 1 AS version, content_hash, NOT EXISTS (SELECT 1 FROM two WHERE two.tenant_id = one.tenant_id AND two.source_path = one.source_path) AS live FROM one
 UNION ALL SELECT tenant_id, source_path, 1 + (SELECT count(*) FROM one WHERE two.tenant_id = one.tenant_id AND two.source_path = one.source_path), content_hash, true FROM two"""


def _stored(spark: SparkSession, sf_dir: str) -> tuple[str, list[dict[str, int]]]:
    """A store with the documents of even ids and then those of odd ids, and what each run counted."""
    folder = f"{shared_dir(spark)}/store-{uuid.uuid4()}"
    docs = document(spark, sf_dir)
    return folder, [versioned.ingest(docs.where(F.col("doc_id") % 2 == k), folder, _AT, 8) for k in (0, 1)]


@query("versioned_ingest", _STORE_SQL)
def versioned_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version in the store after two runs, the second of which supersedes paths of the first."""
    folder, _ = _stored(spark, sf_dir)
    return versioned.documents(spark, folder).select("tenant_id", "source_path", F.col("version").cast("long").alias("version"), "content_hash", F.isnull("superseded_by").alias("live"))


_COUNTERS_SQL = f"""{_RUNS_SQL}, known AS (SELECT count(*) AS n FROM two SEMI JOIN one ON two.tenant_id = one.tenant_id AND two.source_path = one.source_path),
 size AS (SELECT count(*) FILTER (WHERE doc_id % 2 = 0) AS even, count(*) FILTER (WHERE doc_id % 2 = 1) AS odd FROM d)
 SELECT 0 AS run, (SELECT count(*) FROM one) AS created, even - (SELECT count(*) FROM one) AS skipped, 0 AS superseded FROM size
 UNION ALL SELECT 1, (SELECT count(*) FROM two) - known.n, odd - (SELECT count(*) FROM two), known.n FROM size, known"""


@query("ingest_counters", _COUNTERS_SQL)
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What both runs counted in their writes: texts created, skipped and superseded."""
    _, counts = _stored(spark, sf_dir)
    return spark.createDataFrame([(k, c["created"], c["skipped"], c["superseded"]) for k, c in enumerate(counts)], "run int, created long, skipped long, superseded long")
