"""Governed documents and operational roll-ups: listing, dedup, versions, traces, quotas, rate limits, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import CHUNK_SQL, DOCUMENT_SQL, LIVE_SQL, SPAN_SQL, chunk, document, governed, live, span, visible
from ..session import table


@query("tenant_filter", f"WITH {DOCUMENT_SQL} SELECT doc_id, source_path FROM document WHERE tenant_id = 1 AND list_has_any(labels, ['finance', 'legal'])")
def tenant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governed(document(spark, sf_dir), 1, ["finance", "legal"]).select("doc_id", "source_path")


@query("label_filter", f"WITH {DOCUMENT_SQL} SELECT doc_id, coalesce(list_has_any(labels, ['public']), false) AS visible, false AS without_labels FROM document")
def label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a label is shared; no labels on either side, or unknown ones, deny."""
    shares = lambda labels: F.coalesce(F.arrays_overlap("labels", F.array(*map(F.lit, labels)).cast("array<string>")), F.lit(False))
    return document(spark, sf_dir).select("doc_id", shares(["public"]).alias("visible"), shares([]).alias("without_labels"))


@query("live_docs", f"WITH {DOCUMENT_SQL}, {LIVE_SQL} SELECT doc_id, source_path FROM live")
def live_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(document(spark, sf_dir)).select("doc_id", "source_path")


def tenant_view(rows: DataFrame, tenant: int | None) -> DataFrame:
    """What a session sees of a table with a tenant_id; one without a tenant sees nothing."""
    return rows.where("false") if tenant is None else rows.where(F.col("tenant_id") == tenant)


@query("chunk_doc_join", f"WITH {DOCUMENT_SQL}, {LIVE_SQL}, {CHUNK_SQL} SELECT c.chunk_id, d.doc_id, d.source_path FROM chunk c JOIN live d ON d.doc_id = c.doc_id WHERE c.tenant_id = 1 AND d.tenant_id = 1 AND list_has_any(d.labels, ['finance', 'public'])")
def chunk_doc_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their documents, the tenant asked of both sides; the join's sides are filtered first, and its kind is left to their sizes."""
    docs = visible(document(spark, sf_dir), 1, ["finance", "public"]).select("doc_id", "source_path")
    return tenant_view(chunk(spark, sf_dir), 1).join(docs, "doc_id").select("chunk_id", "doc_id", "source_path")


_CONNECTOR_SQL = "connector AS (SELECT s_suppkey AS connector_id, s_suppkey % 4 AS tenant_id, CASE s_suppkey % 3 WHEN 0 THEN ['finance', 'ops'] WHEN 1 THEN ['legal'] ELSE [] END AS required_labels FROM supplier)"


def connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.expr("CASE s_suppkey % 3 WHEN 0 THEN array('finance', 'ops') WHEN 1 THEN array('legal') ELSE array() END")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("connector_id"), (F.col("s_suppkey") % 4).alias("tenant_id"), labels.alias("required_labels"))


_RLS_SQL = {"document": "SELECT tenant_id FROM document", "chunk": "SELECT tenant_id FROM chunk", "span": "SELECT tenant_id FROM span", "connector": "SELECT tenant_id FROM connector", "message": "SELECT conv_id % 4 AS tenant_id FROM conversations"}


def governed_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every relation that has a tenant, by name."""
    message = table(spark, sf_dir, "conversations").withColumn("tenant_id", F.col("conv_id") % 4)
    return {"document": document(spark, sf_dir), "chunk": chunk(spark, sf_dir), "span": span(spark, sf_dir), "connector": connector(spark, sf_dir), "message": message}


@query("rls_scope", f"WITH {DOCUMENT_SQL}, {SPAN_SQL}, {CHUNK_SQL}, {_CONNECTOR_SQL}, a AS ({' UNION ALL '.join(f'SELECT {n!r} AS relation, tenant_id FROM ({q})' for n, q in _RLS_SQL.items())}) SELECT relation, count(*) FILTER (WHERE tenant_id = 2) AS seen, CAST(0 AS BIGINT) AS without_session FROM a GROUP BY relation")
def rls_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each governed relation that one tenant sees, and how many a session without a tenant sees."""
    counts = []
    for name, rows in governed_tables(spark, sf_dir).items():
        both = tenant_view(rows.select("tenant_id"), 2).select(F.lit(1).alias("s"), F.lit(0).alias("w")).unionAll(tenant_view(rows.select("tenant_id"), None).select(F.lit(0), F.lit(1)))
        counts.append(both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("seen"), F.coalesce(F.sum("w"), F.lit(0)).alias("without_session")).select(F.lit(name).alias("relation"), "seen", "without_session"))
    return reduce(DataFrame.unionAll, counts)


@query("known_labels", f"WITH {DOCUMENT_SQL}, {_CONNECTOR_SQL} SELECT tenant_id, unnest(labels) AS label FROM document UNION SELECT tenant_id, unnest(required_labels) FROM connector")
def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in use: those that documents bear and those that connectors ask for."""
    borne = document(spark, sf_dir).select("tenant_id", F.explode("labels").alias("label"))
    return borne.union(connector(spark, sf_dir).select("tenant_id", F.explode("required_labels"))).distinct()


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("exact_dedup", f"WITH {DOCUMENT_SQL} SELECT tenant_id, sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) - 1 AS skipped FROM document GROUP BY ALL")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first document of each text; an aggregate, so that many copies are combined before the shuffle
    return document(spark, sf_dir).groupBy("tenant_id", F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), (F.count(F.lit(1)) - 1).alias("skipped"))


@query("doc_versions", f"WITH {DOCUMENT_SQL} SELECT doc_id, row_number() OVER w AS version, lead(doc_id) OVER w AS superseded_by FROM document WINDOW w AS (PARTITION BY tenant_id, source_path ORDER BY doc_id)")
def doc_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("tenant_id", "source_path").orderBy("doc_id")
    return document(spark, sf_dir).select("doc_id", F.row_number().over(w).cast("long").alias("version"), F.lead("doc_id").over(w).alias("superseded_by"))


_LISTED_SQL = f"WITH {DOCUMENT_SQL}, {LIVE_SQL}, {CHUNK_SQL}, c AS (SELECT doc_id, count(*) AS n FROM chunk GROUP BY doc_id) SELECT d.doc_id, source_path, coalesce(n, 0) AS chunks FROM {{}} d LEFT JOIN c ON c.doc_id = d.doc_id WHERE tenant_id = 0 AND list_has_any(labels, ['public']) ORDER BY d.doc_id DESC"


def listed(spark: SparkSession, sf_dir: str, superseded: bool = False) -> DataFrame:
    """What a tenant may see, newest first, with the number of chunks; older versions only if asked for."""
    docs = document(spark, sf_dir).select("tenant_id", "doc_id", "source_path", "labels")
    rows = (governed if superseded else visible)(docs, 0, ["public"]).select("doc_id", "source_path")
    counts = chunk(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(counts, "doc_id", "left").select("doc_id", "source_path", F.coalesce("n", F.lit(0)).alias("chunks")).orderBy(F.desc("doc_id"))


@query("list_documents", _LISTED_SQL.format("live"))
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir)


@query("list_documents_all", _LISTED_SQL.format("document"))
def list_documents_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir, superseded=True)


@query("delete_visible", f"WITH {DOCUMENT_SQL} SELECT doc_id, CASE WHEN tenant_id = 1 AND list_has_any(labels, ['finance']) THEN 'deleted' ELSE 'not found' END AS outcome FROM document")
def delete_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request to delete each document gets: what the caller can't see isn't there."""
    seen = (F.col("tenant_id") == 1) & F.arrays_overlap("labels", F.array(F.lit("finance")))
    return document(spark, sf_dir).select("doc_id", F.when(seen, "deleted").otherwise("not found").alias("outcome"))


@query("trace_rollup", f"WITH {SPAN_SQL} SELECT trace_id, min(ts) AS started_at, round(sum(duration_ms), 2) AS duration_ms, bool_or(status = 'error') AS failed, count(*) AS spans FROM span GROUP BY trace_id")
def trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span(spark, sf_dir).groupBy("trace_id").agg(F.min("ts").alias("started_at"), F.round(F.sum("duration_ms"), 2).alias("duration_ms"), F.bool_or(F.col("status") == "error").alias("failed"), F.count(F.lit(1)).alias("spans"))


@query("recent_traces", f"WITH {SPAN_SQL}, r AS (SELECT trace_id, max(ts) AS latest FROM span GROUP BY trace_id ORDER BY latest DESC, trace_id LIMIT 20) SELECT s.trace_id, s.event_id, s.name FROM span s JOIN r ON r.trace_id = s.trace_id")
def recent_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = span(spark, sf_dir)
    latest = spans.groupBy("trace_id").agg(F.max("ts").alias("at")).orderBy(F.desc("at"), "trace_id").limit(20)
    return spans.join(F.broadcast(latest), "trace_id").select("trace_id", "event_id", "name")


@query("trace_spans", f"WITH {SPAN_SQL} SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY ts, event_id) AS place, event_id, name, status FROM span")
def trace_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of each trace in order, as rows: a trace of any length is sorted with spilling, and none is gathered into one value."""
    place = F.row_number().over(Window.partitionBy("trace_id").orderBy("ts", "event_id")).cast("long")
    return span(spark, sf_dir).select("trace_id", place.alias("place"), "event_id", "name", "status")


def audit(spark: SparkSession, sf_dir: str, tenant: int, denied_only: bool, page: int = 200) -> DataFrame:
    """The latest entries of a tenant, at most `page`; only denied ones if asked for."""
    rows = tenant_view(span(spark, sf_dir), tenant)
    rows = rows.where("status = 'error'") if denied_only else rows
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(min(page, 200)).select("event_id", "name", "status", "ts")


@query("audit_denied", f"WITH {SPAN_SQL} SELECT event_id, name, status, ts FROM span WHERE tenant_id = 1 AND status = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, sf_dir, 1, denied_only=True)


@query("audit_page", f"WITH {SPAN_SQL} SELECT event_id, name, status, ts FROM span WHERE tenant_id = 1 ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, sf_dir, 1, denied_only=False, page=1000)


@query("denied_calls", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE denied AND NOT unknown) AS denied, count(*) FILTER (WHERE unknown) AS unknown FROM (SELECT user_id, ts, event_type IN ('error', 'signup') AS denied, event_id % 7 = 0 AS unknown FROM events) GROUP BY ALL")
def denied_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run: calls of known tools that were refused, and calls of tools that don't exist."""
    denied, unknown = F.col("event_type").isin("error", "signup"), F.col("event_id") % 7 == 0
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(denied & ~unknown).alias("denied"), F.count_if(unknown).alias("unknown"))


@query("quota_check", "SELECT event_id, spent, greatest(0, 400000 - spent) AS remaining, spent < 400000 AS allowed, resets_at FROM (SELECT event_id, CAST(coalesce(sum(CAST(round(value * 1000) AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent, CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) AS resets_at FROM events)")
def quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call against what its caller spent before it that day (UTC), and when the day ends: checked before, recorded after.

    A spent budget stays spent until midnight, so refused calls, which record nothing, may be summed too.
    """
    day = F.to_date("ts")
    before = Window.partitionBy("user_id", day).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.round(F.col("value") * 1000).cast("long")).over(before), F.lit(0).cast("long"))
    rows = table(spark, sf_dir, "events").select("event_id", spent.alias("spent"), F.date_add(day, 1).cast("timestamp_ntz").alias("resets_at"))
    return rows.select("event_id", "spent", F.greatest(F.lit(0).cast("long"), 400000 - F.col("spent")).alias("remaining"), (F.col("spent") < 400000).alias("allowed"), "resets_at")


@query("quota_daily", "WITH d AS (SELECT user_id % 4 AS tenant_id, CAST(ts AS DATE) AS day, sum(CAST(round(value * 1000) AS BIGINT)) AS micros FROM events GROUP BY ALL) SELECT tenant_id, day, CAST(micros AS BIGINT) AS micros, CAST(greatest(0, 5000000 - micros) AS BIGINT) AS remaining, micros >= 5000000 AS exhausted FROM d")
def quota_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("tenant_id"), F.to_date("ts").alias("day")).agg(F.sum(F.round(F.col("value") * 1000).cast("long")).alias("micros"))
    return spent.select("tenant_id", "day", "micros", F.greatest(F.lit(0).cast("long"), 5000000 - F.col("micros")).alias("remaining"), (F.col("micros") >= 5000000).alias("exhausted"))


@query("rate_limit", "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS started_at, count(*) AS calls, count(*) > 3 AS limited FROM s GROUP BY user_id, k")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter is kept until a caller has been silent for the window, so windows are sessions."""
    found = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "3600 seconds").alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return found.select("user_id", F.col("w.start").alias("started_at"), "calls", (F.col("calls") > 3).alias("limited"))


@query("rate_tumbling", "SELECT user_id, date_trunc('hour', ts) AS started_at, count(*) AS calls FROM events GROUP BY ALL")
def rate_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("calls")).select("user_id", F.col("w.start").alias("started_at"), "calls")


@query("retention_dry_run", "SELECT p.policy, count(*) FILTER (WHERE e.ts < TIMESTAMP '2024-01-31' - to_days(CAST(p.days AS INTEGER))) AS to_delete FROM (VALUES ('short', 7), ('medium', 14), ('long', 28)) p(policy, days), events e GROUP BY p.policy")
def retention_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = {"short": 7, "medium": 14, "long": 28}
    counts = table(spark, sf_dir, "events").agg(*[F.count_if(F.col("ts") < F.expr(f"TIMESTAMP '2024-01-31' - INTERVAL {d} DAYS")).alias(p) for p, d in policies.items()])
    return counts.select(F.explode(F.create_map(*[c for p in policies for c in (F.lit(p), F.col(p))])).alias("policy", "to_delete"))


#: What a million tokens of messages cost, in dollars.
_USD = 0.4
_TENANT_SQL = "tenant AS (SELECT r_regionkey AS tenant_id, lower(replace(r_name, ' ', '-')) AS slug FROM region)"


@query("tenant_cost", f"WITH {_TENANT_SQL}, m AS (SELECT conv_id % 7 AS tenant_id, sum(greatest(1, coalesce(length(text), 0) // 4)) AS tokens FROM conversations GROUP BY 1) SELECT slug, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, round(coalesce(tokens, 0) * {_USD} / 1000000, 4) AS usd FROM tenant LEFT JOIN m ON m.tenant_id = tenant.tenant_id")
def tenant_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and cost of each tenant's messages, summed before they are joined; a tenant without any has none, messages of no tenant count for nobody."""
    tenant = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("tenant_id"), F.lower(F.replace("r_name", F.lit(" "), F.lit("-"))).alias("slug"))
    spent = table(spark, sf_dir, "conversations").groupBy((F.col("conv_id") % 7).alias("tenant_id")).agg(F.sum(F.greatest(F.lit(1), F.expr("coalesce(length(text), 0) div 4"))).alias("tokens"))
    tokens = F.coalesce("tokens", F.lit(0))
    return tenant.join(spent, "tenant_id", "left").select("slug", tokens.alias("tokens"), F.round(tokens * _USD / 1000000, 4).alias("usd"))


@query("orphan_checkpoints", "SELECT DISTINCT conv_id FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.turn >= 3)")
def orphan_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id").distinct().join(turns.where("turn >= 3").select("conv_id"), "conv_id", "left_anti")
