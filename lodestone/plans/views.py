"""Governed views that the queries share, derived from the loaded tables by fixed rules, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

ACL = "CASE doc_id % 5 WHEN 0 THEN array('public') WHEN 1 THEN array('public', 'finance') WHEN 2 THEN array('finance') WHEN 3 THEN array('hr', 'legal') ELSE array() END"

#: The same views for the oracle, put before its SELECT.
DOCUMENT_SQL = """document AS (
  SELECT doc_id, doc_id % 4 AS tenant_id, source || '/' || (doc_id % 50) AS source_path, text, lang,
    CASE doc_id % 5 WHEN 0 THEN ['public'] WHEN 1 THEN ['public', 'finance'] WHEN 2 THEN ['finance'] WHEN 3 THEN ['hr', 'legal'] ELSE [] END AS labels
  FROM documents)"""
#: Those that no later version of their path replaces, and the chunks of each document.
LIVE_SQL = """live AS (SELECT * FROM document SEMI JOIN (SELECT tenant_id, source_path, max(doc_id) AS doc_id FROM document GROUP BY ALL) l ON l.doc_id = document.doc_id AND l.tenant_id = document.tenant_id)"""
CHUNK_SQL = """chunk AS (SELECT chunk_id, doc_id, doc_id % 4 AS tenant_id, embedding FROM (SELECT vec_id AS chunk_id, n - 1 - vec_id % n AS doc_id, embedding FROM embeddings, (SELECT count(*) AS n FROM documents)))"""
ORDERS_SQL = """v_orders AS (
  SELECT o.o_orderkey AS order_id, o.o_orderstatus AS order_status, CAST(o.o_orderdate AS DATE) AS ordered_at, c.c_custkey AS customer_id, c.c_name AS customer_name,
    n.n_name AS customer_country, c.c_mktsegment AS customer_segment, date_diff('day', CAST(o.o_orderdate AS DATE), CAST(s.shipped_at AS DATE)) AS days_to_ship
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped_at FROM lineitem GROUP BY l_orderkey) s ON s.l_orderkey = o.o_orderkey)"""
LINES_SQL = """v_order_lines AS (
  SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, o.o_orderstatus AS order_status, p.p_partkey AS product_id, p.p_name AS product_name, l.l_quantity AS quantity,
    CAST(round(l.l_extendedprice * 100) AS BIGINT) AS line_cents
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey)"""
SPAN_SQL = """span AS (
  SELECT event_id, user_id % 4 AS tenant_id, user_id || '-' || strftime(ts, '%Y%m%d') AS trace_id, event_type AS name, value AS duration_ms,
    CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, ts
  FROM events)"""


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("tenant_id"), F.concat("source", F.lit("/"), F.col("doc_id") % 50).alias("source_path"), "text", "lang", F.expr(ACL).alias("labels"))


def governed(docs: DataFrame, tenant: int, labels: list[str]) -> DataFrame:
    """The rows of one tenant with a label in common; no labels on either side give none."""
    return docs.where((F.col("tenant_id") == tenant) & F.arrays_overlap("labels", F.array(*map(F.lit, labels)))) if labels else docs.where("false")


def live(docs: DataFrame) -> DataFrame:
    """The newest version of each path of a tenant; texts stay out of the aggregate."""
    newest = docs.groupBy("tenant_id", "source_path").agg(F.max("doc_id").alias("doc_id")).select("tenant_id", "doc_id")
    return docs.join(newest, ["tenant_id", "doc_id"], "left_semi").select(*docs.columns)


def visible(docs: DataFrame, tenant: int, labels: list[str]) -> DataFrame:
    """Governed rows that no later version of their path replaces, also where the caller may not see that version."""
    mine = governed(docs, tenant, labels)
    newest = live(docs.where(F.col("tenant_id") == tenant).select("tenant_id", "source_path", "doc_id"))
    return mine.join(newest.select("tenant_id", "doc_id"), ["tenant_id", "doc_id"], "left_semi").select(*docs.columns)


def chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, doc_id, tenant_id, embedding: vectors dealt over the documents, newest first."""
    total = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("total"))
    vectors = table(spark, sf_dir, "embeddings").join(F.broadcast(total))  # one row
    doc_id = F.col("total") - 1 - F.col("vec_id") % F.col("total")
    return vectors.select(F.col("vec_id").alias("chunk_id"), doc_id.alias("doc_id"), (doc_id % 4).alias("tenant_id"), "embedding")


def v_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped_at"))
    joined = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey")).join(shipped, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    ordered = F.to_date("o_orderdate")
    return joined.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("order_status"), ordered.alias("ordered_at"), F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        F.col("n_name").alias("customer_country"), F.col("c_mktsegment").alias("customer_segment"), F.datediff(F.to_date("shipped_at"), ordered).cast("long").alias("days_to_ship"),
    )


def v_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(part, F.col("p_partkey") == F.col("l_partkey"))
    return joined.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), F.col("o_orderstatus").alias("order_status"), F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("l_quantity").alias("quantity"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("line_cents"))


def span(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", (F.col("user_id") % 4).alias("tenant_id"), F.concat(F.col("user_id"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("trace_id"), F.col("event_type").alias("name"), F.col("value").alias("duration_ms"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"), "ts")
