"""Relational queries over the curated views: projection, predicates, joins, aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.views import LINES_SQL, ORDERS_SQL, v_order_lines, v_orders
from ..session import table


@query("v_orders", f"WITH {ORDERS_SQL} SELECT * FROM v_orders")
def orders_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_orders(spark, sf_dir)


@query("v_order_lines", f"WITH {LINES_SQL} SELECT * FROM v_order_lines")
def lines_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_order_lines(spark, sf_dir)


@query("metric_revenue", f"WITH {ORDERS_SQL}, {LINES_SQL} SELECT customer_country, customer_segment, CAST(sum(line_cents) AS BIGINT) AS revenue_cents, count(DISTINCT o.order_id) AS n_orders FROM v_orders o JOIN v_order_lines l ON l.order_id = o.order_id GROUP BY ALL")
def metric_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancelled orders count unless they are filtered out. Only what the metric asks for is joined: lines are summed per order, orders per customer."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(cents).alias("cents"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    per = orders.groupBy("o_custkey").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"))
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = per.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy(F.col("n_name").alias("customer_country"), F.col("c_mktsegment").alias("customer_segment")).agg(F.sum("cents").alias("revenue_cents"), F.sum("n").alias("n_orders"))


@query("customer_revenue", f"WITH {ORDERS_SQL}, {LINES_SQL} SELECT customer_id, CAST(sum(line_cents) AS BIGINT) AS revenue_cents, count(DISTINCT o.order_id) AS n_orders FROM v_orders o JOIN v_order_lines l ON l.order_id = o.order_id GROUP BY customer_id")
def customer_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined with their lines, by customer; lines are summed before the join."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(F.sum("cents").alias("revenue_cents"), F.count(F.lit(1)).alias("n_orders"))


@query("metric_ship_days", f"WITH {ORDERS_SQL} SELECT order_status, round(avg(days_to_ship), 6) AS avg_days, count(days_to_ship) AS shipped, count(*) AS n_orders FROM v_orders GROUP BY order_status")
def metric_ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean leaves out orders that were not shipped. Customers are not asked for, so they are not joined."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped_at"))
    orders = table(spark, sf_dir, "orders").join(shipped, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    days = F.datediff(F.to_date("shipped_at"), F.to_date("o_orderdate"))
    return orders.groupBy(F.col("o_orderstatus").alias("order_status")).agg(F.round(F.avg(days), 6).alias("avg_days"), F.count(days).alias("shipped"), F.count(F.lit(1)).alias("n_orders"))


@query("metric_orders", f"WITH {ORDERS_SQL} SELECT date_trunc('month', ordered_at)::DATE AS month, count(*) AS n_orders FROM v_orders GROUP BY 1")
def metric_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.count(F.lit(1)).alias("n_orders"))


@query("project", "SELECT c_custkey AS id, upper(c_name) AS name, c_acctbal AS balance FROM customer")
def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


@query("predicates", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name LIKE 'Customer%' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F')")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    rows = table(spark, sf_dir, "customer").where(F.col("c_acctbal").between(100, 5000) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_name").like("Customer%"))
    return rows.join(open_orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("predicates_more", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%' AND (c_acctbal < 0) IS NOT TRUE AND c_name IS NOT NULL AND c_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_custkey >= (SELECT coalesce(max(s_suppkey), 0) FROM supplier WHERE s_nationkey = 3)")
def predicates_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ILIKE, IS TRUE, IS NULL, ANY as a semi-join, ALL as a comparison with the greatest value."""
    ours = table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey")
    greatest = table(spark, sf_dir, "supplier").where("s_nationkey = 3").agg(F.coalesce(F.max("s_suppkey"), F.lit(0)).alias("top"))
    rows = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").ilike("build%") & ~F.coalesce(F.col("c_acctbal") < 0, F.lit(False)) & F.col("c_name").isNotNull())
    return rows.join(ours, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").join(F.broadcast(greatest)).where("c_custkey >= top").select("c_custkey")  # one row


@query("conditional", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END AS size, nullif(o_orderstatus, 'O') AS closed, coalesce(nullif(o_orderstatus, 'O'), 'open') AS state FROM orders")
def conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = F.nullif("o_orderstatus", F.lit("O"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "large").when(F.col("o_totalprice") > 50000, "medium").otherwise("small").alias("size"), closed.alias("closed"), F.coalesce(closed, F.lit("open")).alias("state"))


@query("arithmetic", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_orderkey % 7 AS bucket, -l_linenumber AS negative, power(l_linenumber, 2) AS square FROM lineitem")
def arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"), (F.col("l_orderkey") % 7).alias("bucket"), (-F.col("l_linenumber")).alias("negative"), F.pow("l_linenumber", F.lit(2)).alias("square"))


@query("group_having", "SELECT o_custkey, count(*) AS n, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 5")
def group_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most")).where("n > 5")


@query("join_kinds", "SELECT 'anti' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'left', count(*) FROM customer LEFT JOIN orders ON o_custkey = c_custkey UNION ALL SELECT 'full', count(*) FROM customer FULL JOIN supplier ON c_custkey = s_suppkey UNION ALL SELECT 'right', count(*) FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders, supplier, nation = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier", "nation"))
    joins = {
        "anti": customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "left": customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left"),
        "full": customer.join(supplier, F.col("c_custkey") == F.col("s_suppkey"), "full"),
        "right": supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "right"),
    }
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in joins.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out


_WIN = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query("win_rank", f"SELECT o_orderkey, row_number() OVER ({_WIN}) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders")
def win_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_date, by_priority = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(by_date).cast("long").alias("rn"), F.rank().over(by_priority).cast("long").alias("rk"), F.dense_rank().over(by_priority).cast("long").alias("dr"))


@query("win_lag_lead", f"SELECT o_orderkey, lag(o_totalprice) OVER ({_WIN}) AS before, lead(o_totalprice) OVER ({_WIN}) AS after FROM orders")
def win_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice").over(w).alias("after"))


@query("win_frame", f"SELECT o_orderkey, count(*) OVER ({_WIN} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, max(o_totalprice) OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS most FROM orders")
def win_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("n"), F.max("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("most"))


@query("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20).select("o_orderkey", "o_totalprice")


@query("set_ops", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < 0)")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier, nation = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    both = customer.select(F.col("c_nationkey").alias("k")).intersect(supplier.select("s_nationkey"))
    rest = nation.select("n_nationkey").subtract(customer.where("c_acctbal < 0").select("c_nationkey"))
    return both.union(rest).distinct()


@query("str_funcs", "SELECT p_partkey, substring(p_name, 2, 5) AS part, length(p_name) AS n, lower(p_name) AS low, trim(p_name) AS trimmed, p_name || '#' || p_partkey AS joined FROM part")
def str_funcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.substring("p_name", 2, 5).alias("part"), F.length("p_name").cast("long").alias("n"), F.lower("p_name").alias("low"), F.trim("p_name").alias("trimmed"), F.concat("p_name", F.lit("#"), "p_partkey").alias("joined"))
