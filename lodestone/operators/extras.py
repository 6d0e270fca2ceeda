"""Further relational forms: lateral joins, recursion, other aggregates and windows, rollups, dates, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import table


@query("join_lateral", "SELECT n_nationkey, c_custkey FROM nation, LATERAL (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer WHERE c_nationkey = n_nationkey) WHERE r <= 3")
def join_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three richest customers of each nation; a window with a limit of ranks, so that only three a task and nation travel."""
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    top = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_custkey").withColumn("r", F.row_number().over(w)).where("r <= 3")
    return table(spark, sf_dir, "nation").join(top, F.col("c_nationkey") == F.col("n_nationkey")).select("n_nationkey", "c_custkey")


@query("cte", "WITH big AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY o_custkey), mean AS (SELECT avg(cents) AS m FROM big) SELECT o_custkey, CAST(cents AS BIGINT) AS cents FROM big, mean WHERE cents > 2 * m")
def cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return big.join(F.broadcast(big.agg(F.avg("cents").alias("m")))).where("cents > 2 * m").select("o_custkey", "cents")  # the mean is one row


@query("cte_recursive", "WITH RECURSIVE r(key, depth) AS (SELECT n_nationkey, 0 FROM nation UNION ALL SELECT key // 2, depth + 1 FROM r WHERE key > 0) SELECT key, depth, count(*) AS n FROM r GROUP BY key, depth")
def cte_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ancestors of keys in a binary tree, by recursion until the root."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("lodestone_nation")
    return spark.sql("WITH RECURSIVE r(key, depth) AS (SELECT CAST(n_nationkey AS BIGINT), 0 FROM lodestone_nation UNION ALL SELECT key DIV 2, depth + 1 FROM r WHERE key > 0) SELECT key, depth, count(*) AS n FROM r GROUP BY key, depth")


@query("agg_extra", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, round(stddev_samp(l_quantity), 6) AS spread, round(quantile_cont(l_quantity, 0.5), 6) AS middle, bool_and(l_discount >= 0) AS fine FROM lineitem GROUP BY l_returnflag")
def agg_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.round(F.stddev_samp("l_quantity"), 6).alias("spread"), F.round(F.percentile("l_quantity", 0.5), 6).alias("middle"), F.bool_and(F.col("l_discount") >= 0).alias("fine"))


@query("rollup_ext", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


_WIN = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


@query("win_extra", f"SELECT o_orderkey, ntile(3) OVER ({_WIN}) AS third, first_value(o_orderkey) OVER ({_WIN}) AS first_order, round(percent_rank() OVER ({_WIN}), 6) AS share FROM orders")
def win_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.ntile(3).over(w).cast("long").alias("third"), F.first("o_orderkey").over(w).alias("first_order"), F.round(F.percent_rank().over(w), 6).alias("share"))


@query("month_window", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-03-01' - INTERVAL 1 MONTH AND o_orderdate < DATE '1996-03-01'")
def month_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The month before a fixed day; literals are folded, so both bounds reach the scan."""
    return table(spark, sf_dir, "orders").where("o_orderdate >= add_months(DATE '1996-03-01', -1) AND o_orderdate < DATE '1996-03-01'").select("o_orderkey")


@query("backoff", "SELECT l_orderkey, l_linenumber, least(0.5 * power(2, l_linenumber - 1), 8.0) AS seconds FROM lineitem")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.least(0.5 * F.pow(F.lit(2), F.col("l_linenumber") - 1), F.lit(8.0)).alias("seconds"))


@query("vec_norm", "SELECT vec_id, round(embedding[1]::DOUBLE / n, 6) AS first, round(embedding[-1]::DOUBLE / n, 6) AS last, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / n)), 5) AS total FROM (SELECT vec_id, embedding, CASE sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) WHEN 0 THEN 1 ELSE sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) END AS n FROM embeddings)")
def vec_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled to length 1 (a zero vector stays); their ends and sum are shown."""
    total = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scaled = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(total == 0, 1.0).otherwise(total).alias("n"))
    units = scaled.select("vec_id", F.transform("embedding", lambda x: x.cast("double") / F.col("n")).alias("unit"))
    return units.select("vec_id", F.round(F.element_at("unit", 1), 6).alias("first"), F.round(F.element_at("unit", -1), 6).alias("last"), F.round(F.aggregate("unit", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))
