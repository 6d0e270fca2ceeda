"""Streaming forms of the rate limit, the daily quota and the ingest; the same functions take batches.

Late rows are an extension: a watermark says how long state waits for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def call_windows(calls: DataFrame, window: str = "60 seconds", limit: int = 30, late: str = "10 minutes") -> DataFrame:
    """calls (caller, ts) as caller, started_at, calls, limited: a window lasts until the caller is silent for its length."""
    counted = calls.withWatermark("ts", late).groupBy("caller", F.session_window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return counted.select("caller", F.col("w.start").alias("started_at"), "calls", (F.col("calls") > limit).alias("limited"))


def daily_spend(costs: DataFrame, budget_micros: int = 5_000_000, late: str = "1 hour") -> DataFrame:
    """costs (tenant, ts, micros) as tenant, day, spent, exhausted; days are UTC's."""
    spent = costs.withWatermark("ts", late).groupBy("tenant", F.window("ts", "1 day").alias("w")).agg(F.sum("micros").alias("spent"))
    return spent.select("tenant", F.to_date("w.start").alias("day"), "spent", (F.col("spent") >= budget_micros).alias("exhausted"))


def ingest(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append documents (tenant, source_path, text) to the sink, each text of a tenant once, and end with what is there now.

    A batch that is run again after a loss finds its hashes in the sink and adds nothing. The sink is
    partitioned by the first two digits of the hash, and only the partitions of the batch are read.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        # a null text has a hash of its own, so that it is found again
        hashed = batch.withColumn("hash", F.coalesce(F.sha2("text", 256), F.lit("null"))).withColumn("part", F.substring("hash", 1, 2))
        new = hashed.groupBy("tenant", "hash", "part").agg(F.min_by(F.struct("source_path", "text"), "source_path").alias("d")).select("tenant", "hash", "d.source_path", "d.text", "part")
        if _exists(spark, sink):
            parts = [r["part"] for r in hashed.select("part").distinct().collect()]  # 257 at most
            known = spark.read.schema(new.schema).parquet(sink).where(F.col("part").isin(*parts))
            new = new.join(known.select("tenant", "hash"), ["tenant", "hash"], "left_anti")
        new.write.mode("append").partitionBy("part").parquet(sink)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)
