"""Guards and their state: approvals, idempotent effects, run ceilings, breakers, addresses, retention."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.breaker import FAILURES, RECOVERY, step
from ..plans.registry import query
from ..plans.views import chunk
from ..session import table
from ..sources.versioned import POLICIES

_RUN = "PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id"


@query("idempotent", "SELECT user_id % 4 AS tenant_id, props AS key, min(event_id) AS event_id, count(*) - 1 AS replays FROM events GROUP BY ALL")
def idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One effect for each tenant and key: the first one."""
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).alias("tenant_id"), F.col("props").alias("key")).agg(F.min("event_id").alias("event_id"), (F.count(F.lit(1)) - 1).alias("replays"))


@query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").where(k == "7").select("event_id", k.cast("long").alias("k"))


#: Ceilings of one run, in the order in which they are checked.
STEPS, CALLS, SECONDS, MICROS = 8, 12, 120, 500_000


@query("run_halts", f"WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, ts, count(*) OVER w AS steps, count(*) FILTER (WHERE event_type = 'click') OVER w AS calls, epoch_us(ts) - min(epoch_us(ts)) OVER w AS us, sum(CAST(round(value * 1000) AS BIGINT)) OVER w AS micros FROM events WINDOW w AS ({_RUN})), h AS (SELECT *, CASE WHEN steps >= {STEPS} THEN 'steps' WHEN calls >= {CALLS} THEN 'tool_calls' WHEN us >= {SECONDS}000000 THEN 'time' WHEN micros >= {MICROS} THEN 'cost' END AS halt FROM r) SELECT user_id, day, min(steps) AS at_step, arg_min(halt, steps) AS halt FROM h WHERE halt IS NOT NULL GROUP BY user_id, day")
def run_halts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each run (a user's day) reaches its first ceiling, and which."""
    day = F.to_date("ts").alias("day")
    w = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    run = table(spark, sf_dir, "events").select("user_id", day, "event_id", "ts", "event_type", "value").select(
        "user_id", "day", F.count(F.lit(1)).over(w).alias("steps"), F.count_if(F.col("event_type") == "click").over(w).alias("calls"), (us - F.min(us).over(w)).alias("us"), F.sum(F.round(F.col("value") * 1000).cast("long")).over(w).alias("micros")
    )
    halt = F.when(F.col("steps") >= STEPS, "steps").when(F.col("calls") >= CALLS, "tool_calls").when(F.col("us") >= SECONDS * 1_000_000, "time").when(F.col("micros") >= MICROS, "cost")
    return run.withColumn("halt", halt).where("halt IS NOT NULL").groupBy("user_id", "day").agg(F.min("steps").alias("at_step"), F.min_by("halt", "steps").alias("halt"))


@query("approvals_actionable", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) + 1 AS expires_on FROM orders WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) + 1 > DATE '1997-01-01'")
def approvals_actionable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open proposals that have not expired on a fixed day; they live for a day."""
    expires = F.date_add(F.to_date("o_orderdate"), 1)
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "O") & (expires > F.lit("1997-01-01").cast("date"))).select(F.col("o_orderkey").alias("id"), expires.alias("expires_on"))


#: IPv4 networks that connectors may not reach; the last three may be opened by a setting.
BLOCKED = ("169.254.0.0/16", "127.0.0.0/8", "0.0.0.0/8", "100.64.0.0/10", "224.0.0.0/4", "240.0.0.0/4")
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")


def _bounds(network: str) -> tuple[int, int]:
    address, bits = network.split("/")
    low = sum(int(part) << shift for part, shift in zip(address.split("."), (24, 16, 8, 0), strict=True))
    return low, low + (1 << 32 - int(bits)) - 1


def _reach_sql(address: str) -> str:
    inside = lambda networks: " OR ".join("{} BETWEEN {} AND {}".format(address, *_bounds(n)) for n in networks)
    return f"CASE WHEN {inside(BLOCKED)} THEN 'blocked' WHEN {inside(PRIVATE)} THEN 'private' ELSE 'open' END"


@query("egress_cidr", f"SELECT event_id, {_reach_sql('a')} AS reach FROM (SELECT event_id, event_id * 2654435761 % 4294967296 AS a FROM events)")
def egress_cidr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses (derived from ids) by what may reach them; nine fixed ranges are compared in place, without a join."""
    addresses = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * F.lit(2654435761) % F.lit(4294967296)).alias("a"))
    return addresses.select("event_id", F.expr(_reach_sql("a")).alias("reach"))


#: The first 16 bits and their mask of the IPv6 networks that are blocked and private; the loopback address is blocked too.
V6_BLOCKED, V6_PRIVATE = (0xFE80, 0xFFC0), (0xFC00, 0xFE00)


def reach_v6(address: F.Column) -> F.Column:
    """Reach of a full IPv6 address (eight groups of hexadecimal digits)."""
    first = F.conv(F.substring_index(address, ":", 1), 16, 10).cast("int")
    inside = lambda network: first.bitwiseAND(network[1]) == network[0]
    loop = F.rlike(address, F.lit("^0+(:0+){6}:0*1$"))
    return F.when(loop | inside(V6_BLOCKED), "blocked").when(inside(V6_PRIVATE), "private").otherwise("open")


@query("egress_v6", f"SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'blocked' WHEN (event_id * 40503 % 65536) & {V6_BLOCKED[1]} = {V6_BLOCKED[0]} THEN 'blocked' WHEN (event_id * 40503 % 65536) & {V6_PRIVATE[1]} = {V6_PRIVATE[0]} THEN 'private' ELSE 'open' END AS reach FROM events")
def egress_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.lower(F.lpad(F.hex(F.col("event_id") * 40503 % 65536), 4, "0"))
    address = F.when(F.col("event_id") % 11 == 0, "0000:0000:0000:0000:0000:0000:0000:0001").otherwise(F.concat(group, F.lit(":0000:0000:0000:0000:0000:0000:0007")))
    return table(spark, sf_dir, "events").select("event_id", reach_v6(address).alias("reach"))


@query("retention_apply", "SELECT event_id, ts FROM events WHERE NOT (ts < TIMESTAMP '2024-01-31' - INTERVAL 14 DAY) OR event_type = 'purchase'")
def retention_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that survive a policy of 14 days, purchases exempt; a second run removes nothing."""
    return table(spark, sf_dir, "events").where("ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAYS OR event_type = 'purchase'").select("event_id", "ts")


#: Fixed value: rows that one pass of a policy deletes at most.
DELETED_AT_ONCE = 10_000


@query("retention_capped", f"SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 14 DAY ORDER BY ts, event_id LIMIT {DELETED_AT_ONCE})")
def retention_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one pass leaves: the oldest of the rows that are too old go, a bounded number at once, and are broadcast as such."""
    events = table(spark, sf_dir, "events")
    gone = events.where("ts < TIMESTAMP '2024-01-31' - INTERVAL 14 DAYS").orderBy("ts", "event_id").limit(DELETED_AT_ONCE).select("event_id")
    return events.select("event_id").join(F.broadcast(gone), "event_id", "left_anti")


#: The day on which policies are run, and the records that each table stands for: expression of the time, condition.
_TODAY = "TIMESTAMP '2024-02-15'"
_DATED = {
    "trace_span": ("events", "ts", "true"),
    "agent_run": ("events", "ts", "event_type = 'click'"),
    "connector_audit": ("events", "ts - INTERVAL 350 DAY", "true"),
    "conversation_message": ("conversations", "TIMESTAMP '2024-02-01' - conv_id % 120 * INTERVAL 1 DAY", "true"),
    "conversation": ("conversations", "TIMESTAMP '2024-02-01' - conv_id % 120 * INTERVAL 1 DAY", "turn = 0"),
    "ingest_job": ("orders", "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 312 MONTH", "true"),
    "approval_request": ("orders", "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 312 MONTH", "o_orderstatus = 'O'"),
}


def _policy_sql(name: str, days: int) -> str:
    source, at, condition = _DATED[name]
    return f"SELECT '{name}' AS policy, count(*) FILTER (WHERE {at} >= {_TODAY} - INTERVAL {days} DAY) AS kept, count(*) FILTER (WHERE {at} < {_TODAY} - INTERVAL {days} DAY) AS to_delete FROM {source} WHERE {condition}"


@query("retention_run", " UNION ALL ".join(_policy_sql(p.store, p.days) for p in POLICIES))
def retention_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the seven policies keeps and deletes of its own records; each table is read once for all its policies."""
    counts = []
    for source in dict.fromkeys(t for t, _, _ in _DATED.values()):
        own = [(p.store, p.days, *_DATED[p.store][1:]) for p in POLICIES if _DATED[p.store][0] == source]
        limit = lambda days: f"{_TODAY} - INTERVAL {days} DAY"
        cells = [F.struct(F.lit(n).alias("policy"), F.count_if(F.expr(f"{c} AND {at} >= {limit(d)}")).alias("kept"), F.count_if(F.expr(f"{c} AND {at} < {limit(d)}")).alias("to_delete")) for n, d, at, c in own]
        counts.append(table(spark, sf_dir, source).agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*"))
    return reduce(DataFrame.unionAll, counts)


@query("delete_cascade", "SELECT 'chunk' AS relation, vec_id AS id FROM embeddings, (SELECT count(*) AS n FROM documents) WHERE n - 1 - vec_id % n NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') UNION ALL SELECT 'document', doc_id FROM documents WHERE lang <> 'fr'")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and chunks that stay when the documents of one language are deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    chunks = chunk(spark, sf_dir).select("chunk_id", "doc_id").join(docs.where("lang = 'fr'").select("doc_id"), "doc_id", "left_anti")
    return chunks.select(F.lit("chunk").alias("relation"), F.col("chunk_id").alias("id")).unionAll(docs.where("lang <> 'fr'").select(F.lit("document"), "doc_id"))


def breaker_states(calls: DataFrame, failures: int = FAILURES, recovery: float = RECOVERY) -> DataFrame:
    """calls (key, at seconds, id, ok) with the state that each meets (closed, open or half_open), whether it is refused, and the state after it.

    Keys are streamed in order of time, so a task holds one key's counters and never its rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, failed, opened = None, 0, None
        for rows in batches:
            met, states = [], []
            for k, at, ok in zip(rows["key"], rows["at"], rows["ok"], strict=True):
                if k != key:
                    key, failed, opened = k, 0, None
                m, failed, opened = step(failed, opened, at, ok, failures, recovery)
                met.append(m)
                states.append("closed" if opened is None else "open")
            yield rows[["key", "id"]].assign(met=met, refused=[m == "open" for m in met], state=states)

    ordered = calls.repartition("key").sortWithinPartitions("key", "at", "id")
    return ordered.mapInPandas(run, "key long, id long, met string, refused boolean, state string")


_BREAKER_SQL = f"""WITH RECURSIVE c AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS t, event_id AS id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
 m(key, r, id, met, failed, opened) AS (SELECT key, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', 0, CAST(NULL AS DOUBLE) FROM (SELECT DISTINCT key FROM c) UNION ALL
  SELECT key, r, id, met, CASE WHEN met = 'open' THEN failed WHEN ok THEN 0 WHEN trips THEN {FAILURES} ELSE failed + 1 END, CASE WHEN met = 'open' THEN opened WHEN ok THEN NULL WHEN trips THEN t ELSE opened END
  FROM (SELECT *, met = 'half_open' OR failed + 1 >= {FAILURES} AS trips FROM (SELECT c.key, c.r, c.id, c.t, c.ok, m.failed, m.opened, CASE WHEN m.opened IS NULL THEN 'closed' WHEN c.t - m.opened >= {RECOVERY} THEN 'half_open' ELSE 'open' END AS met FROM m JOIN c ON c.key = m.key AND c.r = m.r + 1)))
 SELECT key, id, met, met = 'open' AS refused, CASE WHEN opened IS NULL THEN 'closed' ELSE 'open' END AS state FROM m WHERE r > 0"""


@query("breaker", _BREAKER_SQL)
def breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each user, errors being failures, under the usual limits; events are minutes apart, so runs of five failures are what opens one."""
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    return breaker_states(calls)
