"""Management reads and guards: users, jobs, proposals, tools, and what their rules refuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.embed import embedded
from ..plans.registry import query
from ..plans.views import document, live
from ..session import table
from .governance import _CONNECTOR_SQL, connector, known_labels
from .retrieval import clamped

_USER_SQL = "app_user AS (SELECT c_custkey AS user_id, c_nationkey AS tenant_id, CASE c_custkey % 10 WHEN 0 THEN ['admin', 'member'] WHEN 1 THEN ['member', 'owner'] ELSE ['member'] END AS roles, CASE c_custkey % 3 WHEN 0 THEN ['public'] WHEN 1 THEN ['finance', 'gone'] ELSE [] END AS held, CASE c_custkey % 4 WHEN 0 THEN ['public', 'typo'] WHEN 1 THEN ['finance', 'gone'] WHEN 2 THEN ['unknown', 'abc', 'hr'] ELSE [] END AS asked FROM customer)"


def app_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, tenant_id, roles, labels held and labels asked for, derived from customers."""
    roles = F.expr("CASE c_custkey % 10 WHEN 0 THEN array('admin', 'member') WHEN 1 THEN array('member', 'owner') ELSE array('member') END")
    held = F.expr("CASE c_custkey % 3 WHEN 0 THEN array('public') WHEN 1 THEN array('finance', 'gone') ELSE cast(array() AS array<string>) END")
    asked = F.expr("CASE c_custkey % 4 WHEN 0 THEN array('public', 'typo') WHEN 1 THEN array('finance', 'gone') WHEN 2 THEN array('unknown', 'abc', 'hr') ELSE cast(array() AS array<string>) END")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("tenant_id"), roles.alias("roles"), held.alias("held"), asked.alias("asked"))


@query("list_users", f"WITH {_USER_SQL} SELECT user_id, array_to_string(roles, ',') AS roles FROM app_user WHERE tenant_id = 3 ORDER BY user_id LIMIT 200")
def list_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return app_user(spark, sf_dir).where("tenant_id = 3").orderBy("user_id").limit(200).select("user_id", F.array_join("roles", ",").alias("roles"))


@query("list_connectors", f"WITH {_CONNECTOR_SQL} SELECT connector_id, array_to_string(required_labels, ',') AS required FROM connector WHERE tenant_id = 1 ORDER BY connector_id LIMIT 200")
def list_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's connectors and the labels they ask for; no secret is among the columns."""
    return connector(spark, sf_dir).where("tenant_id = 1").orderBy("connector_id").limit(200).select("connector_id", F.array_join("required_labels", ",").alias("required"))


@query("admin_count", f"WITH {_USER_SQL} SELECT tenant_id, count(*) FILTER (WHERE list_contains(roles, 'admin')) AS admins FROM app_user GROUP BY tenant_id")
def admin_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return app_user(spark, sf_dir).groupBy("tenant_id").agg(F.count_if(F.array_contains("roles", "admin")).alias("admins"))


@query("last_admin", f"WITH {_USER_SQL}, n AS (SELECT tenant_id, count(*) AS n FROM app_user WHERE list_contains(roles, 'admin') GROUP BY tenant_id) SELECT user_id, n <= 1 AS refused FROM app_user JOIN n USING (tenant_id) WHERE list_contains(roles, 'admin')")
def last_admin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admins, and whether taking the role away is refused because a tenant would have none left."""
    admins = app_user(spark, sf_dir).where(F.array_contains("roles", "admin")).select("user_id", "tenant_id")
    counts = admins.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))
    return admins.join(counts, "tenant_id").select("user_id", (F.col("n") <= 1).alias("refused"))


#: The roles that exist.
ROLES = ("admin", "member")


@query("unknown_roles", f"WITH {_USER_SQL} SELECT user_id, array_to_string(list_sort(list_filter(roles, lambda r: r NOT IN {ROLES})), ',') AS unknown FROM app_user")
def unknown_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return app_user(spark, sf_dir).select("user_id", F.array_join(F.array_sort(F.array_except("roles", F.array(*map(F.lit, ROLES)))), ",").alias("unknown"))


@query("unknown_labels", f"WITH {_USER_SQL}, known AS (SELECT unnest(['public', 'finance', 'hr', 'legal', 'ops']) AS label), a AS (SELECT user_id, unnest(asked) AS label, held FROM app_user) SELECT user_id, string_agg(label, ',' ORDER BY label) AS unknown FROM a WHERE NOT list_contains(held, label) AND label NOT IN (SELECT label FROM known) GROUP BY user_id")
def unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels newly asked for that nothing bears or asks for; what is held already may be kept."""
    known = known_labels(spark, sf_dir).select("label").distinct()
    added = app_user(spark, sf_dir).select("user_id", F.explode(F.array_except("asked", "held")).alias("label"))
    # a user asks for a few labels
    return added.join(known, "label", "left_anti").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("unknown"))


def authorised(labels: Column, required_labels: Column, roles: Column, required_roles: Column) -> Column:
    """A label in common with a tool that asks for some, and a role in common if it asks for any."""
    shares = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    return (F.size(required_labels) > 0) & shares(labels, required_labels) & ((F.size(required_roles) == 0) | shares(roles, required_roles))


_TOOL_SQL = "tool AS (SELECT p_partkey AS tool_id, p_partkey % 5 = 0 AS writes, CASE p_partkey % 3 WHEN 0 THEN ['public'] WHEN 1 THEN ['legal', 'finance'] ELSE [] END AS required_labels, CASE p_partkey % 4 WHEN 0 THEN ['admin'] ELSE [] END AS required_roles FROM part)"


def tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.expr("CASE p_partkey % 3 WHEN 0 THEN array('public') WHEN 1 THEN array('legal', 'finance') ELSE cast(array() AS array<string>) END")
    roles = F.expr("CASE p_partkey % 4 WHEN 0 THEN array('admin') ELSE cast(array() AS array<string>) END")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tool_id"), (F.col("p_partkey") % 5 == 0).alias("writes"), labels.alias("required_labels"), roles.alias("required_roles"))


_ALLOWED_SQL = "len(required_labels) > 0 AND list_has_any(required_labels, ['finance', 'public']) AND (len(required_roles) = 0 OR list_has_any(required_roles, ['member']))"


def _allowed() -> Column:
    mine = lambda *values: F.array(*map(F.lit, values))
    return authorised(mine("finance", "public"), F.col("required_labels"), mine("member"), F.col("required_roles"))


@query("tool_gate", f"WITH {_TOOL_SQL} SELECT tool_id, {_ALLOWED_SQL} AS allowed FROM tool")
def tool_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool(spark, sf_dir).select("tool_id", _allowed().alias("allowed"))


@query("tool_listing", f"WITH {_TOOL_SQL} SELECT tool_id FROM tool WHERE {_ALLOWED_SQL} AND NOT writes")
def tool_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is offered to a caller: what they may use and what only reads."""
    return tool(spark, sf_dir).where(_allowed() & ~F.col("writes")).select("tool_id")


_JOBS_SQL = "SELECT o_orderkey AS job_id, CAST(o_orderdate AS DATE) AS created_on, o_orderstatus AS status FROM (SELECT *, o_custkey % 4 AS tenant_id FROM orders) WHERE tenant_id = 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT"


@query("list_jobs", f"{_JOBS_SQL} 100")
def list_jobs(spark: SparkSession, sf_dir: str, limit: int = 1000) -> DataFrame:
    """A tenant's jobs, newest first, from 1 to 100 of them."""
    mine = table(spark, sf_dir, "orders").withColumn("tenant_id", F.col("o_custkey") % 4).where("tenant_id = 1").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(max(1, min(limit, 100)))
    return mine.select(F.col("o_orderkey").alias("job_id"), F.to_date("o_orderdate").alias("created_on"), F.col("o_orderstatus").alias("status"))


@query("job_progress", "SELECT l_orderkey AS job_id, count(*) FILTER (WHERE l_linestatus = 'F') AS files_done, count(*) AS files_total FROM lineitem GROUP BY l_orderkey")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count_if(F.col("l_linestatus") == "F").alias("files_done"), F.count(F.lit(1)).alias("files_total"))


#: Fixed value: hours until a proposal expires.
TTL_HOURS = 24
_NOW = "1997-01-02 00:00:00"
_PROPOSAL_SQL = f"proposal AS (SELECT o_orderkey AS id, o_custkey AS requested_by, o_custkey % 50 AS approver, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'executed' ELSE 'rejected' END AS status, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS created_at, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL {TTL_HOURS} HOUR AS expires_at FROM orders)"


def proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "executed").otherwise("rejected")
    created = F.to_date("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("requested_by"), (F.col("o_custkey") % 50).alias("approver"), status.alias("status"), created.alias("created_at"), (created + F.expr(f"INTERVAL {TTL_HOURS} HOURS")).alias("expires_at"))


def _now() -> Column:
    return F.lit(_NOW).cast("timestamp_ntz")


@query("approvals_list", f"WITH {_PROPOSAL_SQL} SELECT id, status, created_at FROM proposal WHERE status = 'pending' ORDER BY created_at DESC, id DESC LIMIT 200")
def approvals_list(spark: SparkSession, sf_dir: str, pending_only: bool = True) -> DataFrame:
    rows = proposal(spark, sf_dir)
    rows = rows.where("status = 'pending'") if pending_only else rows
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(200).select("id", "status", "created_at")


@query("approvals_expired", f"WITH {_PROPOSAL_SQL} SELECT id, expires_at FROM proposal WHERE status = 'pending' AND expires_at < TIMESTAMP '{_NOW}'")
def approvals_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proposal(spark, sf_dir).where((F.col("status") == "pending") & (F.col("expires_at") < _now())).select("id", "expires_at")


@query("approve_guards", f"WITH {_PROPOSAL_SQL} SELECT id, CASE WHEN status <> 'pending' THEN 'not pending' WHEN expires_at < TIMESTAMP '{_NOW}' THEN 'expired' WHEN requested_by = approver THEN 'own proposal' ELSE 'approved' END AS outcome FROM proposal")
def approve_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an approval of each proposal gets, in the order of the checks: pending, not expired, not one's own."""
    outcome = F.when(F.col("status") != "pending", "not pending").when(F.col("expires_at") < _now(), "expired").when(F.col("requested_by") == F.col("approver"), "own proposal").otherwise("approved")
    return proposal(spark, sf_dir).select("id", outcome.alias("outcome"))


@query("dry_run", f"WITH {_PROPOSAL_SQL} SELECT p.id, p.requested_by AS payload, coalesce(c_acctbal > 0, false) AS reachable FROM proposal p LEFT JOIN customer ON c_custkey = p.requested_by WHERE p.status = 'pending'")
def dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored payload of each pending proposal as it is, and whether its target (here: the customer) could be reached."""
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("requested_by"), (F.col("c_acctbal") > 0).alias("up"))
    return proposal(spark, sf_dir).where("status = 'pending'").join(targets, "requested_by", "left").select("id", F.col("requested_by").alias("payload"), F.coalesce("up", F.lit(False)).alias("reachable"))


@query("compensate", "WITH e AS (SELECT user_id AS id, event_id, ts, CASE event_type WHEN 'signup' THEN 'execute' WHEN 'error' THEN 'timeout' WHEN 'purchase' THEN 'compensate' END AS action FROM events) SELECT id, event_id, action, action = 'compensate' AND coalesce(lag(action) OVER (PARTITION BY id ORDER BY ts, event_id) = 'execute', false) AS compensated FROM e WHERE action IS NOT NULL")
def compensate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compensation takes effect right after an execution that is known to have happened; a timeout leaves it unknown, so nothing is undone."""
    action = F.when(F.col("event_type") == "signup", "execute").when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "purchase", "compensate")
    w = Window.partitionBy("id").orderBy("ts", "event_id")
    acts = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "ts", action.alias("action")).where("action IS NOT NULL")
    return acts.select("id", "event_id", "action", ((F.col("action") == "compensate") & F.coalesce(F.lag("action").over(w) == "execute", F.lit(False))).alias("compensated"))


@query("page_caps", "SELECT k, greatest(1, least(k, 50)) AS search, greatest(1, least(k, 100)) AS jobs, least(k, 200) AS audit FROM (SELECT DISTINCT l_linenumber * 40 - 60 AS k FROM lineitem)")
def page_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page sizes as asked, and as each listing grants them."""
    k = F.col("k")
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 40 - 60).alias("k")).distinct()
    return asked.select("k", F.greatest(F.lit(clamped(0)), F.least(k, F.lit(clamped(1000)))).alias("search"), F.greatest(F.lit(1), F.least(k, F.lit(100))).alias("jobs"), F.least(k, F.lit(200)).alias("audit"))


def reindexed(docs: DataFrame, dimension: int = 64) -> DataFrame:
    """docs (doc_id, text and others) with an embedding made anew; everything else stays as it is."""
    return docs.withColumn("embedding", embedded(F.col("text"), dimension))


@query("reindex")
def reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, a digest of the unchanged text, and the new embedding of every live document."""
    return reindexed(live(document(spark, sf_dir))).select("doc_id", F.md5("text").alias("text_md5"), "embedding")


@query("fake_embed", "SELECT doc_id, 64 AS dimension, true AS unit FROM documents")
def fake_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic embeddings: their dimension, and whether their length is 1."""
    e = table(spark, sf_dir, "documents").select("doc_id", embedded(F.col("text")).alias("e"))
    length = F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)
    return e.select("doc_id", F.size("e").alias("dimension"), (F.abs(length - 1) < 1e-9).alias("unit"))
