"""The guard of foreign SQL and the replay of approvals."""

import random

import pytest

from lodestone.operators import approvals, guard

#: Fixed values up to the one of `dblink_connect`: statements that have to be refused.
REFUSED = """DROP TABLE customers
DELETE FROM orders
UPDATE orders SET order_status = 'shipped'
INSERT INTO customers (name) VALUES ('x')
TRUNCATE customers
SELECT 1; DROP TABLE customers
WITH x AS (DELETE FROM orders RETURNING *) SELECT * FROM x
SELECT * FROM customers
SELECT * FROM pg_shadow
SELECT current_setting('app.tenant_id')
SELECT pg_read_file('/etc/passwd')
COPY customers TO '/tmp/out.csv'
GRANT ALL ON curated.v_orders TO analytics_readonly
CREATE TABLE evil (id int)
SELECT * FROM curated.v_orders UNION SELECT * FROM pg_user
SET ROLE postgres
SELECT dblink_connect('host=evil.example.com')
SELECT * FROM parquet.`/tmp/x`
WITH r AS (SELECT * FROM secret) SELECT * FROM r
SELECT 1 WHERE EXISTS (SELECT 1 FROM pg_user)
SELECT * FROM curated.v_orders WHERE order_id IN (SELECT id FROM t)
SELECT (SELECT max(x) FROM t)
SELECT * FROM curated.v_orders ORDER BY java_method('a', 'b')
SELECT * FROM (WITH customers AS (SELECT 1 AS a) SELECT * FROM customers) x JOIN customers
WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a
SELECT * FROM range(5)
SELECT current_user()
SELECT input_file_name() FROM curated.v_orders
SELECT * FROM x.curated.v_orders
INSERT INTO curated.v_orders SELECT * FROM curated.v_orders
FROM curated.v_orders INSERT INTO x SELECT *
EXPLAIN SELECT 1
SHOW TABLES

not sql at all""".split("\n")


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    with pytest.raises(guard.UnsafeSQLError):
        guard.checked(spark, sql)


def test_a_users_function_is_refused(spark):
    spark.udf.register("leak", lambda: "x")
    for sql in ("SELECT leak()", "SELECT curated.leak()"):
        with pytest.raises(guard.UnsafeSQLError):
            guard.checked(spark, sql)


@pytest.mark.parametrize(
    ("sql", "rows", "limit", "applied"),
    [
        ("SELECT * FROM curated.v_orders", 5, 5, True),
        ("SELECT order_id FROM Curated.V_ORDERS o LIMIT 3;", 3, 3, False),
        ("SELECT v_orders.order_id FROM curated.v_orders WHERE order_id >= 0 LIMIT 10 * 1000", 5, 5, True),
        ("SELECT o.order_id, row_number() OVER (PARTITION BY o.customer_id ORDER BY o.ordered_at DESC) AS r FROM curated.v_orders AS o ORDER BY 1 LIMIT 900", 5, 5, True),
        ("SELECT count(*) FROM curated.v_orders, curated.v_order_lines WHERE v_orders.order_id = v_order_lines.order_id", 1, 5, True),
        ("SELECT 1 UNION ALL SELECT count(*) FROM curated.v_orders LIMIT 4 OFFSET 1", 1, 4, False),
        ("WITH a AS (SELECT * FROM curated.v_orders LIMIT 50), b AS (SELECT customer_country c, count(*) n FROM a GROUP BY 1 HAVING count(*) > 0) SELECT * FROM b ORDER BY n DESC, c LIMIT 2", 2, 2, False),
        ("SELECT CASE WHEN a > 1 THEN 'x' ELSE coalesce(b, 'y') END FROM (VALUES (1, 'z'), (2, null)) AS t(a, b)", 2, 5, True),
    ],
)
def test_allowed(spark, sf, sql, rows, limit, applied):
    safe = guard.checked(spark, sql, 5)
    assert (safe.limit, safe.limit_applied) == (limit, applied)
    assert guard.guarded(spark, sf, sql, 5).count() == rows
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lodestone_")]


def plain_replay(events):
    state, out = {}, []
    for id_, _, event, action, late, own in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        now = state.get(id_, "none")
        new, legal = now, False
        if action == "propose" and now in ("none", "rejected", "executed", "expired"):
            new, legal = "pending", True
        elif (action in ("approve", "reject") and now == "pending") or (action == "execute" and now == "approved"):
            if late:
                new = "expired"
            elif not (action == "approve" and own):
                new, legal = {"approve": "approved", "reject": "rejected", "execute": "executed"}[action], True
        state[id_] = new
        out.append((id_, event, action, legal, new))
    return out


def test_replay_equals_a_plain_machine_over_many_tasks(spark):
    rng = random.Random(2)
    for parts in (1, 7):
        # one request holds most events, so that it fills several tasks
        events = [(rng.choice([1, 2, 3, 4, *[5] * 8]), rng.randrange(50), k, rng.choice([*approvals.ACTIONS, "read", None]), rng.random() < 0.2, rng.random() < 0.2) for k in range(400)]
        df = spark.createDataFrame(events, "id long, ts long, event_id long, action string, late boolean, own boolean")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", False)
        try:
            got = approvals.replayed(df).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.set("spark.sql.adaptive.enabled", True)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(plain_replay(events), key=lambda r: r[1])
    assert approvals.replayed(df.limit(0)).count() == 0


def test_what_is_refused_moves_nothing(spark):
    events = [(1, k, k, a, False, own) for k, (a, own) in enumerate([("propose", False), ("execute", False), ("approve", True), ("execute", False), ("approve", False), ("execute", False)])]
    got = approvals.replayed(spark.createDataFrame(events, "id long, ts long, event_id long, action string, late boolean, own boolean"))
    assert [r["legal"] for r in got.orderBy("event_id").collect()] == [True, False, False, False, True, True]
