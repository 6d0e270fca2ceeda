"""Streams with state against their batch forms, over any split, with a restart between any two parts; and the REST source."""

import http.server
import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import connectors, limits
from lodestone.session import table
from lodestone.sources import rest
from lodestone.streaming import stateful


def in_parts(spark, rows, schema, cuts, form, folder, mode="append"):
    """Each part is a file and a run of its own, which ends before the next one begins and goes on from the checkpoint."""
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/in")
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        form(stream).writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("cuts", [[], [3, 4, 60]])
def test_breaker_stream_equals_the_batch(spark, tmp_path, cuts):
    rng = random.Random(5)
    rows = [(rng.randrange(4), float(k * rng.choice([1, 1, 9])), k, rng.random() < 0.35) for k in range(120)]
    rows.sort(key=lambda r: (r[1], r[2]))
    schema = "key long, at double, id long, ok boolean"
    got = in_parts(spark, rows, schema, cuts, stateful.breaker_stream, tmp_path)
    want = limits.breaker_states(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {r["met"] for r in want.collect()} == {"closed", "open", "half_open"}


def test_quota_stream_equals_the_batch(spark, sf, tmp_path):
    from lodestone.operators import governance

    events = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), F.round(F.col("value") * 1000).cast("long").alias("micros"))
    rows = [tuple(r) for r in events.orderBy("at", "id").collect()]
    got = in_parts(spark, rows, "key long, at long, id long, micros long", [1, 400, 401], stateful.quota_stream, tmp_path)
    want = governance.quota_check(spark, sf).select(F.col("event_id").alias("id"), "spent", "remaining", "allowed", F.unix_micros(F.col("resets_at").cast("timestamp")).alias("resets_at"))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and want.where("not allowed").count() > 0


def test_replays_have_one_effect(spark, sf, tmp_path):
    calls = table(spark, sf, "events").select((F.col("user_id") % 4).alias("tenant_id"), F.col("props").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id").orderBy("ts", "event_id")
    rows = [tuple(r) for r in calls.collect()]
    rows = rows[:300] + rows[250:300] + rows[300:]  # some come again, late
    got = in_parts(spark, rows, "tenant_id long, key string, ts timestamp, event_id long", [260, 290, 340], lambda df: stateful.effects(df, "400 days"), tmp_path)
    want = limits.idempotent(spark, sf)
    assert sorted((r["tenant_id"], r["key"]) for r in got.collect()) == sorted((r["tenant_id"], r["key"]) for r in want.collect())


ENDPOINT = rest.Endpoint("thing", "/things/{id}", ("id",), ("q",))


def test_rest_requests_are_declared():
    assert rest.target(ENDPOINT, {"id": "a b", "q": "1&2", "debug": "x"}) == "/things/a%20b?q=1%262"
    with pytest.raises(ValueError, match="no endpoint"):
        rest.asked([ENDPOINT], [("other", {})], "x")


def test_rest_source_over_recorded_responses(spark, tmp_path):
    rest.record(spark.createDataFrame([("/things/1", '{"items": [{"a": 1}, {"a": 2}]}'), ("/things/2?q=x", "no json")], "request string, body string"), f"{tmp_path}/r")
    spark.dataSource.register(rest.RestSource)
    requests = [("thing", {"id": "1", "secret": "s"}), ("thing", {"id": "2", "q": "x"}), ("thing", {"id": "3"}), ("thing", {"id": "../4"}), ("thing", {})]
    got = spark.read.format("lodestone_rest").options(**rest.asked([ENDPOINT], requests, f"{tmp_path}/r")).load()
    assert got.rdd.getNumPartitions() == 5
    rows = {r["no"]: r for r in got.collect()}
    assert [rows[k]["status"] for k in range(5)] == [200, 200, 404, None, None] and rows[2]["error"] == "status 404" and "single segment" in rows[3]["error"] and "id" in rows[4]["error"]
    cells = connectors.shaped(got.where("error IS NULL"), "no", "body", "request").collect()
    assert sorted((r["no"], r["key"], r["value"]) for r in cells) == [(0, "a", "1"), (0, "a", "2"), (1, "body", "no json")]


def test_rest_source_over_http(spark):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            seen.append((self.path, self.headers.get("X-Key")))
            again = self.path == "/things/busy" and sum(p == self.path for p, _ in seen) < 3
            self.send_response(503 if again else 302 if self.path == "/things/away" else 200)
            self.send_header("Location", "/things/elsewhere")
            self.end_headers()
            self.wfile.write(b'{"path": "%s"}' % self.path.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(rest.RestSource)
        options = rest.asked([ENDPOINT], [("thing", {"id": i}) for i in ("1", "busy", "away")], f"http://127.0.0.1:{server.server_port}", "X-Key", "k")
        rows = {r["no"]: r for r in spark.read.format("lodestone_rest").options(**options).load().collect()}
    finally:
        server.shutdown()
    assert [rows[k]["status"] for k in range(3)] == [200, 200, 302] and rows[0]["body"] == '{"path": "/things/1"}'
    assert all(key == "k" for _, key in seen) and "/things/elsewhere" not in [p for p, _ in seen]


def test_progress_counts_what_a_job_has_written(spark, tmp_path):
    import time

    from lodestone.streaming.progress import Progress, counted

    listener, schema = Progress(), "k long, text string"
    spark.streams.addListener(listener)
    try:
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
        for part in range(3):
            spark.createDataFrame([(k, None if k % 4 == 0 else "x") for k in range(part * 10, part * 10 + 10)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = counted(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), missing="text IS NULL", large="k >= 25")
        job = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        job.awaitTermination()
        for _ in range(100):  # events come by another thread
            if listener.state.get(str(job.id)) == "done":
                break
            time.sleep(0.1)
        got = {r["counter"]: r["value"] for r in listener.jobs(spark).where(f"job = '{job.id}' AND state = 'done'").collect()}
    finally:
        spark.streams.removeListener(listener)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert got == {"files": out.count(), "missing": out.where("text IS NULL").count(), "large": out.where("k >= 25").count()} == {"files": 30, "missing": 8, "large": 5}
