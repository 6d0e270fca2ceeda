"""The versioned store: versions, reruns, kills between any two writes, deletes and retention."""

import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources import versioned

SCHEMA = "tenant_id long, source_path string, text string, labels array<string>"
AT, LATER = "2024-01-01 00:00:00", "2024-01-02 00:00:00"


def batch(spark, *rows):
    return spark.createDataFrame([(t, p, x, ["public"]) for t, p, x in rows], SCHEMA)


def state(spark, folder):
    docs = sorted((r["tenant_id"], r["source_path"], r["version"], r["text"], r["superseded_by"] is None, str(r["superseded_at"] or "")) for r in versioned.documents(spark, folder).collect())
    chunks = sorted((r["document_id"], r["ordinal"], r["content"]) for r in versioned.chunks(spark, folder).collect())
    return docs, chunks


def files(folder):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


FIRST = [(0, "a", "one"), (0, "b", "two"), (1, "a", "one"), (0, "c", "two"), (0, "e", None)]
SECOND = [(0, "a", "one, changed"), (0, "b", "two"), (0, "d", "# H\n\nnew"), (1, "z", "")]


def test_versions_counters_and_reruns(spark, tmp_path):
    folder = str(tmp_path / "s")
    assert versioned.ingest(batch(spark, *FIRST), folder, AT, 4) == {"created": 4, "skipped": 1, "superseded": 0, "chunks": 3}
    assert versioned.ingest(batch(spark, *SECOND), folder, LATER, 4) == {"created": 2, "skipped": 1, "superseded": 1, "chunks": 2}
    docs, chunks = state(spark, folder)
    assert [d[:5] for d in docs] == [(0, "a", 1, "one", False), (0, "a", 2, "one, changed", True), (0, "b", 1, "two", True), (0, "d", 1, "# H\n\nnew", True), (0, "e", 1, "", True), (1, "a", 1, "one", True), (1, "z", 1, "", True)]
    assert docs[0][5] == LATER and len(chunks) == 5
    before = files(folder)
    assert versioned.ingest(batch(spark, *SECOND), folder, "2025-01-01", 4) == {"created": 0, "skipped": 4, "superseded": 0, "chunks": 0}
    assert files(folder) == before
    # a text that was superseded is new again
    assert versioned.ingest(batch(spark, (0, "a", "one")), folder, LATER, 4)["superseded"] == 1
    assert versioned.documents(spark, folder).where("source_path = 'a' AND tenant_id = 0").agg(F.max("version")).first()[0] == 3
    assert versioned.ingest(batch(spark), folder, LATER, 4) == {"created": 0, "skipped": 0, "superseded": 0, "chunks": 0}


@pytest.mark.parametrize("where", ["staging", "before", "between"])
@pytest.mark.parametrize("turn", [0, 1])
def test_a_killed_run_is_finished_by_the_next(spark, tmp_path, monkeypatch, where, turn):
    whole, folder = str(tmp_path / "whole"), str(tmp_path / "s")
    for f in (whole, folder):
        versioned.ingest(batch(spark, *FIRST), f, AT, 4)
    versioned.ingest(batch(spark, *SECOND), whole, LATER, 4)
    finish, calls = versioned._finish, []

    def killed(spark_, folder_, stage):
        calls.append(stage)
        if len(calls) - 1 == turn:
            if where == "between":  # a partition is gone, and its staged rows are not there yet
                fs = versioned._Files(spark_, folder_)
                name = next(n for n in fs.names(stage) if not n.startswith("_"))
                tenant = next(n for n in fs.names(stage, name) if n.startswith("tenant_id="))
                fs.delete(name, tenant, next(n for n in fs.names(stage, name, tenant) if n.startswith("bucket=")))
            if where == "staging":
                versioned._Files(spark_, folder_).delete(stage, "_ready")
            raise KeyboardInterrupt
        finish(spark_, folder_, stage)

    monkeypatch.setattr(versioned, "_finish", killed)
    with pytest.raises(KeyboardInterrupt):
        versioned.ingest(batch(spark, *SECOND), folder, LATER, 4)
    monkeypatch.setattr(versioned, "_finish", finish)
    versioned.ingest(batch(spark, *SECOND), folder, LATER, 4)
    assert state(spark, folder) == state(spark, whole) and not versioned._Files(spark, folder).names("_stage")


def test_delete_takes_chunks_and_touches_only_its_partitions(spark, tmp_path):
    folder = str(tmp_path / "s")
    versioned.ingest(batch(spark, *[(t, f"p{k}", f"text {t} {k}") for t in range(2) for k in range(40)]), folder, AT, 4)
    gone = versioned.documents(spark, folder).where("tenant_id = 1 AND source_path IN ('p3', 'p5')").select("document_id", "bucket")
    ids = [(r["document_id"],) for r in gone.collect()]
    parts = {f"tenant_id=1/bucket={r['bucket']}" for r in gone.collect()}
    before = files(folder)
    versioned.delete(spark.createDataFrame([*ids, ("unknown",), ids[0]], "document_id string"), folder)
    assert versioned.documents(spark, folder).count() == 78 == versioned.chunks(spark, folder).count()
    after = files(folder)
    assert {f for f in before if f not in after or after[f] != before[f]} == {f for f in before if any(p + "/" in f for p in parts)}
    whole = versioned.documents(spark, folder).where("tenant_id = 0").select("document_id")
    versioned.delete(whole, folder)
    assert not os.path.exists(f"{folder}/document/tenant_id=0/bucket=0") and versioned.chunks(spark, folder).count() == 38
    after = files(folder)
    versioned.delete(whole.limit(0), folder)
    assert files(folder) == after


def test_retention_by_policy_in_passes(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = spark.range(100).select("id", (F.timestamp_seconds(1_700_000_000 + F.col("id") * 86_400 / 2)).alias("created_at"))
    for p in versioned.POLICIES[:5]:
        versioned.append(rows, folder, p)
        versioned.append(rows, folder, p)  # a rerun adds nothing
    now = "2024-01-03 22:13:20"  # fifty days after the first row
    assert versioned.retain(spark, folder, now, dry_run=True) == {"trace_span": 40, "conversation_message": 0, "conversation": 0, "agent_run": 0, "ingest_job": 40, "connector_audit": 0, "approval_request": 0}
    before = files(folder)
    assert [versioned.retain(spark, folder, now, at_once=25)["trace_span"] for _ in range(3)] == [25, 15, 0]
    left = spark.read.parquet(f"{folder}/trace_span")
    assert left.count() == 60 and left.agg(F.min("id")).first()[0] == 40
    changed = {f for f, t in before.items() if files(folder).get(f) != t}
    assert changed and all("/trace_span/" in f or "/ingest_job/" in f for f in changed)
