"""Exact membership by bitmaps against sets."""

import pytest

from lodestone.llm import marks, members


@pytest.mark.parametrize("bits", [24, 8])
def test_rows_of_members_are_told_exactly(spark, monkeypatch, bits):
    # workers import the module anew, so a small bitmap is met by many ids instead
    rows = spark.range(0, 3000).selectExpr("CASE WHEN id % 100 = 7 THEN NULL ELSE id % 2000 END AS k", "concat('t', id) AS text")
    wanted = spark.range(0, 5000, 3).selectExpr("CASE WHEN id = 9 THEN NULL ELSE id END AS other")
    if bits == 8:
        found = members.bitmaps(rows.select("k"), wanted, levels=1)
        assert found is None or len(found) == 1
        monkeypatch.setattr(members, "bitmaps", lambda *_: None)
    got = members.rows_of(rows, "k", wanted)
    want = sorted(r["text"] for r in rows.collect() if r["k"] is not None and r["k"] % 3 == 0 and r["k"] != 9)
    assert got.columns == rows.columns and sorted(r["text"] for r in got.collect()) == want


def test_wrong_marks_are_told_apart(spark):
    """Ids that share a place in the bitmap are of both kinds."""
    import numpy as np

    ids = np.arange(1, 60_000)
    spots = marks._spot(ids)
    order = np.argsort(spots, kind="stable")
    same = np.flatnonzero(spots[order][1:] == spots[order][:-1])
    pairs = [(int(ids[order[i]]), int(ids[order[i + 1]])) for i in same[:40]]
    assert len(pairs) == 40
    rows = spark.createDataFrame([(x,) for p in pairs for x in p], "k long")
    wanted = spark.createDataFrame([(p[0],) for p in pairs], "k long")
    found = members.bitmaps(rows, wanted)
    assert len(found) > 1
    assert sorted(r["k"] for r in members.rows_of(rows, "k", wanted).collect()) == sorted({p[0] for p in pairs})
    assert members.rows_of(rows, "k", wanted.limit(0)).count() == 0 == members.rows_of(rows.limit(0), "k", wanted).count()
