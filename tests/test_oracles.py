"""Every query with an oracle gives the oracle's rows."""

import duckdb
import pandas as pd
import pytest

from lodestone.operators import answers, approvals, approximate, connectors, documents, evaluation, extras, governance, guard, ingest, lexemes, limits, management, pages, relational, rest, retrieval  # noqa: F401
from lodestone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v)[:19] if "-" in str(v)[:11] and ":" in str(v) else str(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, sf, key):
    got = registry.queries()[key](spark, sf).toPandas()
    want = duck.execute(registry.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    norm = lambda f: f.apply(lambda c: c.dt.strftime("%Y-%m-%d %H:%M:%S") if str(c.dtype).startswith("datetime") else c)
    one = lambda f: [tuple(x.split(" 00:00:00")[0].removesuffix(".0").removesuffix(".000000") for x in r) for r in rows(norm(f))]
    assert one(got) == one(want)
