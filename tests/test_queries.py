"""Every registered query against its SQL twin in DuckDB, on the same Parquet files."""

from __future__ import annotations

import os

import duckdb
import pytest

from weftlog.plans import catalog, registry, store_catalog  # noqa: F401  (the catalogs register their queries)

SF = os.environ.get("WEFTLOG_SF", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float) else v


def test_all_queries_have_a_twin():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df, twin = registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLE_SQL[name])
    kinds = dict(zip(twin.columns, map(str, twin.types)))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    ours = sorted(repr([plain(r[c]) for c in df.columns]) for r in df.collect())
    at = [twin.columns.index(c) for c in df.columns]
    assert ours == sorted(repr([plain(r[k]) for k in at]) for r in twin.fetchall())
    assert ours or name in ("global_range", "response_contract", "outbox_cleanup", "projection_batch")


def test_golden_totals(spark):
    assert registry.QUERIES["seeded_accounts"](spark, SF).first().asDict() == {
        "accounts": 100_000, "final_balance": 7_550_000, "snapshots": 100_000, "stored_events": 6_400_000,
    }
