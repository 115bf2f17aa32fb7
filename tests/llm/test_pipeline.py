"""The pipeline's stages, each on its own input, and the whole against its stages."""

from __future__ import annotations

import ast
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tests.llm.test_texts import grouped, slow_links
from weftlog.llm import common, queries, simhash
from weftlog.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = common.read(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SF), f"test-{name}"))
    rows = [df.collect() for df in kept]
    assert all(df.columns == columns for df in kept[:-1])
    labels = {r.doc_id: r.quality for r in common.read(spark, SF, "labels").collect()}
    good = {r.doc_id for r in rows[1]}
    judged = [(labels[r.doc_id] == 1) == (r.doc_id in good) for r in rows[0] if r.doc_id in labels]
    assert sum(judged) / len(judged) > 0.95
    sets = {r.doc_id: set(simhash.shingle_hashes((r.text or "").encode(), 5).tolist()) for r in rows[1]}
    alike = lambda least: lambda a, b: bool(a or b) and len(a & b) >= least * len(a | b) or a == b
    similar, loose = grouped(sets, alike(0.8)), grouped(sets, alike(0.6))
    left = {r.doc_id for r in rows[2]}
    assert set(loose.values()) <= {loose[k] for k in left} and len(left) == len(rows[2])
    assert len({similar[k] for k in left}) >= len(left) - max(1, len(left) // 100)
    assert len(left) < len(rows[1])
    before = {r.doc_id: r for r in rows[2]}
    assert {r.doc_id for r in rows[3]} == set(before)
    for r in rows[3]:
        assert (r.text == before[r.doc_id].text) == (not slow_links(before[r.doc_id].text or ""))
        assert r.n_chars == len(r.text)
    assert {r.doc_id for r in rows[4]} <= set(before)
    packed = Counter(r.doc_id for r in rows[5] if r.piece == 0)
    assert packed == Counter(r.doc_id for r in rows[4])
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, rows[5]))


EDGE = [
    (1, "Some words of a text that is long enough to be told apart from others here.", "en", "a", 76, "x"), (1, "Some words of a text that is long enough to be told apart from others here.", "en", "a", 76, "x"),
    (2, None, None, None, None, None), (None, "No id, but words that are its own and nobody else's, as it happens to be.", "en", "a", 70, "y"), (None, None, None, None, 0, None), (None, None, None, None, 0, None),
    (3, "", "de", "b", 0, "z"), (4, " \t\n", "de", "b", 3, "z"), (5, "token = abcdefghijklmnop and some more words around it, to have shingles", "en", "b", 70, "q"),
    (6, "é " * 40_000 + "password: hunter2hunter2", "fr", "c", 80_024, "long"),
]
CLASH = "doc_id long, text string, lang string, source string, n_chars long, _row string"


@pytest.mark.parametrize("labelled", [True, False])
def test_stages_on_edges(spark, tmp_path, labelled):
    """Nulls in every column, repeated rows, empty and very long texts, ties and a clashing name, stage by stage; then empty tables."""
    labels = [(r[0], k % 2, 0) for k, r in enumerate(EDGE) if r[0]] if labelled else []
    for name, rows in (("full", EDGE), ("none", [])):
        spark.createDataFrame(rows, CLASH).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = common.read(spark, f"{tmp_path}/{name}", "documents")
        for stage, f in corpus_pipeline.STAGES:
            out = written(f(spark, docs, f"{tmp_path}/{name}"), f"edge-{stage}")
            n, before = out.count(), docs.count()
            if stage != "packing":
                assert out.columns == docs.columns
            if not rows:
                assert n == 0
            elif stage == "near_duplicates":
                kept = Counter(r.doc_id for r in out.collect())
                assert max(kept.values()) <= 2 and n < before
            elif stage == "secrets":
                assert n == before and not any("hunter2" in (r.text or "") or "abcdefghijklmnop" in (r.text or "") for r in out.collect())
            elif stage == "packing":
                assert len({(r.sequence_id, r.offset) for r in out.collect()}) == n >= before
            docs = out
        if rows and not labelled:  # nothing is known of quality, so that every row stays
            first = written(corpus_pipeline.STAGES[0][1](spark, common.read(spark, f"{tmp_path}/{name}", "documents"), f"{tmp_path}/{name}"), "edge")
            assert first.count() == len(EDGE)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.01/{table}.parquet'")
    twin = con.sql(queries.ORACLE_SQL[name])
    ours = queries.queries()[name](spark, "/root/testdata/sf0.01").select(*twin.columns).collect()
    assert sorted(map(repr, map(tuple, ours))) == sorted(map(repr, twin.fetchall()))


def test_every_operator_is_registered_once():
    found = sorted(int(k[2:].split("_")[0]) for k in queries.queries() if k.startswith("op"))
    assert found == list(range(1, 11)) and "pipeline" in queries.queries()


def test_native_modules_run_no_python(spark):
    """The operators that must be plans import neither numpy, pandas nor Arrow, and map no partitions."""
    for name in ("mixing", "secrets"):
        with open(f"{queries.__file__.rpartition('/')[0]}/{name}.py", encoding="utf-8") as f:
            tree = ast.parse(f.read())
        imported = {a.name.split(".")[0] for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names}
        calls = {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
        assert not imported & {"numpy", "pandas", "pyarrow"}
        assert not calls & {"mapInArrow", "mapInPandas", "applyInPandas", "udf", "pandas_udf", "rdd", "collect", "toPandas"}
