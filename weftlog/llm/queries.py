"""The registered queries of this sub-package: each operator over its whole table, with production parameters.

The operators keep their own interfaces; a query only reads its table and gives the result the contract's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlog.llm import embeddings, html, mixing, neighbours, packing, quality, secrets, simhash, tokens, toxicity
from weftlog.llm.common import read


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _remainder(by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id has remainder 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % by, F.lit(0))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = _remainder(4) == 2
    model = quality.train(docs, read(spark, sf_dir, "labels").where(~held))
    out = quality.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: at the start, in the middle, at the end."""
    import public_tokenizers

    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    edit = lambda a, b, new: F.struct(a.alias("start"), b.alias("end"), F.lit(new).alias("new"))
    half = F.floor(size / 2)
    edits = F.array(
        edit(F.lit(0).cast("long"), F.lit(0).cast("long"), "Revised. "), edit(half, half + 12, "amended"),
        edit(F.lit(2**40), F.lit(2**40), "\n\nEnd of document."),
    )
    out = tokens.recount(
        read(spark, sf_dir, "documents"), edits, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return out.select(F.col("id").alias("doc_id"), F.col("before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_chars", "leaves", "encoded")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex_fp().alias("fingerprint"), F.col("component").alias("component_id"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = _remainder(5) == 0
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed, model = neighbours.index(read(spark, sf_dir, "embeddings"))
    return neighbours.search(indexed, model, F.col("id") % 50 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(read(spark, sf_dir, "documents"), word_tokenizer())
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of ``op1_mixing`` for each source: its words, its target, and whether what is taken comes within a percent of it."""
    out = mixing.mix(read(spark, sf_dir, "documents")).groupBy("source", "source_size", "target").agg(F.count("*").alias("documents"), F.sum("taken").alias("taken"))
    near = F.abs(F.col("taken") - F.col("target")) <= F.greatest(F.col("target") * 0.02, F.lit(100.0))
    return out.select("source", "documents", "source_size", F.round("target", 3).alias("target"), near.alias("near"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op10_secrets`` finds by the base patterns alone."""
    return op10_secrets(spark, sf_dir).drop("spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return found | {"mixing_targets": mixing_targets, "secret_counts": secret_counts, "pipeline": pipeline}


_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND list_sum(list_transform(embedding, lambda c: CASE WHEN c IS NULL OR NOT isfinite(c) THEN 1 ELSE 0 END)) = 0 AND list_sum(list_transform(embedding, lambda c: abs(c))) > 0"

#: SQL twins of the operators whose whole result SQL can express: all others rest on hashes, fits, tokenizers or text
#: positions that it has no functions for, and are tested against brute force.
_FOUND = "list_transform(range(1, len({m}) + 1), lambda i: {{'s': list_sum(list_transform({g}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: length(x))), 0), 'm': {m}[i], 'k': {k}}})"
_PATTERNS = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX}
_KEPT = {
    "assign": f"length(regexp_extract(x.m, '{secrets.ASSIGN.replace("'", "''")}', 2)) >= {secrets.LEAST_VALUE}",
    "access": f"length(x.m) >= {secrets.LEAST_ACCESS}", "hex": f"length(x.m) >= {secrets.LEAST_HEX}",
}
_SPLIT = ", ".join(f"string_split_regex(t, '{p.replace("'", "''")}') AS {k}_g, regexp_extract_all(t, '{p.replace("'", "''")}', 0) AS {k}_m" for k, p in _PATTERNS.items())
_BASE = ", ".join(f"list_filter({_FOUND.format(g=f'{k}_g', m=f'{k}_m', k=n)}, lambda x: {_KEPT[k]}) AS {k}" for n, k in enumerate(_PATTERNS))
_NAME = "CASE x.k WHEN 0 THEN 'assign' WHEN 1 THEN 'access' ELSE 'hex' END"

ORACLE_SQL: dict[str, str] = {
    "mixing_targets": r"""WITH D AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    S AS (SELECT source, CAST(count(*) AS BIGINT) AS documents, CAST(sum(size) AS BIGINT) AS total, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS w FROM D GROUP BY source),
    R AS (SELECT *, 3.0 * total / w AS ratio, sum(total) OVER () AS budget FROM S),
    L AS (SELECT *, (budget - coalesce(sum(3.0 * total) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM R
    WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    F AS (SELECT min_by(level, ratio) AS final FROM L WHERE level <= ratio)
    SELECT source, documents, total AS source_size, round(least(3.0 * total, w * coalesce((SELECT final FROM F), 1e300)), 3) AS target, true AS near FROM L""",
    "secret_counts": rf"""WITH T AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), G AS (SELECT doc_id, {_SPLIT} FROM T), B AS (SELECT doc_id, {_BASE} FROM G),
    A AS (SELECT doc_id, assign, access, hex, list_sort(list_transform(list_concat(list_concat(assign, access), hex), lambda x: {{'s': x.s, 'k': x.k, 'e': x.s + length(x.m)}})) AS spans FROM B)
    SELECT doc_id, CAST(len(assign) AS BIGINT) AS n_assign, CAST(len(access) AS BIGINT) AS n_access, CAST(len(hex) AS BIGINT) AS n_hex,
    sha256(array_to_string(list_transform(spans, lambda x: {_NAME} || ':' || x.s || ':' || x.e), ',')) AS base_sha256 FROM A""",
    "op6_embeddings": f"""WITH RECURSIVE V AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {_USABLE}),
    E AS (SELECT a.vec_id AS a, b.vec_id AS b FROM V a JOIN V b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
    R(id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT R.id, E.b FROM R JOIN E ON E.a = R.reached),
    C AS (SELECT id, min(reached) AS component_id FROM R GROUP BY id), N AS (SELECT a, count(*) AS n FROM E GROUP BY a)
    SELECT id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept FROM C LEFT JOIN N ON N.a = C.id"""
}
