"""A corpus pipeline of five operators: quality, near-duplicates, secrets, mixing, packing.

Each stage gets the table that its predecessor wrote, works on all of it and returns what it keeps; all but the last
return the columns of ``documents``. Every stage takes nulls in any column, empty and very long texts (read whole), repeated
rows, other columns of any name (kept, but by the last) and empty tables (which give no rows); what it makes of them is below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlog.llm import mixing, packing, quality, secrets, simhash
from weftlog.llm.common import read, written
from weftlog.llm.queries import word_tokenizer


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the ranking scores under the threshold.

    Null and empty texts are scored like any other, equal texts alike; a score at the threshold stays; without labels of both
    kinds every row does.
    """
    return quality.kept(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: shingles of five words, a similarity of 0.8 or more.

    Null and wordless texts are alike, one of them stays. The smallest id stays, a null id last; of rows that tie in id the one of
    the smallest text hash, of wholly equal rows one.
    """
    return simhash.deduplicated(docs, words=5, similarity=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every reported secret in the texts; no document goes. n_chars is counted anew where a text changed.

    Null texts stay null; repeated rows are changed alike; overlapping spans are replaced by one mask.
    """
    return secrets.redacted(docs).withColumn("n_chars", secrets.recounted("text", "n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's documents as often as its target asks; a document taken twice is there twice.

    A null source is a source; null texts have no words and are taken the whole number of times; rows equal in id, source and
    text are taken alike; ties in the seeded order go by id and size.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of at most 4096 tokens: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are the end token; repeated rows and null ids are packed each; only documents over a sequence are cut.
    """
    return packing.pack(docs, word_tokenizer()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the learnt ranking or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
