"""What several operators of this sub-package share: written tables, components, features of text."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space of the contracts, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"


#: Paths of the tables that this process wrote and has not deleted.
_WRITTEN: set[str] = set()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="weftlog-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a local one on a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file://{_own_folder()}").rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for :func:`forget` to delete."""
    path = f"{shared_dir(spark)}/weftlog/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: computed once, and free of lineage.

    A lost executor costs only the tasks it was running, since the table is outside every executor.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftlog_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the table behind a frame that :func:`written` returned; no later action may read it."""
    if path := getattr(df, "_weftlog_path", None):
        _delete(df.sparkSession, path)


def forget(spark: SparkSession) -> None:
    """Delete all tables that operators have written in this process: once no frame that they returned is read any more."""
    for path in list(_WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.discard(path)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of ``edges`` (u long, v long); root is the smallest node of its component.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in MapReduce and
    Beyond" (2014): rounds grow with the logarithm of the longest path, a node's neighbours are met by joins and
    minima (never gathered in one task), and each round's edges are a written table. Loops and nulls are ignored;
    no edges give no rows.
    """
    low = F.least("u", "v")
    now = written(
        edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), low.alias("v")).distinct(), name
    )
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark.n, mark.h) == before:
            break
        before = (mark.n, mark.h)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = _with_least(large, large.groupBy("u").agg(F.min("v").alias("m")))
        small = joined.select("u", F.col("m").alias("v")).unionByName(
            joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        after = written(small.distinct(), name)
        drop_written(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with m of ``least`` (u, m).

    The planner can split the edges of a hub over tasks.
    """
    return edges.join(least.select(again("u").alias("w"), "m"), F.col("u") == F.col("w")).drop("w")


def again(key: str) -> Column:
    """A long key as an expression of itself. What is aggregated by a key and joined by this is shuffled for the join anew, so that
    both sides come straight from a shuffle, and the planner can split hot keys over tasks (adaptive skew join)."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("long"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_fields(schema: T.StructType, ddl: str) -> T.StructType:
    """A new schema: ``schema`` and the fields of ``ddl``."""
    return T.StructType(schema.fields + T.StructType.fromDDL(ddl).fields)


def boxed(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns but some as one struct, so that an operator's own columns beside it clash with no name: "_row".

    With no column left it holds a null called ``_none``.
    """
    cols = [F.col(f"`{c}`") for c in df.columns if c not in without]
    return F.struct(*cols or [F.lit(None).cast("int").alias("_none")]).alias("_row")


def unboxed(df: DataFrame, *more: str | Column) -> DataFrame:
    return df.select("_row.*", *more)
