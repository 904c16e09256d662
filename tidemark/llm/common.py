"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: space and \t \n \x0B \f \r.
WS = "\x20\x09\x0a\x0b\x0c\x0d"
#: A word of the contracts, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a new local one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def running(df: DataFrame, by: list[str], at: str, value: str, out: str, fan: int = 1000) -> DataFrame:
    """df (one row per `by` and non-negative whole number `at`) with `out`: the sum of `value` over the rows of `by` with a smaller `at`.

    Blocks of `fan` numbers are added up first, so that a window holds one block, or one row per block, but never all rows.
    """
    block, before = free_name(df, "run_block"), free_name(df, "run_before")
    d = df.withColumn(block, F.floor(F.col(at) / fan))
    sums = d.groupBy(*by, block).agg(F.sum(value).alias(before))
    earlier = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    inside = F.sum(value).over(Window.partitionBy(*by, block).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn(out, F.coalesce(inside, F.lit(0))).join(sums, [*by, block]).withColumn(out, F.col(out) + F.col(before)).drop(block, before)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model learns from: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


_SEPARATORS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def tokens(text: str) -> list[bytes]:
    """Lower-cased words: runs of characters other than ASCII punctuation and white space, as UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(_SEPARATORS).split()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
