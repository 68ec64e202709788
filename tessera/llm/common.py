"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word pattern `[^\x20\x09-\x0D]+` leaves it out. bytes.split() splits at the same six bytes.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run in one process."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if there is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
        there = sc.getCheckpointDir()
    return there


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 1 << 22) -> None:
    """Texts go to Python in batches of so many rows and about so many bytes at most (a longer text goes by itself; a bound on bytes that the
    session has set stays), which keeps workers small beside a full executor heap."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the shared folder from then on, so a lost executor costs nothing upstream."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """`cut`, then read in no more partitions than its rows ask for: a small table, as links are at first, goes through joins in few tasks
    and leaves few files, a large one stays as it is."""
    kept = cut(df)
    return kept.coalesce(max(1, -(-kept.count() // rows)))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def n_words(c: Column) -> Column:
    """Their number; 0 for null."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def fresh(prefix: str) -> str:
    """A column name that clashes with no column of a caller's table."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
