"""Column profiles: what all matchers on values start from, and numbering rows at any size."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Table


def kept(df: DataFrame) -> DataFrame:
    """The rows computed once and kept in the shared folder, so that a lost executor costs nothing upstream."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        there = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if there is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(there or tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint(eager=True)


def cells(tables: Iterable[Table]) -> DataFrame:
    return reduce(DataFrame.union, [t.cells() for t in tables])


def profile(tables: Iterable[Table]) -> DataFrame:
    """(table, column, pos, value, freq): distinct values of every column. Counts are combined before they are moved."""
    return cells(tables).groupBy("table", "column", "pos", "value").agg(F.count("*").alias("freq"))


def column_stats(tables: Iterable[Table]) -> DataFrame:
    """(table, column, pos, rows, distinct) for every column that has values."""
    return profile(tables).groupBy("table", "column", "pos").agg(F.sum("freq").alias("rows"), F.count("*").alias("distinct"))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds a row number from 1 in a global order, without bringing all rows to one task: range partitions are numbered by themselves and
    moved on by the sizes of those before them."""
    parts = kept(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__row", number).join(F.broadcast(sizes), "__part").withColumn(name, F.col("__before") + F.col("__row")).drop("__part", "__row", "__before")
