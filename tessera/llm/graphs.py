"""Connected components and membership bitmaps that no single machine has to hold whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import compact, cut, fresh


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), root being the least node of its component: large-star and small-star in turn until
    nothing changes. Links are kept in the shared folder between rounds."""
    edges = compact(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = compact(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def bitmap(hashes: DataFrame, column: str, bits: int = 1 << 25) -> np.ndarray:
    """A bit for each value of a bigint hash column, modulo `bits` (a power of two), as bytes of fixed number. Absent values may look
    present, present ones never look absent."""
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    rows = hashes.select(F.shiftright(at, 15).cast("int").alias("block"), at.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((bits >> 15, 4096), dtype=np.uint8)
    for r in rows.toLocalIterator():
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def present(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h.astype(np.int64) & np.int64(len(bits) * 8 - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


#: The largest test that `maybe_in` makes, in bits: 32 MB.
MOST = 1 << 28


def maybe_in(ids: DataFrame, column: str, rows: int | None = None):
    """A test for bigint columns: true for every value of `ids`, and by chance for few others. It has 16 bits for each of the `rows` ids and
    `MOST` at most, so every task can hold it, and rows that fail it need no join with `ids`. With more ids than it can tell apart, more
    rows take part in that join; none is lost."""
    n = ids.count() if rows is None else rows
    size = min(MOST, 1 << max(20, (16 * n).bit_length()))
    shared = ids.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64(F.col(column).cast("long")).alias("h")), "h", size))

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(present(shared.value, h.to_numpy()))

    return lambda c: test(F.xxhash64(c.cast("long")))


def left_joined(df: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """df left join right on key <=> right_key, where `right` has few of df's keys: only rows that may have a partner are moved."""
    test = maybe_in(right, right_key)
    mine: Column = test(F.col(key))
    joined = df.where(mine).join(right, F.col(key).eqNullSafe(F.col(right_key)), "left")
    rest = df.where(~mine)
    return joined.unionByName(rest, allowMissingColumns=True)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key isn't in `ids` (one column of that name, null among its values): only rows that may be in it are moved."""
    name = fresh(key)
    gone = cut(ids.select(F.col(key).alias(name)).distinct())
    mine = maybe_in(gone, name)(F.col(key))
    return df.where(~mine).union(df.where(mine).join(gone, F.col(key).eqNullSafe(F.col(name)), "left_anti"))
