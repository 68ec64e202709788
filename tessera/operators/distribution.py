"""Matching by value distributions: global ranks, quantile histograms, earth mover's distance, clusters, and distances within clusters.

Histograms are over sorted boundaries, the source column is always the reference side, and both clusterings have closed forms (the distance
between histograms on equally spaced buckets is the sum of differences of their running shares; the integer program that separates
attributes has no constraints that couple its variables). What grows with the data stays in joins and aggregates; the matrix of column pairs
is as large as the schemas are and goes to the driver for thresholds and components.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number
from ..plans.profile import kept, numbered, profile
from ..sources.tables import Table
from .base import SCHEMA, Matcher

INF = float("inf")
BUCKETS = 1024
#: The most quantiles, and so bounds, of a column.
MOST = 1 << 16


def sort_value(v: Column) -> Column:
    """The number that a text begins with, as numeric sorting sees it: no exponent, no plus sign, 0 for none."""
    return F.coalesce(F.regexp_extract(v, r"^[ \t]*(-?[0-9]*\.?[0-9]*)", 1).try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))


def identity(v: Column) -> Column:
    """Texts that are the same number have the same identity."""
    n = number(v)
    return F.when(n.isNotNull(), F.concat(F.lit("n"), n.cast("string"))).otherwise(F.concat(F.lit("s"), v))


def global_ranks(values: DataFrame) -> DataFrame:
    """(value, rank) of distinct texts, by leading number, then by bytes. Texts with line breaks have no rank."""
    v = values.select("value").distinct().where(~F.col("value").contains("\n"))
    return numbered(v.withColumn("num", sort_value(F.col("value"))), "rank", F.col("num"), F.col("value")).select("value", "rank")


def column_ranks(prof: DataFrame, ranks: DataFrame) -> DataFrame:
    """(table, column, pos, key, rank, freq): texts that are the same number share the last of their ranks."""
    last = ranks.groupBy(identity(F.col("value")).alias("key")).agg(F.max("rank").alias("rank"))
    keyed = prof.withColumn("key", identity(F.col("value"))).groupBy("table", "column", "pos", "key").agg(F.sum("freq").alias("freq"))
    return keyed.join(last, "key").select("table", "column", "pos", "key", "rank", "freq")


def cut_points(ranks: DataFrame, by: list[str], quantiles: int = 256) -> DataFrame:
    """(by..., low, bounds): distinct inclusive quantiles of each group, by linear interpolation, to three decimals.

    Running counts go by buckets of the rank, so a column with very many distinct values is spread over tasks."""
    top = ranks.agg(F.max("rank")).first()[0] or 1
    r = ranks.groupBy(*by, "rank").agg(F.sum("freq").alias("freq")).withColumn("b", F.floor(F.col("rank") * BUCKETS / (top + 1)).cast("int"))
    sums = r.groupBy(*by, "b").agg(F.sum("freq").alias("n"), F.min("rank").alias("low"))
    ahead = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "b", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy(*by)).alias("total"), F.min("low").over(Window.partitionBy(*by)).alias("low"))
    within = Window.partitionBy(*by, "b").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    r = r.join(sums, [*by, "b"]).withColumn("first", F.col("before") + F.coalesce(F.sum("freq").over(within), F.lit(0)))
    # Cut point k lies at (total - 1) * k / (quantiles + 1); each value tells which of their lower and upper neighbours it is.
    parts = quantiles + 1
    # Only cut points near the value's share of the running counts are looked at.
    each = F.lit(parts) / F.greatest(F.col("total") - 1, F.lit(1))
    low_k = F.greatest(F.lit(1), F.floor((F.col("first") - 1) * each) - 1).cast("int")
    high_k = F.when(F.col("total") < 2, quantiles).otherwise(F.least(F.lit(quantiles), F.ceil((F.col("first") + F.col("freq")) * each) + 1)).cast("int")
    near = F.when(low_k <= high_k, F.sequence(low_k, F.greatest(low_k, high_k))).otherwise(F.array().cast("array<int>"))
    ks = F.transform(near, lambda k: F.struct(k.alias("k"), F.floor((F.col("total") - 1) * k / parts).alias("j"), ((F.col("total") - 1) * k % parts / parts).alias("w")))
    inside = lambda j: (j >= F.col("first")) & (j < F.col("first") + F.col("freq"))
    last = F.col("total") - 1
    found = F.filter(ks, lambda x: inside(x["j"]) | inside(F.least(x["j"] + 1, last)))
    share = lambda x: F.when(inside(x["j"]), 1 - x["w"]).otherwise(0.0) + F.when(inside(F.least(x["j"] + 1, last)), x["w"]).otherwise(0.0)
    points = r.select(*by, "low", "rank", F.explode(F.transform(found, lambda x: F.struct(x["k"].alias("k"), share(x).alias("s")))).alias("x"))
    points = points.groupBy(*by, "x.k").agg(F.bround(F.sum(F.col("rank") * F.col("x.s")), 3).alias("q"), F.min("low").alias("low"))
    return points.groupBy(*by).agg(F.min("low").alias("low"), F.array_sort(F.collect_set("q")).alias("bounds"))


def bucket_of(rank: Column, bounds: Column, most: int = 256) -> Column:
    """How many of the sorted bounds are below the rank, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.get(bounds, i + s - 1) < rank, i + s).otherwise(i))


def histograms(rows: DataFrame, bounds: DataFrame, pair: list[str]) -> DataFrame:
    """(pair..., bucket, n, mass): each pair's rows over that pair's reference bounds. A value on an edge is in the lower bucket; values
    outside are left out."""
    at = rows.join(bounds, [c for c in pair if c in bounds.columns])
    at = at.withColumns({"bucket": bucket_of(F.col("rank"), F.col("bounds"), MOST), "n": F.size("bounds")}).where("rank >= low and bucket < n")
    return at.groupBy(*pair, "bucket", "n").agg(F.sum("freq").alias("mass"))


def emd(left: DataFrame, right: DataFrame, pair: list[str]) -> DataFrame:
    """(pair..., emd) of two histograms on the same buckets; pairs without mass on one side are absent."""
    both = left.select(*pair, "bucket", "n", F.col("mass").alias("l"), F.lit(0).alias("r")).unionByName(right.select(*pair, "bucket", "n", F.lit(0).alias("l"), F.col("mass").alias("r")))
    both = both.groupBy(*pair, "bucket", "n").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    all_, run = Window.partitionBy(*pair), Window.partitionBy(*pair).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    shares = both.select(*pair, "bucket", "n", F.sum("l").over(all_).alias("tl"), F.sum("r").over(all_).alias("tr"), F.sum("l").over(run).alias("cl"), F.sum("r").over(run).alias("cr"), F.lead("bucket").over(Window.partitionBy(*pair).orderBy("bucket")).alias("next"))
    gap = F.abs(F.col("cl") / F.col("tl") - F.col("cr") / F.col("tr"))
    wide = F.coalesce("next", "n") - F.col("bucket")
    return shares.where("tl > 0 and tr > 0").groupBy(*pair).agg((F.sum(gap * wide) / F.first("n")).alias("emd"))


def cutoff(distances: list[float], threshold: float) -> float:
    """The distance before the widest gap among those up to the threshold, which is one of them itself; 0 without a gap."""
    seen = sorted(d for d in [*distances, threshold] if d <= threshold)
    gaps = [(b - a, a) for a, b in zip(seen, seen[1:], strict=False) if b > a]
    widest = max((g for g, _ in gaps), default=0.0)
    return next((a for g, a in gaps if g == widest), 0.0)


def cutoffs(nodes: list, distance: dict, threshold: float) -> dict:
    """Each node's cutoff among its distances to the others."""
    return {n: cutoff([distance[n, m] for m in nodes if (n, m) in distance], threshold) for n in nodes}


def neighbours(nodes: list, distance: dict, threshold: float) -> dict:
    """Directed edges: from each node to those within its cutoff."""
    at = cutoffs(nodes, distance, threshold)
    return {n: {m for m in nodes if (n, m) in distance and distance[n, m] <= at[n]} for n in nodes}


def connected(nodes: list, edges: dict) -> list[list]:
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, bs in edges.items():
        for b in bs:
            root[max(find(a), find(b))] = min(find(a), find(b))
    groups: dict = {}
    for n in nodes:
        groups.setdefault(find(n), []).append(n)
    return list(groups.values())


def attributes(nodes: list, near: dict) -> list[list]:
    """Nodes that are one or two steps apart belong together; components of that."""
    reach = {n: near[n] | {c for b in near[n] for c in near.get(b, ())} for n in nodes}
    return connected(nodes, reach)


PAIR = ["st", "sc", "tt", "tc"]


def ranked_columns(source: Table, target: Table) -> DataFrame:
    prof = kept(profile([source, target]))
    return kept(column_ranks(prof, global_ranks(prof)))


def sides(ranks: DataFrame, source: Table, target: Table) -> tuple[DataFrame, DataFrame]:
    s = ranks.where(F.col("table") == source.name).select(F.col("table").alias("st"), F.col("column").alias("sc"), F.col("pos").alias("sp"), "key", "rank", "freq")
    t = ranks.where(F.col("table") == target.name).select(F.col("table").alias("tt"), F.col("column").alias("tc"), F.col("pos").alias("tp"), "key", "rank", "freq")
    return s, t


def column_emd(ranks: DataFrame, source: Table, target: Table, quantiles: int = 256) -> DataFrame:
    """(st, sc, tt, tc, emd) for all pairs of a source and a target column; infinite where a histogram is empty."""
    s, t = sides(ranks, source, target)
    bounds = kept(cut_points(s, ["st", "sc"], quantiles))
    pairs = s.select("st", "sc", "sp").distinct().join(t.select("tt", "tc", "tp").distinct())
    own = histograms(s, bounds, ["st", "sc"])
    left = own.join(pairs.select(*PAIR), ["st", "sc"])
    placed = t.join(bounds)
    right = placed.withColumns({"bucket": bucket_of(F.col("rank"), F.col("bounds"), MOST), "n": F.size("bounds")}).where("rank >= low and bucket < n").groupBy(*PAIR, "bucket", "n").agg(F.sum("freq").alias("mass"))
    return pairs.join(emd(left, right, PAIR), PAIR, "left").withColumn("emd", F.coalesce("emd", F.lit(INF)))


def intersection_emd(ranks: DataFrame, source: Table, target: Table, quantiles: int = 256) -> DataFrame:
    """(st, sc, tt, tc, emd): the mean distance of both columns to the rows of either whose value they share; infinite without any."""
    s, t = sides(ranks, source, target)
    common = s.join(t.withColumnsRenamed({"rank": "r2", "freq": "f2"}), "key").select(*PAIR, "rank", (F.col("freq") + F.col("f2")).alias("freq"))
    common = kept(common)
    out = []
    for own, key in ((s, ["st", "sc"]), (t, ["tt", "tc"])):
        bounds = cut_points(own, key, quantiles)
        left = histograms(own, bounds, key).join(common.select(*PAIR).distinct(), key)
        right = histograms(common, bounds, PAIR)
        out.append(emd(left, right, PAIR))
    pairs = s.select("st", "sc", "sp").distinct().join(t.select("tt", "tc", "tp").distinct())
    both = out[0].withColumnRenamed("emd", "e1").join(out[1].withColumnRenamed("emd", "e2"), PAIR)
    return pairs.join(both, PAIR, "left").withColumn("emd", F.coalesce((F.col("e1") + F.col("e2")) / 2, F.lit(INF))).drop("e1", "e2")


def both_ways(rows) -> dict:
    out = {}
    for r in rows:
        a, b = (0, r.st, r.sc), (1, r.tt, r.tc)
        out[a, b] = out[b, a] = r.emd
    return out


def graph(first) -> tuple[list, dict]:
    """Nodes (0, table, column) and (1, table, column), and the distances both ways, of rows (st, sc, tt, tc, emd)."""
    return sorted({(0, r.st, r.sc) for r in first} | {(1, r.tt, r.tc) for r in first}), both_ways(first)


@dataclass
class DistributionBased(Matcher):
    threshold1: float = 0.15
    threshold2: float = 0.15
    quantiles: int = 256
    process_num: int = 1

    def match(self, source: Table, target: Table) -> DataFrame:
        spark = source.df.sparkSession
        if source.name == target.name:
            target = Table(f"{target.name}\x00target", target.df, target.nested)
        ranks = ranked_columns(source, target)
        first = column_emd(ranks, source, target, self.quantiles).collect()
        nodes, distance = graph(first)
        clusters = [c for c in connected(nodes, neighbours(nodes, distance, self.threshold1)) if len(c) > 1]
        pos = {(r.sc, r.tc): (r.sp, r.tp) for r in first}
        shared = both_ways(intersection_emd(ranks, source, target, self.quantiles).collect()) if clusters else {}
        rows = []
        for cluster in clusters:
            for group in attributes(cluster, neighbours(cluster, shared, self.threshold2)):
                for a in (n for n in group if n[0] == 0):
                    for b in (n for n in group if n[0] == 1):
                        rows.append((a[1], a[2], b[1].removesuffix("\x00target"), b[2], *pos[a[2], b[2]], 1 / (1 + distance[a, b])))
        return spark.createDataFrame(rows, SCHEMA)


