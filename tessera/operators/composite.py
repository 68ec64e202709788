"""A composite matcher in the manner of published combined matchers: names, tokens, types and paths, and with instances also values.

Each measure scores every column pair; their mean is the pair's score. A pair stays if it is among the best `max_n` of both of its columns
(0: any number) and reaches the threshold. Value evidence is the cosine of TF-IDF vectors of value tokens over columns as documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.profile import cells
from ..sources.tables import Table
from .base import Matcher
from .cupid import compatibility, leaves, name_similarity


def grams(name: Column, n: int = 3) -> Column:
    s = F.concat(F.lit("  "), F.lower(name), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n))))


def dice(a: Column, b: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(a, b)) / F.greatest(F.size(a) + F.size(b), F.lit(1))


def token_vectors(tables: list[Table], side: str) -> DataFrame:
    """(table, column, token, tf): counts of value tokens, combined before they are moved."""
    words = F.explode(F.array_distinct(F.filter(F.split(F.lower("value"), r"[^\p{L}\p{N}]+"), lambda w: w != "")))
    return cells(tables).select("table", "column", words.alias("token")).groupBy("table", "column", "token").agg(F.count("*").alias("tf")).withColumn("side", F.lit(side))


def value_cosine(sources: list[Table], targets: list[Table]) -> DataFrame:
    both = token_vectors(sources, "s").unionByName(token_vectors(targets, "t"))
    n = both.select("side", "table", "column").distinct().count()
    idf = both.groupBy("token").agg(F.log((F.lit(n) + 1) / (F.count("*") + 1)).alias("idf")).withColumn("idf", F.col("idf") + 1)
    w = both.join(idf, "token").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = w.groupBy("side", "table", "column").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = w.join(norm, ["side", "table", "column"]).withColumn("w", F.col("w") / F.col("norm"))
    s = w.where("side = 's'").select("token", F.col("table").alias("source_table"), F.col("column").alias("source_column"), F.col("w").alias("ws"))
    t = w.where("side = 't'").select("token", F.col("table").alias("target_table"), F.col("column").alias("target_column"), F.col("w").alias("wt"))
    return s.join(t, "token").groupBy("source_table", "source_column", "target_table", "target_column").agg(F.sum(F.col("ws") * F.col("wt")).alias("value_sim"))


@dataclass
class Composite(Matcher):
    max_n: int = 0
    use_instances: bool = False
    java_xmx: str = "1024m"  # kept for callers that set it
    threshold: float = 0.4

    def match(self, source: Table, target: Table) -> DataFrame:
        return self.match_all([source], [target])

    def match_all(self, sources, targets) -> DataFrame:
        spark = sources[0].df.sparkSession
        s = leaves(list(sources), spark).toDF("source_table", "source_column", "source_pos", "sl", "s_tok")
        t = leaves(list(targets), spark).toDF("target_table", "target_column", "target_pos", "tl", "t_tok")
        pairs = s.join(t)  # catalogs
        path = dice(grams(F.concat_ws(" ", "source_table", "source_column")), grams(F.concat_ws(" ", "target_table", "target_column")))
        parts = [dice(grams(F.col("source_column")), grams(F.col("target_column"))), name_similarity(F.col("s_tok"), F.col("t_tok")), compatibility(F.col("sl"), F.col("tl")), path]
        if self.use_instances:
            pairs = pairs.join(value_cosine(list(sources), list(targets)), ["source_table", "source_column", "target_table", "target_column"], "left")
            parts.append(F.coalesce("value_sim", F.lit(0.0)))
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        scored = pairs.withColumn("similarity", total / len(parts)).where(F.col("similarity") >= self.threshold)
        if self.max_n > 0:
            one = F.row_number().over(Window.partitionBy("source_table", "source_column", "target_table").orderBy(F.desc("similarity"), "target_pos"))
            two = F.row_number().over(Window.partitionBy("target_table", "target_column", "source_table").orderBy(F.desc("similarity"), "source_pos"))
            scored = scored.withColumns({"r1": one, "r2": two}).where((F.col("r1") <= self.max_n) & (F.col("r2") <= self.max_n))
        return scored.select("source_table", "source_column", "target_table", "target_column", "source_pos", "target_pos", "similarity")
