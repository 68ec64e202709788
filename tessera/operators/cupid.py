"""Matching by names and types: the linguistic phase with leaf scores.

Column names are cut into number, common and content tokens; two names are as similar as their tokens' best partners, weighted by token kind.
A pair whose types are compatible enough has lsim = name similarity * compatibility; its score is w * compatibility + (1 - w) * lsim.
Token similarity is edit similarity unless a lexicon (word1, word2, similarity) knows the pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_tokens, similarity_of
from ..sources.tables import Table, catalog
from .base import Matcher

#: The weight of each kind of token.
KINDS = (("number", 0.1), ("common", 0.1), ("content", 0.8))
#: Compatibility of a source's type label with a target's. Equal labels are 1; pairs not listed are as similar as their names.
COMPATIBLE = {
    "text": {"keyword": 1.0, "varchar": 1.0, "nvarchar": 0.9, "nchar": 0.8, "char": 0.6},
    "keyword": {"text": 1.0, "varchar": 1.0, "nvarchar": 0.9, "nchar": 0.8, "char": 0.6},
    "varchar": {"text": 1.0, "keyword": 1.0, "nvarchar": 0.9, "nchar": 0.8, "char": 0.6, "int": 0.1},
    "nvarchar": {"text": 0.9, "keyword": 0.9, "varchar": 0.9, "nchar": 0.8, "char": 0.6},
    "nchar": {"text": 0.7, "keyword": 0.7, "varchar": 0.7, "nvarchar": 1.0, "char": 0.7},
    "char": {"text": 0.7, "keyword": 0.7, "varchar": 0.7, "nchar": 0.8, "nvarchar": 0.6},
    "date": {"double": 0.1, "int": 0.1, "decimal": 0.1, "bit": 0.1},
    "double": {"date": 0.1, "float": 1.0, "decimal": 1.0},
    "decimal": {"date": 0.1, "float": 1.0, "double": 1.0},
    "int": {"date": 0.1, "long": 0.8, "short": 0.7, "smallint": 0.7, "integer": 1.0, "varchar": 0.1},
    "integer": {"date": 0.1, "long": 0.8, "short": 0.7, "smallint": 0.7, "int": 1.0},
    "bit": {"time": 0.1, "date": 0.1},
    "time": {"bit": 0.1},
    "float": {"double": 0.9},
    "long": {"short": 0.6, "int": 0.8, "bigint": 1.0, "smallint": 0.6, "integer": 0.8},
    "bigint": {"short": 0.6, "int": 0.8, "long": 1.0, "smallint": 0.6, "integer": 0.8},
    "short": {"long": 0.6, "int": 0.8, "bigint": 0.6, "smallint": 1.0, "integer": 0.8},
    "smallint": {"long": 0.6, "int": 0.8, "bigint": 0.6, "short": 1.0, "integer": 0.8},
}


def best_partners(a: Column, b: Column, lexicon: Column | None = None) -> Column:
    """Sum over the tokens of a of their best similarity to a token of b."""

    def sim(x, y):
        edit = similarity_of(F.levenshtein(x["data"], y["data"]), x["data"], y["data"])
        known = F.get(F.transform(F.filter(lexicon, lambda e: (e["word1"] == x["data"]) & (e["word2"] == y["data"])), lambda e: e["similarity"]), F.lit(0)) if lexicon is not None else F.lit(None).cast("double")
        return F.when(x["data"] == y["data"], 1.0).otherwise(F.coalesce(known, edit))

    best = F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: sim(x, y))))
    return F.aggregate(best, F.lit(0.0), lambda s, v: s + v)


def of_kind(tokens: Column, kind: str) -> Column:
    return F.filter(tokens, lambda t: t["kind"] == kind)


def name_similarity(a: Column, b: Column, lexicon: Column | None = None) -> Column:
    """Weighted mean over the kinds that both names have; 0 without any."""
    above = below = F.lit(0.0)
    for kind, weight in KINDS:
        x, y = of_kind(a, kind), of_kind(b, kind)
        both = (F.size(x) > 0) & (F.size(y) > 0)
        one = (best_partners(x, y, lexicon) + best_partners(y, x, lexicon)) / (F.size(x) + F.size(y))
        above = above + F.when(both, one * weight).otherwise(0.0)
        below = below + F.when(both, F.lit(weight)).otherwise(0.0)
    return F.when((above == 0) | (below == 0), 0.0).otherwise(above / below)


def compatibility(a: Column, b: Column) -> Column:
    """Of a source's label with a target's; the empty label fits itself only."""
    listed = F.create_map(*[F.lit(x) for s, row in COMPATIBLE.items() for t, v in row.items() for x in (f"{s} {t}", v)])
    same = F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0)
    return same.otherwise(F.coalesce(F.element_at(listed, F.concat(a, F.lit(" "), b)), similarity_of(F.levenshtein(a, b), a, b)))


def leaves(tables: list[Table], spark) -> DataFrame:
    rows = catalog(tables, with_labels=True)
    return spark.createDataFrame(rows, "table string, column string, pos int, label string").withColumn("tokens", name_tokens(F.col("column")))


@dataclass
class Cupid(Matcher):
    leaf_w_struct: float = 0.2
    w_struct: float = 0.2  # of the structural phase, which has no effect on leaves
    th_accept: float = 0.7
    th_high: float = 0.6
    th_low: float = 0.35
    c_inc: float = 1.2
    c_dec: float = 0.9
    th_ns: float = 0.7
    parallelism: int = 1
    lexicon: DataFrame | None = None

    def match(self, source: Table, target: Table) -> DataFrame:
        return self.match_all([source], [target])

    def match_all(self, sources, targets) -> DataFrame:
        spark = sources[0].df.sparkSession
        s = leaves(list(sources), spark).toDF("source_table", "source_column", "source_pos", "sl", "s_tok")
        t = leaves(list(targets), spark).toDF("target_table", "target_column", "target_pos", "tl", "t_tok")
        pairs = s.join(t)  # catalogs: as many rows as the schemas have column pairs
        words = None
        if self.lexicon is not None:
            pairs = pairs.join(self.lexicon.agg(F.collect_list(F.struct("word1", "word2", "similarity")).alias("lexicon")))
            words = F.col("lexicon")
        pairs = pairs.withColumn("compat", compatibility(F.col("sl"), F.col("tl")))
        lsim = F.when(F.col("compat") > self.th_ns, name_similarity(F.col("s_tok"), F.col("t_tok"), words) * F.col("compat")).otherwise(0.0)
        scored = pairs.withColumn("similarity", F.col("compat") * self.leaf_w_struct + lsim * (1 - self.leaf_w_struct)).where(F.col("similarity") >= self.th_accept)
        return scored.select("source_table", "source_column", "target_table", "target_column", "source_pos", "target_pos", "similarity")
