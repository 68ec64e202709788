"""Similarity flooding over schema graphs.

A table is a graph of identity nodes (the table, its columns, its types) and literal nodes (their names, and what kind of thing they are),
joined by labelled edges. Pairs of edges with one label make the connectivity graph; weights turn it into a propagation graph, along which
similarities flow until they settle. Graphs are as large as schemas, so the iteration is one vectorised group per pair of tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import similarity_of
from ..sources.tables import Table, catalog
from .base import SCHEMA, Matcher

POLICIES = ("inverse_average", "inverse_product")
FORMULAS = ("basic", "formula_a", "formula_b", "formula_c")
STEPS, RESIDUAL = 100, 1e-4


def schema_edges(table: Table) -> list[tuple[str, str, str, bool, str, bool]]:
    """(label, src, src_name, src_is_id, dst, ...) flattened: label, source node and destination node, each with its shown name and whether it
    is an identity. Node names carry their role, so equal texts in different roles stay apart."""
    ident = lambda role, x: (f"id:{role}:{x}", "", True)
    literal = lambda role, x: (f"{role}:{x}", x, False)
    me = ident("table", table.name)
    out = [("name", me, literal("name", table.name)), ("type", me, literal("kind", "Table"))]
    types_seen = set()
    for _, column, _, label in catalog([table], with_labels=True):
        c, t = ident("column", column), ident("type", label)
        out += [("type", c, literal("kind", "Column")), ("column", me, c), ("name", c, literal("name", column)), ("SQLtype", c, t)]
        if label not in types_seen:
            types_seen.add(label)
            out += [("type", t, literal("kind", "ColumnType")), ("name", t, literal("typename", label))]
    return [(lab, *a, *b) for lab, a, b in out]


EDGE = "label string, src string, src_name string, src_id boolean, dst string, dst_name string, dst_id boolean"


def edges(spark: SparkSession, table: Table) -> DataFrame:
    return spark.createDataFrame(schema_edges(table), EDGE)


def nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("node"), F.col("src_name").alias("name"), F.col("src_id").alias("is_id")).union(e.select("dst", "dst_name", "dst_id")).distinct()


def initial_map(e1: DataFrame, e2: DataFrame) -> DataFrame:
    """(n1, n2, sim): names' edit similarity for every pair of nodes; 0 where one is an identity."""
    a, b = nodes(e1).toDF("n1", "m1", "i1"), nodes(e2).toDF("n2", "m2", "i2")
    sim = F.when(F.col("i1") | F.col("i2"), 0.0).otherwise(similarity_of(F.levenshtein("m1", "m2"), F.col("m1"), F.col("m2")))
    return a.join(b).select("n1", "n2", sim.alias("sim"))  # both sides are as large as one schema


def connectivity(e1: DataFrame, e2: DataFrame) -> DataFrame:
    """(label, a1, a2, b1, b2): pairs of edges with one label."""
    return e1.select("label", F.col("src").alias("a1"), F.col("dst").alias("b1")).join(e2.select("label", F.col("src").alias("a2"), F.col("dst").alias("b2")), "label").select("label", "a1", "a2", "b1", "b2")


def weights(e1: DataFrame, e2: DataFrame, policy: str = "inverse_average") -> DataFrame:
    """(u1, u2, v1, v2, weight): propagation edges in both directions."""
    c = connectivity(e1, e2)
    if policy == "inverse_product":
        out = c.groupBy("label", "a1", "a2").agg(F.count("*").alias("fo"))
        into = c.groupBy("label", "b1", "b2").agg(F.count("*").alias("fi"))
        both = c.join(out, ["label", "a1", "a2"]).join(into, ["label", "b1", "b2"]).withColumns({"wf": 1.0 / F.col("fo"), "wb": 1.0 / F.col("fi")})
    elif policy == "inverse_average":
        count = lambda e, node, name: e.groupBy("label", F.col(node[0]).alias(node[1])).agg(F.count("*").alias(name))
        both = c.join(count(e1, ("src", "a1"), "o1"), ["label", "a1"]).join(count(e2, ("src", "a2"), "o2"), ["label", "a2"])
        both = both.join(count(e1, ("dst", "b1"), "i1"), ["label", "b1"]).join(count(e2, ("dst", "b2"), "i2"), ["label", "b2"])
        both = both.withColumns({"wf": 2.0 / (F.col("o1") + F.col("o2")), "wb": 2.0 / (F.col("i1") + F.col("i2"))})
    else:
        raise ValueError(f"policy must be one of {POLICIES}")
    forth = both.select(F.col("a1").alias("u1"), F.col("a2").alias("u2"), F.col("b1").alias("v1"), F.col("b2").alias("v2"), F.col("wf").alias("weight"))
    return forth.union(both.select("b1", "b2", "a1", "a2", "wb"))


def flow(start: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, inside: np.ndarray, formula: str) -> np.ndarray:
    """Similarities once they settle: the iterate before the last one. `inside` marks nodes of the propagation graph."""
    n = len(start)
    add = lambda x: np.bincount(dst, x, n)

    def step(prev: np.ndarray, how: str) -> np.ndarray:
        if how == "basic":
            new = prev + add(w * prev[src])
        elif how == "formula_a":
            new = start + add(w * prev[src])
        elif how == "formula_b":
            new = add(w * start[src])
        else:
            new = prev + add(start[src] + w * (prev[src] + start[src]))
        new = np.where(inside, new, 0.0)
        top = new.max() if n else 0
        return new / top if top > 0 else new

    prev = step(start, "formula_b") if formula in ("formula_b", "formula_c") else start.copy()
    for _ in range(STEPS - (formula in ("formula_b", "formula_c"))):
        new = step(prev, formula)
        if np.sqrt(((prev - new) ** 2).sum()) <= RESIDUAL:
            break
        prev = new
    return prev


@dataclass
class SimilarityFlooding(Matcher):
    coeff_policy: str = "inverse_average"
    formula: str = "formula_c"

    def match(self, source: Table, target: Table) -> DataFrame:
        return self.match_all([source], [target])

    def match_all(self, sources: Sequence[Table], targets: Sequence[Table]) -> DataFrame:
        """A group for each pair of tables, so a batch is spread over tasks; each table's graph is made once."""
        spark = sources[0].df.sparkSession
        if self.formula not in FORMULAS:
            return spark.createDataFrame([], SCHEMA)
        formula, p = self.formula, "id:column:"
        left, right = [(t.name, {f.name: i for i, f in t.fields}, edges(spark, t)) for t in sources], [(t.name, {f.name: i for i, f in t.fields}, edges(spark, t)) for t in targets]
        parts, of = [], {}
        for s_name, s_pos, e1 in left:
            for t_name, t_pos, e2 in right:
                g = F.lit(len(of)).alias("g")
                of[len(of)] = (s_name, s_pos, t_name, t_pos)
                none = F.lit(None).cast("string")
                parts.append(initial_map(e1, e2).select(g, "n1", "n2", none.alias("v1"), none.alias("v2"), F.col("sim").alias("x")))
                parts.append(weights(e1, e2, self.coeff_policy).select(g, F.col("u1").alias("n1"), F.col("u2").alias("n2"), "v1", "v2", F.col("weight").alias("x")))

        def settle(pdf: pd.DataFrame) -> pd.DataFrame:
            s_name, s_pos, t_name, t_pos = of[int(pdf["g"].iloc[0])]
            first = pdf[pdf["v1"].isna()].sort_values(["n1", "n2"])
            at = {k: i for i, k in enumerate(zip(first["n1"], first["n2"], strict=True))}
            go = pdf[pdf["v1"].notna()].sort_values(["n1", "n2", "v1", "v2", "x"]).drop_duplicates(["n1", "n2", "v1", "v2"], keep="last")
            src = np.array([at[k] for k in zip(go["n1"], go["n2"], strict=True)], dtype=int)
            dst = np.array([at[k] for k in zip(go["v1"], go["v2"], strict=True)], dtype=int)
            inside = np.zeros(len(at), dtype=bool)
            inside[src] = inside[dst] = True
            sim = flow(first["x"].to_numpy(), src, dst, go["x"].to_numpy(), inside, formula)
            rows = [(s_name, a[len(p) :], t_name, b[len(p) :], s_pos[a[len(p) :]], t_pos[b[len(p) :]], float(sim[i])) for (a, b), i in at.items() if a.startswith(p) and b.startswith(p)]
            return pd.DataFrame(rows, columns=["source_table", "source_column", "target_table", "target_column", "source_pos", "target_pos", "similarity"])

        return reduce(DataFrame.unionByName, parts).groupBy("g").applyInPandas(settle, SCHEMA)
