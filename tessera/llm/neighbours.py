"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard, shard results merged.

Equal vectors are one node with its smallest ids, as many as a result can hold, so a very common vector costs one node. Nodes are dealt to
shards of about `shard_size` by a hash. In a shard, inner product is turned into distance by one more component that gives all vectors
the same length; each layer links a node to diverse near nodes and back, in one flat array of neighbours a layer. An index is a row:
vectors, ids and neighbour arrays. Queries are sent to every shard, a task reads one index and then its queries block by block, which go
down the layers by beam search; the best of all shards are merged by partial top-k. The graph is searched in single precision, on
vectors scaled to at most 1; scores are inner products of the original vectors in double precision.

Vectors that are null, zero, empty or hold null or non-finite components take no part. Vectors of different lengths don't meet. Rows with
a null id take no part; rows that repeat id and vector count once; an id with two vectors is two candidates, and no candidate of a query
has the query's id. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARD, LINKS, BEAM, POOL, BLOCK = 16_384, 16, 96, 48, 256
#: Queries in a row, and rows for each copy of an index.
QUERIES, ROWS = 1024, 32


def usable(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))


def diverse(near: np.ndarray, sim: np.ndarray, x: np.ndarray, links: int) -> np.ndarray:
    """Of each row's candidates (best first), those nearer to the node than to any one taken before; then the rest, up to `links`."""
    out = np.full((len(near), links), -1, dtype=np.int32)
    for at in range(0, len(near), BLOCK):
        c, s = near[at : at + BLOCK], sim[at : at + BLOCK]
        g = x[np.maximum(c, 0)]
        between = np.einsum("bid,bjd->bij", g, g, optimize=True)
        taken = np.zeros(c.shape, dtype=bool)
        for j in range(c.shape[1]):
            nearer = (taken & (between[:, j] > s[:, j, None])).any(axis=1)
            taken[:, j] = ~nearer & (c[:, j] >= 0) & (taken.sum(axis=1) < links)
        order = np.argsort(~taken, axis=1, kind="stable")[:, :links]
        picked = np.take_along_axis(c, order, axis=1)
        out[at : at + BLOCK, : picked.shape[1]] = picked
    return out


def layer(x: np.ndarray, nodes: np.ndarray, links: int) -> np.ndarray:
    """Flat neighbour array (a row of 2 * links for each of `nodes`, -1 behind the last): forward links, then links back."""
    k = min(POOL, len(nodes) - 1)
    width = 2 * links
    flat = np.full((len(nodes), width), -1, dtype=np.int32)
    if k < 1:
        return flat
    own = x[nodes]
    near, sim = np.empty((len(nodes), k), dtype=np.int32), np.empty((len(nodes), k), dtype=np.float32)
    for at in range(0, len(nodes), BLOCK):
        s = own[at : at + BLOCK] @ own.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        got = np.take_along_axis(s, top, axis=1)
        order = np.argsort(-got, axis=1, kind="stable")
        near[at : at + BLOCK], sim[at : at + BLOCK] = np.take_along_axis(top, order, axis=1), np.take_along_axis(got, order, axis=1)
    forward = diverse(near, sim, own, min(links, k))
    src = np.repeat(np.arange(len(nodes)), forward.shape[1])
    dst = forward.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    kind = np.repeat([0, 1], len(src))
    score = np.einsum("ij,ij->i", own[a], own[b])
    order = np.lexsort((-score, kind, a))
    a, b = a[order], b[order]
    first = np.r_[True, a[1:] != a[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
    rank = np.arange(len(a)) - start
    fits = rank < width
    flat[a[fits], rank[fits]] = nodes[b[fits]]
    return flat


def scaled(v: np.ndarray) -> np.ndarray:
    """Single precision at a scale where no component is above 1; neither vectors' nor queries' scale changes the order of scores."""
    return (v / max(np.abs(v).max(), np.finfo(np.float64).tiny)).astype(np.float32)


def build(ids: list[list[int]], v: np.ndarray, links: int = LINKS) -> dict:
    """An index over one shard: `layers` from the top down, each (nodes, flat neighbours); `row` finds a node in its layer."""
    exact, v = v, scaled(v)
    square = np.einsum("ij,ij->i", v, v)
    x = np.column_stack([v, np.sqrt(np.maximum(square.max() - square, 0))]).astype(np.float32)
    h = np.array([i[0] for i in ids], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    u = ((h >> np.uint64(11)).astype(float) + 0.5) / 2**53
    level = np.minimum((-np.log(u) / np.log(links)).astype(int), 6)
    layers = []
    for at in range(level.max(), -1, -1):
        nodes = np.flatnonzero(level >= at).astype(np.int32)
        layers.append((nodes, layer(x, nodes, links)))
    single = exact.astype(np.float32)
    return {"ids": ids, "v": v, "exact": single if (single == exact).all() else exact, "layers": layers}


def beam(v: np.ndarray, q: np.ndarray, nodes: np.ndarray, flat: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Best nodes of one layer for each query, best first (-1 behind the last). start: (queries, entries)."""
    n, rows = len(v), np.arange(len(q))[:, None]
    row = np.full(n, -1, dtype=np.int32)
    row[nodes] = np.arange(len(nodes))
    seen = np.zeros((len(q), n + 1), dtype=bool)
    best = np.full((len(q), width), -1, dtype=np.int32)
    best[:, : start.shape[1]] = start
    sim = np.where(best >= 0, np.einsum("qd,qkd->qk", q, v[np.maximum(best, 0)]), -np.inf)
    done = best < 0
    seen[rows, np.where(best >= 0, best, n)] = True
    seen[:, n] = True
    while True:
        pick = np.where(done, -np.inf, sim).argmax(axis=1)
        open_ = np.flatnonzero(~done[np.arange(len(q)), pick])
        if not len(open_):
            return np.take_along_axis(best, np.argsort(-sim, axis=1, kind="stable"), axis=1)
        done[open_, pick[open_]] = True
        around = flat[row[best[open_, pick[open_]]]]
        around = np.where(seen[open_[:, None], around], -1, around)
        seen[open_[:, None], around] = True
        new = np.where(around >= 0, np.einsum("qd,qkd->qk", q[open_], v[np.maximum(around, 0)]), -np.inf)
        # A node that two links of one row lead to would come twice.
        order = np.argsort(around, axis=1, kind="stable")
        sorted_ = np.take_along_axis(around, order, axis=1)
        twice = np.zeros_like(around, dtype=bool)
        np.put_along_axis(twice, order[:, 1:], (sorted_[:, 1:] == sorted_[:, :-1]), axis=1)
        new[twice] = -np.inf
        b = np.concatenate([best[open_], np.where(np.isfinite(new), around, -1)], axis=1)
        s = np.concatenate([sim[open_], new], axis=1)
        d = np.concatenate([done[open_], ~np.isfinite(new)], axis=1)
        keep = np.argpartition(-s, width - 1, axis=1)[:, :width]
        best[open_], sim[open_], done[open_] = (np.take_along_axis(z, keep, axis=1) for z in (b, s, d))


def search(index: dict, q: np.ndarray, k: int, width: int = BEAM) -> list[list[tuple[int, float]]]:
    """The k best (id, score) of one shard for each query, ties to the smaller id."""
    v = index["v"]
    out = []
    for at in range(0, len(q), BLOCK):
        whole = q[at : at + BLOCK]
        part = scaled(whole)
        start = np.repeat(index["layers"][0][0][None, :1], len(part), axis=0)
        for i, (nodes, flat) in enumerate(index["layers"]):
            last = i == len(index["layers"]) - 1
            got = beam(v, part, nodes, flat, start, max(width, k) if last else 16)
            start = got[:, : max(1, int((got >= 0).sum(axis=1).min()))]
        for one, found in zip(whole, got, strict=True):
            found = found[found >= 0]
            scores = (index["exact"][found].astype(np.float64) * one).sum(axis=1)
            pairs = [(i, float(s)) for f, s in zip(found, scores, strict=True) for i in index["ids"][f]]
            out.append(sorted(pairs, key=lambda p: (-p[1], p[0]))[:k])
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vec: str = "embedding", shard_size: int = SHARD, width: int = BEAM) -> DataFrame:
    """(query_id, rank, id, score) for each row of `queries` against all of `vectors`, the query's own id left out."""
    spark = vectors.sparkSession
    v = usable(vectors, key, vec).distinct().withColumn("h", F.xxhash64("v"))
    few = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    nodes = cut(v.withColumn("n", few).where(F.col("n") <= k + 1).groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    shards = {r.dim: max(1, -(-r.n // shard_size)) for r in nodes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    many = F.element_at(F.create_map(*[F.lit(x) for pair in shards.items() for x in pair]), F.size("v"))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=[i[0] for i in pdf["ids"]]).sort_values("first")
        made = build([[int(i) for i in x] for x in pdf["ids"]], np.stack(pdf["v"]).astype(np.float64))
        return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "index": [pickle.dumps(made)]})

    placed = nodes.select("ids", "v", F.size("v").alias("dim"), F.pmod("h", many).cast("int").alias("shard"))
    indexes = cut(placed.groupBy("dim", "shard").applyInPandas(index, "dim int, shard int, index binary"))
    asked = usable(queries, key, vec).distinct().withColumn("h", F.xxhash64("v"))
    classes = asked.groupBy("h", "v").agg(F.min("id").alias("asker"))
    few_rows = max(1, -(-classes.count() // QUERIES))
    blocks = classes.withColumns({"dim": F.size("v"), "block": F.pmod("h", F.lit(few_rows)).cast("int")})
    blocks = blocks.groupBy("dim", "block").agg(F.collect_list(F.struct("asker", "v")).alias("q"))
    # An index is sent once for every ROWS rows of queries; a row of queries once to each shard.
    copies = max(1, -(-few_rows // ROWS))
    rows = blocks.join(indexes.select("dim", "shard"), "dim").select("dim", "shard", F.pmod("block", F.lit(copies)).alias("copy"), F.lit(None).cast("binary").alias("index"), "q")
    tables = indexes.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "index", F.lit(None).cast("array<struct<asker:bigint,v:array<double>>>").alias("q"))
    both = tables.union(rows).repartition("dim", "shard", "copy").sortWithinPartitions("dim", "shard", "copy", F.col("index").isNull())

    def run(batches):
        held = None
        for pdf in batches:
            for blob, qs in zip(pdf["index"], pdf["q"], strict=True):
                if blob is not None:
                    held = pickle.loads(blob)
                    continue
                got = search(held, np.stack([r["v"] for r in qs]), k + 1, width)
                found = [(r["asker"], i, x) for r, best in zip(qs, got, strict=True) for i, x in best]
                yield pd.DataFrame(found, columns=["asker", "id", "score"])

    best = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "id"))
    found = both.select("index", "q").mapInPandas(run, "asker long, id long, score double")
    found = found.withColumn("place", best).where(F.col("place") <= k + 1)
    best = found.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("best"))
    members = asked.join(classes, ["h", "v"]).select("id", "asker")
    each = members.join(best, "asker").select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda b: b["id"] != F.col("id")), 1, k).alias("b"))
    return each.select("query_id", F.posexplode("b").alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.id").alias("id"), F.col("b.score").alias("score"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all other vectors for every row whose vec_id is divisible by 20."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(v, v.where(F.col("vec_id") % 20 == 0), 20).withColumnRenamed("id", "vec_id")
