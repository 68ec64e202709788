"""Packing documents into sequences by cutting-stock column generation.

A document's tokens are cut into full sequences and one remainder. The remainders' length histogram is a cutting-stock problem: a linear
program over patterns of lengths that fit a sequence, whose columns come from a knapsack dynamic program on the duals. The patterns are
rounded down, what is left of the histogram is packed best-fit, and the documents, ranked within each length, are dealt to the patterns'
slots. The driver sees the histogram alone, whose size is set by the sequence length.

Nulls: a null text counts as empty; an empty text is its end mark alone. Repeated rows are packed each; extra columns are ignored; an
empty table gives an empty result. Every id lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, partitions, small_batches, table

LENGTH = 1024
#: Remainders are told apart by this many tokens: the linear program has LENGTH / GRAIN rows, and a piece wastes GRAIN / 2 tokens on average.
GRAIN = 4
END = 0
PIECES = "doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids {ids}"


class Tokens:
    """Ids of texts. The tokenizer's own vocabulary as ranks is faster and gives the same ids; texts beyond Latin-1, where the two
    libraries' character classes might differ, go to the tokenizer itself."""

    def __init__(self, name: str):
        import base64
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.full = Tokenizer.from_file(public_tokenizers.path(name))
        self.full.encode_special_tokens = True
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.full.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", length: int = LENGTH, with_ids: bool = True, narrow: bool = False) -> DataFrame:
    """Each document's pieces: full ones and the remainder. `ids` is null unless asked for. `narrow` ids are bytes: little-endian
    integers of two bytes where all ids of a piece fit, else of four."""

    def shown(one: np.ndarray):
        return (one.astype("<u2") if one.max() < 1 << 16 else one).tobytes() if narrow else one.astype("int32")

    def run(batches):
        tokens = Tokens(tokenizer)
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = np.asarray([*tokens.ids(text or ""), END], dtype="<u4")
                for at in range(0, len(ids), length):
                    one = ids[at : at + length]
                    rows.append((key, at, len(one), zlib.crc32(one.tobytes()), len(ids), shown(one) if with_ids else None))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, PIECES.format(kind=kind, ids="binary" if narrow else "array<int>"))


def knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, Counter]:
    """The most valuable multiset of sizes that fits the room."""
    use = values > 1e-12
    s, v = sizes[use], values[use]
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    ends = np.searchsorted(s, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if k := ends[c]:
            got = best[c - s[:k]] + v[:k]
            j = int(got.argmax())
            if got[j] > best[c] + 1e-12:
                best[c], last[c] = got[j], j
    pattern: Counter = Counter()
    c = room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[int(s[last[c]])] += 1
            c -= int(s[last[c]])
    return float(best[room]), pattern


def first_basis(count: dict[int, int], room: int) -> list[Counter]:
    """As many patterns as sizes: complementary sizes together, and what one of them has more of by itself."""
    out = []
    for s in sorted(count):
        t = room - s
        if t in count and t != s:
            if s < t:
                out += [Counter({s: 1, t: 1}), Counter({s: room // s}) if count[s] > count[t] else Counter({t: 1})]
        else:
            out.append(Counter({s: room // s}))
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products without BLAS, whose threads can stall beside a JVM in the same driver."""
    return np.einsum("ij,j->i", a, b) if a.ndim == 2 else np.einsum("i,ij->j", a, b)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with the largest pivot of each column."""
    n = len(matrix)
    m = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        r = k + int(np.abs(m[k:, k]).argmax())
        if r != k:
            m[[k, r]] = m[[r, k]]
        m[k] /= m[k, k]
        factor = m[:, k].copy()
        factor[k] = 0
        rows = np.flatnonzero(factor)
        m[rows] -= factor[rows, None] * m[k]
    return m[:, n:]


def column_generation(count: dict[int, int], room: int, gap: float = 0.001) -> list[tuple[Counter, float]]:
    """Patterns and how often the linear program uses them: the fewest sequences with room for every item. It ends once a lower bound, the
    ids there are or what the duals prove, is within `gap` of its value."""
    sizes = np.array(sorted(count))
    if not len(sizes):
        return []
    row = {int(s): i for i, s in enumerate(sizes)}
    need = np.array([count[int(s)] for s in sizes], dtype=float)
    column = lambda p: np.bincount([row[s] for s in p], [float(n) for n in p.values()], len(sizes))
    basis: list[Counter | None] = list(first_basis(count, room))
    matrix = np.array([column(p) for p in basis]).T
    cost = np.ones(len(sizes))
    inverse = inverted(matrix)
    x = times(inverse, need)
    bound = float((sizes * need).sum()) / room
    for step in range(1, 50 * len(sizes) + 100):
        value, duals = float((cost * x).sum()), times(cost, inverse)
        if value * (1 - gap) <= bound:
            break
        if (i := int(duals.argmin())) >= 0 and duals[i] < -1e-9:  # the surplus of this size enters: room for more of it than there is
            pattern, a = None, -np.eye(len(sizes))[i]
        else:
            best, pattern = knapsack(sizes, duals, room)
            bound = max(bound, value / max(best, 1.0))
            if best <= 1 + 1e-9 or value * (1 - gap) <= bound:
                break
            a = column(pattern)
        d = times(inverse, a)
        up = d > 1e-9
        ratio = np.full(len(x), np.inf)
        ratio[up] = np.maximum(x[up], 0) / d[up]
        r = int(ratio.argmin())
        basis[r], matrix[:, r], cost[r] = pattern, a, float(pattern is not None)
        if step % 200:
            t, pivot = ratio[r], inverse[r] / d[r]
            inverse = inverse - np.outer(d, pivot)
            inverse[r] = pivot
            x = x - t * d
            x[r] = t
        else:
            inverse = inverted(matrix)
            x = times(inverse, need)
    return [(p, float(v)) for p, v in zip(basis, x, strict=True) if p is not None and v > 1e-9]


def best_fit(count: Counter, room: int) -> Counter:
    """Patterns for what rounding leaves, which is at most a few items for each size: largest first, each where it leaves least."""
    bins: list[list[int]] = []
    free = np.zeros(sum(count.values()) + 1, dtype=int)
    for s in sorted(count.elements(), reverse=True):
        left = np.where(free[: len(bins)] >= s, free[: len(bins)], room + 1)
        k = int(left.argmin()) if len(bins) else 0
        if len(bins) and left[k] <= room:
            bins[k].append(s)
            free[k] -= s
        else:
            free[len(bins)] = room - s
            bins.append([s])
    return Counter(tuple(sorted(b, reverse=True)) for b in bins)


def plan(count: dict[int, int], room: int, gap: float = 0.001) -> list[tuple[dict[int, int], int]]:
    """Whole patterns (size -> how many of it) and how many sequences follow each; every item has exactly one slot."""
    left = Counter({s: n for s, n in count.items() if n > 0 and s < room})
    out: list[tuple[dict[int, int], int]] = [({room: 1}, count[room])] if count.get(room) else []
    for p, x in column_generation(dict(left), room, gap):
        n = min([int(x + 1e-6), *(left[s] // k for s, k in p.items())])
        if n > 0:
            out.append((dict(p), n))
            left.subtract({s: k * n for s, k in p.items()})
    return out + [(dict(Counter(b)), n) for b, n in sorted(best_fit(+left, room).items(), reverse=True)]


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, end rank, items a sequence, first sequence, first slot): at most one row for each pattern and size."""
    rows, used, sequence = [], Counter(), 0
    for p, n in patterns:
        slot = 0
        for s in sorted(p, reverse=True):
            rows.append((s, used[s], used[s] + p[s] * n, p[s], sequence, slot))
            used[s] += p[s] * n
            slot += p[s]
        sequence += n
    return rows


def pack(parts: DataFrame, length: int = LENGTH, grain: int = GRAIN, gap: float = 0.001) -> DataFrame:
    """Adds sequence_id and offset to pieces. `parts` should be cheap to read twice. Sizes are lengths in units of `grain`, rounded up."""
    spark = parts.sparkSession
    buckets = 4 * partitions(spark)
    p = parts.withColumns({"__size": F.ceil(F.col("length") / grain).cast("long"), "__bucket": F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int")})
    counts = cut(p.groupBy("__size", "__bucket").agg(F.count("*").alias("n")))
    patterns = plan({int(r["__size"]): r.n for r in counts.groupBy("__size").agg(F.sum("n").alias("n")).collect()}, length // grain, gap)
    deal = spark.createDataFrame(slots(patterns) or [(0, 0, 0, 1, 0, 0)], "size bigint, lo bigint, hi bigint, each bigint, seq bigint, slot bigint")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__size").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = p.join(counts.select("__size", "__bucket", before.alias("__before")), ["__size", "__bucket"])
    number = F.row_number().over(Window.partitionBy("__size", "__bucket").orderBy("doc_id", "start", "ids_crc32"))
    p = p.withColumn("__rank", F.col("__before") + number - 1)
    # The slots have at most a row for each pattern and size: a bound set by the sequence length alone.
    p = p.join(F.broadcast(deal), (F.col("__size") == deal["size"]) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")))
    nth = F.col("__rank") - F.col("lo")
    p = p.select(*parts.columns, (F.col("seq") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("slot") + nth % F.col("each")).alias("__slot"))
    ahead = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    return p.select(*parts.columns, "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))


def sequences(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", length: int = LENGTH) -> DataFrame:
    """Every piece with its place and its ids, as array<int>. Texts are tokenized once; places are found without the ids, which are moved
    once, to meet them."""
    parts = cut(pieces(docs, tokenizer, length, narrow=True).withColumn("__piece", F.monotonically_increasing_id()))
    placed = pack(parts.drop("ids"), length)
    joined = placed.join(parts.select("__piece", "ids"), "__piece").drop("__piece")
    return joined.withColumn("ids", unpacked(F.col("length"), F.col("ids")))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def unpacked(length: pd.Series, ids: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4").astype("int32") for n, b in zip(length, ids, strict=True)], dtype=object)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place. Tokens are read once: the pieces, without ids, are kept in the shared folder."""
    parts = cut(pieces(table(spark, sf_dir, "documents"), with_ids=False).drop("ids"))
    return pack(parts)
