"""N-gram Jaccard join by vertical partitioning.

Documents with equal shingle sets are one class. Shingles have a global order, rare ones first (frequencies estimated over all documents
by a merged sketch; the order decides the cost, not the result). The order is cut into fragments at the same pivots for all sets; a set's
part in a fragment is counted against another's by itself, and the partial overlaps are summed for each pair until the sum, or what the
fragments to come can add, decides.

Two sets over the threshold share a shingle among the first ones of both, so classes meet in the groups of these shingles; shingles
with the same classes make one group. A class is sent to a group once, never once for each partner: groups of many classes are cut into
blocks, and a task works on one pair of blocks in memory and gives back links that join components, at most one for each class. Groups are
worked on in three steps:

1. Every class's parity bitmap (about a bit for each shingle; bits that differ in two bitmaps are a lower bound of the sets' symmetric
   difference, so no link is lost) tells which classes can have a link in a group at all. Only those go on.
2. Each of them is sent, with its whole set, to one group: the largest. What links there makes components. Bitmaps tell which classes
   can still have a link to another component, other than to those met before; step 2 is taken `TURNS` times.
3. Those that are left after it go to all their groups, which ends the search.

Nulls: a null text, or one without words, has an empty set, links with nothing and is its own component. A null doc_id never names a
component unless nothing else is in it. Repeated rows are in one class. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import compact, cut, small_batches, table
from .graphs import bitmap, components, present
from .substrings import B1, I1, Rolling, mixed, texts, word_hashes

N, NUM, DEN = 4, 85, 100
CELLS, BLOCK = 1 << 22, 1 << 16
FRAGMENTS = 8
#: In so many turns a class goes to one group only, the largest.
TURNS = 2
#: A block has about so many classes, and so many shingles, at most; a single set may be larger.
CLASSES, SHINGLES = 4096, 1 << 21


def shingles(text: bytes, n: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, in hash order."""
    words = text.lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone separates
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(Rolling(word_hashes(words), B1, I1).runs(min(n, len(words))))


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def cells(s: np.ndarray, count: int = CELLS) -> np.ndarray:
    return (s >> np.uint64(11)).astype(np.int64) & np.int64(count - 1)


def batch_of(columns: list, kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def parity(s: np.ndarray, num: int, den: int) -> bytes:
    """A bit for each value of a hash's low bits: whether an odd number of the set's hashes have it. Sets that link differ in
    (den - num) / (den + num) of their shingles at most; four to eight times as many bits tell most others from them."""
    size = max(64, 1 << (8 * len(s) * (den - num) // (den + num)).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def described(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """One pass for two things: (doc_id, n, class, bits) of every document, and each partition's frequency sketch in blocks. The bitmap is
    given with a partition's first document of a class."""
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "class": pa.binary(), "bits": pa.binary(), "block": pa.int32(), "counts": pa.binary()}

    def run(batches):
        total = np.zeros(CELLS, dtype=np.uint32)
        sent: set[bytes] = set()
        for batch in batches:
            rows = []
            for key, text in texts(batch):
                s = shingles(text, n)
                np.add.at(total, cells(s), np.uint32(1))
                d = digest(s) if len(s) else None
                rows.append((key, len(s), d, None if d is None or d in sent else parity(s, num, den)))
                sent.add(d)
            if rows:
                yield batch_of([*zip(*rows, strict=True), [None] * len(rows), [None] * len(rows)], kinds)
        for b in range(CELLS // BLOCK):
            part = total[b * BLOCK : (b + 1) * BLOCK]
            if part.any():
                yield batch_of([[None], [None], [None], [None], [b], [zlib.compress(part.tobytes(), 1)]], kinds)

    return docs.mapInArrow(run, "doc_id bigint, n bigint, class binary, bits binary, block int, counts binary")


def levels(blocks: DataFrame) -> np.ndarray:
    """How frequent a cell's shingles are, as a power of two: CELLS bytes."""

    def merge(batches):
        block, total = None, None
        for pdf in batches:
            rows = []
            for b, c in zip(pdf["block"], pdf["counts"], strict=True):
                if b != block:
                    if block is not None:
                        rows.append((block, level(total)))
                    block, total = b, np.zeros(BLOCK, dtype=np.uint64)
                total += np.frombuffer(zlib.decompress(c), np.uint32)
            yield pd.DataFrame(rows, columns=["block", "level"])
        if block is not None:
            yield pd.DataFrame([(block, level(total))], columns=["block", "level"])

    def level(total: np.ndarray) -> bytes:
        return np.floor(np.log2(total.astype(float) + 1)).astype(np.uint8).tobytes()

    out = np.zeros((CELLS // BLOCK, BLOCK), dtype=np.uint8)
    for r in blocks.repartition("block").sortWithinPartitions("block").mapInPandas(merge, "block int, level binary").toLocalIterator():
        out[r.block] = np.frombuffer(r.level, np.uint8)
    return out.ravel()


def rank_keys(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Places in the global order: by level, then by hash."""
    return (level[cells(s)].astype(np.uint64) << np.uint64(56)) | (mixed(s) >> np.uint64(8))


def pivots(level: np.ndarray, fragments: int = FRAGMENTS) -> np.ndarray:
    """Where the global order is cut, so that fragments hold about as many shingles each. A level's hashes are spread evenly."""
    n = np.bincount(level, minlength=64)
    ends = np.cumsum(np.where(n > 0, n * (2.0 ** np.arange(len(n)) - 1), 0))
    out = []
    for at in np.arange(1, fragments) * ends[-1] / fragments:
        k = int(np.searchsorted(ends, at, side="right"))
        before = ends[k - 1] if k else 0.0
        inside = (at - before) / max(ends[min(k, len(ends) - 1)] - before, 1.0)
        out.append((min(k, 63) << 56) + int(inside * (2**56 - 1)))
    return np.array(out, dtype=np.uint64)


def can_link(n: int, num: int, den: int) -> bool:
    """Whether a set of n can be over the threshold with another set at all: the best other set has one shingle more."""
    return n * den >= num * (n + 1)


def first_shingles(docs: DataFrame, level, n: int, num: int, den: int) -> DataFrame:
    """(token, class, n): the shingles among which a set must share one with any set it links with. A task sends a class once."""
    kinds = {"token": pa.int64(), "class": pa.binary(), "n": pa.int64()}

    def run(batches):
        lv = level.value
        sent: set[bytes] = set()
        for batch in batches:
            token, cls, size, held = [], [], [], 0
            for _, text in texts(batch):
                s = shingles(text, n)
                if not len(s) or not can_link(len(s), num, den) or (d := digest(s)) in sent:
                    continue
                sent.add(d)
                keep = len(s) - -(-num * len(s) // den) + 1
                token.append(s[np.argsort(rank_keys(s, lv), kind="stable")[:keep]].view(np.int64))
                cls.append(d)
                size.append(len(s))
                held += keep
                if held > 200_000:
                    yield rows(token, cls, size)
                    token, cls, size, held = [], [], [], 0
            if token:
                yield rows(token, cls, size)

    def rows(token, cls, size):
        each = [len(t) for t in token]
        names = np.repeat(np.frombuffer(b"".join(cls), np.uint8).reshape(-1, 16), each, axis=0)
        names = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(np.arange(0, 16 * len(names) + 1, 16, dtype=np.int32)), pa.py_buffer(names)])
        return batch_of([np.concatenate(token), names, np.repeat(size, each)], kinds)

    return docs.mapInArrow(run, "token bigint, class binary, n bigint")


def sets(docs: DataFrame, wanted, level, cuts: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """(class, bits, edges, part): the sets of wanted documents, fragment after fragment of the global order and in hash order in each."""
    kinds = {"class": pa.binary(), "bits": pa.binary(), "edges": pa.binary(), "part": pa.binary()}

    def run(batches):
        bits, lv = wanted.value, level.value
        sent: set[bytes] = set()
        for batch in batches:
            keys = np.array([0 if k is None else k for k in batch.column(0).to_pylist()], dtype=np.int64)
            on = present(bits, mixed(keys.view(np.uint64)).view(np.int64))
            rows, held = [], 0
            for (_, text), use in zip(texts(batch), on, strict=True):
                if not use:
                    continue
                s = shingles(text, n)
                if not len(s) or (d := digest(s)) in sent:
                    continue
                sent.add(d)
                fragment = np.searchsorted(cuts, rank_keys(s, lv), side="right")
                edges = np.concatenate([[0], np.cumsum(np.bincount(fragment, minlength=len(cuts) + 1))])
                rows.append((d, parity(s, num, den), edges.astype("<i4").tobytes(), s[np.argsort(fragment, kind="stable")].tobytes()))
                held += len(s)
                if held > 1 << 20:
                    yield batch_of(list(zip(*rows, strict=True)), kinds)
                    rows, held = [], 0
            if rows:
                yield batch_of(list(zip(*rows, strict=True)), kinds)

    return docs.mapInArrow(run, "class binary, bits binary, edges binary, part binary")


def doc_bits(classes: DataFrame):
    """A test for the documents that stand for classes (class, doc_id, ...): 16 bits for each, and 32 MB at most; beyond it, documents
    that aren't wanted are read too and go out by the join on class."""

    @F.pandas_udf("bigint")
    def hashed(k: pd.Series) -> pd.Series:
        return pd.Series(mixed(k.fillna(0).to_numpy().astype(np.int64).view(np.uint64)).view(np.int64))

    size = min(1 << 28, 1 << max(20, (16 * classes.count()).bit_length()))
    return classes.sparkSession.sparkContext.broadcast(bitmap(classes.select(hashed("doc_id").alias("h")), "h", size))


class Block:
    """Classes that meet in a task: lengths, components, sides (pairs on one side meet elsewhere) and bitmaps, and the sets where exact
    overlaps are asked for."""

    def __init__(self, rows: list[tuple], num: int, den: int):
        self.num, self.den = num, den
        self.names = [r["class"] for r in rows]
        self.n = np.array([r["n"] for r in rows], dtype=np.int64)
        self.side = np.array([r["side"] for r in rows], dtype=np.int8)
        number: dict[bytes, int] = {}
        self.root = np.array([number.setdefault(r["root"], len(number)) for r in rows])
        self.apart = (self.side != 0).any()
        #: Where a class was compared before; those that were there too are in one component with it or don't link.
        self.met = [np.array([r[c] for r in rows], dtype=np.int64) for c in rows[0] if c.startswith("met")]
        by_width: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            by_width.setdefault(len(r["bits"]) // 8, []).append(i)
        #: For each width in words: who has it, and their bitmaps, one row each.
        self.bits = {w: (np.array(i), np.frombuffer(b"".join(rows[k]["bits"] for k in i), "<u8").reshape(len(i), w)) for w, i in by_width.items()}
        self.at = {k: (w, j) for w, (i, _) in self.bits.items() for j, k in enumerate(i.tolist())}
        self.parts = [np.frombuffer(r["part"], "<u8") for r in rows] if "part" in rows[0] else []
        self.edges = np.array([np.frombuffer(r["edges"], "<i4") for r in rows]) if self.parts else None

    @staticmethod
    def folded(m: np.ndarray) -> np.ndarray:
        """Bitmaps of half the width."""
        half = m.shape[-1] // 2
        return m[..., :half] ^ m[..., half:]

    def near(self, i: int, asked: np.ndarray) -> np.ndarray:
        """Those of the asked that can link with i: other component, other side, length and bitmap allow it."""
        w, j = self.at[i]
        own = self.bits[w][1][j]
        found = []
        for width, fold_own, fold_other in ((w, False, False), (w // 2, True, False), (w * 2, False, True)):
            if width not in self.bits:
                continue
            who, m = self.bits[width]
            both = self.n[who] + self.n[i]
            ok = asked[who] & (self.root[who] != self.root[i]) & (np.minimum(self.n[who], self.n[i]) * self.den >= np.maximum(self.n[who], self.n[i]) * self.num)
            for met in self.met:
                ok &= met[who] != met[i]
            if self.apart:
                ok &= self.side[who] != self.side[i]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            others = m[at]
            differ = np.bitwise_count((self.folded(others) if fold_other else others) ^ (self.folded(own) if fold_own else own)).sum(axis=1, dtype=np.int64)
            # Over the threshold means overlap >= both * num / (den + num), and the difference is both - 2 * overlap.
            found.append(who[at[differ * (self.den + self.num) <= both[at] * (self.den - self.num)]])
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def over(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that are over the threshold with i: partial overlaps, fragment by fragment, summed while it is open."""
        both = self.n[others] + self.n[i]
        o = np.zeros(len(others), dtype=np.int64)
        for f in range(self.edges.shape[1] - 1):
            own = self.parts[i][self.edges[i, f] : self.edges[i, f + 1]]
            got = [self.parts[j][self.edges[j, f] : self.edges[j, f + 1]] for j in others.tolist()]
            if len(own):
                each = np.array([len(g) for g in got])
                held = np.concatenate(got)
                o += np.bincount(np.repeat(np.arange(len(others)), each), own[np.minimum(np.searchsorted(own, held), len(own) - 1)] == held, len(others)).astype(np.int64)
            rest = np.minimum(self.n[i] - self.edges[i, f + 1], self.n[others] - self.edges[others, f + 1])
            open_ = (o + rest) * (self.den + self.num) >= both * self.num
            others, both, o = others[open_], both[open_], o[open_]
            if not len(others):
                break
        return others

    def alive(self) -> list[bytes]:
        """The classes that can have a link here."""
        on, every = np.zeros(len(self.n), dtype=bool), np.ones(len(self.n), dtype=bool)
        for i in range(len(self.n)):
            if not on[i] and len(c := self.near(i, every)):
                on[i] = True
                on[c] = True
        return [self.names[i] for i in np.flatnonzero(on)]

    def links(self) -> list[tuple[bytes, bytes]]:
        """Links that join all components here that any link joins: those found already are not compared with each other."""
        out: list[tuple[bytes, bytes]] = []
        left = np.ones(len(self.n), dtype=bool)
        members: dict[int, list[int]] = {}
        for i, r in enumerate(self.root.tolist()):
            members.setdefault(r, []).append(i)
        for first in range(len(self.n)):
            if not left[first]:
                continue
            stack = members[self.root[first]][:]
            left[stack] = False
            while stack:
                i = stack.pop()
                c = self.near(i, left)
                if len(c):
                    for j in self.over(i, c).tolist():
                        if left[j]:
                            out.append((self.names[i], self.names[j]))
                            own = members[self.root[j]]
                            left[own] = False
                            stack += own
        return out


def grouped(at: DataFrame, work, columns: list[str], schema: str, num: int, den: int) -> DataFrame:
    """Rows (token, class, n, root, m, weight, ...) of a group in one task, or in one for each pair of its blocks; `work` gets a Block."""
    blocks = F.greatest(F.ceil(F.col("m") / CLASSES), F.ceil(F.col("weight") / SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("class", "token"), F.col("k")).cast("int")
    at = at.withColumn("k", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    at = at.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("int").alias("side"), *columns)
    key = ("token", "x", "y")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64() if f.endswith("bigint") else pa.binary() for f in schema.split(", ")]

    def run(batches):
        last, rows = None, []
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                now = tuple(r[k] for k in key)
                if now != last:
                    if len(rows) > 1:
                        out += work(last[0], Block(rows, num, den))
                    last, rows = now, []
                rows.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if len(rows) > 1 and (out := work(last[0], Block(rows, num, den))):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return at.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def rooted(tokens: DataFrame, roots: DataFrame | None, *more: str) -> DataFrame:
    """Adds each class's component, and keeps groups with several."""
    if roots is None:
        at = tokens.withColumn("root", F.col("class"))
    else:
        at = tokens.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    open_ = at.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("weight")).where("lo <> hi")
    return at.select("token", "class", "n", "root", *more).join(open_.select("token", "m", "weight"), "token")


def linked(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: doc_id, n, class), (links: a, b between classes) and (roots: node, root) of the classes that have links."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = cut(described(d, n, num, den))
    members = both.where("block is null").select("doc_id", "n", "class")
    counted = levels(both.where("block is not null").select("block", "counts"))
    level, cuts = spark.sparkContext.broadcast(counted), pivots(counted)
    # A group's size and its classes' signature are found where its rows meet. Of shingles that are among the first ones of the same
    # classes, one says it all: the least is the same for all of these classes.
    first = first_shingles(d, level, n, num, den).repartition("token").groupBy("token", "class").agg(F.first("n").alias("n"))
    group = Window.partitionBy("token")
    sign = [F.bit_xor(F.xxhash64("class", F.lit(i))).over(group).alias(f"s{i}") for i in (1, 2)]
    shared = first.select("token", "class", "n", F.count("*").over(group).alias("m"), *sign).where("m > 1")
    tokens = compact(shared.groupBy("m", "s1", "s2", "class").agg(F.min("token").alias("token"), F.first("n").alias("n")).select("token", "class", "n"))
    met = tokens.select("class").distinct()
    known = cut(both.where("block is null and n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("bits", ignorenulls=True).alias("bits")).join(met, "class", "left_semi"))

    def alive(tokens: DataFrame, roots: DataFrame | None, *more: str) -> DataFrame:
        at = rooted(tokens, roots, *more).join(known.select("class", "bits"), "class")
        on = grouped(at, lambda token, block: [(token, c) for c in block.alive()], ["class", "n", "root", "bits", *more], "token bigint, class binary", num, den)
        return compact(tokens.join(on.distinct(), ["token", "class"], "left_semi"))

    def found(tokens: DataFrame, roots: DataFrame | None, *more: str) -> DataFrame:
        at = rooted(tokens, roots, *more).join(whole, "class")
        return compact(grouped(at, lambda _, block: block.links(), ["class", "n", "root", "bits", "edges", "part", *more], "a binary, b binary", num, den))

    tokens = alive(tokens, None)
    asked = known.join(tokens.select("class").distinct(), "class", "left_semi")
    whole = cut(sets(d, doc_bits(asked), level, cuts, n, num, den).join(asked.select("class"), "class", "left_semi").dropDuplicates(["class"]))
    links, roots, met = None, None, []
    for turn in range(TURNS):
        size = tokens.groupBy("token").agg(F.count("*").alias("size"))
        largest = compact(tokens.join(size, "token").groupBy("class", *met).agg(F.max(F.struct("size", "token"))["token"].alias(f"met{turn}"), F.first("n").alias("n")))
        new = found(largest.withColumn("token", F.col(f"met{turn}")), roots, *met)
        links = new if links is None else links.union(new)
        roots = compact(components(links))
        met.append(f"met{turn}")
        tokens = alive(tokens.join(largest.select("class", met[-1]), "class"), roots, *met)
    links = links.union(found(tokens, roots, *met))
    roots = compact(components(links))
    return members, links, roots


def joined(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id that links reach, the document itself included."""
    members, _, roots = linked(docs, n, num, den)
    at = members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = at.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = at.join(named, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


def brute(texts_: dict[int, str | None], n: int = N, num: int = NUM, den: int = DEN) -> dict[int, tuple[int, int]]:
    """For tests: all pairs that share a shingle, in memory."""
    sets, root = {}, {}
    post: dict = {}
    for k, t in texts_.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
        root[k] = k
        for s in sets[k]:
            post.setdefault(s, []).append(k)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        over: dict = {}
        for s in sets[a]:
            for b in post[s]:
                if b > a:
                    over[b] = over.get(b, 0) + 1
        for b, o in over.items():
            if den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}
