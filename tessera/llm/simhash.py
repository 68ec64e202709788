"""Document fingerprints: 128-bit SimHash in DataFrame functions alone.

A text's terms are its word pairs (its last word counts alone), weighted by the length of their words, so that short function words say
little. Each term's two 64-bit hashes vote on 128 signed bits; a bit is set where the votes for it hold more than half of the weight.
Votes are counted two bits to a 64-bit sum (32 bits each, enough for 10**8 words a document). Texts without words get zeros.

`within` finds all fingerprints within a Hamming radius by permuted block tables: a fingerprint is cut into two blocks more than the
radius, each table leads with a choice of two of them, and two fingerprints within the radius agree on the lead of one table at least.

Nulls: a null text counts as empty, a null doc_id sorts behind all others. Repeated rows stay apart and follow each other in text order.
Extra columns are ignored; a table of one row follows itself; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

LANES = 4294967297  # bits j and j + 32
LEAST = -(2**63)
TRIM = " \t\n\x0b\x0c\r"
BITS = 128


def terms(t: Column) -> Column:
    """Words of a text without the empty ones that splitting leaves at its ends."""
    trimmed = F.btrim(t, F.lit(TRIM))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def weighted_pairs(words: str) -> Column:
    pair = lambda a, b: F.struct(F.xxhash64(a, b).alias("h1"), F.xxhash64(b, F.lit(1), a).alias("h2"), F.least(F.length(a) + F.coalesce(F.length(b), F.lit(0)), F.lit(16)).cast("long").alias("w"))
    return F.zip_with(F.col(words), F.slice(F.col(words), 2, F.size(words)), pair)


def votes() -> list[Column]:
    sums = [F.sum(F.shiftrightunsigned(f"t.h{k}", j).bitwiseAND(F.lit(LANES)) * F.col("t.w")).alias(f"s{k}_{j}") for k in (1, 2) for j in range(32)]
    return [F.sum("t.w").alias("total"), *sums]


def half(k: int) -> Column:
    """64 of the bits from the sums."""
    low = lambda j: F.col(f"s{k}_{j}").bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda j: F.shiftrightunsigned(f"s{k}_{j}", 32)
    bit = lambda votes, j: F.when(votes * 2 > F.col("total"), F.lit(1 << j if j < 63 else LEAST)).otherwise(F.lit(0))
    return reduce(lambda a, b: a.bitwiseOR(b), [bit(low(j), j) for j in range(32)] + [bit(high(j), j + 32) for j in range(32)])


def text_of(f1: Column, f2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def likeness(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return 1.0 - (F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))) / F.lit(float(BITS))


def fingerprints(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each combination of `keys`, which must tell rows apart, with f1 and f2: the two halves of its fingerprint."""
    parted = df.select(*keys, terms(F.coalesce(F.col(text), F.lit(""))).alias("words"))
    exploded = parted.select(*keys, F.explode_outer(weighted_pairs("words")).alias("t"))
    return exploded.groupBy(*keys).agg(*votes()).select(*keys, half(1).alias("f1"), half(2).alias("f2"))


def in_order(docs: DataFrame, rows_each: int = 2000, most: int = 16384) -> DataFrame:
    """(bucket, rid, ghost, doc_id, text): each document with its successor by descending doc_id behind it in the same bucket.

    Buckets are ranges of doc_id of about `rows_each` rows, `most` at most; their bounds come from one aggregate over the ids. The first
    row of a bucket also goes, as a ghost, to the end of the bucket that precedes it. So the texts are moved once."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = d.select("id")
    n = ids.count()
    buckets = max(1, min(most, -(-n // rows_each)))
    bounds = []
    if buckets > 1:
        points = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(ids.agg(F.percentile_approx("id", points, 20 * buckets + 1000).alias("b")).first().b or []))
    steps = max(1, len(bounds).bit_length())
    csv = ",".join(map(str, bounds + [2**63 - 1] * (2**steps - len(bounds))))
    # Binary search: how many bounds are at most the id.
    bucket = F.expr(f"aggregate(sequence({steps - 1}, 0, -1), 0, (at, s) -> at + if(cast(split('{csv}', ',') as array<bigint>)[at + shiftleft(1, s) - 1] <= id, shiftleft(1, s), 0))")
    d = d.withColumn("bucket", bucket)
    firsts = sorted((r.bucket, r.id) for r in d.groupBy("bucket").agg(F.max("id").alias("id")).collect())
    goes = {b: firsts[(i + 1) % len(firsts)][0] for i, (b, _) in enumerate(firsts)}
    where = F.expr("cast(split('" + ",".join(str(goes.get(b, -1)) for b in range(len(bounds) + 2)) + "', ',') as array<int>)")
    largest = F.expr("cast(split('" + ",".join(str(dict(firsts).get(b, LEAST)) for b in range(len(bounds) + 2)) + "', ',') as array<bigint>)")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.get(where, F.col("bucket")).alias("bucket"), F.lit(1).alias("ghost"))
    d = d.select("id", "doc_id", "text", F.explode(F.when(F.col("id") == F.get(largest, F.col("bucket")), F.array(own, ghost)).otherwise(F.array(own))).alias("at"))
    w = Window.partitionBy("bucket").orderBy("ghost", F.desc("id"), "text")
    return d.select("id", "doc_id", "text", "at.*").withColumns({"rid": F.row_number().over(w), "next": F.lead("text").over(w)})


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text (f1 and f2 are its halves) and of its edited text, and their likeness to each other and to the next
    document's."""
    n = F.length("text")
    part = F.floor(n / 2).cast("int")
    rows = in_order(docs).withColumn("edited", F.when(F.col("ghost") == 0, F.concat(F.substring("text", F.lit(1), n - part), F.substring(F.coalesce("next", F.lit("")), F.lit(1), part))))
    keys = ["bucket", "rid", "ghost", "doc_id", "n_chars", "sha"]
    both = F.when(F.col("ghost") == 0, F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t"))))
    rows = rows.select("bucket", "rid", "ghost", "doc_id", n.cast("long").alias("n_chars"), F.unhex(F.sha2("edited", 256)).alias("sha"), F.explode(both).alias("x"))
    prints = fingerprints(rows.select(*keys, "x.kind", F.col("x.t").alias("text")), [*keys, "kind"])
    pick = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    one = prints.groupBy(*keys).agg(pick("f1", 0).alias("a1"), pick("f2", 0).alias("a2"), pick("f1", 1).alias("e1"), pick("f2", 1).alias("e2"))
    w = Window.partitionBy("bucket").orderBy("rid")
    one = one.withColumns({"n1": F.lead("a1").over(w), "n2": F.lead("a2").over(w)}).where("ghost = 0")
    a, e, b = (F.col("a1"), F.col("a2")), (F.col("e1"), F.col("e2")), (F.col("n1"), F.col("n2"))
    return one.select("doc_id", F.col("a1").alias("f1"), F.col("a2").alias("f2"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), text_of(*a).alias("fingerprint"), text_of(*e).alias("edited_fingerprint"), likeness(*a, *e).alias("near_edited"), likeness(*a, *b).alias("near_next"))


def block_tables(radius: int, blocks: int) -> list[tuple[int, int]]:
    """The tables' bits, as masks of f1 and of f2: one table for each choice of blocks - radius of the blocks. Fingerprints within the
    radius differ in `radius` blocks at most, so they agree on all bits of one table at least."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("blocks must be more than the radius, and 128 at most")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    runs = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [(signed(m >> 64), signed(m & (1 << 64) - 1)) for m in map(sum, combinations(runs, blocks - radius))]


def within(prints: DataFrame, radius: int = 3, blocks: int | None = None, each: int = 2000) -> DataFrame:
    """(a1, a2, b1, b2, distance): each ordered pair of different fingerprints within `radius` bits, once, for distinct rows (f1, f2).

    Fingerprints that agree on a table's bits meet in an equi-join; of the tables on which a pair agrees the first gives it. Values of
    more than `each` fingerprints and of more than a thousandth of all rows, a thousand values at most, are dealt over a grid of tasks."""
    masks = block_tables(radius, radius + 2 if blocks is None else blocks)
    entry = lambda k, m: F.struct(F.lit(k).alias("k"), F.col("f1").bitwiseAND(F.lit(m[0])).alias("m1"), F.col("f2").bitwiseAND(F.lit(m[1])).alias("m2"))
    tables = prints.select("f1", "f2", F.explode(F.array(*[entry(k, m) for k, m in enumerate(masks)])).alias("t")).select("f1", "f2", "t.*")
    key = ["k", "m1", "m2"]
    limit = max(each, prints.count() * len(masks) // 1000)
    hot = tables.groupBy(*key).count().where(F.col("count") > limit).select(*key, F.ceil(F.sqrt(F.col("count") / limit)).alias("g"))
    dealt = tables.join(F.broadcast(hot), key, "left").withColumn("g", F.coalesce("g", F.lit(1).cast("long")))
    own, every = F.pmod(F.xxhash64("f1", "f2"), F.col("g")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))
    side = lambda p, row, column: dealt.select(*[F.col(c).alias(p + c) for c in key], F.col("f1").alias(p + "1"), F.col("f2").alias(p + "2"), row.alias(p + "row"), column.alias(p + "column"))
    d1, d2 = F.col("a1").bitwiseXOR(F.col("b1")), F.col("a2").bitwiseXOR(F.col("b2"))
    distance = F.bit_count(d1) + F.bit_count(d2)
    agreed = F.coalesce(*[F.when((d1.bitwiseAND(F.lit(m[0])) == 0) & (d2.bitwiseAND(F.lit(m[1])) == 0), F.lit(k)) for k, m in enumerate(masks)])
    meet = reduce(lambda x, y: x & y, [F.col("a" + c) == F.col("b" + c) for c in [*key, "row", "column"]])
    got = side("a", own, every).join(side("b", every, own), meet & distance.between(1, radius) & (agreed == F.col("ak")))
    return got.select("a1", "a2", "b1", "b2", distance.alias("distance"))


def near_pairs(prints: DataFrame, radius: int = 3, key: str = "doc_id", blocks: int | None = None, each: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Classes of equal fingerprints and the pairs of classes within `radius` bits of each other.

    Returns (members: key, class), a class being the smallest key with that fingerprint, and (pairs: a, b, distance), each once, a < b.
    Keys must not be null."""
    first = cut(prints.groupBy("f1", "f2").agg(F.min(key).alias("class")))
    members = prints.join(first, ["f1", "f2"]).select(key, "class")
    named = lambda p: first.select(F.col("f1").alias(p + "1"), F.col("f2").alias(p + "2"), F.col("class").alias(p))
    pairs = within(first.select("f1", "f2"), radius, blocks, each).join(named("a"), ["a1", "a2"]).join(named("b"), ["b1", "b2"])
    return members, pairs.where("a < b").select("a", "b", "distance")


def with_neighbours(rows: DataFrame, radius: int = 3, blocks: int | None = None, each: int = 2000) -> DataFrame:
    """`rows` (doc_id, f1, f2 and others, kept in the shared folder) with class_id, the smallest doc_id of equal fingerprint (null if all
    are null), and n_near, the number of other fingerprints within `radius` bits of it.

    Fingerprints of more than a thousandth of all rows, a thousand at most, are sent to the rows; the other rows meet theirs in a join."""
    classes = cut(rows.groupBy("f1", "f2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows")))
    found = within(classes.select("f1", "f2"), radius, blocks, each).groupBy(F.col("a1").alias("f1"), F.col("a2").alias("f2")).agg(F.count("*").alias("n_near"))
    known = cut(classes.join(found, ["f1", "f2"], "left").select("f1", "f2", "class_id", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "rows"))
    most = (known.agg(F.sum("rows")).first()[0] or 0) // 1000
    hot, rest = known.where(F.col("rows") > most).drop("rows"), known.where(F.col("rows") <= most).drop("rows")
    return rows.join(F.broadcast(hot), ["f1", "f2"]).unionByName(rows.join(F.broadcast(hot.select("f1", "f2")), ["f1", "f2"], "left_anti").join(rest, ["f1", "f2"]))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and the number of other fingerprints within three bits of a document's."""
    prints = cut(compared(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return with_neighbours(prints).drop("f1", "f2")
