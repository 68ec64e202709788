"""Mixing sources to target weights under a time-varying curriculum.

A source's target is its weight's share of the mix's words; none goes above `cap` times the source's own size, and what is cut off goes
to the others by weight until none is above. A source's stream is its documents in an order by hash, repeated; the mix takes the first
`target` words of it, so the document at the end may give its first words only. Each source has a weight schedule over training time
0..1 (linear from `start` to `end`); its integral is the source's cumulative token demand, and inverting it at the middle of a document's
place in the stream gives the document's training position. The mix is the documents sorted by position.

Nulls: a null text has size 0; null sources are one source, last in order. A document of size 0 takes nothing. Repeated rows each count;
ties in the order by hash are broken by doc_id, then size, and rows that are equal in all of it are interchangeable. Internal columns
begin with `__mix_`; a table with a column named like a result (source_size, target, taken, parts) is refused by `mix`, while `curriculum`
takes any names and returns them as they were. An empty table gives an empty result. The order by hash doesn't depend on partitions, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, n_words, table, words

#: Weights of the sources in order by code point, repeating, and the schedule of each (weight at the start, weight at the end).
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))
#: Documents in a range of the hash, about.
EACH = 2048


def pick(values: Sequence[float], rank: str) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), (F.col(rank) % len(values)).cast("int"))


def ranked(small: DataFrame, *order: Column) -> DataFrame:
    """Adds `rank` (from 0) in the given order: range partitions, then a row number in each and the sizes of those before it."""
    parts = cut(small.repartitionByRange(*order).withColumn("__mix_part", F.spark_partition_id()))
    sizes = parts.groupBy("__mix_part").agg(F.count("*").alias("__mix_n"))
    before = F.coalesce(F.sum("__mix_n").over(Window.orderBy("__mix_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__mix_part", before.alias("__mix_before"))
    number = F.row_number().over(Window.partitionBy("__mix_part").orderBy(*order))
    return parts.withColumn("__mix_row", number).join(sizes, "__mix_part").withColumn("rank", F.col("__mix_before") + F.col("__mix_row") - 1).drop("__mix_part", "__mix_row", "__mix_before")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From (source, source_size): adds rank and target. Each round of resharing is one aggregate over the sources; only sums come back."""
    s = cut(ranked(sizes, F.col("source").isNull(), F.col("source")).withColumn("weight", pick(weights, "rank")))
    total, all_weight, n = s.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    level, capped = (share * (total or 0) / all_weight if all_weight else 0.0), -1
    while n:
        over = F.col("source_size") * cap < F.col("weight") * level
        now, kept, free = s.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size") * cap).otherwise(0.0)), F.sum(F.when(~over, F.col("weight")).otherwise(0.0))).first()
        if now == capped or not free:
            break
        level, capped = (share * total - kept) / free, now
    return s.withColumn("target", F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * F.lit(float(level))))


def inverse(start: Column, end: Column, u: Column) -> Column:
    """The time at which a source has asked for the share u of its tokens: its schedule's integral is solved for the time."""
    a, b = start * 2 / (start + end), end * 2 / (start + end)
    slope = b - a
    return F.when(F.abs(slope) < 1e-9, u).otherwise((F.sqrt(a * a + slope * u * 2) - a) / slope)


def mix(docs: DataFrame, source: str = "source", size: str = "size", key: str = "doc_id", weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds source_size, target, taken, and `parts`: an array of (position, words) for each time the document is used.

    Running sums within a source go by ranges of the hash, as many as the rows ask for, so a source that holds most rows is spread over
    many tasks. Documents are moved once, for the join with these sums and for the sums within a range."""
    taken_names = [c for c in ("source_size", "target", "taken", "parts") if c in docs.columns]
    if taken_names:
        raise ValueError(f"the table has columns named as results: {', '.join(taken_names)}")
    # A text key, so that the join with the sums and the window ask for the same partitions: null is apart from every source.
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))
    d = docs.withColumns({"__mix_source": name, "__mix_size": F.coalesce(F.col(size), F.lit(0)).cast("long"), "__mix_h": F.xxhash64(F.col(key), F.lit(9))})
    bits = max(1, (docs.count() // EACH).bit_length())
    d = d.withColumn("__mix_bucket", F.shiftrightunsigned("__mix_h", 64 - bits))
    sums = cut(d.groupBy("__mix_source", "__mix_bucket").agg(F.sum("__mix_size").alias("n"), F.first(source).alias("source")))
    goal = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, cap)
    goal = goal.withColumns({"start": pick([a for a, _ in schedules], "rank"), "end": pick([b for _, b in schedules], "rank")})
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__mix_source").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sums.select("__mix_source", "__mix_bucket", F.col("source").alias("__mix_s"), before.alias("before"))
    at = at.join(goal, F.col("__mix_s").eqNullSafe(F.col("source")))
    at = at.select("__mix_source", "__mix_bucket", *[F.col(c).alias(f"__mix_{c}") for c in ("before", "source_size", "target", "start", "end")])
    d = d.join(at, ["__mix_source", "__mix_bucket"])
    w = Window.partitionBy("__mix_source", "__mix_bucket").orderBy("__mix_h", key, "__mix_size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__mix_from", F.col("__mix_before") + F.coalesce(F.sum("__mix_size").over(w), F.lit(0)))
    goal_words = F.round("__mix_target").cast("long")
    part = lambda k: F.least(F.col("__mix_size"), F.greatest(F.lit(0), goal_words - F.col("__mix_source_size") * k - F.col("__mix_from")))
    middle = lambda k: (F.col("__mix_source_size") * k + F.col("__mix_from") + part(k) / 2) / F.greatest(goal_words, F.lit(1))
    parts = F.array(*[F.struct(inverse(F.col("__mix_start"), F.col("__mix_end"), middle(k)).alias("position"), part(k).alias("words")) for k in range(int(-(-cap // 1)))])
    taken = sum((part(k) for k in range(1, int(-(-cap // 1)))), part(0))
    out = d.withColumns({"parts": F.filter(parts, lambda p: p["words"] > 0), "taken": taken})
    return out.select(*docs.columns, F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), "taken", "parts")


def curriculum(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The mix itself: documents in training order, one row for each time a document is used; the document at which a source's target is
    reached has its first words, joined by one space. Columns are those of `docs`."""
    own = {c: fresh(c) for c in docs.columns}  # the caller's names, out of the way of the results'
    d = docs.select(*[F.col(c).alias(own[c]) for c in docs.columns], n_words(F.col(text)).alias("__mix_words"))
    names = {k: own[how.pop(k, v)] for k, v in (("source", "source"), ("key", "doc_id"))}
    rows = mix(d, size="__mix_words", **names, **how).withColumn("__mix_part", F.explode("parts"))
    first = F.concat_ws(" ", F.slice(words(F.col(own[text])), F.lit(1), F.col("__mix_part.words").cast("int")))
    rows = rows.withColumn(own[text], F.when(F.col("__mix_part.words") < F.col("__mix_words"), first).otherwise(F.col(own[text])))
    return rows.orderBy("__mix_part.position", names["key"]).select(*[F.col(own[c]).alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, in order of first use; unused documents come last."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    out = mix(docs).withColumn("position", F.get(F.col("parts.position"), F.lit(0)))
    return out.orderBy(F.asc_nulls_last("position"), "doc_id").select("doc_id", "source", "size", "source_size", "target", "taken", "position")
