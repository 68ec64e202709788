"""Fuzzy Jaccard similarity of columns' value sets.

The smaller set of a pair is the outer one (the target's, if they are equal in size); an outer value counts if any inner value is close to
it, and the score is count / (sizes - count). Equal values are found by a hash join first; only what is left looks for close values, in
candidates that share a segment (edit distances: with at most k edits, one of k + 1 segments is intact) or have a fitting length.

Two things keep candidates from being all pairs of two columns whose values look alike. Values are told apart by how often they have each
letter, digits and other characters: most columns of codes and numbers have few such signatures, and pairs of signatures too far apart are
never joined. And inner values come in blocks: a candidate row is an outer value with up to some `BLOCK` inner ones, searched only until
one is close.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import damerau, hamming, jaro, jaro_winkler, similarity_of
from ..plans.profile import kept, profile
from ..sources.tables import Table
from .base import Matcher


class Distance(Enum):
    LEVENSHTEIN = "levenshtein"
    DAMERAU_LEVENSHTEIN = "damerau_levenshtein"
    JARO = "jaro"
    JARO_WINKLER = "jaro_winkler"
    HAMMING = "hamming"
    EXACT = "exact"


#: Inner values in a block, about, and the most signatures of a column that are told apart.
BLOCK, SIGNATURES = 1000, 256
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDITS = (Distance.LEVENSHTEIN, Distance.DAMERAU_LEVENSHTEIN, Distance.HAMMING)
PAIR = ["st", "sc", "tt", "tc"]


def budget(longer: Column, threshold: float) -> Column:
    """A loose bound on the edits of a pair whose longer string has this length; the exact test comes after."""
    return F.floor(longer * (1 - threshold) + 1e-6).cast("int")


def signature(v: Column) -> Column:
    """How many of each letter, of digits, and of other characters a text has."""
    bare = F.length(v)
    letters = [bare - F.length(F.translate(v, c + c.upper(), "")) for c in LETTERS]
    digits = bare - F.length(F.translate(v, "0123456789", ""))
    return F.array(*letters, digits, bare - sum(letters[1:], letters[0]) - digits)


def signed(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Adds `sig`; null in columns of values with more signatures than SIGNATURES, which are joined without it."""
    with_sig = values.withColumn("sig", signature(F.col(column)))
    few = with_sig.select(*by, "sig").distinct().groupBy(*by).agg(F.count("*").alias("sigs")).where(F.col("sigs") <= SIGNATURES)
    return with_sig.join(few, by, "left").withColumn("sig", F.when(F.col("sigs").isNotNull(), F.col("sig"))).drop("sigs")


@dataclass
class Jaccard(Matcher):
    threshold: float = 0.8
    distance: Distance = Distance.LEVENSHTEIN
    process_num: int = 1  # kept for callers that set it; Spark plans the parallelism

    def match(self, source: Table, target: Table) -> DataFrame:
        return self.match_all([source], [target])

    def match_all(self, sources: Sequence[Table], targets: Sequence[Table]) -> DataFrame:
        s = kept(profile(sources).select(F.col("table").alias("st"), F.col("column").alias("sc"), F.col("pos").alias("sp"), "value"))
        t = kept(profile(targets).select(F.col("table").alias("tt"), F.col("column").alias("tc"), F.col("pos").alias("tp"), "value"))
        ns, nt = s.groupBy("st", "sc", "sp").agg(F.count("*").alias("ns")), t.groupBy("tt", "tc", "tp").agg(F.count("*").alias("nt"))
        # The pairs are the product of the two column catalogs: as many rows as the schemas have column pairs, whatever the data.
        pairs = ns.join(nt).withColumn("outer_s", F.col("ns") < F.col("nt"))
        hits = self.hits(s, t, pairs)
        count = F.coalesce("hits", F.lit(0))
        union = F.col("ns") + F.col("nt") - count
        scored = pairs.join(hits, PAIR, "left").withColumn("similarity", F.when(union > 0, count / union).otherwise(0.0)).where("similarity > 0")
        return scored.select(F.col("st").alias("source_table"), F.col("sc").alias("source_column"), F.col("tt").alias("target_table"), F.col("tc").alias("target_column"), F.col("sp").alias("source_pos"), F.col("tp").alias("target_pos"), "similarity")

    def hits(self, s: DataFrame, t: DataFrame, pairs: DataFrame) -> DataFrame:
        exact = s.join(t, "value").select(*PAIR, "value")
        if self.distance is Distance.EXACT or self.threshold >= 1:
            return exact.groupBy(*PAIR).agg(F.count("*").alias("hits"))
        sides = pairs.select(*PAIR, "outer_s")
        out_s = sides.where("outer_s").join(s.drop("sp"), ["st", "sc"])
        out_t = sides.where("not outer_s").join(t.drop("tp"), ["tt", "tc"])
        left = out_s.unionByName(out_t).join(exact, [*PAIR, "value"], "left_anti").withColumn("la", F.length("value"))
        inner = t.select("value", F.lit(True).alias("outer_s"), F.col("tt").alias("it"), F.col("tc").alias("ic")).unionByName(s.select("value", F.lit(False).alias("outer_s"), F.col("st").alias("it"), F.col("sc").alias("ic")))
        inner = inner.withColumnRenamed("value", "other").withColumn("lb", F.length("other"))
        left = left.withColumns({"it": F.when(F.col("outer_s"), F.col("tt")).otherwise(F.col("st")), "ic": F.when(F.col("outer_s"), F.col("tc")).otherwise(F.col("sc"))})
        return exact.unionByName(self.close_values(left, inner).distinct()).groupBy(*PAIR).agg(F.count("*").alias("hits"))

    def close_values(self, left: DataFrame, inner: DataFrame) -> DataFrame:
        """(PAIR, value): outer values with a close inner one; a value may come more than once."""
        v, edits = F.col("value"), self.distance in EDITS
        if not edits:
            cand = self.candidates(left, inner)
            return cand.where(self.close(v, F.col("other"))).select(*PAIR, "value")
        blocks = max(1, inner.count() // BLOCK)
        near = self.candidates(left, inner, blocks).where(F.exists("others", lambda o: self.close(v, o))).select(*PAIR, "value")
        if self.distance is not Distance.DAMERAU_LEVENSHTEIN:
            return near
        # Swaps count once here and twice in plain edit distance: it finds most close values, and rules most others out before the slower
        # function sees them.
        near = kept(near.distinct())
        left = left.join(near, [*PAIR, "value"], "left_anti")
        most = lambda o: 2 * budget(F.greatest(F.length(v), F.length(o)), self.threshold)
        some = self.candidates(left, inner, blocks).select(*PAIR, "value", F.explode(F.filter("others", lambda o: F.call_function("levenshtein", v, o, most(o)) >= 0)).alias("other")).distinct()
        return near.union(some.where(similarity_of(damerau(v, F.col("other")), v, F.col("other")) >= self.threshold).select(*PAIR, "value"))

    def apart(self, la: Column, lb: Column) -> Column:
        """Whether signatures x and y of texts of these lengths rule out that the texts are close."""
        if self.distance in EDITS:
            # An edit takes one character away and brings another at most; a swap does neither.
            gone = F.aggregate(F.zip_with("x", "y", lambda a, b: F.greatest(a - b, F.lit(0))), F.lit(0), lambda s, d: s + d)
            come = F.aggregate(F.zip_with("x", "y", lambda a, b: F.greatest(b - a, F.lit(0))), F.lit(0), lambda s, d: s + d)
            return F.greatest(gone, come) > budget(F.greatest(la, lb), self.threshold)
        need = self.threshold if self.distance is Distance.JARO else (self.threshold - 0.4) / 0.6
        shared = F.aggregate(F.zip_with("x", "y", lambda a, b: F.least(a, b)), F.lit(0), lambda s, d: s + d)
        return (shared / la + shared / lb + 1) / 3 < need - 1e-9

    def candidates(self, left: DataFrame, inner: DataFrame, blocks: int | None = None) -> DataFrame:
        """Outer values with inner ones that may be close, as an equi-join on column, length, signature and, where it prunes, a segment of
        the inner value: `other` in a row each, or with a number of blocks, `others` as arrays."""
        th, on = self.threshold, ["outer_s", "it", "ic"]

        def blocked(index: DataFrame, keys: list[str]) -> DataFrame:
            return index if blocks is None else index.groupBy(*keys, F.pmod(F.xxhash64("other"), F.lit(blocks)).alias("b")).agg(F.collect_list("other").alias("others")).drop("b")

        share = th if self.distance in EDITS else max(3 * th - 2, 0.0) if self.distance is Distance.JARO else max((th - 0.4) / 0.6 * 3 - 2, 0.0)
        if th <= 0 or share <= 0:
            return left.join(blocked(inner, on), on)
        left, inner = kept(signed(left, "value", PAIR)), kept(signed(inner, "other", on))
        # Pairs of lengths and signatures: as many as the columns' lengths, and SIGNATURES squared for a pair of columns at most.
        a, b = left.select(*on, "la", F.col("sig").alias("x")).distinct(), inner.select(*on, "lb", F.col("sig").alias("y")).distinct()
        fits = (F.col("lb") >= F.ceil(F.col("la") * share - 1e-6)) & (F.col("lb") <= F.floor(F.col("la") / share + 1e-6))
        key = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))  # noqa: E731  a null signature is a key like any other
        near = a.join(b, on).where(fits).where(F.col("x").isNull() | F.col("y").isNull() | ~self.apart(F.col("la"), F.col("lb"))).select(*on, "la", "lb", key("x").alias("x"), key("y").alias("y"))
        names = [c for c in left.columns if c != "sig"]
        by_length = left.select(*names, key("sig").alias("x")).join(near, [*on, "la", "x"]).select(*names, "lb", "y")
        inner = inner.select(*on, "lb", "other", key("sig").alias("y"))
        if self.distance not in EDITS or th < 0.7:
            return by_length.join(blocked(inner.select(*on, "lb", "y", "other"), [*on, "lb", "y"]), [*on, "lb", "y"])
        # A swap of neighbours may touch two segments, so it counts as two edits here.
        edits = 2 if self.distance is Distance.DAMERAU_LEVENSHTEIN else 1
        probe = by_length.withColumn("k", edits * budget(F.greatest("la", "lb"), th)).where("k > 0 or la = lb")
        longest = F.floor(F.col("lb") / th + 1e-6).cast("int")
        ks = F.array_distinct(F.transform(F.sequence(F.col("lb"), F.greatest("lb", longest)), lambda x: edits * budget(x, th)))
        index = inner.withColumn("k", F.explode(ks))
        start = lambda i: F.floor(F.col("lb") * i / (F.col("k") + 1)).cast("int")
        cut = lambda i: F.struct(i.alias("i"), F.substring("other", start(i) + 1, start(i + 1) - start(i)).alias("seg"))
        keys = [*on, "lb", "y", "k", "i", "seg"]
        index = blocked(index.withColumn("x", F.explode(F.transform(F.sequence(F.lit(0), F.col("k")), cut))).select(*on, "lb", "y", "k", "other", "x.*"), keys)
        shift = F.lit(0) if self.distance is Distance.HAMMING else F.col("k")
        at = lambda i: F.sequence(F.greatest(F.lit(0), start(i) - shift), F.greatest(F.greatest(F.lit(0), start(i) - shift), F.least(start(i) + shift, F.col("la") - (start(i + 1) - start(i)))))
        seen = F.flatten(F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.array_distinct(F.transform(at(i), lambda p: F.struct(i.alias("i"), F.substring("value", p + 1, start(i + 1) - start(i)).alias("seg"))))))
        probe = probe.withColumn("x", F.explode(seen)).select(*names, "lb", "y", "k", "x.*")
        return probe.join(index, keys)

    def close(self, a: Column, b: Column) -> Column:
        if self.distance in EDITS:
            # The bounded distance ends early; it is never above the Hamming distance.
            bounded = F.call_function("levenshtein", a, b, budget(F.greatest(F.length(a), F.length(b)), self.threshold))
            exact = hamming(a, b) if self.distance is Distance.HAMMING else bounded
            return (bounded >= 0) & (similarity_of(exact, a, b) >= self.threshold)
        return (jaro if self.distance is Distance.JARO else jaro_winkler)(a, b) >= self.threshold
