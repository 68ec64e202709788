"""Evaluation of matches against a ground truth of (source column, target column) names."""

from __future__ import annotations

import math
from abc import ABC
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import functions as F

from .matches import Matches

Truth = Sequence[tuple[str, str]]


#: What a count is asked of: the one-to-one relation or the whole one, and how many of its best rows (None: all).
Part = tuple[bool, int | None]
#: True positives, false positives, false negatives.
Counts = tuple[int, int, int]


def counted(matches: Matches, ground_truth: Truth, parts: Iterable[Part]) -> dict[Part, Counts]:
    """Counts of all parts by column names, in one aggregate. Each truth entry counts, repeats too."""
    parts = list(dict.fromkeys(parts))
    if not parts:
        return {}
    spark = matches.df.sparkSession
    truth = spark.createDataFrame([(a, b, n) for (a, b), n in Counter(map(tuple, ground_truth)).items()], "source_column string, target_column string, times long")
    found = None
    for one in sorted({p[0] for p in parts}):
        rows = (matches.one_to_one() if one else matches).ranked().select("source_column", "target_column", "nth", F.lit(one).alias("one"))
        found = rows if found is None else found.union(rows)
    inside = [(F.col("one") == one) & (F.lit(True) if n is None else F.col("nth") <= n) for one, n in parts]
    names = found.groupBy("source_column", "target_column").agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(inside)])
    at = names.join(truth, ["source_column", "target_column"], "left")
    true = [F.sum(F.when(F.col("times").isNotNull() & (F.col(f"c{i}") > 0), F.col("times")).otherwise(0)) for i in range(len(parts))]
    false = [F.sum(F.when(F.col("times").isNull(), F.col(f"c{i}")).otherwise(0)) for i in range(len(parts))]
    r = at.agg(*[x for pair in zip(true, false, strict=True) for x in pair]).first()
    return {p: (tp := r[2 * i] or 0, r[2 * i + 1] or 0, len(ground_truth) - tp) for i, p in enumerate(parts)}


def counts(matches: Matches, ground_truth: Truth, n: int | None = None) -> Counts:
    """(true positives, false positives, false negatives) of the best n matches."""
    return counted(matches, ground_truth, [(False, n)])[False, n]


@dataclass(frozen=True)
class Metric(ABC):
    """Subclass and give `value` to add a metric of your own, or `part` and `of` to have its counts found together with those of others."""

    def name(self) -> str:
        return type(self).__name__

    def return_format(self, value: float) -> dict[str, float]:
        return {self.name(): value}

    def part(self, matches: Matches, ground_truth: Truth) -> Part | None:
        """What the metric counts in; None for one that finds its value by itself."""
        return None

    def of(self, counts: Counts) -> float:
        raise NotImplementedError

    def value(self, matches: Matches, ground_truth: Truth) -> float:
        part = self.part(matches, ground_truth)
        if part is None:
            raise NotImplementedError(f"{type(self).__name__} needs `value`, or `part` and `of`")
        return self.of(counted(matches, ground_truth, [part])[part])

    def apply(self, matches: Matches, ground_truth: Truth) -> dict[str, float]:
        return self.return_format(self.value(matches, ground_truth))


def evaluated(matches: Matches, ground_truth: Truth, metrics: Iterable[Metric]) -> dict[str, float]:
    """All metrics' values; those that only count do it in one aggregate."""
    order = sorted(metrics, key=lambda m: (m.name(), repr(m)))
    parts = {m: m.part(matches, ground_truth) for m in order}
    found = counted(matches, ground_truth, [p for p in parts.values() if p is not None])
    out: dict[str, float] = {}
    for m in order:
        out.update(m.apply(matches, ground_truth) if parts[m] is None else m.return_format(m.of(found[parts[m]])))
    return out


def ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


@dataclass(frozen=True)
class Precision(Metric):
    one_to_one: bool = True

    def part(self, matches, ground_truth):
        return self.one_to_one, None

    def of(self, counts):
        return ratio(counts[0], counts[0] + counts[1])


@dataclass(frozen=True)
class Recall(Metric):
    one_to_one: bool = True

    def part(self, matches, ground_truth):
        return self.one_to_one, None

    def of(self, counts):
        return ratio(counts[0], counts[0] + counts[2])


@dataclass(frozen=True)
class F1Score(Metric):
    one_to_one: bool = True

    def part(self, matches, ground_truth):
        return self.one_to_one, None

    def of(self, counts):
        tp, fp, fn = counts
        return ratio(2 * tp, 2 * tp + fp + fn)


@dataclass(frozen=True)
class PrecisionTopNPercent(Metric):
    one_to_one: bool = True
    n: int = 10

    def name(self) -> str:
        return f"PrecisionTop{self.n}Percent"

    def part(self, matches, ground_truth):
        m = matches.one_to_one() if self.one_to_one else matches
        return self.one_to_one, math.ceil(self.n / 100 * m.count())

    def of(self, counts):
        return ratio(counts[0], counts[0] + counts[1])


@dataclass(frozen=True)
class RecallAtSizeofGroundTruth(Metric):
    """Recall of as many best matches as the truth has entries; never one-to-one."""

    def part(self, matches, ground_truth):
        return False, len(ground_truth)

    def of(self, counts):
        return ratio(counts[0], counts[0] + counts[2])


METRICS_CORE = frozenset({Precision(), Recall(), F1Score(), PrecisionTopNPercent(), RecallAtSizeofGroundTruth()})
METRICS_ALL = METRICS_CORE
METRICS_PRECISION_RECALL = frozenset({Precision(), Recall()})
METRICS_PRECISION_INCREASING_N = frozenset(PrecisionTopNPercent(n=n) for n in range(10, 101, 10))
