"""The ranked match relation and its operators."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.profile import kept, numbered
from .base import SCHEMA

#: Rows of a relation in a partition, about.
ROWS = 1 << 16

COLUMNS = ["source_table", "source_column", "target_table", "target_column", "source_pos", "target_pos", "similarity"]
KEY = COLUMNS[:4]


def order() -> list:
    return [F.desc("similarity"), *[F.asc(c) for c in ("source_table", "target_table", "source_pos", "target_pos", "source_column", "target_column")]]


class Matches:
    """A match relation, best first; ties by table names, then by column positions. Operators return new relations; nothing is changed.

    `df` is a plan. The first operator keeps its rows, which are as many as the columns matched have pairs, so the matcher runs once."""

    def __init__(self, df: DataFrame):
        self.df = df.select(*COLUMNS)

    @cached_property
    def _kept(self) -> tuple[DataFrame, int]:
        rows = kept(self.df)
        n = rows.count()
        return rows.coalesce(max(1, -(-n // ROWS))), n

    @property
    def rows(self) -> DataFrame:
        return self._kept[0]

    @classmethod
    def of(cls, spark, rows: Iterable[tuple[str, str, str, str, float]]) -> Matches:
        """From (source table, source column, target table, target column, similarity); positions follow the order given."""
        return cls(spark.createDataFrame([(*r[:4], i, i, float(r[4])) for i, r in enumerate(rows)], SCHEMA))

    def ordered(self) -> DataFrame:
        return self.rows.orderBy(*order())

    def collect(self) -> list[tuple[tuple[tuple[str, str], tuple[str, str]], float]]:
        """((source table, source column), (target table, target column)) and similarity, best first."""
        return [(((r.source_table, r.source_column), (r.target_table, r.target_column)), r.similarity) for r in self.ordered().collect()]

    def get_copy(self) -> Matches:
        return Matches(self.df)

    def count(self) -> int:
        return self._kept[1]

    def take_top_n(self, n: int) -> Matches:
        """The best n; a negative n leaves out the worst -n."""
        return Matches(self.ordered().limit(n if n >= 0 else max(0, self.count() + n)))

    def take_top_percent(self, percent: float) -> Matches:
        return self.take_top_n(math.ceil(percent / 100 * self.count()))

    @cached_property
    def _one_to_one(self) -> Matches:
        def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf[COLUMNS].sort_values(["similarity", "source_table", "target_table", "source_pos", "target_pos", "source_column", "target_column"], ascending=[False] + [True] * 6)
            scores = sorted(set(pdf["similarity"]), reverse=True)
            if len(scores) < 2:
                return pdf
            pdf = pdf[pdf["similarity"] >= scores[min(math.ceil(len(scores) / 2), len(scores) - 1)]]
            used: set = set()
            keep = []
            for r in pdf.itertuples(index=False):
                ends = {(r.source_table, r.source_column), (r.target_table, r.target_column)}
                keep.append(not ends & used)
                if keep[-1]:
                    used |= ends
            return pdf[keep]

        # Greedy choice is sequential; its input has a row for each pair of columns of the schemas matched.
        return Matches(self.rows.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(greedy, SCHEMA))

    def one_to_one(self) -> Matches:
        """Best first, each column at most once, none below the median of the distinct scores."""
        return self._one_to_one

    def ranked(self) -> DataFrame:
        """The relation with `nth`, from 1, best first."""
        if self._kept[1] <= ROWS:
            return self.rows.withColumn("nth", F.row_number().over(Window.orderBy(*order())))
        return numbered(self.rows, "nth", *order())

    def get_metrics(self, ground_truth: Sequence[tuple[str, str]], metrics=None) -> dict[str, float]:
        from .metrics import METRICS_CORE, evaluated

        return evaluated(self, ground_truth, METRICS_CORE if metrics is None else metrics)


def last_of_key(parts: Sequence[DataFrame]) -> DataFrame:
    """All parts as one relation; of rows with one key, that of the last part counts."""
    tagged = [p.select(*COLUMNS, F.lit(i).alias("__nth")) for i, p in enumerate(parts)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    w = Window.partitionBy(*KEY).orderBy(F.desc("__nth"))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*COLUMNS)
