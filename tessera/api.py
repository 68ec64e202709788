"""Entry points: match two tables, or two batches of tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from .operators.base import Matcher, NotAMatcher, checked
from .operators.composite import Composite
from .operators.cupid import Cupid
from .operators.distribution import DistributionBased
from .operators.flooding import SimilarityFlooding
from .operators.jaccard import Distance, Jaccard
from .operators.matches import Matches, last_of_key
from .sources.tables import Table

SCHEMA_ONLY = (SimilarityFlooding, Cupid)
INSTANCE_ONLY = (DistributionBased, Jaccard)
SCHEMA_INSTANCE = (Composite,)
ALL_MATCHERS = SCHEMA_ONLY + INSTANCE_ONLY + SCHEMA_INSTANCE


def match(df1: DataFrame, df2: DataFrame, matcher: Matcher, df1_name: str = "table_1", df2_name: str = "table_2") -> Matches:
    return Matches(checked(matcher).match(Table(df1_name, df1), Table(df2_name, df2)))


def match_batch(dfs1: Iterable[DataFrame], dfs2: Iterable[DataFrame], matcher: Matcher, names1: Iterable[str] | None = None, names2: Iterable[str] | None = None) -> Matches:
    """Every table of the one batch against every one of the other. Of tables of one name, the last counts."""
    checked(matcher)
    one, two = list(dfs1), list(dfs2)
    n1 = list(names1) if names1 is not None else [f"table_1_{i}" for i in range(len(one))]
    n2 = list(names2) if names2 is not None else [f"table_2_{i}" for i in range(len(two))]
    if len(n1) != len(one) or len(n2) != len(two):
        raise ValueError("as many names as tables are needed")
    if not one or not two:
        raise ValueError("both batches need a table")
    sources, targets = [Table(*x) for x in zip(n1, one, strict=True)], [Table(*x) for x in zip(n2, two, strict=True)]
    if len(set(n1)) == len(n1) and len(set(n2)) == len(n2):
        return Matches(matcher.match_all(sources, targets))
    return Matches(last_of_key([matcher.match(s, t) for s in sources for t in targets]))


__all__ = ["ALL_MATCHERS", "INSTANCE_ONLY", "SCHEMA_INSTANCE", "SCHEMA_ONLY", "Composite", "Cupid", "Distance", "DistributionBased", "Jaccard", "Matcher", "Matches", "NotAMatcher", "SimilarityFlooding", "Table", "match", "match_batch"]
