"""The matcher interface and the relation that all matchers return."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from ..sources.tables import Table

SCHEMA = "source_table string, source_column string, target_table string, target_column string, source_pos int, target_pos int, similarity double"


class NotAMatcher(TypeError):
    """Raised when something that is no Matcher is given as one."""


class Matcher(ABC):
    """Subclass and give `match` to add a matcher of your own."""

    @abstractmethod
    def match(self, source: Table, target: Table) -> DataFrame:
        """Rows of SCHEMA: a score for pairs of a source and a target column."""

    def match_all(self, sources: Sequence[Table], targets: Sequence[Table]) -> DataFrame:
        """Every source against every target. Matchers that can do it in one job override this."""
        return reduce(DataFrame.unionByName, [self.match(s, t) for s in sources for t in targets])


def checked(matcher) -> Matcher:
    if not isinstance(matcher, Matcher):
        raise NotAMatcher(f"{type(matcher).__name__} is not a Matcher")
    return matcher
