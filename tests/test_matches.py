"""Operators on matches, and metrics, by the values that follow from a hand-written relation."""

import pytest

from tessera.operators.matches import Matches
from tessera.operators.metrics import METRICS_PRECISION_INCREASING_N, F1Score, Precision, PrecisionTopNPercent, Recall, RecallAtSizeofGroundTruth, counts
from tessera.queries import ROWS, TRUTH


@pytest.fixture(scope="module")
def matches(spark):
    return Matches.of(spark, ROWS)


def test_metrics(matches):
    assert Precision().value(matches, TRUTH) == 0.75 and Precision(False).value(matches, TRUTH) == 0.6
    assert Recall().value(matches, TRUTH) == 0.6 and Recall(False).value(matches, TRUTH) == 0.6
    assert F1Score().value(matches, TRUTH) == pytest.approx(2 / 3) and F1Score(False).value(matches, TRUTH) == pytest.approx(0.6)
    assert [PrecisionTopNPercent(n=n).value(matches, TRUTH) for n in (0, 50, 100)] == [0, 1.0, 0.75]
    assert PrecisionTopNPercent(False, 70).value(matches, TRUTH) == 0.75
    assert RecallAtSizeofGroundTruth().value(matches, TRUTH) == 0.6
    assert counts(matches, TRUTH, 2) == (2, 0, 3)
    assert {m.name() for m in METRICS_PRECISION_INCREASING_N} == {f"PrecisionTop{n}Percent" for n in range(10, 101, 10)}
    assert PrecisionTopNPercent(n=10) == PrecisionTopNPercent(n=10) and len({Precision(), Precision()}) == 1


def test_one_to_one(spark):
    base = [("table_1", c, "table_2", c, 1.0) for c in ("A", "B", "C")]
    doubled = base + [("table_1", c, "table_2", c + "foo", 0.5) for c in ("A", "B", "C")]
    got = Matches.of(spark, doubled).one_to_one().collect()
    assert len(got) == 3 and not any(k[1][1].endswith("foo") for k, _ in got)
    more = Matches.of(spark, [*doubled, ("table_1", "BLA", "table_2", "BLA", 0.7214057)]).one_to_one().collect()
    ends = [e for k, _ in more for e in k]
    assert len(more) == 4 and len(ends) == len(set(ends))
    assert Matches.of(spark, base[:1] * 1).one_to_one().count() == 1
    assert Matches.of(spark, []).one_to_one().count() == 0


def test_tops(matches):
    assert [matches.take_top_percent(p).count() for p in (0, 40, 100)] == [0, 2, 5]
    assert [matches.take_top_n(n).count() for n in (0, 2, 5, 6, -1, -9)] == [0, 2, 5, 5, 4, 0]
    assert [v for _, v in matches.collect()] == sorted((r[4] for r in ROWS), reverse=True)
    copy = matches.get_copy()
    assert copy is not matches and copy.collect() == matches.collect()
