"""The matchers, on a small pair of tables and by hand-computed values."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from tessera.api import ALL_MATCHERS, Composite, Cupid, Distance, DistributionBased, Jaccard, NotAMatcher, SimilarityFlooding, Table, match, match_batch
from tessera.functions.scalars import convert_data_type, is_sorted, normalize_distance
from tessera.functions.text import damerau_of, hamming, jaro_of, jaro_winkler_of, name_tokens, number, render
from tessera.operators import distribution
from tessera.operators.flooding import FORMULAS, POLICIES
from tessera.plans.profile import numbered, profile
from tessera.sources.tables import is_date, read_csv, sniff_delimiter, sniff_encoding, write_csv


@pytest.fixture(scope="module")
def papers(spark):
    ids = [f"2-s2.0-{84900000000 + 7919 * i}" for i in range(12)]
    names = ["Silva", "Moreno", "Okafor", "Larsen", "Dubois", "Tanaka", "Novak", "Haddad", "Weber", "Rossi", "Kumar", "Berg"]
    one = spark.createDataFrame([(i, f"{n}, A.", 40 + 17 * k, f"On the {n} problem and its many uses", 2000 + k % 4) for k, (i, n) in enumerate(zip(ids, names, strict=True))], "EID string, Authors string, `Cited by` int, Title string, Year int")
    two = spark.createDataFrame([(i, f"{n}, A.", 40 + 17 * k, ["Spain", "Peru", "Chad"][k % 3], "Journal") for k, (i, n) in enumerate(zip(ids, names, strict=True))], "EID string, Authors string, `Cited by` int, Country string, aggregationType string")
    return one, two


TRUTH = [("Cited by", "Cited by"), ("Authors", "Authors"), ("EID", "EID")]


@pytest.mark.parametrize("distance", list(Distance))
def test_jaccard_finds_equal_columns(papers, distance):
    got = dict(match(*papers, Jaccard(0.8, distance)).collect())
    for a, b in TRUTH:
        assert got[("table_1", a), ("table_2", b)] == 1.0


def brute_jaccard(s, t, close):
    outer, inner = (s, t) if len(s) < len(t) else (t, s)
    n = sum(any(close(o, i) for i in inner) for o in outer)
    return n / (len(s) + len(t) - n)


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.9])
def test_candidates_lose_no_close_pair(spark, threshold):
    import random

    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(60)}
    other = {w[: (k := rng.randrange(len(w) + 1))] + rng.choice("abc") + w[k + rng.randint(0, 1) :] for w in words}
    df1, df2 = spark.createDataFrame([(w,) for w in sorted(words)], "x string"), spark.createDataFrame([(w,) for w in sorted(other)], "y string")
    ham = lambda a, b: sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))
    norm = lambda d: lambda a, b: 1 - d(a, b) / max(len(a), len(b), 1) >= threshold
    checks = {Distance.LEVENSHTEIN: norm(edit), Distance.DAMERAU_LEVENSHTEIN: norm(damerau_of), Distance.HAMMING: norm(ham), Distance.JARO: lambda a, b: jaro_of(a, b) >= threshold, Distance.JARO_WINKLER: lambda a, b: jaro_winkler_of(a, b) >= threshold}
    for d, close in checks.items():
        got = match(df1, df2, Jaccard(threshold, d)).collect()
        want = brute_jaccard(words, other, close)
        assert (got[0][1] if got else 0) == pytest.approx(want), d


def test_outer_side_on_a_tie_is_the_target(spark):
    s, t = spark.createDataFrame([("abcde",), ("abcdf",)], "x string"), spark.createDataFrame([("abcde",), ("zzzzz",)], "y string")
    assert match(s, t, Jaccard()).collect()[0][1] == pytest.approx(1 / 3)


def test_exact_on_rendered_values(spark):
    s, t = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([("1",)], "y string")
    assert match(s, t, Jaccard(distance=Distance.EXACT)).collect()[0][1] == 0.5


def test_every_matcher_returns_rows_and_is_evaluated(papers):
    for m in (Cupid(), Composite(), Composite(use_instances=True), DistributionBased(), SimilarityFlooding()):
        found = match(*papers, m)
        assert found.count() > 0, m
        assert found.get_metrics(TRUTH)["Recall"] == 1.0, m
    assert set(match(*papers, Composite()).collect()) != set(match(*papers, Composite(use_instances=True)).collect())
    assert len(ALL_MATCHERS) == 5


@pytest.mark.parametrize("formula", FORMULAS)
@pytest.mark.parametrize("policy", POLICIES)
def test_flooding_scores_the_whole_product(papers, formula, policy):
    got = match(*papers, SimilarityFlooding(policy, formula)).collect()
    assert len(got) == 25 and all(0 <= v <= 1 for _, v in got)


def test_flooding_unknown_formula_and_policy(papers):
    assert match(*papers, SimilarityFlooding(formula="none")).collect() == []
    with pytest.raises(ValueError):
        match(*papers, SimilarityFlooding("none"))


def test_batches(papers):
    one, two = papers
    assert match_batch((d for d in [one, one]), (d for d in [two, two, two]), Jaccard(distance=Distance.EXACT)).count() == 6 * 3
    named = match_batch([one] * 2, [two] * 2, Jaccard(distance=Distance.EXACT), ["ta1", "tb1"], ["ta2", "tb2"]).collect()
    assert {k[0][0] for k, _ in named} == {"ta1", "tb1"}
    assert match_batch([one] * 2, [two], Jaccard(distance=Distance.EXACT), ["t", "t"], ["u"]).count() == 3
    with pytest.raises(NotAMatcher):
        match(one, two, "jaccard")
    with pytest.raises(ValueError):
        match_batch([one], [two], Cupid(), ["a", "b"])


def test_empty_and_null_columns(spark):
    e = spark.createDataFrame([], "a int, b string")
    n = spark.createDataFrame([(None, None)], "a int, b string")
    full = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    for m in (Jaccard(), DistributionBased(), SimilarityFlooding(), Cupid(), Composite(use_instances=True)):
        for x, y in ((e, full), (full, n), (n, e)):
            match(x, y, m).collect()
    assert match(full, full, DistributionBased(), "t", "t").count() > 0


def test_render_as_python_does(spark):
    values = [0.0, -1.5, 1e7, 123456789.25, 1e15, 1e16, 1.5e300, 0.001, 0.00025, 1e-5, 2.5e-7, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(render(df.x, df.schema["x"].dataType)).collect()]
    assert got == [str(v) for v in values]
    odd = spark.createDataFrame([(True, datetime.datetime(2015, 1, 1), decimal.Decimal("1.50"), datetime.date(2020, 2, 3))], "a boolean, b timestamp, c decimal(5,2), d date")
    assert list(odd.select(*[render(odd[f.name], f.dataType).alias(f.name) for f in odd.schema]).first()) == ["True", "2015-01-01T00:00:00.000000000", "1.50", "2020-02-03"]


def test_strings(spark):
    assert damerau_of("ca", "abc") == 2 and damerau_of("abcd", "abdc") == 1
    assert jaro_of("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert jaro_winkler_of("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert jaro_winkler_of("ab", "ac") == jaro_of("ab", "ac")
    df = spark.createDataFrame([("abc", "abdef"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(hamming(df.a, df.b)).collect()] == [3, 0]
    t = spark.createDataFrame([("aggregationType",), ("Cited by",), ("2 of_3",)], "n string")
    assert [[(x.kind, x.data) for x in r[0]] for r in t.select(name_tokens(t.n)).collect()] == [[("content", "aggregation"), ("content", "type")], [("content", "cited"), ("common", "by")], [("number", "2"), ("common", "of"), ("number", "3")]]
    v = spark.createDataFrame([("1d",), ("1.50",), ("1e3",), ("x",)], "v string")
    assert [r[0] for r in v.select(number(v.v)).collect()] == [None, 1.5, 1000.0, None]
    assert convert_data_type("1.1") == 1.1 and convert_data_type("1") == 1 and convert_data_type("test") == "test"
    assert is_sorted({"a": 1, "b": 2, "c": 3}) and not is_sorted({"a": 2, "b": 1, "c": 3})
    assert normalize_distance(3, "kitten", "sitting") == pytest.approx(1 - 3 / 7) and normalize_distance(0, "", "") == 1.0
    assert is_date("2019-04-26 18:03:50.941332") and not is_date("Sweden")


def test_global_rank_order(spark):
    values = ["10", "9", "1e5", "abc", "-3", "+7", " 2", "0", "B", "a", "1.5", ".5", "two\nlines"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = [r.value for r in distribution.global_ranks(df).orderBy("rank").collect()]
    assert got == ["-3", "+7", "0", "B", "a", "abc", ".5", "1e5", "1.5", " 2", "9", "10"]


def test_numbering_is_dense(spark):
    got = sorted(numbered(spark.range(1000).selectExpr("id % 37 as k", "id"), "n", F.col("k"), F.col("id")).collect(), key=lambda r: r.n)
    assert [r.n for r in got] == list(range(1, 1001)) and [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


def test_cut_points_are_inclusive_quantiles(spark):
    import statistics

    ranks = [1, 2, 3, 10, 10, 44, 45, 46]
    df = spark.createDataFrame([("t", "c", r, ranks.count(r)) for r in sorted(set(ranks))], "table string, column string, rank bigint, freq bigint")
    for q in (1, 3, 10):
        want = sorted({round(x, 3) for x in statistics.quantiles(ranks, n=q + 1, method="inclusive")})
        assert distribution.cut_points(df, ["table", "column"], q).first().bounds == pytest.approx(want)
    one = distribution.cut_points(df.where("rank = 44"), ["table", "column"]).first()
    assert one.bounds == [44.0] and one.low == 44


def test_emd_equals_transport(spark):
    h = lambda xs: spark.createDataFrame([("p", i, 4, x) for i, x in enumerate(xs) if x], "p string, bucket int, n int, mass int")
    assert distribution.emd(h([1, 0, 0, 0]), h([0, 0, 0, 1]), ["p"]).first().emd == pytest.approx(3 / 4)
    assert distribution.emd(h([1, 1, 0, 0]), h([0, 2, 0, 2]), ["p"]).first().emd == pytest.approx((0.5 + 0.5 + 0.5) / 4)


def test_cutoffs():
    assert distribution.cutoff([0.02], 0.15) == 0.02
    assert distribution.cutoff([0.3], 0.15) == 0.0
    assert distribution.cutoff([0.0, 0.1], 0.15) == 0.0
    assert distribution.cutoff([0.10, 0.12], 0.15) == 0.12


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('EID,"Cited by",Title\n1,20,"a, ""quoted"" title"\n2,31,plain é\n', encoding="utf-8")
    assert sniff_encoding(spark, str(p)) == "utf-8" and sniff_delimiter(spark, str(p)) == ","
    df = read_csv(spark, str(p))
    assert df.columns == ["EID", "Cited by", "Title"] and df.first().Title == 'a, "quoted" title'
    write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "out"), ",", "utf-8").collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "latin.csv").write_bytes("a;b\né;ü\n".encode("latin-1"))
    assert sniff_encoding(spark, str(tmp_path / "latin.csv")) == "iso-8859-1" and sniff_delimiter(spark, str(tmp_path / "latin.csv")) == ";"


def test_labels_and_profile(spark):
    df = spark.createDataFrame([(1, 1.5, "x", "2020-01-01", True, None), (None, None, None, None, None, None)], "a int, b double, c string, d string, e boolean, f int")
    assert Table("t", df).labels() == {"a": "int", "b": "float", "c": "varchar", "d": "date", "e": "", "f": "int"}
    assert {(r.column, r.value, r.freq) for r in profile([Table("t", df)]).collect()} == {("a", "1", 1), ("b", "1.5", 1), ("c", "x", 1), ("d", "2020-01-01", 1), ("e", "True", 1)}


def test_streamed_profile(spark, tmp_path):
    from tessera.streaming.profiles import keep_profile, read_profile

    spark.createDataFrame([(1, "x"), (1, "y")], "a int, b string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a int, b string").parquet(str(tmp_path / "in"))
    keep_profile(stream, "t", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {(r.column, r.value, r.freq) for r in read_profile(spark, str(tmp_path / "out")).collect()} == {("a", "1", 2), ("b", "x", 1), ("b", "y", 1)}
