"""Registered queries of the matching engine over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Composite, Cupid, Distance, DistributionBased, Jaccard, Matches, SimilarityFlooding, Table, match_batch
from .operators import distribution, flooding
from .operators.metrics import F1Score, Precision, PrecisionTopNPercent, Recall, RecallAtSizeofGroundTruth
from .plans.profile import column_stats, profile

COLUMNS = {
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "region": ("r_regionkey", "r_name"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
}
#: A hand-written relation and truth for the operators on matches.
ROWS = (("table_1", "Cited by", "table_2", "Cited by", 0.8374313), ("table_1", "Authors", "table_2", "Authors", 0.83498037), ("table_1", "EID", "table_2", "EID", 0.8214057), ("table_1", "Title", "table_2", "DUMMY1", 0.8214057), ("table_1", "Title", "table_2", "DUMMY2", 0.8114057))
REAL_TRUTH = (("c_custkey", "s_suppkey"), ("c_nationkey", "s_nationkey"), ("c_acctbal", "s_acctbal"), ("c_name", "s_name"))
TRUTH = (("Cited by", "Cited by"), ("Authors", "Authors"), ("EID", "EID"), ("Title", "Title"), ("DUMMY3", "DUMMY3"))


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[Table]:
    return [Table(n, spark.read.parquet(f"{sf_dir}/{n}.parquet")) for n in names]


def shown(df: DataFrame) -> DataFrame:
    return df.select("source_table", "source_column", "target_table", "target_column", F.round("similarity", 6).alias("similarity"))


def matching(matcher, source: str, target: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, t = tables(spark, sf_dir, source, target)
        return shown(matcher.match(s, t))

    return run


def column_profile(spark, sf_dir):
    return column_stats(tables(spark, sf_dir, "customer", "supplier")).select("table", "column", "rows", "distinct")


def global_rank(spark, sf_dir):
    return distribution.global_ranks(profile(tables(spark, sf_dir, "nation", "region", "supplier")))


def quantile_histogram(spark, sf_dir):
    s, t = tables(spark, sf_dir, "customer", "supplier")
    bounds = distribution.cut_points(distribution.ranked_columns(s, t), ["table", "column"])
    return bounds.select("table", "column", "low", F.size("bounds").alias("n_bounds"), F.round(F.aggregate("bounds", F.lit(0.0), lambda a, x: a + x), 2).alias("sum_bounds"))


def quantile_emd(spark, sf_dir):
    s, t = tables(spark, sf_dir, "customer", "supplier")
    out = distribution.column_emd(distribution.ranked_columns(s, t), s, t)
    return out.select("sc", "tc", F.when(F.col("emd") == distribution.INF, -1.0).otherwise(F.round("emd", 6)).alias("emd"))


def intersection_emd(spark, sf_dir):
    s, t = tables(spark, sf_dir, "customer", "supplier")
    out = distribution.intersection_emd(distribution.ranked_columns(s, t), s, t)
    return out.select("sc", "tc", F.when(F.col("emd") == distribution.INF, -1.0).otherwise(F.round("emd", 6)).alias("emd"))


def distances(spark, sf_dir) -> tuple[list, dict]:
    s, t = tables(spark, sf_dir, "customer", "supplier")
    return distribution.graph(distribution.column_emd(distribution.ranked_columns(s, t), s, t).collect())


def dist_cutoff(spark, sf_dir):
    at = distribution.cutoffs(*distances(spark, sf_dir), 0.15)
    return spark.createDataFrame([("st"[k[0]], k[2], round(v, 6)) for k, v in at.items()], "side string, col string, cutoff double")


def dist_clusters(spark, sf_dir):
    nodes, distance = distances(spark, sf_dir)
    found = distribution.connected(nodes, distribution.neighbours(nodes, distance, 0.15))
    return spark.createDataFrame([("st"[k[0]], k[2], min("st"[n[0]] + n[2] for n in c)) for c in found for k in c], "side string, col string, cluster string")


def graphs(spark, sf_dir):
    s, t = tables(spark, sf_dir, "nation", "region")
    return flooding.edges(spark, s), flooding.edges(spark, t)


def flood_initial_map(spark, sf_dir):
    return flooding.initial_map(*graphs(spark, sf_dir)).select("n1", "n2", F.round("sim", 6).alias("sim"))


def flood_connectivity(spark, sf_dir):
    return flooding.connectivity(*graphs(spark, sf_dir))


def flood_weights(policy):
    return lambda spark, sf_dir: flooding.weights(*graphs(spark, sf_dir), policy).select("u1", "u2", "v1", "v2", F.round("weight", 6).alias("weight"))


def batch(spark, sf_dir):
    one, two = tables(spark, sf_dir, "customer", "nation"), tables(spark, sf_dir, "supplier", "region")
    m = match_batch([t.df for t in one], [t.df for t in two], Jaccard(distance=Distance.EXACT), [t.name for t in one], [t.name for t in two])
    return shown(m.df)


def fixture(spark) -> Matches:
    return Matches.of(spark, ROWS)


def metrics(spark, sf_dir):
    m = fixture(spark)
    got = {}
    for one in (True, False):
        for k in (Precision(one), Recall(one), F1Score(one), PrecisionTopNPercent(one, 50), PrecisionTopNPercent(one, 70)):
            got[f"{k.name()}_{'1to1' if one else 'all'}"] = k.value(m, TRUTH)
    got["RecallAtSizeofGroundTruth"] = RecallAtSizeofGroundTruth().value(m, TRUTH)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in got.items()], "metric string, value double")


def real_matches(spark, sf_dir) -> Matches:
    s, t = tables(spark, sf_dir, "customer", "supplier")
    return Matches(Jaccard(distance=Distance.EXACT).match(s, t))


def get_metrics(spark, sf_dir):
    got = real_matches(spark, sf_dir).get_metrics(REAL_TRUTH)
    return spark.createDataFrame([(k, round(v, 6)) for k, v in got.items()], "metric string, value double")


QUERIES = {
    "column_profile": column_profile,
    "jaccard_exact": matching(Jaccard(distance=Distance.EXACT), "customer", "supplier"),
    "jaccard_levenshtein": matching(Jaccard(), "customer", "supplier"),
    "jaccard_damerau": matching(Jaccard(distance=Distance.DAMERAU_LEVENSHTEIN), "customer", "supplier"),
    "jaccard_hamming": matching(Jaccard(distance=Distance.HAMMING), "customer", "supplier"),
    "jaccard_jaro": matching(Jaccard(distance=Distance.JARO), "supplier", "nation"),
    "jaccard_jaro_winkler": matching(Jaccard(distance=Distance.JARO_WINKLER), "supplier", "nation"),
    "jaccard_batch": batch,
    "global_rank": global_rank,
    "quantile_histogram": quantile_histogram,
    "quantile_emd": quantile_emd,
    "intersection_emd": intersection_emd,
    "distribution_match": matching(DistributionBased(), "customer", "supplier"),
    "flood_initial_map": flood_initial_map,
    "flood_connectivity": flood_connectivity,
    "flood_weights_average": flood_weights("inverse_average"),
    "flood_weights_product": flood_weights("inverse_product"),
    "cupid_leaf": matching(Cupid(), "customer", "supplier"),
    "composite_match": matching(Composite(), "customer", "supplier"),
    "composite_instances": matching(Composite(use_instances=True), "customer", "supplier"),
    "top_n": lambda spark, sf_dir: shown(fixture(spark).take_top_n(2).df),
    "top_percent": lambda spark, sf_dir: shown(fixture(spark).take_top_percent(40).df),
    "one_to_one": lambda spark, sf_dir: shown(fixture(spark).one_to_one().df),
    "match_metrics": metrics,
    "get_metrics": get_metrics,
    "one_to_one_tables": lambda spark, sf_dir: shown(real_matches(spark, sf_dir).one_to_one().df),
    "top_n_tables": lambda spark, sf_dir: shown(real_matches(spark, sf_dir).take_top_n(3).df),
    "dist_cutoff": dist_cutoff,
    "dist_clusters": dist_clusters,
}
for _formula in flooding.FORMULAS:
    for _policy in flooding.POLICIES:
        QUERIES[f"flood_match_{_formula.removeprefix('formula_')}_{_policy.removeprefix('inverse_')}"] = matching(SimilarityFlooding(_policy, _formula), "nation", "region")
