"""URL filters: association rules mined from labelled URLs, beside a short list of fixed rules.

A URL is a set of tokens: host labels by their level from the right, path segments (digits generalised) and query keys. FP-growth over
the labelled URLs gives rules `tokens -> block`; those under the support or the confidence are pruned, as are rules that add tokens to a
kept rule without adding confidence. A URL is matched through an inverted index from a rule's rarest token to the rule.

Nulls: a null URL, or one without `://`, has an empty host, an empty path and no tokens; no rule fits it and its verdict is `allow`.
Rows are judged one by one, so repeated rows and extra columns pass through unchanged; an empty table gives an empty result; without
labelled URLs, or with labels of one kind only, no rule is learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, fresh, table

BLOCK = "=block"
#: The rules that the query applies before the learned ones (host, path, verdict).
FIXED_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def after_scheme(url: Column) -> Column:
    start = F.instr(url, "://")
    return F.coalesce(F.when(start > 0, url.substr(start + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: `h1:net`, `h2:example` (level from the right), `p:en`, `q:page`."""
    h, p = host(url), path(url)
    labels = F.transform(F.reverse(F.split(h, r"\.")), lambda x, i: F.when(x != "", F.concat(F.lit("h"), (i + 1).cast("string"), F.lit(":"), x)))
    parts = F.transform(F.split(p, "/"), lambda x: F.when(x != "", F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0"))))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.when(x != "", F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0))))
    return F.array_distinct(F.filter(F.concat(labels, parts, keys), lambda x: x.isNotNull()))


def fixed_rule(h: Column, p: Column, rules=FIXED_RULES) -> tuple[Column, Column]:
    """The longest fixed rule that fits (host and all its subdomains, path by its start) and its verdict; null where none fits.

    The list is meant to be short: it becomes one CASE."""
    rule = verdict = None
    for rh, rp, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule = F.when(fits, rh + rp) if rule is None else rule.when(fits, rh + rp)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


@dataclass(frozen=True)
class UrlRules:
    """Learned rules: (antecedent tokens, confidence, support). At most `max_rules` of them, so they fit in every task; `rest` holds those
    beyond, if any, as (key, a, confidence), the key being the rarest token."""

    rules: tuple[tuple[tuple[str, ...], float, float], ...]
    rarity: dict[str, int]
    rest: DataFrame | None = None

    def index(self) -> dict[str, list[tuple[frozenset, float]]]:
        """From the rarest token of each rule to the rule."""
        out: dict[str, list] = {}
        for ante, conf, _ in self.rules:
            out.setdefault(min(ante, key=lambda t: (self.rarity.get(t, 0), t)), []).append((frozenset(ante), conf))
        return out

    def score(self, toks: Column) -> Column:
        """The highest confidence among the rules that fit; null where none does."""
        index = self.index()

        @F.pandas_udf("double")
        def best(s: pd.Series) -> pd.Series:
            def one(ts):
                have = set(ts) if ts is not None else set()
                return max((c for t in have for ante, c in index.get(t, ()) if ante <= have), default=None)

            return pd.Series([one(ts) for ts in s], dtype="float64")

        return best(toks)


def mine(labelled: DataFrame, toks: str = "tokens", bad: str = "bad", min_support: float = 0.002, min_confidence: float = 0.5, max_rules: int = 10_000) -> UrlRules:
    """Rules from all labelled URLs. `max_rules` bounds what each task holds: the most confident rules, then the best supported; the others are matched by a join."""
    items = labelled.where(F.col(bad).isNotNull() & (F.size(toks) > 0)).select(F.concat(F.col(toks), F.when(F.col(bad) == 1, F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    if items.isEmpty():
        return UrlRules((), {})
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.element_at("consequent", 1) == BLOCK).where(F.col("lift") > 1)
    every = cut(found.select(F.array_sort("antecedent").alias("a"), "confidence", "support"))
    # A rule is redundant if a part of it is as confident.
    less = every.select(F.element_at("a", 1).alias("t"), F.col("a").alias("part"), F.col("confidence").alias("as"))
    within = (F.size("part") < F.size("a")) & (F.col("as") >= F.col("confidence")) & (F.size(F.array_except("part", "a")) == 0)
    redundant = every.select("a", "confidence", F.explode("a").alias("t")).join(less, "t").where(within).select("a").distinct()
    kept = cut(every.join(redundant, "a", "left_anti"))
    rows = kept.orderBy(F.desc("confidence"), F.desc("support"), F.size("a"), "a").limit(max_rules).collect()
    rows = sorted(((tuple(r.a), r.confidence, r.support) for r in rows), key=lambda r: (len(r[0]), -r[1], r[0]))
    used = {t for a, _, _ in rows for t in a}
    single = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("t"), "freq")
    rest = None
    if kept.count() > len(rows):
        held = labelled.sparkSession.createDataFrame([(list(a),) for a, _, _ in rows], "a array<string>")
        rarest = F.min_by("t", F.struct("freq", "t")).alias("key")
        rest = cut(kept.join(held, "a", "left_anti").select("a", "confidence", F.explode("a").alias("t")).join(single, "t").groupBy("a", "confidence").agg(rarest).select("key", "a", "confidence"))
    return UrlRules(tuple(rows), {r.t: r.freq for r in single.where(F.col("t").isin(sorted(used))).collect()} if used else {}, rest)


def with_rest(pages: DataFrame, toks: Column, rest: DataFrame, name: str) -> DataFrame:
    """Adds the highest confidence among the rules of `rest` that fit; each set of tokens is matched once."""
    t = fresh("tokens")
    own = pages.withColumn(t, toks)
    sets = own.select(t).where(F.size(t) > 0).distinct()
    fits = sets.select(t, F.explode(F.array_distinct(t)).alias("key")).join(rest, "key").where(F.size(F.array_except("a", t)) == 0)
    best = fits.groupBy(t).agg(F.max("confidence").alias(name))
    return own.join(best, t, "left").drop(t)


def judge(pages: DataFrame, learned: UrlRules, url: str = "url", fixed=FIXED_RULES, threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, block_confidence and verdict to every row; a table that has a column of such a name is refused."""
    if clash := {"host", "path", "rule", "block_confidence", "verdict"} & set(pages.columns):
        raise ValueError(f"the table has columns named as results: {', '.join(sorted(clash))}")
    u = F.col(url)
    h, p = host(u), path(u)
    rule, by_rule = fixed_rule(h, p, fixed)
    conf = learned.score(tokens(u))
    if learned.rest is not None:
        name = fresh("rest")
        pages, conf = with_rest(pages, tokens(u), learned.rest, name), F.greatest(conf, F.col(name))
    out = pages.withColumns({"host": h, "path": p, "rule": rule, "block_confidence": conf})
    out = out.drop(name) if learned.rest is not None else out
    return out.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("block_confidence") >= threshold, "block").otherwise("allow")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged. A page's label is that of the document whose number its path ends with: bad if toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    number = F.expr("try_cast(nullif(regexp_extract(coalesce(url, ''), '^[^?#]*/([0-9]{1,18})', 1), '') as bigint)")
    labelled = pages.select(tokens(F.col("url")).alias("tokens"), number.alias("doc_id")).join(labels, "doc_id").select("tokens", "bad")
    return judge(pages, mine(labelled)).select("page_id", "host", "path", "rule", "verdict", "block_confidence")

