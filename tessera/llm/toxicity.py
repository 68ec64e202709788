"""Toxicity by a classifier chain.

Categories are predicted one after another, each by a logistic model over word features and the probabilities of the categories before
it; for training, those are out-of-fold, as the next model would otherwise learn from probabilities better than it will ever see.
Features are whole words and word starts of 2 to 8 characters, which also meet inflected forms; those with the highest chi-square for a
category are kept, found in whole texts by one automaton. Training uses at most `sample` labelled documents (chosen by a hash of their
id); scoring covers every document.

Nulls: a null text counts as empty; a null label leaves the row out of that category's training. A document labelled more than once
counts once for each label row. Without labelled documents, or with one kind of label only, a category's probability is its share of
positive labels (0 without any). Scoring goes row by row: repeated rows and extra columns pass through, an empty table stays empty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, small_batches, table

SAMPLE, KEPT, FOLDS, THRESHOLD = 16_000, 512, 3, 0.5
STARTS = range(2, 9)
CATEGORIES = ("low_quality", "toxic")
MARK = " "


def normal(text: str | None) -> str:
    return MARK + MARK.join(re.split(r"[\x20\x09-\x0D]+", (text or "").lower())).strip(MARK) + MARK


def features(text: str | None) -> set[str]:
    out = set()
    for w in set(normal(text).split(MARK)) - {""}:
        out.update(MARK + w[:k] for k in STARTS if k <= len(w))
        if len(w) <= 16:
            out.add(MARK + w + MARK)
    return out


@dataclass
class Chain:
    """Feature strings, and for each category its weights: bias, features, earlier categories."""

    categories: tuple[str, ...]
    vocabulary: list[str] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, f in enumerate(self.vocabulary):
            a.add_word(f, i)
        if self.vocabulary:
            a.make_automaton()
        return a

    def hits(self, a, text: str | None) -> list[int]:
        return sorted({i for _, i in a.iter(normal(text))}) if self.vocabulary else []

    def probabilities(self, hits: list[int]) -> list[float]:
        out: list[float] = []
        for w in self.weights:
            n = len(self.vocabulary)
            z = w[0] + w[1 : n + 1][hits].sum() + float(np.dot(w[n + 1 :], out) if out else 0.0)
            out.append(float(1 / (1 + np.exp(-z))))
        return out


def logistic(rows: np.ndarray, cols: np.ndarray, n: int, dim: int, dense: np.ndarray, y: np.ndarray, steps: int = 150, l2: float = 1e-4) -> np.ndarray:
    """Weights (bias, features, dense columns) by full-batch Adam on rows of feature hits."""
    w, m, v = (np.zeros(1 + dim + dense.shape[1]) for _ in range(3))
    share = min(max(y.mean(), 1e-6), 1 - 1e-6) if n else 0.5
    w[0] = np.log(share / (1 - share))
    if not n or share in (1e-6, 1 - 1e-6):
        return w
    for t in range(1, steps + 1):
        z = w[0] + np.bincount(rows, w[1 : dim + 1][cols], n) + (dense * w[dim + 1 :]).sum(axis=1)
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.concatenate([[e.sum()], np.bincount(cols, e[rows], dim), (dense * e[:, None]).sum(axis=0)])
        g[1:] += l2 * w[1:]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def score_rows(w: np.ndarray, rows, cols, n, dim, dense) -> np.ndarray:
    z = w[0] + np.bincount(rows, w[1 : dim + 1][cols], n) + (dense * w[dim + 1 :]).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, sample: int = SAMPLE, kept: int = KEPT, folds: int = FOLDS) -> Chain:
    """`labels` has doc_id and a 0/1 column for each category. At most `sample` labelled rows are used, so the driver's share is bounded."""
    small_batches(docs.sparkSession)
    chosen = labels.select("doc_id", *categories).where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    n_cat = len(categories)

    def count(batches):
        total: Counter = Counter()
        positive = [Counter() for _ in range(n_cat)]

        def counted() -> pd.DataFrame:
            out = pd.DataFrame([(f, n, [p[f] for p in positive]) for f, n in total.items()], columns=["feature", "n", "positive"])
            for c in (total, *positive):
                c.clear()
            return out

        for pdf in batches:
            for text, *ys in zip(pdf["text"], *[pdf[c] for c in categories], strict=True):
                got = features(text)
                total.update(got)
                for c, y in zip(positive, ys, strict=True):
                    if y == 1:
                        c.update(got)
                if len(total) > 100_000:  # what a task holds doesn't grow with its texts
                    yield counted()
        yield counted()

    counts = rows.mapInPandas(count, "feature string, n bigint, positive array<bigint>")
    counts = cut(counts.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(F.get("positive", F.lit(i))).alias(f"p{i}") for i in range(n_cat)]).where("n >= 4"))
    totals = rows.agg(F.count("*").alias("n"), *[F.count_if(F.col(c) == 1).alias(f"p{i}") for i, c in enumerate(categories)]).first()
    vocabulary: set[str] = set()
    for i in range(n_cat):
        n, p = totals["n"], totals[f"p{i}"]
        if not 0 < p < n:
            continue
        a, b = F.col(f"p{i}").cast("double"), F.col("n").cast("double")
        chi = (a * n - b * p) * (a * n - b * p) / (b * (n - b + 1) * p * (n - p))
        vocabulary |= {r.feature for r in counts.orderBy(F.desc(chi), "feature").limit(kept).collect()}
    chain = Chain(tuple(categories), sorted(vocabulary))

    def found(batches):
        a = chain.automaton()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["doc_id"], "fold": [xxhash.xxh3_64_intdigest(normal(t)) % folds for t in pdf["text"]], "hits": [chain.hits(a, t) for t in pdf["text"]], "y": [[-1 if v is None or v != v else int(v) for v in ys] for ys in zip(*[pdf[c] for c in categories], strict=True)]})

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    data = sorted(rows.mapInPandas(found, f"id {id_kind}, fold int, hits array<int>, y array<int>").collect(), key=lambda r: (r.id, r.y, r.hits))
    n, dim = len(data), len(chain.vocabulary)
    cols = np.array([c for r in data for c in r.hits], dtype=int)
    at = np.repeat(np.arange(n), [len(r.hits) for r in data]) if n else np.zeros(0, dtype=int)
    fold = np.array([r.fold for r in data], dtype=int)  # copies of a text are in one fold
    dense = np.zeros((n, 0))

    def train(mask: np.ndarray, y: np.ndarray) -> np.ndarray:
        place = np.cumsum(mask) - 1
        on = mask[at]
        return logistic(place[at[on]], cols[on], int(mask.sum()), dim, dense[mask], y[mask].astype(float))

    for i in range(n_cat):
        y = np.array([r.y[i] for r in data], dtype=int)
        known = y >= 0
        chain.weights.append(train(known, y) if n else np.concatenate([[-30.0], np.zeros(dim + i)]))
        held = np.zeros(n)
        for k in range(folds):
            w = train(known & (fold != k), y)
            held[fold == k] = score_rows(w, at, cols, n, dim, dense)[fold == k]
        dense = np.column_stack([dense, held])
    return chain


def score(docs: DataFrame, chain: Chain, text: str = "text", prefix: str = "p_") -> DataFrame:
    """Adds a column <prefix><category> for each category; a table that has one of that name is refused."""
    if clash := {prefix + c for c in chain.categories} & set(docs.columns):
        raise ValueError(f"the table has columns named as results: {', '.join(sorted(clash))}")

    @F.pandas_udf("array<double>")
    def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = chain.automaton()
        for texts in batches:
            yield pd.Series([chain.probabilities(chain.hits(a, t)) for t in texts])

    name = fresh("p")
    out = docs.withColumn(name, probabilities(F.col(text)))
    return out.withColumns({prefix + c: F.get(name, F.lit(i)) for i, c in enumerate(chain.categories)}).drop(name)


def label_columns(labels: DataFrame) -> DataFrame:
    low: Column = F.when(F.col("quality").isNotNull(), (F.col("quality") == 0).cast("int"))
    return labels.select("doc_id", low.alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Chain:
    return fit(docs, label_columns(table(spark, sf_dir, "labels")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category probabilities of every document and whether it is rejected as toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, trained(spark, docs, sf_dir))
    return out.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), (F.col("p_toxic") >= THRESHOLD).alias("rejected"))


def reject(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not rejected; columns as given."""
    prefix = fresh("p")
    return score(docs, trained(spark, docs, sf_dir), prefix=prefix).where(F.col(f"{prefix}toxic") < THRESHOLD).select(*docs.columns)
