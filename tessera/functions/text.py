"""String rendering, name tokens and string distances."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def render(c: Column, kind: T.DataType) -> Column:
    """A value as text, the same for equal values of all numeric types that print alike: floats keep a decimal point and turn to exponents
    below 1e-4 and from 1e16; booleans are capitalised; timestamps are ISO with nine digits of a second."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        plain = d.cast("string")
        whole = F.concat(d.cast("bigint").cast("string"), F.lit(".0"))
        digits = F.regexp_replace(plain.cast("decimal(38,18)").cast("string"), "0+$", "")
        mantissa = F.regexp_replace(F.regexp_extract(plain, "^(-?[0-9.]+)E", 1), r"\.0$", "")
        exponent = F.regexp_extract(plain, "E(-?[0-9]+)$", 1).cast("int")
        scientific = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
        size = F.abs(d)
        shown = F.when(F.isnan(d), "nan").when(size == float("inf"), F.when(d > 0, "inf").otherwise("-inf"))
        shown = shown.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), plain).when((size >= 1e7) & (size < 1e16) & (d == F.floor(d)), whole)
        return shown.when((size >= 1e-4) & (size < 1e16), digits).otherwise(scientific)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def similarity_of(distance: Column, a: Column, b: Column) -> Column:
    """An edit distance as a similarity: 1 - d / max(length, 1)."""
    return 1.0 - distance / F.greatest(F.length(a), F.length(b), F.lit(1))


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ; what one string has more counts as differing."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.length(b), F.lit(1))), F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))).cast("int"))


def damerau_of(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: swapped neighbours may be edited again."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [far, i] + [0] * len(b)
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            swap = rows[k][m] + (i - k - 1) + 1 + (j - m - 1)
            row[j + 1] = min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, swap)
            if x == y:
                seen = j
        rows.append(row)
        last[x] = i
    return rows[-1][-1]


def jaro_of(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b and bool(a))
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    mine = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [y for y, u in zip(b, used, strict=True) if u]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro, raised for up to four equal first characters where it is above 0.7."""
    j = jaro_of(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j) if j > 0.7 else j


@F.pandas_udf(T.IntegerType())
def damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([damerau_of(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


NUMBER = r"^[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*$"


def number(c: Column) -> Column:
    """The value of a text that reads as a decimal number, else null."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def snake(c: Column) -> Column:
    split = F.regexp_replace(F.regexp_replace(c, r"(.)([A-Z][a-z]+)", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(split)


def stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def name_tokens(name: Column) -> Column:
    """Tokens of a schema name as an array of (kind, data): numbers, common words and content; symbols say nothing and are left out."""
    spaced = F.translate(snake(name), "_", " ")
    words = F.filter(F.split(F.regexp_replace(spaced, r"[^\p{L}\p{N}.]+", " "), " "), lambda w: F.regexp_replace(w, r"[.]", "") != "")
    kind = lambda w: F.when(w.rlike(NUMBER), "number").when(w.isin(stop_words()), "common").otherwise("content")
    return F.transform(words, lambda w: F.struct(kind(w).alias("kind"), w.alias("data")))
