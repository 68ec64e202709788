"""Tables, their column catalog, type labels, and reading delimited files."""

from __future__ import annotations

import csv
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import render

INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
#: Rows looked at for columns' first values.
HEAD = 100
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


@dataclass(frozen=True, eq=False)
class Table:
    """A named DataFrame. Nested and binary columns have no comparable values and are left out unless `nested` turns them to JSON."""

    name: str
    df: DataFrame
    nested: bool = False

    @property
    def fields(self) -> list[tuple[int, T.StructField]]:
        """Position and field of each column; of columns with one name, the last counts."""
        by_name = {f.name: (i, f) for i, f in enumerate(self.df.schema.fields) if self.nested or not isinstance(f.dataType, NESTED)}
        return sorted(by_name.values(), key=lambda x: x[0])

    @property
    def columns(self) -> list[str]:
        return [f.name for _, f in self.fields]

    @property
    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def cells(self) -> DataFrame:
        """(table, column, pos, value): every non-null value as text, in long form, so one job serves all columns."""
        fields = self.fields
        if not fields:
            return self.df.sparkSession.createDataFrame([], "table string, column string, pos int, value string")
        wide = self.df.toDF(*[f"c{i}" for i in range(len(self.df.columns))])
        one = [F.struct(F.lit(f.name).alias("column"), F.lit(i).alias("pos"), render(F.col(f"c{i}"), f.dataType).alias("value")) for i, f in fields]
        return wide.select(F.explode(F.array(*one)).alias("x")).where("x.value is not null").select(F.lit(self.name).alias("table"), "x.*")

    def labels(self) -> dict[str, str]:
        """The type label of each column. A string column is a date if its first value reads as one. Values are looked for in the first rows;
        only columns without any there are read on, each until a value is found."""
        fields = self.fields
        wide = self.df.toDF(*[f"c{i}" for i in range(len(self.df.columns))])
        shown = {f"c{i}": render(F.col(f"c{i}"), f.dataType).alias(f"c{i}") for i, f in fields}
        head = wide.select(*shown.values()).limit(HEAD).collect() if fields else []
        first = {c: next((r[c] for r in head if r[c] is not None), None) for c in shown}
        if len(head) == HEAD:
            for c in (c for c, v in first.items() if v is None):
                found = wide.where(F.col(c).isNotNull()).select(shown[c]).limit(1).collect()
                first[c] = found[0][0] if found else None
        out = {}
        for i, f in fields:
            value = first[f"c{i}"]
            if isinstance(f.dataType, (T.StringType, T.DateType, T.DecimalType)):
                out[f.name] = "date" if value is not None and is_date(value) else "varchar"
            elif value is None:
                out[f.name] = f.dataType.simpleString()
            else:
                out[f.name] = "int" if isinstance(f.dataType, INTS) else "float" if isinstance(f.dataType, FLOATS) else ""
        return out


def catalog(tables: Iterable[Table], with_labels: bool = False) -> list[tuple[str, str, int, str]]:
    """(table, column, pos, label) of all columns. Its size is the schemas', not the data's."""
    out = []
    for t in tables:
        labels = t.labels() if with_labels else {}
        out += [(t.name, f.name, i, labels.get(f.name, "")) for i, f in t.fields]
    return out


def is_date(text: str, fuzzy: bool = False) -> bool:
    from dateutil.parser import parse

    try:
        parse(text, fuzzy=fuzzy)
    except (ValueError, OverflowError, TypeError):
        return False
    return True


def sniff_encoding(spark: SparkSession, path: str, sample: int = 65536) -> str:
    """The encoding that a file's first bytes fit: a byte-order mark decides, then UTF-8, then Latin-1. Plain ASCII counts as UTF-8."""
    head = bytes(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, sample).alias("head")).first().head)
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if head.startswith(mark):
            return name
    for cut in range(4):  # the sample may end within a character
        try:
            head[: len(head) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    return "iso-8859-1"


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).first()
    return csv.Sniffer().sniff(first.value).delimiter if first else ","


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A delimited file with a header and doubled quotes; delimiter and encoding are found out unless given."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    reader = reader.option("sep", delimiter or sniff_delimiter(spark, path)).option("encoding", encoding or sniff_encoding(spark, path).replace("utf-8-sig", "utf-8"))
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)
