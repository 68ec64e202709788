"""Line dedup with a log-template tree.

A line's tokens that hold a digit are variable fields. The tree's leaf is chosen by the number of tokens and the first `depth` of them;
in a leaf, lines (the most frequent first) join the first template with which they share `similarity` of their tokens by position,
and positions on which they differ become variable too. A template that occurs in `min_docs` documents or more is recurring, one of `LONG`
tokens or more from `repeats` documents on: its lines are dropped from all documents but the first one that has it. So is a line that
`repeats` documents or more hold word for word, whatever its length. Nothing is lost altogether.

A leaf that fewer than `repeats` documents reach can't hold a recurring line, so only the other leaves' lines are moved. Equal lines
are counted before they meet in a leaf, and a leaf is read as a sorted stream; a task holds the templates of one leaf at a time.

Lines of up to three tokens are in it too, with leaves of equal lines only; their fields are variable where a word stands beside them, so
that bare numbers are alike only where they are equal.

Nulls: a null text has no lines and stays null. Blank lines are never dropped. Rows with a null doc_id, or that
repeat one, are handled as one document each id. A document whose lines all go stays, with an empty text. Extra columns pass through under any
names but those of the results, which the caller chooses; an empty table gives an empty result. Ties in frequency are broken by the masked line.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, small_batches, table
from .graphs import bitmap, maybe_in, present

DEPTH, SIMILARITY, MIN_DOCS, MIN_TOKENS = 3, 0.8, 5, 1
#: Word-for-word repeats, and templates of so many tokens, recur from so many documents on.
REPEATS, LONG = 2, 50
#: Lines of fewer tokens keep their digits unless a word is left beside the fields.
SHORT = 4
FIELD = b"<*>"
DIGIT = re.compile(b"[0-9]")
LETTER = re.compile(r"[^\W\d_]")


def masked(tokens: list[bytes], line: bytes) -> list[bytes]:
    """The tokens of a line, variable fields generalised."""
    if not DIGIT.search(line):
        return tokens
    general = [FIELD if DIGIT.search(t) else t for t in tokens]
    return general if len(tokens) >= SHORT or any(LETTER.search(t.decode()) for t in general) else tokens


def leaf_of(tokens: list[bytes], depth: int) -> int:
    return xxhash.xxh3_64_intdigest(b"\x00".join([b"%d" % len(tokens), *tokens[:depth]])) - 2**63


def key_of(tokens: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b"\x00".join(tokens))


def lines_of(text: str | None, min_tokens: int):
    """(tokens, masked tokens) of all lines but blank ones. bytes.split() splits at ASCII white space."""
    for line in (text or "").encode().split(b"\n"):
        tokens = line.split()
        if len(tokens) >= max(1, min_tokens):
            yield tokens, masked(tokens, line)


class Leaf:
    """Templates of one leaf, in the order they came. A line and a template that share enough tokens differ in `most` positions at most, so
    of most + 1 groups of positions one is equal in both: an index of the groups' tokens finds all templates a line can join, without a
    comparison with every one of them."""

    def __init__(self, width: int, similarity: float):
        self.width, self.similarity = width, similarity
        self.most = int(width * (1 - similarity) + 1e-9)
        self.groups = min(self.most + 1, width)
        self.rows: list[list[bytes]] = []
        self.names: list[bytes] = []
        self.index: dict[tuple, list[int]] = {}

    def keys(self, tokens: list[bytes]) -> list[tuple]:
        return [(g, *tokens[g :: self.groups]) for g in range(self.groups)]

    def place(self, tokens: list[bytes]) -> bytes:
        """The name of the first template that the line joins, or of a new one. Positions that differ become variable."""
        found = range(len(self.rows)) if self.most >= self.width else sorted({i for k in self.keys(tokens) for i in self.index.get(k, ())})
        for i in found:
            row = self.rows[i]
            if sum(map(bytes.__eq__, row, tokens)) >= self.similarity * self.width - 1e-9:
                general = [a if a == b else FIELD for a, b in zip(row, tokens, strict=True)]
                for old, new in zip(self.keys(row), self.keys(general), strict=True):
                    if old != new:
                        self.index[old].remove(i)
                        self.index.setdefault(new, []).append(i)
                self.rows[i] = general
                return self.names[i]
        for k in self.keys(tokens):
            self.index.setdefault(k, []).append(len(self.rows))
        self.rows.append(tokens)
        self.names.append(key_of(tokens))
        return self.names[-1]


def templates(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, keys): the lines, word for word, that a document loses."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def reach(batches):
        for pdf in batches:
            ids, leaves = [], []
            for key, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                got = {leaf_of(m, depth) for _, m in lines_of(text, min_tokens)}
                ids += [key] * len(got)
                leaves += got
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=pdf["doc_id"].dtype), "leaf": pd.Series(leaves, dtype="int64")})

    reached = d.mapInPandas(reach, f"doc_id {kind}, leaf bigint").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min(repeats, min_docs))
    bits = spark.sparkContext.broadcast(bitmap(reached, "leaf"))

    def emit(batches):
        """A row for each distinct line of a document; the first of those with one masked form carries it."""
        for pdf in batches:
            ids, leaves, raws, keys, lines = [], [], [], [], []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                got = list(lines_of(text, min_tokens))
                if not got:
                    continue
                leaf = np.array([leaf_of(m, depth) for _, m in got], dtype=np.int64)
                seen: set[bytes] = set()
                forms: set[bytes] = set()
                for on, x, (tokens, m) in zip(present(bits.value, leaf), leaf, got, strict=True):
                    if on and (raw := key_of(tokens)) not in seen:
                        seen.add(raw)
                        key = raw if m is tokens else key_of(m)
                        ids.append(doc)
                        leaves.append(x)
                        raws.append(raw)
                        keys.append(key)
                        lines.append(None if key in forms else b"\x00".join(m))
                        forms.add(key)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=pdf["doc_id"].dtype), "leaf": pd.Series(leaves, dtype="int64"), "raw": pd.Series(raws, dtype=object), "key": pd.Series(keys, dtype=object), "line": pd.Series(lines, dtype=object)})

    found = cut(d.mapInPandas(emit, f"doc_id {kind}, leaf bigint, raw binary, key binary, line binary"))

    def parse(batches):
        leaf, tree = None, None
        for pdf in batches:
            names, needs = [], []
            for x, line in zip(pdf["leaf"], pdf["line"], strict=True):
                tokens = bytes(line).split(b"\x00")
                if x != leaf:
                    leaf, tree = x, Leaf(len(tokens), similarity)
                names.append(tree.place(tokens) if len(tokens) == tree.width else key_of(tokens))
                needs.append(min(repeats, min_docs) if len(tokens) >= LONG else min_docs)
            yield pd.DataFrame({"key": pdf["key"], "template": pd.Series(names, dtype=object), "need": pd.Series(needs, dtype="int64")})

    counted = found.where("line is not null").groupBy("leaf", "key", "line").agg(F.count("*").alias("n"))
    parsed = cut(counted.repartition("leaf").sortWithinPartitions("leaf", F.desc("n"), "line").mapInPandas(parse, "key binary, template binary, need bigint"))
    used = cut(found.select("doc_id", "raw", "key").join(parsed, "key").select("doc_id", "raw", "template", "need"))

    def lost(by: str, need) -> DataFrame:
        many = used.select(by, "need", "doc_id").distinct().groupBy(by).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.min("need").alias("need")).where(F.col("docs") >= need).select(by, "first")
        return used.join(many, by).where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "raw")

    return lost("template", F.col("need")).union(lost("raw", F.lit(repeats))).groupBy("doc_id").agg(F.collect_set("raw").alias("keys"))


def without(text: str | None, keys, min_tokens: int) -> tuple[str | None, int, int]:
    """The text that is left, its lines and how many of them went."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if keys is None:
        return text, len(lines), 0
    gone = {bytes(k) for k in keys}
    kept = [x for x in lines if len(t := x.encode().split()) < max(1, min_tokens) or key_of(t) not in gone]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def dedup(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, repeats: int = REPEATS, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """The documents without recurring lines: text is what is left; two columns are added. Only documents that may lose lines are moved or
    go to Python."""
    if clash := {n_lines, n_dropped} & set(docs.columns):
        raise ValueError(f"the table has columns named as results: {', '.join(sorted(clash))}")
    id_, keys, out = fresh("id"), fresh("keys"), fresh("out")
    drop = templates(docs, depth, similarity, min_docs, min_tokens, repeats)
    drop = cut(drop.select(F.col("doc_id").alias(id_), F.col("keys").alias(keys)))

    def apply(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([without(t, k, min_tokens) for t, k in zip(texts, keys, strict=True)], columns=["text", "lines", "dropped"])

    run = F.pandas_udf(apply, "text string, lines bigint, dropped bigint")
    mine = maybe_in(drop, id_)(F.col("doc_id"))
    joined = docs.where(mine).join(drop, F.col("doc_id").eqNullSafe(F.col(id_)), "left").withColumn(out, run("text", keys))
    some = joined.withColumn("text", F.col(f"{out}.text")).select(*docs.columns, F.col(f"{out}.lines").alias(n_lines), F.col(f"{out}.dropped").alias(n_dropped))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return some.union(docs.where(~mine).select(*docs.columns, lines.cast("long").alias(n_lines), F.lit(0).cast("long").alias(n_dropped)))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def brute(texts: dict[int, str | None], depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, repeats: int = REPEATS) -> dict[int, tuple[int, int, str]]:
    """For tests: the same tree in one process."""
    docs_of: dict[tuple, set] = {}
    holders: dict[tuple, set] = {}
    form: dict[tuple, tuple] = {}
    for k, t in texts.items():
        for tokens, m in lines_of(t, min_tokens):
            docs_of.setdefault(tuple(m), set()).add(k)
            holders.setdefault(tuple(tokens), set()).add(k)
            form[tuple(tokens)] = tuple(m)
    trees: dict[tuple, list] = {}
    name: dict[tuple, list] = {}
    for m in sorted(docs_of, key=lambda m: (-len(docs_of[m]), b"\x00".join(m))):
        leaf = trees.setdefault((len(m), m[:depth]), [])
        for t in leaf:
            if sum(a == b for a, b in zip(t[1], m, strict=True)) / len(m) >= similarity:
                t[1] = [a if a == b else FIELD for a, b in zip(t[1], m, strict=True)]
                t[2] |= docs_of[m]
                name[m] = t
                break
        else:
            leaf.append([m, list(m), set(docs_of[m])])
            name[m] = leaf[-1]

    def stays(line: str, k: int) -> bool:
        tokens = tuple(line.encode().split())
        if tokens not in form:
            return True
        same, alike = holders[tokens], name[form[tokens]][2]
        need = min(repeats, min_docs) if len(tokens) >= LONG else min_docs
        return (len(same) < repeats or min(same) == k) and (len(alike) < need or min(alike) == k)

    out = {}
    for k, t in texts.items():
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if stays(x, k)]
        out[k] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out
