"""Substring dedup: windows of consecutive words that start in an earlier document are removed.

Two passes. The first makes a count-min sketch: each partition counts, by the sketch's rows, the anchors of its windows (an anchor is the
window's 25-word gram of least hash; equal windows have equal anchors, so an anchor's count is at least that of each of its windows), and the
merged sketches overestimate how many documents have an anchor. The second pass takes the windows whose anchor is estimated in two documents
or more and groups exactly those by a 128-bit hash of their words: the least doc_id of a window decides which documents lose it. Nothing
that repeats is lost: estimates are never too low.

The sketch is never in one place. The hash space is cut into blocks, as many as the corpus asks for, each with its own rows of cells, so a
block costs the same at any size. A partition sends each block the cells it touched (once, or more often) and the runs of windows whose
anchors lie in it; the block's cells are merged first and its runs are looked up then. So texts are read once for the sketch and the
lookup, and then only those that hold runs estimated repeated. Anchors that repeat within a partition need no lookup, and windows that
a partition has in an earlier document need no comparison, so a passage that a third of all documents hold is sent once by each partition.

Nulls: a null text has no words; a null doc_id takes no part in comparisons and loses nothing. Documents with fewer words than a window
lose nothing. Rows that repeat a doc_id are one document's parts: they don't make each other lose words, and each gets its own result (rows
are told apart by their text's hash). Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .graphs import maybe_in

WINDOW, GRAM = 50, 25
#: Rows of the sketch, and cells of a block in each of them.
ROWS, CELLS = 3, 1 << 20
#: Runs, and windows, that a task holds before it sends them.
RUNS, WINDOWS = 200_000, 300_000
RECORD = np.dtype([("h", "<u8"), ("doc_id", "<i8"), ("part", "<i8"), ("start", "<i4"), ("n", "<i4")])
M1, M2, B1, B2 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
I1, I2 = (np.uint64(pow(int(b), -1, 2**64)) for b in (B1, B2))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * M1
    h = (h ^ (h >> np.uint64(29))) * M2
    return h ^ (h >> np.uint64(32))


def powers(b: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), b)]), dtype=np.uint64)[:n]


class Rolling:
    """Hashes of all runs of k words, from running sums of the words' hashes times powers of an odd number, modulo 2**64."""

    def __init__(self, words: np.ndarray, base: np.uint64, inverse: np.uint64):
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * powers(base, len(words)), dtype=np.uint64)])
        self.back = powers(inverse, len(words) + 1)

    def runs(self, k: int) -> np.ndarray:
        return mixed((self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(rolling: Rolling, window: int, gram: int) -> np.ndarray:
    """The anchor hash of every window: the least gram hash in it."""
    g = rolling.runs(gram)
    span, out = window - gram + 1, g
    done = 1
    while done * 2 <= span:  # sliding minimum by doubling
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = span - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def cells_of(h: np.ndarray, width: int) -> np.ndarray:
    """(rows, n): the cell of each hash in each row of the sketch; a row's cells follow those of the row before."""
    second = mixed(h ^ B2) | np.uint64(1)
    return np.stack([((h + np.uint64(r) * second) >> np.uint64(20)) % np.uint64(width) + np.uint64(r * width) for r in range(ROWS)]).astype(np.int64)


def texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    ids = batch.column(0).to_pylist()
    for i, t in zip(ids, batch.column(1), strict=True):
        yield i, t.as_buffer().to_pybytes() if t.is_valid else b""


def packed(cells: np.ndarray) -> bytes:
    return zlib.compress(np.diff(cells, prepend=cells[:1] * 0).astype("<u4").tobytes(), 1) if len(cells) else b""


def unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(b), "<u4").astype(np.int64)) if b else np.zeros(0, dtype=np.int64)


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return (mixed(h ^ B2) % np.uint64(blocks)).astype(np.int64)


def keyed(batch: pa.RecordBatch) -> Iterator[tuple[int | None, int, bytes]]:
    """doc_id, hash of the text, text."""
    for (key, text), part in zip(texts(batch), batch.column(2).to_pylist(), strict=True):
        yield key, part, text


def counted(docs: DataFrame, blocks: int, width: int, window: int, gram: int) -> DataFrame:
    """(block, kind, once, twice): for each block the cells touched (kind 0; once or by two documents or more) and the runs of windows to look
    up (kind 1); and the runs whose anchors repeat in the task (kind 2)."""
    schema = {"block": pa.int64(), "kind": pa.int32(), "once": pa.binary(), "twice": pa.binary()}

    def run(batches):
        touched: list[np.ndarray] = []
        runs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            anchors_, n = np.unique(np.concatenate(touched), return_counts=True)
            at = block_of(anchors_, blocks)
            cells = (cells_of(anchors_, width) + at * (ROWS * width)).ravel()
            # Two anchors of one document may share a cell, which then counts as touched twice: an estimate may be too high.
            cells, many = np.unique(np.concatenate([cells, np.repeat(cells, np.tile(np.minimum(n, 2) - 1, ROWS))]), return_counts=True)
            out = []
            of = cells // (ROWS * width)
            edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(cells)], strict=True):
                own = cells[a:b] - of[a] * (ROWS * width)
                out.append((int(of[a]), 0, packed(own), packed(own[many[a:b] > 1])))
            every = np.concatenate(runs)
            known = np.isin(every["h"], anchors_[n > 1])
            if known.any():
                out.append((blocks + int(every["doc_id"][0] % blocks), 2, zlib.compress(every[known].tobytes(), 1), None))
            every = every[~known]
            of = block_of(every["h"], blocks)
            order = np.argsort(of, kind="stable")
            every, of = every[order], of[order]
            edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
            for a, b in zip(edges, [*edges[1:], len(of)], strict=True) if len(of) else ():
                out.append((int(of[a]), 1, zlib.compress(every[a:b].tobytes(), 1), None))
            touched.clear()
            runs.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.values(), strict=True)], list(schema))

        for batch in batches:
            for key, part, text in keyed(batch):
                words = text.split()
                if key is None or len(words) < window:
                    continue
                a = anchors(Rolling(word_hashes(words), B1, I1), window, gram)
                touched.append(np.unique(a))
                start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                r = np.zeros(len(start), RECORD)
                r["h"], r["doc_id"], r["part"], r["start"], r["n"] = a[start], key, part, start, np.diff(np.r_[start, len(a)])
                runs.append(r)
                held += len(r)
                if held > RUNS:
                    yield flush()
                    held = 0
        if touched:
            yield flush()

    return docs.mapInArrow(run, "block bigint, kind int, once binary, twice binary")


def estimated(bits: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Which hashes are estimated in two documents or more: all their cells are."""
    out = np.ones(len(h), dtype=bool)
    for cells in cells_of(h, width):
        out &= bits[cells]
    return out


def looked_up(parts: DataFrame, width: int) -> DataFrame:
    """(id, part, start, n): the runs of windows whose anchors are estimated in two documents or more. Rows come sorted by block and kind, so
    a block's cells are merged before its runs are looked up."""

    def run(batches):
        block, once, twice = None, None, None
        for batch in batches:
            found = []
            for of, kind, first, second in zip(*[batch.column(i) for i in range(4)], strict=True):
                data = first.as_py()
                if kind.as_py() == 2:
                    found.append(np.frombuffer(zlib.decompress(data), RECORD))
                    continue
                if of.as_py() != block:
                    block, once, twice = of.as_py(), np.zeros(ROWS * width, dtype=bool), np.zeros(ROWS * width, dtype=bool)
                if kind.as_py() == 0:
                    cells = unpacked(data)
                    twice[cells[once[cells]]] = True
                    once[cells] = True
                    twice[unpacked(second.as_py())] = True
                else:
                    runs = np.frombuffer(zlib.decompress(data), RECORD)
                    found.append(runs[estimated(twice, runs["h"], width)])
            if found:
                out = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(out[c].copy()) for c in ("doc_id", "part", "start", "n")], ["id", "part", "start", "n"])

    return parts.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, "id bigint, part bigint, start int, n int")


def windows(docs: DataFrame, window: int) -> DataFrame:
    """(k1, k2, doc_id, part, start, known) of the windows in the runs of (doc_id, text, part, runs). Of equal windows in a task, those that an
    earlier document has there too are known to go; they get keys of their own."""

    def sent(got: list) -> pa.RecordBatch:
        k1, k2, doc, part, start = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.lexsort((start, part, doc, k2, k1))
        k1, k2, doc, part, start = (c[order] for c in (k1, k2, doc, part, start))
        new = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
        known = doc > doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
        one = new | np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (start[1:] != start[:-1])]
        k1 = np.where(known, mixed((part + start).view(np.uint64)), k1)
        back = np.lexsort((start[one], part[one], doc[one]))  # neighbours compress
        return pa.RecordBatch.from_arrays([pa.array(c[one][back]) for c in (k1.view(np.int64), k2.view(np.int64), doc, part, start.astype(np.int32), known)], ["k1", "k2", "doc_id", "part", "start", "known"])

    def run(batches):
        got, held = [], 0
        for batch in batches:
            runs = batch.column(3)
            edges, from_, n = (c.to_numpy(zero_copy_only=False) for c in (runs.offsets, runs.values.field(0), runs.values.field(1)))
            for i, (key, part, text) in enumerate(keyed(batch)):
                h = word_hashes(text.split())
                own = slice(edges[i], edges[i + 1])
                start = np.concatenate([np.arange(a, a + k, dtype=np.int64) for a, k in zip(from_[own].tolist(), n[own].tolist(), strict=True)])
                got.append((Rolling(h, B1, I1).runs(window)[start], Rolling(mixed(h), B2, I2).runs(window)[start], np.full(len(start), key, np.int64), np.full(len(start), part, np.int64), start))
                held += len(start)
                if held > WINDOWS:
                    yield sent(got)
                    got, held = [], 0
        if got:
            yield sent(got)

    return docs.mapInArrow(run, "k1 bigint, k2 bigint, doc_id bigint, part bigint, start int, known boolean")


def with_part(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("part"))


def joined_parts(docs: DataFrame, right: DataFrame, how: str) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, part) joined with right (id, part, ...), and the rows that can't have a partner; only the others are moved."""
    mine = maybe_in(right, "id")(F.col("doc_id"))
    right = right.withColumnRenamed("part", "part_")
    both = docs.where(mine).join(right, (F.col("doc_id") == F.col("id")) & (F.col("part") == F.col("part_")), how)
    return both, docs.where(~mine)


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """(id, part, starts): where the windows start that a document with a smaller doc_id has too, for each document and text."""
    small_batches(docs.sparkSession)
    d = with_part(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    # Some 13 windows share an anchor and a word has about 6 bytes; 12 cells for each anchor keep the estimates sharp.
    need = 12 * int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // 80
    blocks = need // cells + 1
    runs = looked_up(counted(d, blocks, cells, window, gram), cells)
    # Rows of one document and text have the same runs, so an array is no longer than a text.
    runs = cut(runs.groupBy("id", "part").agg(F.collect_set(F.struct("start", "n")).alias("runs")))
    texts_, _ = joined_parts(d, runs, "inner")
    w = windows(texts_.select("doc_id", "text", "part", "runs"), window)
    w = w.withColumn("first", F.min("doc_id").over(Window.partitionBy("k1", "k2"))).where("known or first < doc_id")
    return w.groupBy(F.col("doc_id").alias("id"), "part").agg(F.collect_set("start").alias("starts"))


def kept_words(words: list[bytes], starts, window: int) -> list[bytes]:
    n = len(words)
    gone = np.zeros(n + 1, dtype=np.int64)
    s = np.asarray(starts, dtype=np.int64)
    s = s[s + window <= n]
    np.add.at(gone, s, 1)
    np.add.at(gone, s + window, -1)
    cover = np.cumsum(gone)[:n] > 0
    return [w for w, c in zip(words, cover, strict=True) if not c]


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, cells: int = CELLS, text_out: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, text): each document without the words that earlier documents' windows cover; `text` (kept
    words joined by one space) is null unless asked for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    gone = cut(removals(docs, window, gram, cells))
    some, rest = joined_parts(with_part(docs), gone, "left")
    joined = some.select("doc_id", "text", "starts").union(rest.select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts")))

    def finish(batches):
        for pdf in batches:
            rows = []
            for text, starts in zip(pdf["text"], pdf["starts"], strict=True):
                words = (text or "").encode().split()
                kept = kept_words(words, starts, window) if starts is not None else words
                whole = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode() if text_out else None))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "text"])
            out.insert(0, "doc_id", pdf["doc_id"].values)
            yield out

    return joined.mapInPandas(finish, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, text string")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), text_out=False).drop("text")


def brute(texts_: dict[int, str | None], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """For tests: all windows in a dictionary."""
    words = {k: (t or "").encode().split() for k, t in texts_.items()}
    first: dict[tuple, int] = {}
    for k in sorted(words):
        for i in range(len(words[k]) - window + 1):
            first.setdefault(tuple(words[k][i : i + window]), k)
    out = {}
    for k, w in words.items():
        kept = kept_words(w, [i for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < k], window)
        out[k] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out
