"""Each stage of the pipeline against a plain version of it in one process, on what the stage before kept."""

import hashlib
import math
import struct
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import jaccard_join, line_templates, mixing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows of `documents` and of every stage, in order."""
    home = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, SF)
        out.append(done.collect())
        done.write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
    return out


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_toxicity(spark, kept):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    chain = toxicity.trained(spark, docs, SF)
    stay = []
    for r in kept[0]:
        text, before = toxicity.normal(r.text), []
        for w in chain.weights:
            z = w[0] + sum(w[1 + i] for i, f in enumerate(chain.vocabulary) if f in text)
            z += sum(a * b for a, b in zip(w[1 + len(chain.vocabulary) :], before, strict=True))
            before.append(1 / (1 + math.exp(-z)))
        if before[chain.categories.index("toxic")] < toxicity.THRESHOLD:
            stay.append(r)
    assert sorted(kept[1]) == sorted(stay) and 0 < len(stay) < len(kept[0])


def test_line_dedup(kept):
    want = line_templates.brute({r.doc_id: r.text for r in kept[1]})
    given = {r.doc_id: r for r in kept[1]}
    assert sorted(r.doc_id for r in kept[2]) == sorted(given) and any(n for _, n, _ in want.values())
    for r in kept[2]:
        was, dropped = given[r.doc_id], want[r.doc_id][1]
        assert hashlib.sha256((r.text or "").encode()).hexdigest() == want[r.doc_id][2]
        assert (r.lang, r.source, r.n_chars) == (was.lang, was.source, len(r.text) if dropped else was.n_chars)


def test_one_of_each(kept):
    groups = jaccard_join.brute({r.doc_id: r.text for r in kept[2]}, 5, 80, 100)
    assert sorted(kept[3]) == sorted(r for r in kept[2] if groups[r.doc_id][1] == r.doc_id)


def level_targets(sizes):
    """Shares by weight; sources above twice their size are held there and the rest is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, s in enumerate(names)}
    rest, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        over = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]}
        if not over or over == free:
            break
        free -= over
        rest -= sum(2 * sizes[s] for s in over)
        target |= {s: 2 * sizes[s] for s in over}
    total = sum(weight[x] for x in free)
    return names, target | {s: min(2 * sizes[s], rest * weight[s] / total) for s in free}


def time_of(start, end, share):
    """By bisection: when a linear schedule has asked for this share of its tokens."""
    low, high = 0.0, 1.0
    for _ in range(60):
        t = (low + high) / 2
        asked = (start * t + (end - start) * t * t / 2) / ((start + end) / 2)
        low, high = (t, high) if asked < share else (low, t)
    return low


def test_mixing(kept):
    by = defaultdict(list)
    for r in kept[3]:
        h = xxhash.xxh64_intdigest(struct.pack("<i", 9), xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42))
        by[r.source].append((h, r.doc_id, words(r.text), r))
    sizes = {s: sum(len(w) for _, _, w, _ in rows) for s, rows in by.items()}
    names, target = level_targets(sizes)
    want = []
    for i, s in enumerate(names):
        goal, at = math.floor(target[s] + 0.5), 0
        for turn in range(2):
            for _, k, w, r in sorted(by[s], key=lambda x: x[:2]):
                n = min(len(w), max(0, goal - at))
                if n:
                    text = r.text if n == len(w) else " ".join(w[:n])
                    want.append((time_of(*mixing.SCHEDULES[i % len(mixing.SCHEDULES)], (at + n / 2) / goal), k, text, s, len(text)))
                at += len(w)
    want.sort(key=lambda x: x[:2])
    got = [(r.doc_id, r.text, r.source, r.n_chars) for r in kept[4]]
    assert sum(len(words(r.text)) for r in kept[4]) == sum(math.floor(t + 0.5) for t in target.values())
    assert got == [x[1:] for x in want]


def test_packing(kept):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = defaultdict(list)
    for r in kept[4]:
        ids[r.doc_id].append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0])
    used, at = Counter(), defaultdict(list)
    for r in kept[5]:
        assert any(len(x) == r.doc_tokens and x[r.start : r.start + r.length] == list(r.ids) for x in ids[r.doc_id])
        used[r.doc_id] += r.length
        at[r.sequence_id].append((r.offset, r.length))
    assert used == Counter({k: sum(map(len, x)) for k, x in ids.items()})
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert sum(used.values()) / (1024 * len(at)) > 0.95
