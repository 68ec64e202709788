"""Packing, mixing, URL rules, nearest neighbours, and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, neighbours, packing, url_filters
from tessera.llm.common import n_words

SF = "/root/testdata/sf0.001"


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["b", "a", "é", "Z", None, "hot", "hot", "hot"]), rng.choice((0, 1, 7, 300))) for i in range(800)]
    rows += [(5, "a", 7), (5, "a", 7), (None, "b", 3), (901, "b", None), (902, "tiny", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumns({"rank": F.lit(1), "n": F.lit("x"), "start": F.lit("y")})
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + (n or 0)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, fixed = {}, set()
    while True:
        free = [s for s in order if s not in fixed]
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in fixed)
        goal = {s: 2 * sizes[s] if s in fixed else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if goal[s] > 2 * sizes[s]}
        if not over:
            break
        fixed |= over
    for s in order:
        mine = [r for r in got if r.source == s]
        assert mine[0].source_size == sizes[s] and mine[0].target == pytest.approx(goal[s])
        assert abs(sum(r.taken for r in mine) - goal[s]) <= 1
    assert all(0 <= r.taken <= 2 * (r.size or 0) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(df.where("false")).count() == 0


def test_schedules_are_followed(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3], 10) for i in range(3000)], "doc_id long, source string, size long")
    rows = mixing.mix(df, weights=(1.0,), share=1.0).select("source", F.explode("parts").alias("p")).select("source", "p.position").collect()
    early = {s: sum(r.position < 0.25 for r in rows if r.source == s) / 1000 for s in "abc"}
    assert early["a"] == pytest.approx(0.5 * 0.25 + 0.25**2 / 2, abs=0.01) and early["b"] == pytest.approx(0.25, abs=0.01) and early["c"] == pytest.approx(1.5 * 0.25 - 0.25**2 / 2, abs=0.01)


def test_curriculum_counts_words(spark):
    df = spark.createDataFrame([(i, "one two\nthree " * (i % 5), "s", 1) for i in range(50)] + [(99, None, None, None)], "doc_id long, text string, source string, size int")
    out = mixing.curriculum(df)
    assert out.columns == df.columns
    total = sum(6 // 2 * (i % 5) for i in range(50))
    assert sum(len(re.findall(r"\S+", r.text)) for r in out.collect()) == round(1.5 * total)
    assert [r[0] for r in df.select(n_words(F.col("text"))).where("text is null").collect()] == [0]


def test_cutting_stock():
    rng = random.Random(3)
    for n in (0, 1, 5, 300, 4000):
        count: dict = {}
        for _ in range(n):
            s = min(256, max(1, int(rng.lognormvariate(4, 1))))
            count[s] = count.get(s, 0) + 1
        plan = packing.plan(dict(count), 256)
        used: dict = {}
        for p, k in plan:
            assert sum(s * m for s, m in p.items()) <= 256
            for s, m in p.items():
                used[s] = used.get(s, 0) + m * k
        assert used == count
        if n >= 300:
            assert sum(k for _, k in plan) <= 1.02 * sum(s * m for s, m in count.items()) / 256 + 2


def test_knapsack_against_brute_force():
    sizes, values = np.array([3, 5, 7]), np.array([0.4, 0.7, 0.95])
    for room in range(1, 25):
        want = max(a * 0.4 + b * 0.7 + c * 0.95 for a in range(9) for b in range(6) for c in range(4) if 3 * a + 5 * b + 7 * c <= room)
        best, pattern = packing.knapsack(sizes, values, room)
        assert best == pytest.approx(want) and sum(s * n for s, n in pattern.items()) <= room


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    texts = {i: " ".join(rng.choice(["the", "word", "ünder", "naïve", "日本語", "'s", "x9"]) for _ in range(rng.choice((1, 30, 900, 2500)))) for i in range(40)}
    texts |= {50: None, 51: "", 52: "a" * 30_000, 53: " \n\n  tab\t!", 54: "curly ’quotes’ …"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumns({"length": F.lit(1), "offset": F.lit("x")})
    parts = packing.cut(packing.pieces(df))
    rows = packing.pack(parts).collect()
    for k, text in texts.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert [i for r in mine for i in r.ids] == ids and all(r.doc_tokens == len(ids) for r in mine)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(packing.cut(packing.pieces(df.where("false")))).count() == 0
    twice = packing.pack(packing.cut(packing.pieces(df.union(df), with_ids=False).drop("ids"))).collect()
    assert len(twice) == 2 * len(rows) and len({(r.sequence_id, r.offset) for r in twice}) == len(twice)


def test_ids_of_all_latin_1_pairs():
    tokens = packing.Tokens("byte_bpe_50k.json")
    letters = [chr(i) for i in range(256)]
    texts = [*letters, *(a + b for a in letters for b in letters), *(f"x{a}{b} 7" for a in letters for b in letters), "a <|endoftext|> b"]
    want = [e.ids for e in tokens.full.encode_batch(texts, add_special_tokens=False)]
    assert [tokens.ids(t) for t in texts] == want


URLS = ["http://A.Example.NET/en/1?x#y", "https://example.com/de/", "http://example.com", "ftp://www.bbc.org/fr/a", "no scheme/net/", None, "", "://x.net/", "http://net/", "http://xnet/", "http://h.net?q=/", "http://a.org/fr", "a://b://c.net/z", "HTTP://ÄB.ORG/fr/"]


def judge_one(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [h + p for h, p, _ in url_filters.FIXED_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_fixed_url_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumn("tokens", F.lit(1))
    rows = url_filters.judge(df, url_filters.UrlRules((), {})).collect()
    for r in rows:
        assert (r.host, r.path, r.rule) == judge_one(r.url)
        assert r.verdict == ("block" if r.rule in ("net/", "example.com/de/") else "allow")
    assert url_filters.judge(df.where("false"), url_filters.UrlRules((), {})).count() == 0


def test_learned_url_rules(spark):
    rng = random.Random(2)
    urls = [(f"http://{h}.site.com/{p}/{i}", int(h == "bets" and p == "x")) for i in range(400) for h, p in [(rng.choice(("bets", "blog", "www")), rng.choice(("x", "y")))]]
    df = spark.createDataFrame(urls, "url string, bad int").withColumn("tokens", url_filters.tokens(F.col("url")))
    learned = url_filters.mine(df, min_confidence=0.8)
    assert learned.rules and all({"h3:bets", "p:x"} <= set(a) for a, _, _ in learned.rules)
    wrong = [r for r in url_filters.judge(df, learned).collect() if (r.verdict == "block") != bool(r.bad)]
    assert not wrong
    assert url_filters.mine(df.where("false")).rules == () and url_filters.mine(df.where("bad = 0")).rules == ()


def test_url_rules_beyond_the_bound_are_joined(spark):
    rng = random.Random(7)
    urls = [(i, f"http://{h}.site.com/{p}/{q}", int(h == "bets" or p == "x" and rng.random() < 0.8)) for i in range(400) for h, p, q in [(rng.choice(("bets", "blog", "www")), rng.choice("xy"), rng.choice("mn"))]]
    df = spark.createDataFrame([*urls, (None, None, None)], "id int, url string, bad int")
    rules = lambda most: url_filters.mine(df.withColumn("tokens", url_filters.tokens(F.col("url"))), max_rules=most)
    got = [sorted((r.id or -1, r.verdict, r.block_confidence or 0.0) for r in url_filters.judge(df, rules(most)).collect()) for most in (1, 10_000)]
    assert got[0] == got[1] and len(got[0]) == 401
    assert len({c for _, _, c in got[0]}) > 2


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[40:400] = x[40]
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [float("inf")] + [1.0] * 15), (2005, [None] + [1.0] * 15), (None, rows[0][1]), (2020, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad + rows[:2], "vec_id long, embedding array<float>").withColumn("id", F.lit(1))
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), 20, shard_size=500).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    v = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    hit = 0
    assert set(by) == set(range(0, 1500, 20))
    for q in by:
        s = v @ v[q]
        want = [i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:20]
        mine = sorted(by[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and q not in {m[1] for m in mine}
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1])) and all(m[2] == pytest.approx(s[m[1]]) for m in mine)
        hit += len({m[1] for m in mine} & set(want))
    assert hit / (20 * len(by)) >= 0.9
    assert neighbours.nearest(df.where("false"), df.where("false"), 20).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = packing.cut(stage(spark, docs, SF))
        assert after.columns == docs.columns, name
        seen.append({r.doc_id for r in after.select("doc_id").collect()})
        docs = after
    clean = {k for k, v in labels.items() if not v}
    assert clean <= seen[0] and seen[0] == seen[1]
    assert seen[2] <= seen[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert packed and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
