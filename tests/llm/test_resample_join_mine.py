"""Importance resampling, the Jaccard join and hard-negative mining against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from faultline.llm import hard_negatives, jaccard, queries, resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", " \n", "a b", "Ab", "é日😀 x9_Z", "one two three four five six", "x " * 4000, "same words " * 15, "same words " * 15, "İstanbul ÀB " * 12]


def frame(spark, texts=TEXTS):
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "same words " * 15, None), (3, "a b", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as bucket", "2 as n", "3 as score", "4 as label", "5 as key", "6 as set_id", "7 as weight")


def resampled(docs, target, grams=1, buckets=10_000):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, grams + 1) for i in range(len(w) - k + 1)]

    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, x in docs:
        np.add.at(s, features(x)[1], 1)
    for x in target:
        np.add.at(t, features(x)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * float(s.sum() + buckets) / ((a + 1) * float(t.sum() + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for d, x in docs:
        n, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= 20])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(order[: 10 * len(order) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("grams", [1, 2])
def test_resampling_against_brute_force(spark, sf_dir, grams):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(frame(spark).selectExpr("doc_id + 100000 as doc_id", "text"))
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = resampling.resample(docs, target, grams)
    want = resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], grams)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(r[4] is not None for r in want) > 10


def test_resampling_of_odd_tables(spark):
    docs, none = frame(spark), frame(spark).limit(0)
    got = resampling.resample(docs, none).collect()
    assert sorted((tuple(r) for r in got), key=repr) == resampled([(r.doc_id, r.text) for r in docs.collect()], [])
    assert resampling.resample(none, docs).count() == 0


def test_scoring_explodes_nothing_and_gains_are_one_literal(spark, sf_dir):
    plan = resampling.mean_gain(resampling.F.col("b"), list(range(10_000)))
    text = spark.createDataFrame([([1, 2, 2],), ([],)], "b array<int>").select(plan.alias("w"))
    assert [r.w for r in text.collect()] == [1, 0]
    explained = text._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in explained and "split" not in explained  # folded


def shingles(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, share, of):
    sets = [(d, shingles(t, k)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and of * len(x & y) >= share * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {(d, len(s), root(d)) for d, s in sets}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for i in rng.sample(range(len(w)), edits):
            w[i] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def planted(seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    out = [t for edits in (1, 2, 3, 4, 5) for t in family(rng, base, 8, edits)] + [" ".join(base)]
    out += family(rng, base[:30], 10, 1) + [" ".join(base[:40])] * 5 + [" ".join(base[:41])]
    passage = [f"p{i}" for i in range(60)]
    out += [" ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 40))]) for _ in range(25)]
    forms = [[f"f{i}" if i % 5 else f"v{rng.randrange(3)}x{i}" for i in range(60)] for _ in range(20)]
    out += [" ".join(f) for f in forms] + [" ".join(f[:-1] + ["z"]) for f in forms]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("rule", "hot", "block"), [(jaccard.Rule(), 512, 1024), (jaccard.Rule(), 2, 4), (jaccard.Rule(5, 80), 1, 8), (jaccard.Rule(1, 2, 3), 3, 16)])
def test_join_against_all_pairs(spark, monkeypatch, rule, hot, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = frame(spark, TEXTS + planted(hot))
    got = {tuple(r) for r in jaccard.jaccard_components(docs, rule, hot).collect() if r.doc_id is not None}
    assert got == components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], rule.shingle, rule.share, rule.of)
    assert len({c for _, _, c in got}) < len(got) - 40


def test_join_of_odd_rows(spark):
    rows = {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(frame(spark)).collect()}
    assert {(0, 0), (1, 1), (2, 2), (8, 8), (9, 8), (None, 8), (3, 3)} <= rows  # texts without words link with nothing
    assert jaccard.jaccard_components(frame(spark).limit(0)).count() == 0
    alone = spark.createDataFrame([(None, "a b c d e")], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.jaccard_components(alone).collect()] == [(None, 2, None)]


def test_sizes_of_partners_and_parts():
    for rule in (jaccard.Rule(), jaccard.Rule(5, 80), jaccard.Rule(3, 1, 2)):
        for n in range(1, 400):
            k, schemes = rule.size_class(n)
            for m in range(-(-rule.share * n // rule.of), n + 1):
                common = {x[0]: x[1] for x in rule.size_class(m)[1]}
                both = [p for number, p in schemes if common.get(number) == p]
                assert both and max(both) > n + m - 2 * rule.least_shared(n + m)


def mined(rows, every=50, positives=5, negatives=3):
    v = []
    for i, x, label in rows:
        if i is not None and x is not None and label is not None and all(c is not None and math.isfinite(c) for c in x):
            v.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(c)) for c in x]))
    out = set()
    for i, label, q in v:
        if i % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, r, strict=False)), j, other) for j, other, r in v if j != i]
        same = sorted(((s, j) for s, j, other in scored if other == label), key=lambda x: (-x[0], x[1]))[:positives]
        for p, j in same:
            fits = sorted(((s, m) for s, m, other in scored if other != label and 50 * p <= 100 * s <= 95 * p), key=lambda x: (-x[0], x[1]))
            out |= {(i, j, k + 1, m, p, s) for k, (s, m) in enumerate(fits[:negatives])}
    return out


@pytest.mark.parametrize("scale", [1.0, 300.0, 3e5])
def test_mining_against_brute_force(spark, scale):
    rng = np.random.default_rng(int(scale))
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, 700)] + rng.normal(size=(700, 6)) * rng.choice([0, 0.2], 700)[:, None]
    rows = [(i, [float(c) * scale for c in r], int(rng.integers(0, 4))) for i, r in enumerate(x)]
    rows += [(700, None, 1), (750, [], 1), (701, [1.0, None], 1), (702, [float("nan")] * 6, 2), (703, [float("inf")] * 6, 2), (704, [1.0] * 6, None), (None, [1.0] * 6, 1), (705, [2.0 * scale] * 3, 1), (3, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as id", "2 as q", "3 as windows", "4 as part")
    got = [tuple(r) for r in hard_negatives.mine_embeddings(df).collect()]
    assert len(got) == len(set(got)) and set(got) == mined(rows[:-1]) and len(got) > 50
    assert hard_negatives.mine_embeddings(df.limit(0)).count() == 0
    beyond = spark.createDataFrame([(i, [1e30, 1.0], i % 2) for i in range(60)], df.select("vec_id", "embedding", "label").schema)
    assert hard_negatives.mine_embeddings(beyond).count() >= 0  # scores that 64 bits don't hold end no run


def test_mining_of_one_vector_many_times(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PART", 64)
    rows = [(i, [0.5, 0.25], i % 2) for i in range(1000)] + [(i, [0.5, 0.1], i % 3) for i in range(1000, 1400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert {tuple(r) for r in hard_negatives.mine_embeddings(df).collect()} == mined([(i, np.float32(x).tolist(), k) for i, x, k in rows])


def test_queries_keep_every_row(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert queries.op11_importance_resampling(spark, sf_dir).count() == queries.op12_jaccard_join(spark, sf_dir).count() == n
