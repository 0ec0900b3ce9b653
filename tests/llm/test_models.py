"""Language ID and the quality discriminant, recomputed without Spark."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from faultline.llm import language, quality_qda


def bins_of(text):
    """The definition: byte trigrams without digits of the lower-cased text between blanks, mixed to 15 bits."""
    raw, out = b" " + (text or "").lower().encode() + b" ", []
    for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
        if any(48 <= v <= 57 for v in (a, b, c)):
            continue
        x = ((a * 0x9E3779B1) ^ (b * 0x85EBCA77) ^ (c * 0xC2B2AE3D)) & 0xFFFFFFFF
        out.append((x * 0x27D4EB2F & 0xFFFFFFFF) >> 17)
    return Counter(out)


def brute_identify(rows):
    """[(lang, posterior, text_lang)] of rows (text, declared code, host, suffix)."""
    counts = defaultdict(Counter)
    for text, declared, _, _ in rows:
        if declared:
            counts[declared].update(bins_of(text))
    # A language that is declared only of texts without trigrams has no counts
    langs = sorted(k for k, v in counts.items() if v)
    k, size = len(langs), language.BINS
    log, default, own = {}, {}, {}
    for x in langs:
        total = sum(counts[x].values()) + 0.5 * size
        log[x] = {b: math.log((n + 0.5) / total) for b, n in counts[x].items()}
        default[x] = math.log(0.5 / total)
        own[x] = sum(math.exp(v) * v for v in log[x].values()) + (size - len(log[x])) * math.exp(default[x]) * default[x]
    texts = []
    for text, _, _, _ in rows:
        b = bins_of(text)
        ll = {x: language.TEMPER * sum(n * log[x].get(i, default[x]) for i, n in b.items()) for x in langs}
        best = max(langs, key=lambda x: (ll[x], [-ord(c) for c in x]))
        other = language.TEMPER * sum(b.values()) * (own[best] + language.UNKNOWN_AT * (-math.log(size) - own[best]))
        texts.append((ll, other, best if other <= ll[best] else None))
    seen = Counter(t for _, _, t in texts if t)
    by = {j: defaultdict(Counter) for j in (1, 2, 3)}
    for row, (_, _, t) in zip(rows, texts, strict=True):
        for j in by:
            if row[j] is not None and t:
                by[j][row[j]][t] += 1
    out = []
    for row, (ll, other, t) in zip(rows, texts, strict=True):
        said = by[1].get(row[1])
        top, logs = max(ll.values()), {}
        for x in langs:
            everywhere = (seen[x] + 1 / k) / (sum(seen.values()) + 1)
            share = lambda c, w, parent, x=x: ((c[x] if c else 0) + w * parent) / ((sum(c.values()) if c else 0) + w)
            host = share(by[2].get(row[2]), language.HOST_WEIGHT, share(by[3].get(row[3]), language.SUFFIX_WEIGHT, everywhere))
            logs[x] = ll[x] - top + math.log(host) + (math.log((said[x] + language.DECLARED_WEIGHT / k) / (seen[x] + language.DECLARED_WEIGHT)) if said else 0)
        logs[None] = other - top + math.log(language.UNKNOWN) - (math.log(k) if said else 0)
        most = max(logs.values())
        out.append((next(x for x in [*langs, None] if logs[x] == most), 1 / sum(math.exp(v - most) for v in logs.values()), t))
    return out


def corpus(n_langs, per, seed=3):
    """Texts of invented languages, each with syllables of its own; some misdeclared or undeclared."""
    rnd = random.Random(seed)
    codes = [a + b for a in "abcdefghijklmnop" for b in "qrstuvwxyzabcde"][:n_langs]
    numbers = lambda: rnd.choice(["", f" {rnd.randrange(10**6)}"])
    syllables = {c: ["".join(rnd.choice("aeiou" if k % 2 else "bcdfghklmnprst") for k in range(rnd.choice([2, 3]))) for _ in range(12)] for c in codes}
    rows = []
    for c in codes:
        for _ in range(per):
            text = " ".join("".join(rnd.choice(syllables[c]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.choice([1, 4, 40])))
            rows.append((text + numbers(), rnd.choice([c, c, c, rnd.choice(codes), None]), rnd.choice([f"h{c}", "big", None]), rnd.choice(["com", c, None])))
    return [*rows, (None, codes[0], "big", None), ("", None, None, "com"), ("!? 12", codes[1], "hx", "com"), rows[0], rows[0]]


@pytest.mark.parametrize("block", [2, 128])
def test_language_posteriors_against_brute_force(spark, block):
    rows = corpus(5, 12)
    df = spark.createDataFrame([(i, *r, 7, "x") for i, r in enumerate(rows)], "top long, text string, declared string, host string, suffix string, ll int, lang string").selectExpr("*", "1 as first", "2 as likely", "3 as rest", "4 as row", "5 as `a.b`", "6 as seen")
    got = language.identify(df, block=block)
    assert set(got.columns) == {*df.columns, "posterior", "text_lang", "kept"} - {"text"}
    got = got.orderBy("top").collect()
    assert len(got) == len(rows)
    for g, (lang, posterior, text_lang), row in zip(got, brute_identify(rows), rows, strict=True):
        assert (g.lang, g.text_lang) == (lang, text_lang) and g.posterior == pytest.approx(posterior, rel=1e-4)
        assert (g.ll, g.first, g["a.b"], g.host, g.declared) == (7, 1, 5, row[2], row[1])
        assert g.kept == (any(c.isalpha() for c in row[0] or "") and lang is not None and posterior >= language.MIN_POSTERIOR)


def test_two_hundred_languages_are_all_told_apart(spark):
    rnd, rows = random.Random(2), []
    codes = [a + b for a in "abcdefghijklmnop" for b in "qrstuvwxyzabcde"][:200]
    for c in codes:
        syllables = ["".join(rnd.choice("aeiou" if k % 2 else "bcdfghklmnprst") for k in range(3)) for _ in range(12)]
        rows += [(f"{c}{i}", " ".join(rnd.choice(syllables) + rnd.choice(syllables) for _ in range(60)), c if i else rnd.choice(codes), None, None) for i in range(6)]
    got = language.identify(spark.createDataFrame(rows, "id string, text string, declared string, host string, suffix string")).collect()
    assert {r.lang for r in got if r.lang == r.id[:2]} == set(codes)
    assert sum(r.lang == r.id[:2] for r in got) > 0.97 * len(rows)


def test_ties_empty_tables_and_declared_forms(spark):
    df = spark.createDataFrame([("same words here", "en-GB"), ("same words here", "fr"), ("same words here", "English!"), (None, None)], "text string, declared string").selectExpr("*", "null as host", "null as suffix")
    got = language.identify(df).collect()
    assert sorted(r.text_lang for r in got if r.text_lang) == ["en"] * 4 and len(got) == 4  # equally likely: the first code; no text, too
    assert language.identify(df.limit(0)).count() == 0
    codes = [r.c for r in df.select(language.code(F.col("declared")).alias("c")).collect()]
    assert codes == ["en", "fr", None, None]


def test_trigrams_of_a_long_text_in_blocks():
    text = "".join(random.Random(1).choice("abcdé ") for _ in range(1_100_000))
    alone = [b for bins, _ in language.trigrams(pa.array([text])) for b in bins.tolist()]
    ((bins, owners),) = language.trigrams(pa.array(["x", text]))
    assert alone == bins[owners == 1].tolist() and len(alone) == len(text.encode())
    assert [len(b) for b, _ in language.trigrams(pa.array([""]))] == [0]


def brute_features(text):
    """The nine statistics by their definitions."""
    import re

    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = len(words) + 1, len(t) + 20
    upper = len(re.sub(r"[^A-ZÀ-ÖØ-Þ]", "", t))
    return [
        math.log(n),
        math.log((sum(map(len, words)) + 5) / n),
        math.log(sum(t.count(c) for c in "#*$%&|<>") / n + 0.02),
        math.log(t.count("!") / n + 0.02),
        math.sqrt(len(covered) / (len(words) + quality_qda.REPEAT_WORDS)),
        math.sqrt((len(lines) - len(set(lines))) / (len(lines) + quality_qda.REPEAT_LINES)),
        (len(set(words)) + quality_qda.DISTINCT_WORDS) / (len(words) + quality_qda.DISTINCT_WORDS),
        math.log((upper + 0.4) / chars),
        math.sqrt(sum(c in "0123456789" for c in t) / chars),
    ]


def test_classifier_recomputed_from_texts_and_labels(spark, sf_dir):
    """Features, moments, shrinkage, log odds and scores, on documents with odd texts, repeated labels and a long text."""
    import zlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "A! " * 60_000), (None, "no id"), (10**6 + 3, "é # 12\n12\n12")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "1 as score", "2 as _x", "3 as label")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    more = labels.limit(5).union(spark.createDataFrame([(3, None), (10**6 + 2, 0), (10**6 + 9, 1)], labels.schema))
    labels = labels.union(more).cache()
    got = {r.doc_id: r for r in quality_qda.scored(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    x = {d: np.array(brute_features(t)) for d, t in texts.items()}
    known = [(x[r.doc_id], r.quality) for r in labels.collect() if r.quality is not None and r.doc_id in x and not held(r.doc_id)]
    own, mean = [], []
    for k in (0, 1):
        rows = np.array([v for v, q in known if q == k])
        mean.append(rows.mean(0))
        own.append((rows - mean[k]).T @ (rows - mean[k]) / len(rows))
    n = [sum(q == k for _, q in known) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    cov = [(1 - quality_qda.POOL - quality_qda.DIAG) * c + quality_qda.POOL * pooled + quality_qda.DIAG * np.diag(np.diag(pooled)) + quality_qda.FLOOR * np.eye(9) for c in own]
    density = lambda v, k: -0.5 * (v - mean[k]) @ np.linalg.inv(cov[k]) @ (v - mean[k]) - 0.5 * np.linalg.slogdet(cov[k])[1]
    assert set(got) == set(texts)
    for d, row in got.items():
        odds = density(x[d], 1) - density(x[d], 0) + math.log(n[1] / n[0])
        assert row.score == pytest.approx(1 / (1 + math.exp(-max(-500, min(500, odds)))), abs=1e-6), d
        assert row.held_out == held(d)
