"""Dedup, WARC, quality, sharding, language, SimHash and the pipeline against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyspark.sql.functions as F
import pytest
import xxhash

import corpus_pipeline
from faultline.llm import components, exact_dedup, language, near_dup, quality_qda, quality_rules, queries, sharding, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n", "a b", "ab", "a\tb", "A b", "one two three four five six", "one two three four five six seven", "x " * 4000, "é日😀", "same", "same", "same"]


def frame(spark, extra=True):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}") for i, t in enumerate(TEXTS)] + [(None, "same", "en", None), (5, "a\tb", "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 as id", "2 as h", "'q' as digest", "3 as n", "4 as kept", "5 as bucket", "6 as _row") if extra else df


def normal(text):
    return "".join(WORD.findall(text or ""))


def test_exact_dedup_against_brute_force(spark):
    rows = frame(spark).collect()
    got = exact_dedup.exact_dedup(frame(spark), capacity=2).toPandas()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(normal(r.text), []).append(r)
    for norm, members in groups.items():
        digest = hashlib.sha256(norm.encode()).hexdigest()
        part = got[got.digest == digest]
        longest = max(len(r.text or "") for r in members)
        keep = min((r.doc_id for r in members if len(r.text or "") == longest and r.doc_id is not None))
        assert len(part) == len(members) and set(part.group_size) == {len(members)} and set(part.keep_id) == {keep}
        assert part.kept.sum() == 1 and part[part.kept].id.tolist() == [keep]
    assert exact_dedup.exact_dedup(frame(spark).limit(0)).count() == 0
    assert sorted(r.doc_id for r in exact_dedup.keep_first(frame(spark)).collect()) == sorted(min(r.doc_id for r in m if r.doc_id is not None and len(r.text or "") == max(len(x.text or "") for x in m)) for m in groups.values())


@pytest.mark.parametrize("capacity", [3, 40, 10**6])
def test_directory_splits_overfull_buckets_only(spark, sf_dir, capacity):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = exact_dedup.build_index(docs, "doc_id", "text", capacity).toPandas()
    assert len(index) == docs.count()
    held = index.drop_duplicates("h").groupby(["bucket", "depth"]).h.agg(list).reset_index()
    assert held.bucket.is_unique and held.h.map(len).max() <= capacity
    prefix = lambda h, d: (int(h) % 2**64) >> (64 - d) if d else 0
    hashes = [int(h) % 2**64 for h in index.h.unique()]
    for r in held.itertuples():
        assert {prefix(h, r.depth) for h in r.h} == {prefix(r.bucket, r.depth)}
        if r.depth:  # its parent was overfull
            assert sum(prefix(h, r.depth - 1) == prefix(r.bucket, r.depth - 1) for h in hashes) > capacity


def test_a_wrong_directory_is_not_passed_over(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    right, want = exact_dedup.directory, exact_dedup.exact_dedup(docs, capacity=5).toPandas().sort_values("id")
    assert want.group_size.max() > 1
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: [(n, cells.filter("pmod(xxhash64(cell), 2) = 0")) for n, cells in right(*a)])
    with pytest.raises(Exception, match="no bucket"):
        exact_dedup.exact_dedup(docs, capacity=5).count()

    def scattered(*a):  # one hash in two buckets: its chain is torn
        return [(n, cells.union(cells.withColumn("bucket", F.col("bucket") + 1))) for n, cells in right(*a)]

    monkeypatch.setattr(exact_dedup, "directory", scattered)
    assert exact_dedup.exact_dedup(docs, capacity=5).count() != len(want)


def test_warc_round_trip(spark):
    big = "é" * 200_000
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (None, "u", big), (1, "u", big), (7, "u", "HTTP/1.1\r\n\r\nWARC/1.1" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as head", "2 as body", "'z' as digest")
    table = warc.write_archive(pages)
    assert table.agg(F.max(F.octet_length("data"))).first()[0] <= warc.CHUNK
    got = warc.read_archive(table).toPandas()
    assert len(got) == len(rows)
    for r in got.itertuples():
        page = None if math.isnan(r.page_id) else int(r.page_id)
        body = next((h or "").encode() for p, _, h in rows if p == page)
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha256(body).hexdigest()
        revisit = page is None or page == 2
        assert r.record_type == ("revisit" if revisit else "response") and (r.refers_to == 1 if revisit else math.isnan(r.refers_to))
    first = b"".join(bytes(r.data) for r in table.filter("record_id like '3/%'").orderBy("chunk_no").collect())
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and first.endswith(b"x" * 99 + b"\r\n\r\n")
    assert warc.read_archive(warc.write_archive(pages.limit(0))).count() == 0


def brute_stats(t):
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    seen, cover = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover.update(j for i in at for j in (i, i + 1, i + 2))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_quality_rules_statistics(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    df = some.union(frame(spark, extra=False)).selectExpr("*", "1 as n_words", "2 as rate", "3 as rows")
    got = quality_rules.adaptive_filter(df).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, *brute_stats(r.text)) for r in df.select("doc_id", "text").collect())
    assert sorted((r.id is None, r.id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.adaptive_filter(df.limit(0)).count() == 0
    assert quality_rules.adaptive_filter(df.filter("text = 'same'")).filter("kept").count() == 0


def test_sketch_quantiles_merge_and_stay_close(spark):
    values = [int(x) for x in np.random.default_rng(2).lognormal(5, 2, 3000)]
    df = spark.createDataFrame([(f"g{i % 3}", v) for i, v in enumerate(values)], "source string, v long").withColumn("bucket", quality_rules.bucket(F.col("v")))
    buckets = df.groupBy("bucket").agg(F.count("*").alias("n"))
    parts = df.groupBy("source", "bucket").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    assert sorted(buckets.collect()) == sorted(parts.collect())
    for r in df.collect():
        assert r.bucket <= r.v < r.bucket + max(1, r.v / 64 + 1)


def test_rendezvous_moves_rows_only_into_the_new_shard(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(4000)] + [(None, None), (None, None), (3, "t3")], "doc_id long, text string").selectExpr("*", "9 as shard", "8 as slot", "7 as _bucket")
    got = sharding.shard_documents(df).toPandas()
    assert len(got) == 4003
    moved = got[got["shard"] != got.grown_shard]
    assert set(moved.grown_shard) == {16} and 4000 / 17 * 0.7 < len(moved) < 4000 / 17 * 1.3
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
        assert 4000 / 16 * 0.7 < len(g) < 4000 / 16 * 1.3
    for r in got.dropna(subset=["doc_id"]).itertuples():
        key = xxhash.xxh64_intdigest(int(r.doc_id).to_bytes(8, "little", signed=True), 42)
        as_bytes = lambda x: int(x).to_bytes(8, "little")

        def score(s, key=key, as_bytes=as_bytes):
            first = xxhash.xxh64_intdigest(as_bytes(key), 42)
            u = ((xxhash.xxh64_intdigest(as_bytes(s), first) >> 11) + 0.5) / 2**53
            return -1 / math.log(u)

        assert r.shard == max(range(16), key=lambda s: (score(s), -s))
    assert got.text_crc32.max() <= max(zlib.crc32(f"t{i}".encode()) for i in range(7))
    weighted = df.withColumn("s", sharding.shard_of(["doc_id"], {0: 3.0, 1: 1.0})).groupBy("s").count().collect()
    assert 2.4 < {r.s: r["count"] for r in weighted}[0] / {r.s: r["count"] for r in weighted}[1] < 3.7
    assert sharding.shard_documents(df.limit(0)).count() == 0


def brute_print(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORD.findall(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, ids, distance=4):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(ids))]


def test_simhash_components_against_brute_force(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("doc_id >= 100")
    df = some.union(frame(spark, extra=False).select("doc_id", "text")).selectExpr("*", "1 as key", "2 as node", "3 as label", "4 as fingerprint")
    rows = df.select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    want = sorted(map(repr, zip([r.doc_id for r in rows], prints, brute_classes(prints, [r.doc_id for r in rows]), strict=True)))
    got = near_dup.simhash_components(df).collect()
    assert sorted(repr((r.doc_id, r.fingerprint % 2**64, r.component_id)) for r in got) == want
    assert near_dup.simhash_components(df.limit(0)).count() == 0


@pytest.mark.parametrize(("distance", "per_pair", "crowded"), [(4, 64, 10**9), (4, 16, 40), (7, 256, 60)])
def test_trie_join_finds_every_link(spark, distance, per_pair, crowded):
    rng = np.random.default_rng(distance + crowded % 7)
    base, prints = [int(x) for x in rng.integers(0, 2**63, 25)], []
    for _ in range(900):
        b = base[rng.integers(25)]
        for _ in range(rng.integers(0, 10)):
            b ^= 1 << int(rng.integers(64))
        prints.append(b)
    prints = sorted(set(prints))
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    leaves = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    pairs = near_dup.split_crowded(near_dup.staged(near_dup.shared_levels(leaves, len(prints), distance, per_pair), "t"), distance, crowded)
    place = ["trie", "depth", "node", "mask"]
    links = pairs.repartition(4, *place).sortWithinPartitions(*place).mapInArrow(near_dup._walk_group(distance), "a long, b long")
    label = {r.node: r.label for r in components.connected_components(links).collect()}
    got = [label.get(x, x) for x in signed]
    want = brute_classes(prints, list(range(len(prints))), distance)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in components.connected_components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_quality_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_quality_classifier(spark, sf).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both.quality).mean() > 0.95
    odd = frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert set(quality_qda.scored(odd, none).select("score").toPandas().score) == {0.5}
    assert quality_qda.scored(odd.limit(0), spark.read.parquet(f"{sf}/labels.parquet")).count() == 0


def test_discriminant_equals_the_densities():
    rng = np.random.default_rng(3)
    x = [rng.normal(size=(200, 9)) * (k + 1) + k for k in (0, 1)]
    means, factors = [a.mean(0) for a in x], [np.linalg.cholesky(np.cov(a.T) + np.eye(9)) for a in x]
    m = quality_qda.Qda(means, factors, 0.3)
    point = rng.normal(size=(5, 9))
    for k in (0, 1):
        cov = factors[k] @ factors[k].T
        away = point - means[k]
        want = -0.5 * (np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away) + np.linalg.slogdet(cov)[1])
        assert np.allclose(m.log_density(point, k), want)


def test_language_posterior_and_cases(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.identify(language.document_rows(docs)).toPandas()
    assert len(got) == docs.count() and (got.text_lang == got.declared).mean() > 0.97 and got.kept.mean() > 0.97
    pages = queries.language_id_pages(spark, sf).toPandas()
    assert (pages.lang == pages.declared).mean() > 0.97
    odd = language.identify(language.document_rows(frame(spark))).collect()
    assert len(odd) == len(TEXTS) + 2 and not any(r.kept for r in odd if r.doc_id in (0, 1, 2))
    none = language.identify(language.document_rows(frame(spark).withColumn("lang", F.lit(None).cast("string")))).collect()
    assert len(none) == len(TEXTS) + 2 and not any(r.kept for r in none)
    assert language.identify(language.document_rows(frame(spark).limit(0))).count() == 0


def test_trigrams_are_counted_inside_texts_only():
    import pyarrow as pa

    alone = [np.sort(next(language.trigrams(pa.array([t], pa.string())))[0]).tolist() for t in ("abc", "", None, "xyz é")]
    ((bins, owners),) = language.trigrams(pa.array(["abc", "", None, "xyz é"]))
    assert [np.sort(bins[owners == i]).tolist() for i in range(4)] == alone


def test_pipeline_stages_against_their_rules(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = corpus_pipeline.staged(stage(spark, docs, sf), name)
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(before)
            break
        assert out.columns == columns
        after = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "exact_dedup":
            assert {normal(before[d]) for d in after} == {normal(t) for t in before.values()} and len(after) == len({normal(t) for t in before.values()})
        if name == "simhash_near_dedup":
            assert after < set(before) and len({near_dup.fingerprint(before[d], 5) for d in after}) == len(after)
        docs = out


def test_pipeline_of_odd_rows_and_of_none(spark, sf_dir):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = frame(spark).withColumn("n_chars", F.lit(None).cast("long")).withColumn("score", F.lit("x")).withColumn("label", F.lit("y"))
    columns = [c for c in odd.columns if c not in real.columns]
    more = real.withColumns({c: F.lit(None).cast(odd.schema[c].dataType) for c in columns})
    for docs in (odd.unionByName(more.limit(60)).unionByName(more.limit(3)), odd.limit(0), odd.filter("doc_id < 3")):
        before = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.staged(stage(spark, docs, sf_dir), name)
            assert name == "packing" or out.columns == docs.columns and out.count() <= docs.count()
            docs = out
        assert before == 0 or before < 4 or docs.count() > 40
