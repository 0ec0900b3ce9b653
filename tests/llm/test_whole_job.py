"""What operators must not leave out: near copies beyond few bits, odd tokens, deep tries, texts of no language."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from faultline.llm import jaccard, language, near_dup, words
from faultline.llm.queries import tokenizer


def five_words(t):
    w = (t or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_similar(texts, bits=None):
    """{id: least id of its group} by comparing all pairs: similar sets, or fingerprints within so many bits."""
    prints = {d: near_dup.fingerprint(t, 5) for d, t in texts.items()} if bits is not None else None
    sets = {d: five_words(t) for d, t in texts.items()}
    sizes, least = {d: len(s) for d, s in sets.items()}, {d: d for d in texts}
    root = lambda d: d if least[d] == d else root(least[d])
    for a in sets:
        for b in sets:
            x, y = sizes[a], sizes[b]
            close = a < b and prints is not None and ((prints[a] ^ prints[b]) % 2**64).bit_count() <= bits
            if close or a < b and x and 4 * x <= 5 * y and 4 * y <= 5 * x and 9 * len(sets[a] & sets[b]) >= 4 * (x + y):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {d: root(d) for d in texts}


def test_similarity_dedup_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(400))
    common = " ".join(word() for _ in range(30))
    texts = [None, "", " ", "a b", "A  b", "one two three four five six", *(common + " " + " ".join(word() for _ in range(6)) for _ in range(40))]
    for _ in range(30):
        base = [word() for _ in range(rnd.choice([8, 60, 200]))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rnd.randrange(5)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    df = spark.createDataFrame([*enumerate(texts), (None, "a b")], "doc_id long, text string").selectExpr("*", "1 as n", "2 as s", "3 as label")
    want = brute_similar(dict(enumerate(texts)))
    assert 20 < sum(d != r for d, r in want.items()) < len(texts) - 60
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, near_dup.SIMILAR).collect() if r.doc_id is not None} == want
    got = near_dup.keep_one(df)
    assert got.columns == df.columns
    want = brute_similar(dict(enumerate(texts)), 4)
    assert want[2] == 0 and {r.doc_id for r in got.collect()} == {None, *want.values()}  # texts without words have one fingerprint
    assert near_dup.keep_one(df.limit(0)).count() == 0


def test_sizes_of_parts_never_rule_out_what_sets_share():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (40, 50), (200, 190), (3000, 3700), (70_000, 80_000)):  # the last by parts of 17 and more
        shared = rng.integers(0, 2**64, min(n, m) * 2 // 3, np.uint64)
        x, y = (np.unique(np.r_[shared, rng.integers(0, 2**64, k - len(shared), np.uint64)]) for k in (n, m))
        sizes = [jaccard.sizes_of_parts(x), jaccard.sizes_of_parts(y)]
        most = int(np.minimum(*jaccard._unpacked(sizes, min(map(len, sizes)))).sum())
        assert len(np.intersect1d(x, y)) <= most <= min(n, m)
        assert n < 100 or most < min(n, m) * 0.99


def forms(pairs, seed=7):
    """Texts of 300 words with 42 fields of 8 values; of each two copies that differ in 5 fields (similarity 0.844; strangers 0.23)."""
    rnd = random.Random(seed)
    out = []
    for _ in range(pairs):
        fields = [rnd.randrange(8) for _ in range(42)]
        other = list(fields)
        for at in rnd.sample(range(42), 5):
            other[at] = (other[at] + rnd.randrange(1, 8)) % 8
        for values in (fields, other):
            out.append(" ".join(f"v{values[k // 7]}x{k}" if k % 7 == 3 and k // 7 < 42 else f"w{k}" for k in range(300)))
    return out


@pytest.mark.parametrize("pairs", [400, 3000])
def test_no_copy_of_a_form_is_lost(spark, pairs):
    """All pairs meet under common shingles; every one must be found, however many forms there are."""
    texts = forms(pairs)
    copies = [(2 * k, 2 * k + 1) for k in range(pairs) if 9 * len(five_words(texts[2 * k]) & five_words(texts[2 * k + 1])) >= 4 * (len(five_words(texts[2 * k])) + len(five_words(texts[2 * k + 1])))]
    df = spark.createDataFrame(enumerate(texts), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df, near_dup.SIMILAR).collect()}
    assert len(copies) > 0.9 * pairs and all(got[a] == got[b] for a, b in copies)
    assert len(set(got.values())) >= 0.9 * pairs


def test_pipeline_leaves_no_similar_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, sf), name)
    left = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(left) > 700 and all(d == r for d, r in brute_similar(left).items())


@pytest.mark.parametrize("depth", [14, 16, 17, 20])
def test_trie_join_finds_links_from_deep_levels(spark, depth):
    rnd = random.Random(depth)
    bits = [(3, 21, 42, 50), (21, 22), (0, 20, 21, 63), (15, 21, 42, 63), (41, 42), *(tuple(rnd.sample(range(64), rnd.randint(1, 4))) for _ in range(60))]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    pairs = []
    for at in bits:  # bit 0 is the highest
        a = rnd.getrandbits(64)
        pairs.append((signed(a), signed(a ^ sum(1 << 63 - k for k in at))))
    leaves = spark.createDataFrame([(x,) for p in pairs for x in p], "fingerprint long")
    shared = near_dup.staged(near_dup.shared_levels(leaves, 2 * len(pairs), 4, 2 * len(pairs) / 2**depth), "t")
    split = near_dup.split_crowded(shared, 4, 1)
    place = ["trie", "depth", "node", "mask"]
    links = split.repartition(4, *place).sortWithinPartitions(*place).mapInArrow(near_dup._walk_group(4), "a long, b long")
    assert {frozenset((r.a, r.b)) for r in links.collect()} == {frozenset(p) for p in pairs}


def test_packing_ids_of_mixed_case_special_tokens():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    marks = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>"]
    texts = ["Plain Text.", *marks, *(f"A{m}B, {m}. {m}{marks[0]} END{m}X." for m in marks), "<|ENDOF TEXT|>"]
    flat, counts = words.encode_blank_free(words.Words(pa.array(texts)), words.library(path, spaced=False))
    library = Tokenizer.from_file(path)
    got = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    assert got == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_texts_of_no_modelled_language_are_rejected(spark):
    rnd = random.Random(1)
    junk = [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(100)) for _ in range(5)]
    odd = [*junk, "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.", "国境の長いトンネルを抜けると雪国であった。夜の底が白くなった。", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [(10**6 + i, x, [None, "es"][i % 2], "web") for i, x in enumerate(odd)]
    got = language.identify(language.document_rows(docs.union(spark.createDataFrame(rows, docs.schema)))).toPandas()
    planted = got.doc_id >= 10**6
    assert planted.sum() == len(odd) and not got[planted].kept.any() and got[planted].lang.isna().all()
    assert got[~planted].kept.mean() > 0.995 and (got[~planted].lang == got[~planted].declared).mean() > 0.99
