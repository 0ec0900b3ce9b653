"""Packing, token shards, piece encoding: exact round trips against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from faultline.llm import grammar, packing, pieces
from faultline.llm.queries import tokenizer

ODD = [None, "", " ", "a", "  two  spaces ", "tab\there\n\nline", "word " * 3000, "x" * 5000, "é́ ñ 日本 😀 ﬁ\xa0z", "it's, it's. 'S we'll!", "▁ literal ▁▁ marks", "a.b,c. D. É. end.", "<|endoftext|> in text", "same", "same"]


def docs(spark, texts, extra=False):
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(6, "repeated id"), (6, "repeated id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "1 as _n", "'x' as ids", "2 as start") if extra else df


def library_ids(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name)).encode(text or "", add_special_tokens=False).ids


def test_packing_covers_every_id_once(spark):
    df = docs(spark, ODD, extra=True)
    got = packing.pack_along_curve(df, tokenizer("word_bpe_49k.json"), size=64).toPandas()
    want = sorted(tuple(library_ids("word_bpe_49k.json", r.text) + [1]) for r in df.collect())
    joined = []
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id", sort=False):
        assert g.offset.tolist() == np.r_[0, np.cumsum(g.length)[:-1]].tolist()
        assert g.length.sum() <= 64
    for (_, tokens, _), g in got.groupby(["doc_id", "doc_tokens", "curve"], dropna=False):
        by_start = {}
        for r in g.itertuples():
            assert len(r.ids) == 4 * r.length
            by_start.setdefault(r.start, []).append(np.frombuffer(r.ids, "<u4").tolist())
        n = max(len(v) for v in by_start.values())
        for _ in range(n):
            ids, at = [], 0
            while at < tokens:
                part = by_start[at].pop()
                ids, at = ids + part, at + len(part)
            joined.append(tuple(ids))
    assert sorted(joined) == want


def test_packing_pads_only_the_last_sequence_of_a_range(spark, sf_dir):
    got = packing.pack_along_curve(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer("word_bpe_49k.json")).toPandas()
    fill = got.groupby("sequence_id").length.sum()
    assert (fill < 2048).sum() <= 4 and fill.max() == 2048


def test_packing_of_an_empty_table(spark):
    assert packing.pack_along_curve(spark.createDataFrame([], "doc_id long, text string"), tokenizer("word_bpe_49k.json")).count() == 0


def test_hilbert_neighbours_are_adjacent_cells():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    place = packing.hilbert(cells, 4)
    assert sorted(place) == list(range(16**3))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_token_shards_read_back(spark):
    df = docs(spark, ODD, extra=True)
    shards = grammar.write_shards(df, tokenizer("byte_bpe_50k.json"), shard_tokens=500)
    got = grammar.read_documents(shards).toPandas()
    want = sorted(tuple(library_ids("byte_bpe_50k.json", r.text) + [0]) for r in df.collect())
    assert sorted(tuple(np.frombuffer(x, "<u4").tolist()) for x in got.ids) == want
    got = got.sort_values("start")
    assert got.start.tolist() == np.r_[0, np.cumsum(got.n_tokens)[:-1]].tolist()
    ids = got.doc_id.dropna().tolist()
    assert ids == sorted(ids)
    one = grammar.read_range(shards, 18).collect()
    assert [r.ids for r in one] == [library_ids("byte_bpe_50k.json", ODD[6]) + [0]]
    assert grammar.read_documents(grammar.write_shards(df.limit(0), tokenizer("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_grammar_is_lossless_with_random_access(seed):
    rng = np.random.default_rng(seed)
    tokens = np.concatenate([rng.integers(0, 2 + 40 * seed, 3000), np.tile(rng.integers(0, 9, 7), 300), np.full(999, 5)]).astype(np.uint32)
    rules, sizes, symbols = grammar.compress(tokens)
    g = grammar.Grammar(rules, sizes)
    assert (g.decode(symbols) == tokens).all()
    assert len(symbols) < len(tokens)
    for a, b in ((0, 1), (17, 17), (2999, 3105), (len(tokens) - 1, len(tokens))):
        assert (g.decode(symbols, a, b) == tokens[a:b]).all()


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), pieces.model(path)
    rnd = random.Random(4)
    texts = [*ODD[1:], *("".join(rnd.choice("abcdeéß日 ▁\n\t.,-=<>😀tionhe") for _ in range(rnd.randint(1, 80))) for _ in range(800)), "ab" * 2000, " " * 700]
    ids, counts = m.encode(pa.array(texts))
    ends = np.cumsum(counts)
    back = m.decode(ids, counts)
    for t, a, b, x in zip(texts, ends - counts, ends, back, strict=True):
        want = sp.encode(t)
        assert ids[a:b].tolist() == want, t
        assert x.decode() == sp.decode(want), t
    df = docs(spark, ODD, extra=True)
    text = {r.doc_id: r.text for r in pieces.decode_ids(pieces.encode_texts(df, path), path).collect()}
    assert text[0] == "" and text[3] == "" and text[24] == ODD[8]
    digests = pieces.round_trip_digests(df, path)
    assert digests.count() == df.count() and digests.filter("n_tokens = 0").count() == 2
    assert pieces.round_trip_digests(df.limit(0), path).count() == 0


def test_crc_of_pieces_is_of_little_endian_ids(spark):
    import pyspark.sql.functions as F

    row = spark.createDataFrame([(bytearray(np.array([1, 2], "<u4").tobytes()),)], "ids binary").select(F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(np.array([1, 2], "<u4").tobytes())
