"""Token ids in shards compressed by a Re-Pair grammar, with random access.

Documents are range-partitioned by id; each task encodes its range and closes a
shard every SHARD_TOKENS tokens. Per shard, rounds replace frequent pairs of
adjacent symbols by nonterminals until no pair has MIN_COUNT places: a round
counts the pairs, takes all frequent ones, and replaces their places from left
to right without overlap. A rule costs three numbers, which rarer pairs don't
earn back. A shard row holds

  rules        pairs of symbols, nonterminal k = FIRST_RULE + k; later rules use earlier ones
  rule_tokens  how many tokens each rule expands to
  symbols      the compressed sequence
  doc_ids, doc_tokens   the documents in it, in order
  tokens_before         tokens in all earlier shards, on reading

all as little-endian unsigned 32-bit numbers. Running sums of expansion lengths
find the symbols of any token range, so a document is decoded alone.

Cases: null text is empty and has the end id only; null ids come first; rows that
repeat an id are documents each, one after the other; a document longer than a
shard makes a longer shard, and its text is encoded in portions, so that a task
holds the text, its ids and the working memory of one portion; an empty table
gives no shard and an empty result. Further columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_checked, prefix_sums, staged, steps
from .words import encode_spaced, gather, library

SHARD_TOKENS = 1 << 20
FIRST_RULE = 1 << 20
MIN_COUNT = 8
_TABLE_BITS = 17  # small enough for a core's cache
SHARDS = "part int, seq int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, rules binary, rule_tokens binary, symbols binary"
_SHARDS = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("rules", pa.binary()), ("rule_tokens", pa.binary()), ("symbols", pa.binary())]
)
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _cell(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def compress(tokens: np.ndarray, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, rule_tokens, symbols) of a token sequence."""
    seq, rules, sizes = tokens.astype(np.uint64), [], []
    low, high = np.uint64(0xFFFFFFFF), np.uint64(32)
    newest = None  # where set, all frequent pairs without a symbol from here on have been replaced
    while True:
        if newest is None:
            keys, where = (seq[:-1] << high) | seq[1:], None
        else:
            fresh = seq >= newest
            where = np.flatnonzero(fresh[:-1] | fresh[1:])
            keys = (seq[where] << high) | seq[where + 1]
        at = _cell(keys)
        ordered = np.sort(keys[np.bincount(at, minlength=1 << _TABLE_BITS)[at] >= min_count])  # a cell holds all places of its pairs
        if not len(ordered):
            break
        edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        counts = np.diff(np.r_[edge, len(ordered)])
        often = np.flatnonzero(counts >= min_count)
        if not len(often):
            break
        pick = often[np.argsort(-counts[often], kind="stable")]
        pairs = ordered[edge[pick]]
        cells = _cell(pairs)
        _, first = np.unique(cells, return_index=True)  # of pairs in one cell the more frequent; others wait a round
        first.sort()
        pairs, cells = pairs[first], cells[first]
        base = sum(map(len, rules))
        newest = np.uint64(FIRST_RULE + base) if len(pairs) == len(often) else None
        held, number = np.zeros(1 << _TABLE_BITS, np.uint64), np.zeros(1 << _TABLE_BITS, np.uint32)
        held[cells], number[cells] = pairs, np.arange(len(pairs)) + 1
        found = np.flatnonzero((held[at] == keys) & (number[at] > 0))
        made = number[at[found]]
        hits = found if where is None else where[found]
        run = np.r_[True, np.diff(hits) > 1]
        since = hits - hits[np.flatnonzero(run)][np.cumsum(run) - 1]
        apart = since % 2 == 0
        hits, made = hits[apart], made[apart]
        seq[hits] = made.astype(np.uint64) + np.uint64(FIRST_RULE + base - 1)
        keep = np.ones(len(seq), bool)
        keep[hits + 1] = False
        seq = seq[keep]
        new = np.stack([pairs >> high, pairs & low], 1).astype(np.uint32)
        known = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        rules.append(new)
        sizes.append(_widths(new, known).sum(1))
    all_rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return all_rules, (np.concatenate(sizes) if sizes else np.zeros(0)).astype(np.uint32), seq.astype(np.uint32)


def _widths(symbols: np.ndarray, rule_tokens: np.ndarray) -> np.ndarray:
    """Tokens that each symbol expands to."""
    if not len(rule_tokens):
        return np.ones(symbols.shape, np.int64)
    rule = symbols.astype(np.int64) - FIRST_RULE
    return np.where(rule < 0, 1, rule_tokens.astype(np.int64)[np.maximum(rule, 0)])


class Grammar:
    """The rules of one shard, expanded once."""

    def __init__(self, rules: np.ndarray, rule_tokens: np.ndarray):
        self.sizes = np.r_[np.int64(1), rule_tokens.astype(np.int64)]
        self.starts = np.r_[np.int64(0), np.cumsum(self.sizes)[:-1]]
        self.flat = np.zeros(int(self.sizes.sum()), np.uint32)
        done = 0
        while done < len(rules):  # all rules whose parts are known, level by level
            ready = (rules[done:].astype(np.int64).max(1) < FIRST_RULE + done).cumprod().astype(bool).sum()
            block = rules[done : done + ready]
            self.flat[self.starts[done + 1] : self.starts[done + ready] + self.sizes[done + ready]] = self._expand(block.ravel())
            done += ready

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        rule = np.maximum(symbols.astype(np.int64) - FIRST_RULE + 1, 0)
        sizes = self.sizes[rule]
        out = gather(self.flat, self.starts[rule], sizes)
        plain = rule == 0
        out[(np.cumsum(sizes) - sizes)[plain]] = symbols[plain]
        return out

    def decode(self, symbols: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Tokens start to stop of the shard: only the symbols that cover them are expanded."""
        ends = np.cumsum(self.sizes[np.maximum(symbols.astype(np.int64) - FIRST_RULE + 1, 0)])
        stop = int(ends[-1]) if stop is None and len(ends) else stop or 0
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self._expand(symbols[a:b])[start - before : stop - before]


def _shard(part: int, seq: int, ids: list, sizes: list, tokens: list) -> pa.RecordBatch:
    flat = np.concatenate(tokens)
    rules, rule_tokens, symbols = compress(flat)
    row = (part, seq, len(flat), np.concatenate(sizes).tolist(), rules, rule_tokens, symbols)
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([row[3]], pa.list_(pa.int64()))]
        + [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (rules, rule_tokens, symbols)],
        schema=_SHARDS,
    )


def _encoded(path: str, end_id: int, shard_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, 0
        ids, sizes, tokens = [], [], []
        for batch in batches:
            for step in steps(batch, "text"):
                flat, counts = encode_spaced(step.column("text"), library(path, spaced=True))
                ends = np.cumsum(counts + 1)
                out = np.full(int(ends[-1]), end_id, np.uint32)
                out[np.delete(np.arange(len(out)), ends - 1)] = flat
                ids, sizes, tokens, held = ids + step.column("doc_id").to_pylist(), [*sizes, counts + 1], [*tokens, out], held + len(out)
                if held >= shard_tokens:
                    yield _shard(part, seq, ids, sizes, tokens)
                    ids, sizes, tokens, held, seq = [], [], [], 0, seq + 1
        if held:
            yield _shard(part, seq, ids, sizes, tokens)

    return run


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The written shard table; (part, seq) ascend with doc_id."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The second key spreads rows without an id, or with one id, over ranges.
    rows = docs.select("doc_id", "text").withColumn("spread", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "spread").sortWithinPartitions("doc_id", "spread").drop("spread")
    return staged(rows.mapInArrow(_encoded(tokenizer, end_id, shard_tokens), SHARDS), "shards")


def _documents(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i] for k in ("tokens_before", "doc_ids", "doc_tokens", "rules", "rule_tokens", "symbols")}
            rules, rule_tokens, symbols = (np.frombuffer(row[k].as_buffer(), "<u4") for k in ("rules", "rule_tokens", "symbols"))
            data = Grammar(rules.reshape(-1, 2), rule_tokens).decode(symbols).astype("<u4").tobytes()
            sizes = row["doc_tokens"].values.to_numpy()
            ends = np.cumsum(sizes)
            if ends[-1] * 4 != len(data):
                raise ValueError("a shard doesn't expand to the tokens that it states")
            ids = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, 4 * ends].astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(ends - sizes + row["tokens_before"].as_py()), pa.array(sizes), ids], schema=_DOCS)


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document decoded from its shard; start counts the tokens of all before it.

    Running sums are over the shards of a part, and over one row per part.
    """
    sizes = shards.select("part", "seq", "n_tokens")
    parts = prefix_sums(sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")), ["part"], "n", "part_before").drop("n")
    before = prefix_sums(sizes, ["seq"], "n_tokens", "within", ["part"]).drop("n_tokens").join(F.broadcast(parts), "part")
    before = staged(before.select("part", "seq", (F.col("part_before") + F.col("within")).alias("tokens_before")), "starts")
    placed = join_checked(shards, before, ["part", "seq"], "inner", 24)
    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")


def read_range(shards: DataFrame, doc_id: int) -> DataFrame:
    """One document's ids by random access: only its shard is read, and only its symbols are expanded."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rules, rule_tokens, symbols = (np.frombuffer(batch.column(k)[i].as_py(), "<u4") for k in ("rules", "rule_tokens", "symbols"))
                sizes, at = np.cumsum(batch.column("doc_tokens")[i].as_py()), batch.column("doc_ids")[i].as_py()
                g = Grammar(rules.reshape(-1, 2), rule_tokens)
                found = [g.decode(symbols, int(sizes[k - 1]) if k else 0, int(sizes[k])).tolist() for k, d in enumerate(at) if d == doc_id]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return shards.filter(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).mapInArrow(run, "doc_id long, ids array<long>")
