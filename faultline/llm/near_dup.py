"""SimHash near-dedup by a self-join of binary tries.

Fingerprints are the leaves of a binary trie over their 64 bits. The join visits
pairs of nodes of one depth together, adds up the bits in which their paths
differ, and drops a pair as soon as that is more than it may be. Of two
fingerprints within D bits, one of TRIES = 3 blocks of bits has at most D // 3
differing bits, so the join runs over three tries, each with another block in
front, where a pair may differ in D // 3 bits in the front block and in D in all.

The first levels are walked by the cluster: every fingerprint sends itself to the
node pairs that its path leads to (its own node, and those that differ from it in
up to D // 3 of the first bits), the rest of each pair's subtries is walked by one
task in numpy, level by level in bounded blocks. The depth of the shared levels
follows the number of fingerprints; node pairs that are still overfull send their
fingerprints further down until they are small or the front block is used up.
A task links what it finds to the least fingerprint of its group, so it returns
fewer links than fingerprints however many pairs there are.

Equal fingerprints are one leaf. Every link is within D bits; none is dropped.

Cases: null and empty texts, and texts without words, have fingerprint zero and
are linked like any other; texts with fewer than SHINGLE words are one shingle;
repeated rows share a class; null ids are ignored as representatives, a class of
null ids alone has a null one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import discard, in_steps, join_checked, staged, staged_so_far
from .components import connected_components
from .shingles import shingle_hashes

SHINGLE, DISTANCE = 4, 4
TRIES = 3
#: What is a near copy beside few differing bits: sets of five-word shingles of a similarity of 0.8 and more.
SIMILAR = jaccard.Rule(5, 80)
#: Fingerprints that a node pair holds on average and at most, before it is split further.
LEAVES, CROWDED = 1 << 11, 1 << 14
#: Node pairs that a task expands at a time.
_BLOCK = 1 << 17
_PRINTS = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed number."""
    values = shingle_hashes(text, shingle)
    if not len(values):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 15):
        ones += np.unpackbits(values[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint) of whole texts."""

    def work(batch):
        prints = [fingerprint(x.as_py(), shingle) for x in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints, pa.int64())], schema=_PRINTS)

    return docs.select("doc_id", "text").mapInArrow(in_steps("text", work), "doc_id long, fingerprint long")


def rotated(value: Column, bits: int) -> Column:
    """value with its bits turned left."""
    return value if not bits else F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits))


def front_blocks(tries: int = TRIES) -> list[tuple[int, int]]:
    """(first bit, bits) of each trie's front block."""
    edges = [64 * k // tries for k in range(tries + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _visits(prefix: Column, bits: int, errors: int, side: Column | None = None) -> Column:
    """Node pairs of depth `bits` that a path leads to: (node, differing bits) with the smaller node first, and the side.

    Two nodes that differ in the bits of `mask` meet under (node without those bits, mask).
    A leaf's side is its path's value in the highest bit of the mask; under nodes
    that differ already (side is given) the pair is named by the path on side 0.
    """
    own = [F.struct(prefix.alias("node"), F.lit(0).cast("long").alias("mask"), F.lit(0).alias("side"))]
    for k in range(1, errors + 1):
        for at in combinations(range(bits), k):
            mask = sum(1 << b for b in at)
            # The two nodes are complements on the mask: of both, the pattern with the top bit off names the pair.
            top = F.shiftrightunsigned(prefix, max(at)).bitwiseAND(F.lit(1).cast("long")) if side is None else side
            node = F.when(top == 0, prefix).otherwise(prefix.bitwiseXOR(F.lit(mask).cast("long")))
            own.append(F.struct(node.alias("node"), F.lit(mask).cast("long").alias("mask"), top.cast("int").alias("side")))
    return F.explode(F.array(*own))


def shared_levels(leaves: DataFrame, n: int, distance: int, per_pair: int = LEAVES) -> DataFrame:
    """(trie, depth, node, mask, side, key): the node pairs of the first levels with the leaves under them.

    key is the leaf turned so that the trie's front block comes first.
    """
    depth = max(0, math.ceil(math.log2(max(n, 1) / per_pair)))
    out = None
    for trie, (first, bits) in enumerate(front_blocks()):
        d = min(depth, bits)
        turned = leaves.select(rotated(F.col("fingerprint"), first).alias("key"))
        prefix = F.shiftrightunsigned("key", 64 - d) if d else F.lit(0).cast("long")
        part = turned.select("key", _visits(prefix, d, min(distance // TRIES, d)).alias("v"))
        part = part.select(F.lit(trie).alias("trie"), F.lit(d).alias("depth"), "v.node", "v.mask", "v.side", "key")
        out = part if out is None else out.unionByName(part)
    return out


def split_crowded(pairs: DataFrame, distance: int, crowded: int = CROWDED) -> DataFrame:
    """Sends the leaves of overfull node pairs down to the next levels of the front block; leaves of others stay where they are.

    A pair that has used its front budget goes on with equal paths only; a node
    with itself branches into the children pairs within the budget. Bits behind
    the front block are left to the walk, which holds them against the whole distance.
    """
    place = ["trie", "depth", "node", "mask"]
    sizes = [bits for _, bits in front_blocks()]
    within = F.col("depth") < F.get(F.array(*[F.lit(x) for x in sizes]), F.col("trie"))
    full = staged(pairs.filter(within).groupBy(*place).agg(F.count("*").alias("n")).filter(F.col("n") > crowded).drop("n"), "crowded")
    budget = distance // TRIES
    levels = sorted((r.trie, r.depth) for r in full.select("trie", "depth").distinct().collect())
    if not levels:
        return pairs
    hot = pairs.join(full, place, "left_semi")
    out = pairs.join(full, place, "left_anti")
    for trie, depth in levels:
        down = min(6, sizes[trie] - depth)
        low = F.expr(f"shiftrightunsigned(shiftleft(key, {depth}), {64 - down})")
        for used in range(budget + 1):
            here = hot.filter((F.col("trie") == trie) & (F.col("depth") == depth) & (F.bit_count("mask") == used))
            visited = here.select("trie", "depth", F.col("node").alias("n0"), F.col("mask").alias("m0"), F.col("side").alias("s0"), "key", _visits(low, down, budget - used, F.col("side") if used else None).alias("v"))
            node = F.shiftleft(F.col("n0"), down).bitwiseOR(F.col("v.node"))
            mask = F.shiftleft(F.col("m0"), down).bitwiseOR(F.col("v.mask"))
            side = F.when(F.col("m0") == 0, F.col("v.side")).otherwise(F.col("s0"))
            out = out.unionByName(visited.select("trie", (F.col("depth") + down).alias("depth"), node.alias("node"), mask.alias("mask"), side.alias("side"), "key"))
    return split_crowded(staged(out, "pairs"), distance, crowded)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


class Links:
    """Groups of leaves, as each one's least linked leaf."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.parent[a], self.parent[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))
            self.parent = _roots(self.parent)


def walk(keys: np.ndarray, split: int, depth: int, front: int, front_budget: int, distance: int, links: Links) -> None:
    """Walk the trie pairs under one node pair: sorted leaves [0, split) against [split, n), or against themselves if split is 0.

    A state is two runs of leaves with one path each from the root, and a depth
    up to which their paths are compared. Children of both runs are paired, the
    differing bits of a pair are those of its two paths.
    """
    n = len(keys)
    left = (0, n) if split == 0 else (0, split)
    right = (0, n) if split == 0 else (split, n)
    stack = [tuple(np.array([x]) for x in (*left, *right)) + (depth,)]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    while stack:
        a0, a1, b0, b1, at = stack.pop()
        if len(a0) > _BLOCK:
            half = len(a0) // 2
            stack.append((a0[:half], a1[:half], b0[:half], b1[:half], at))
            stack.append((a0[half:], a1[half:], b0[half:], b1[half:], at))
            continue
        small = (a1 - a0) * (b1 - b0) <= 16
        if at == 64:
            small[:] = True
        if small.any():
            sa, na, sb, nb = a0[small], (a1 - a0)[small], b0[small], (b1 - b0)[small]
            each = na * nb
            which = np.repeat(np.arange(len(each)), each)
            k = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
            i, j = sa[which] + k // nb[which], sb[which] + k % nb[which]
            once = i < j
            i, j = i[once], j[once]
            near = np.bitwise_count(keys[i] ^ keys[j]) <= distance
            links.add(i[near], j[near])
        go = ~small
        a0, a1, b0, b1 = a0[go], a1[go], b0[go], b1[go]
        if not len(a0):
            continue
        bit = np.uint64(1) << np.uint64(63 - at)
        mid = lambda lo, hi: _middle(keys, lo, hi, bit)
        am, bm = mid(a0, a1), mid(b0, b1)
        quads = [(a0, am, b0, bm), (am, a1, bm, b1), (a0, am, bm, b1), (am, a1, b0, bm)]
        same = (a0 == b0) & (a1 == b1)
        new = []
        for q, (x0, x1, y0, y1) in enumerate(quads):
            ok = (x1 > x0) & (y1 > y0)
            if q == 3:
                ok &= ~same  # a run with itself: one of the two mixed pairs is enough
            new.append(tuple(v[ok] for v in (x0, x1, y0, y1)))
        a0, a1, b0, b1 = (np.concatenate(c) for c in zip(*new, strict=True))
        at += 1
        path = full << np.uint64(64 - at) if at < 64 else full
        apart = (keys[a0] ^ keys[b0]) & path
        ok = np.bitwise_count(apart) <= distance
        head = min(at, front)
        ok &= np.bitwise_count(apart & (full << np.uint64(64 - head))) <= front_budget
        stack.append((a0[ok], a1[ok], b0[ok], b1[ok], at))


def _middle(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """The first leaf in each run [lo, hi) that has the bit; runs share all higher bits and are sorted."""
    above = keys[lo] & ~(bit | (bit - np.uint64(1)))
    return np.clip(np.searchsorted(keys, above | bit), lo, hi)


def _walk_group(distance: int):
    blocks = front_blocks()

    def run(batches):
        """Rows sorted by node pair; one group is held at a time."""
        last, held = None, []
        for batch in batches:
            place = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("trie", "depth", "node", "mask")], 1)
            side, key = batch.column("side").to_numpy(), batch.column("key").to_numpy()
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(place)], strict=True):
                if a == b:
                    continue
                here = tuple(place[a].tolist())
                if here != last and held:
                    yield from _linked(last, held)
                    held = []
                last = here
                held.append((side[a:b], key[a:b]))
        if held:
            yield from _linked(last, held)

    def _linked(place, held):
        trie, depth, _, mask = place
        side = np.concatenate([s for s, _ in held])
        key = np.concatenate([k for _, k in held]).view(np.uint64)
        split = 0
        if mask:
            split = int((side == 0).sum())
            if split in (0, len(key)):
                return
        order = np.lexsort((key, side))
        key = key[order]
        links = Links(len(key))
        first, bits = blocks[trie]
        if not mask:
            walk(key, 0, depth, bits, distance // TRIES, distance, links)
        else:
            # Both sides in one sorted array, so that runs are found by one search.
            rank = np.argsort(key, kind="stable")
            merged = key[rank]
            sides = np.r_[np.zeros(split, bool), np.ones(len(key) - split, bool)][rank]
            walk_sides(merged, sides, depth, bits, distance, links)
            key = merged
        root = _roots(links.parent)
        moved = np.flatnonzero(root != np.arange(len(key)))
        if len(moved):
            back = lambda k: (k >> np.uint64(first) | k << np.uint64(64 - first) if first else k).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(back(key[moved])), pa.array(back(key[root[moved]]))], names=["a", "b"])

    def walk_sides(keys, sides, depth, bits, distance, links):
        """The two nodes of a pair are two runs of the sorted leaves: their paths differ within the first levels."""
        change = int(np.flatnonzero(sides != sides[0])[0])
        walk(keys, change, depth, bits, distance // TRIES, distance, links)

    return run


def near_links(leaves: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all pairs within the distance."""
    n = leaves.count()
    pairs = split_crowded(staged(shared_levels(leaves, n, distance), "pairs"), distance)
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["trie", "depth", "node", "mask"]
    dealt = pairs.repartition(parts, *place).sortWithinPartitions(*place)
    return dealt.mapInArrow(_walk_group(distance), "a long, b long")


def simhash_components(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprint as a number, component_id the smallest id that links reach."""
    prints = staged(fingerprints(docs, shingle), "prints")
    leaves = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "leaves")
    labels = connected_components(near_links(leaves, distance))
    joined = leaves.join(labels, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("label", "fingerprint").alias("label"))
    joined = staged(joined, "classes")
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = joined.join(least, "label").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_copies(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(node, label): the ids of documents with a near copy, and the smallest id that links reach.

    Links are those of the trie join over fingerprints of five-word shingles, and those
    of the Jaccard join: few bits lose copies near the similarity of 0.8.
    """
    moved = lambda rows: rows.filter("doc_id <> component_id").select(F.col("doc_id").cast("long").alias("a"), F.col("component_id").cast("long").alias("b"))
    rows = moved(simhash_components(docs, distance, SIMILAR.shingle)).union(moved(jaccard.jaccard_components(docs, SIMILAR)))
    return connected_components(staged(rows, "links"))


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs that stay: of each group of near copies the row with the smallest id. Ids identify rows here; rows without an id stay."""
    mark = staged_so_far()
    gone = staged(near_copies(docs, distance).filter("node <> label").select(F.col("node").alias("doc_id")), "copies")
    discard(docs.sparkSession, mark, gone)
    return join_checked(docs, gone, "doc_id", "left_anti", 16)
