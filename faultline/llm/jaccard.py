"""N-gram Jaccard join: which documents have sets of word n-grams of at least a given similarity.

Rare-first prefix filtering: n-grams are ordered by how often their bucket of a
counting sketch over all documents occurs, rarest first. Two sets whose similarity
is high enough share an n-gram of their prefixes, the first n - ceil(t n) + 1 in
that order, so sets are joined on prefix n-grams. Of the pairs that meet, the length
filter drops those whose sizes differ too much, the positional filter those that
share their first n-gram too late, and the suffix filter those whose n-grams, dealt
to parts by hash, differ too much in the sizes of the parts. What is left is
verified once per pair by whole sets.

Equal sets are one node from the start. An n-gram that is common (more than HOT
documents by its bucket) is no key of its own: a set with a common n-gram in its
prefix is cut into D + 1 parts by hash, where D is how many n-grams two similar sets
of its size class can differ in, and its parts are keys. Similar sets have an equal
part, so two sets whose shared prefix n-grams are all common meet there.

Only connections are asked for, not all pairs, so a key's group is worked in two
steps. First each member is held against the one with the most shared keys, which
in a family of copies is the original or near it: one pair a row. Then, in groups
whose members are not all connected yet, every pair that is not connected is held
against the filters, in blocks of BLOCK members, and what passes is verified. No
pair that could connect two components is left out, whatever the size of a group.

Cases: null texts and texts without words have no n-grams and link with nothing;
texts with fewer words than an n-gram are one of it; repeated rows share their set;
a row with a null id counts for no link, takes the component of its set if others
have that set, else null; an empty table gives an empty result; other columns are
not read. N-grams and sets are held as 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, in_steps, join_checked, staged, staged_so_far, steps
from .components import connected_components

#: Counters of the sketch, sent to every task as one number of 32 bits each, and how many travel together.
COUNTERS, SEGMENT = 1 << 20, 1 << 13
#: Documents by its counter, over the mean counter, from which on an n-gram is common.
HOT = 512
#: Members of a group that are held against each other at a time, and bytes that one such step makes.
BLOCK, _STEP = 1024, 1 << 24
#: Members of a group from which on the sizes of parts travel with them, so that only pairs that pass all filters leave a task.
LARGE = 32
#: Sets whose keys a task knows to be sent already, and bytes of text that are hashed at a time.
_SENT, _PIECE = 1 << 17, 1 << 17


@dataclass(frozen=True)
class Rule:
    """Sets of `shingle` words' runs are linked if `of` times what they share is at least `share` times their union."""

    shingle: int = 4
    share: int = 85
    of: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.share * n // self.of) + 1

    def least_shared(self, total):
        """What two sets of together `total` n-grams must share."""
        return -(-self.share * total // (self.share + self.of))

    def size_class(self, n: int) -> tuple[int, list[tuple[int, int]]]:
        """(the class of a size, the two schemes that it takes part in as (number, parts)).

        A set's partners are of its class or a neighbouring one; a scheme serves a class and the next.
        """
        k, low = 0, 1
        while (high := low * self.of // self.share + 1) <= n:
            k, low = k + 1, high
        schemes = [(k, self._parts(high - 1))]
        if k:
            schemes.append((k - 1, self._parts(low - 1)))
        return k, schemes

    def _parts(self, most: int) -> int:
        """One more than sets of up to `most` n-grams and their partners can differ in."""
        total = most + most * self.of // self.share
        return total * (self.of - self.share) // (self.of + self.share) + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: A number for each byte, and the powers of an odd base and of its inverse modulo 2^64.
_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_UP, _DOWN = _powers(_BASE, _PIECE + 1), _powers(pow(_BASE, -1, 1 << 64), _PIECE + 1)


def _run_hashes(words: list[bytes], k: int) -> np.ndarray:
    """A hash of each run of k words: the difference of two prefix sums of a polynomial over the text's bytes, brought to one power."""
    line = np.frombuffer(b" ".join(words), np.uint8)
    if len(line) > _PIECE:
        if len(words) <= 2 * k:  # words of great length
            import xxhash

            return np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)], np.uint64)
        half = len(words) // 2
        return np.concatenate([_run_hashes(words[: half + k - 1], k), _run_hashes(words[half:], k)])
    sums = np.zeros(len(line) + 1, np.uint64)
    np.cumsum(_BYTES[line] * _UP[: len(line)], out=sums[1:])
    gaps = np.flatnonzero(line == 32)
    starts, ends = np.r_[0, gaps + 1], np.r_[gaps, len(line)]
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    return _mixed((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """A text's distinct n-grams as hashes, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(_run_hashes(words, min(shingle, len(words))))


def set_id(s: np.ndarray) -> int:
    """One signed number for a whole set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), len(s))).view(np.int64))


def part_keys(s: np.ndarray, rule: Rule) -> np.ndarray:
    """A key for each part of a set under its two schemes: the scheme, the part and all that lies in it."""
    out = []
    for number, parts in rule.size_class(len(s))[1]:
        part = (_mixed(s ^ np.uint64(number + 1)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        total = np.r_[np.uint64(0), np.cumsum(_mixed(s[order]), dtype=np.uint64)]
        edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        inside = total[edges[1:]] - total[edges[:-1]]
        out.append(_mixed(_mixed(inside + np.arange(parts, dtype=np.uint64)) + np.uint64(number)))
    return np.concatenate(out)


def prefix_keys(s: np.ndarray, rule: Rule, counters: np.ndarray, hot: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places): the prefix n-grams that are not common, with their places in the order, and the parts if some are; parts are at place 0."""
    n = len(s)
    if not n:
        return s, np.zeros(0, np.int32)
    count = counters[(s & np.uint64(len(counters) - 1)).astype(np.int64)]
    first = np.lexsort((s, count))[: rule.prefix(n)]
    rare = count[first] <= hot
    keys, places = s[first][rare], np.flatnonzero(rare).astype(np.int32)
    if not rare.all():
        more = part_keys(s, rule)
        keys, places = np.concatenate([keys, more]), np.concatenate([places, np.zeros(len(more), np.int32)])
    return keys, places


def sizes_of_parts(s: np.ndarray) -> bytes:
    """How many n-grams of a set lie in each of one to two times as many parts, 4096 at most; empty if a part holds too many to tell."""
    parts = 1 << min(12, max(6, len(s).bit_length()))
    counts = np.bincount((s >> np.uint64(20) & np.uint64(parts - 1)).astype(np.int64), minlength=parts)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def set_rows(docs: DataFrame, rule: Rule, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, set_id, n, sizes, segment, counts): a row for each document without the last two, and the task's sketch as rows of the last two alone.

    counts are SEGMENT numbers of as many bytes as the largest needs: how many distinct n-grams of documents fall on each counter.
    """
    names = ["doc_id", "set_id", "n", "sizes", "segment", "counts"]

    def run(batches):
        total = np.zeros(counters, np.uint32)
        for batch in batches:
            for part in steps(batch, "text", 1 << 20):
                sets = [shingle_set(x.as_py(), rule.shingle) for x in part.column("text")]
                k = len(sets)
                at, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]) & np.uint64(counters - 1), return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.uint32)
                columns = [part.column("doc_id"), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([sizes_of_parts(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        width = min(SEGMENT, counters)
        for i in range(0, counters, width):
            here = total[i : i + width]
            if here.any():
                packed = here.astype(np.uint8 if here.max() < 1 << 8 else np.uint16 if here.max() < 1 << 16 else np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([i // width], pa.int32()), pa.array([packed], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, set_id long, n int, sizes binary, segment int, counts binary")


def sketch(rows: DataFrame, counters: int = COUNTERS) -> np.ndarray:
    """The counters of all tasks' sketches, added up by segment."""
    width = min(SEGMENT, counters)
    kinds = {width: np.uint8, 2 * width: np.uint16, 4 * width: np.uint32}

    def add(batches):
        total, now = np.zeros(width, np.int64), None
        for batch in batches:
            for segment, packed in zip(batch.column("segment").to_pylist(), batch.column("counts"), strict=True):
                if segment != now:
                    if now is not None:
                        yield one(now, total)
                    total, now = np.zeros(width, np.int64), segment
                total += np.frombuffer(packed.as_py(), kinds[len(packed.as_py())])
        if now is not None:
            yield one(now, total)

    def one(segment, total):
        total = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["segment", "counts"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = rows.filter("segment is not null").select("segment", "counts").repartition(parts, "segment").sortWithinPartitions("segment")
    out = np.zeros(counters, np.uint32)  # as many numbers as there are counters
    for r in summed.mapInArrow(add, "segment int, counts binary").collect():
        out[r.segment * width : (r.segment + 1) * width] = np.frombuffer(r.counts, np.uint32)
    return out


def key_rows(docs: DataFrame, rule: Rule, counters: np.ndarray, hot: int = HOT) -> DataFrame:
    """(key, set_id, n, place) of the sets of documents with an id; a task sends the keys of a set once."""
    mean = float(counters.mean())
    most = mean + max(float(hot), 4 * mean**0.5)

    def run(batches):
        sent: set[int] = set()
        for batch in batches:
            for part in steps(batch, "text", 1 << 20):
                found, own, size = [], [], []
                for x in part.column("text"):
                    s = shingle_set(x.as_py(), rule.shingle)
                    me = set_id(s)
                    if not len(s) or me in sent:
                        continue
                    if len(sent) >= _SENT:
                        sent.clear()
                    sent.add(me)
                    found.append(prefix_keys(s, rule, counters, most))
                    own.append(me)
                    size.append(len(s))
                if found:
                    each = np.array([len(keys) for keys, _ in found])
                    keys, places = (np.concatenate([x[i] for x in found]) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(np.array(own, np.int64), each)), pa.array(np.repeat(np.array(size, np.int32), each)), pa.array(places)], names=_KEYS)

    return docs.filter("doc_id is not null").select("text").mapInArrow(run, "key long, set_id long, n int, place int")


_KEYS = ["key", "set_id", "n", "place"]


def _shared(batches):
    """Of rows sorted by key and set, one of each key and set, of keys that two sets or more have. A row is held back until the next tells."""
    held, known = None, False
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        key, own = batch.column("key").to_numpy(), batch.column("set_id").to_numpy()
        first = np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
        batch, key = batch.filter(pa.array(first)), key[first]
        same = key[1:] == key[:-1]
        keep = np.r_[known, same] | np.r_[same, False]
        held, known = batch.slice(len(key) - 1), bool(keep[-1])
        if keep[:-1].any():
            yield batch.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
    if held is not None and known:
        yield held


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of keys that two sets or more have, once for each set: one shuffle, after which most keys end."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(parts, "key").sortWithinPartitions("key", "set_id").mapInArrow(_shared, "key long, set_id long, n int, place int")


def _fits(rule: Rule):
    """The length and the positional filter on the columns x and y, structs of (set_id, n, place)."""
    n_x, n_y = F.col("x.n").cast("long"), F.col("y.n").cast("long")
    least = F.ceil((n_x + n_y) * rule.share / (rule.share + rule.of))
    return (n_x * rule.of >= n_y * rule.share) & (n_y * rule.of >= n_x * rule.share) & (F.least(n_x - F.col("x.place"), n_y - F.col("y.place")) >= least)


def _once(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) of the columns x and y, the smaller set first."""
    return pairs.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).filter("a < b").distinct()


def _unpacked(sizes: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(sizes), width), np.uint16)
    for i, x in enumerate(sizes):
        v = np.frombuffer(x, np.uint8).astype(np.uint16)
        out[i] = v if len(v) == width else v.reshape(-1, width).sum(0)
    return out


def suffix_filter(rule: Rule):
    """A mapInArrow function over pairs with n and sizes of both: those (a, b) whose sizes of parts allow them to be similar."""

    def run(batches):
        for batch in batches:
            n = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("sizes_a"), batch.column("sizes_b"), strict=True)):
                x, y = x.as_py(), y.as_py()
                if x and y:
                    width = min(len(x), len(y))
                    keep[i] = np.minimum(*_unpacked([x, y], width)).sum() >= rule.least_shared(int(n[i]))
                else:
                    keep[i] = True
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def verified_pairs(rule: Rule):
    """A mapInArrow function over pairs with both texts: those (a, b) whose whole sets are similar. Rows of one a come together."""

    def run(batches):
        last, mine = None, None
        for batch in batches:
            ids_a, ids_b, keep = batch.column("a").to_pylist(), batch.column("b").to_pylist(), np.zeros(batch.num_rows, bool)
            for i, a in enumerate(ids_a):
                if a != last:
                    last, mine = a, shingle_set(batch.column("text_a")[i].as_py(), rule.shingle)
                other = shingle_set(batch.column("text_b")[i].as_py(), rule.shingle)
                if set_id(other) == ids_b[i] and set_id(mine) == a:  # a repeated id may have other texts
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    keep[i] = both * rule.of >= (len(mine) + len(other) - both) * rule.share
                else:
                    last = None if set_id(mine) != a else last
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _both_sides(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of rows (set_id, ...) for b and for a."""
    side = lambda k: rows.select(*[F.col(c).alias(k if c == "set_id" else f"{c}_{k}") for c in rows.columns])
    return pairs.join(side("b"), "b").join(side("a"), "a")


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The written pairs (a, b) of set ids that are similar. Sizes travel first, texts only for the pairs that they allow."""
    mark = staged_so_far()
    checked = _both_sides(pairs, sets.select("set_id", "n", "sizes")).select("a", "b", "n_a", "n_b", "sizes_a", "sizes_b")
    possible = staged(checked.mapInArrow(suffix_filter(rule), "a long, b long"), "possible")
    named = possible.select(F.col("a").alias("set_id")).union(possible.select("b")).distinct()
    named = staged(sets.join(named, "set_id", "left_semi").select("set_id", "doc_id"), "named")
    texts = join_checked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), named, "doc_id", "inner", 16).select("set_id", "text")
    both = _both_sides(possible, texts).select("a", "b", "text_a", "text_b")
    found = staged(both.mapInArrow(verified_pairs(rule), "a long, b long"), "similar")
    discard(docs.sparkSession, mark, found)
    return found.distinct()


def with_leaders(shared: DataFrame) -> DataFrame:
    """shared with leader, the member of the group with the most shared keys (the least of equals), members, their number, and the block of each."""
    degrees = shared.groupBy("set_id").agg(F.count("*").alias("degree"))
    best = F.struct("degree", (-F.col("set_id")).alias("order"), "n", "place")
    groups = shared.join(degrees, "set_id").groupBy("key").agg(F.max(best).alias("b"), F.count("*").alias("members"))
    leader = F.struct((-F.col("b.order")).alias("set_id"), "b.n", "b.place")
    groups = groups.select("key", leader.alias("leader"), "members", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    return shared.join(groups, "key").withColumn("salt", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))


def first_pairs(shared: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): each member of a group against its leader, if they pass the filters."""
    return _once(shared.select(F.struct("set_id", "n", "place").alias("x"), F.col("leader").alias("y")).filter(_fits(rule)))


def _in_blocks(rule: Rule):
    """A mapInArrow function over rows sorted by unit: the pairs (a, b) of a unit that are in different components and pass all filters."""
    fields = ["set_id", "n", "place", "label", "side"]

    def run(batches):
        held, sizes, unit = [], [], None
        for batch in batches:
            place = np.stack([batch.column(k).to_numpy() for k in ("key", "low", "high")], 1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(place)], strict=True):
                if a == b:
                    continue
                here = tuple(place[a].tolist())
                if here != unit and held:
                    yield from _unit_pairs(np.concatenate(held), sizes)
                    held, sizes = [], []
                unit = here
                held.append(np.stack([batch.column(k).to_numpy()[a:b].astype(np.int64) for k in fields], 1))
                sizes += batch.column("sizes")[a:b].to_pylist()
        if held:
            yield from _unit_pairs(np.concatenate(held), sizes)

    def _unit_pairs(rows, sizes):
        width = np.array([len(x) for x in sizes])
        kinds = np.unique(width)
        for w_x in kinds:
            for w_y in kinds:
                x, y = np.flatnonzero(width == w_x), np.flatnonzero(width == w_y)
                w = int(min(w_x, w_y))
                b_x, b_y = (_unpacked([sizes[i] for i in k], w) if w else None for k in (x, y))
                step = max(1, _STEP // ((2 * w + 64) * len(y)))
                for at in range(0, len(x), step):
                    i = x[at : at + step]
                    p, q = rows[i][:, None, :], rows[y][None, :, :]
                    total = p[..., 1] + q[..., 1]
                    least = rule.least_shared(total)
                    ok = (p[..., 3] != q[..., 3]) & ((p[..., 4] < q[..., 4]) | (rows[:, 4].max() == rows[:, 4].min()) & (p[..., 0] < q[..., 0]))
                    ok &= (p[..., 1] * rule.of >= q[..., 1] * rule.share) & (q[..., 1] * rule.of >= p[..., 1] * rule.share)
                    ok &= np.minimum(p[..., 1] - p[..., 2], q[..., 1] - q[..., 2]) >= least
                    if w and ok.any():
                        some = np.flatnonzero(ok.any(1))  # rows without a pair left are not compared
                        shared = np.minimum(b_x[at : at + step][some][:, None, :], b_y[None, :, :]).sum(-1, dtype=np.int64)
                        ok[some] &= shared >= least[some]
                    r, c = np.nonzero(ok)
                    if len(r):
                        a, b = rows[i[r], 0], rows[y[c], 0]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def other_pairs(shared: DataFrame, labels: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): the pairs that share a key, are in different components and pass all filters."""
    spark = shared.sparkSession
    rows = shared.filter("members > 2").drop("leader").join(labels.select(F.col("node").alias("set_id"), "label"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    apart = rows.groupBy("key").agg((F.min("label") < F.max("label")).alias("apart")).filter("apart").select("key")
    rows = rows.join(apart, "key", "left_semi")
    large = rows.filter(F.col("members") > LARGE).join(sets.select("set_id", "sizes"), "set_id")
    rows = large.unionByName(rows.filter(F.col("members") <= LARGE).withColumn("sizes", F.lit(b"")))
    mine, blocks = F.col("salt"), F.col("blocks")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    units = rows.select("key", "set_id", "n", "place", "label", "sizes", "salt", other)
    units = units.select("key", F.least(mine, "other").alias("low"), F.greatest(mine, "other").alias("high"), (mine > F.col("other")).cast("int").alias("side"), "set_id", "n", "place", "label", "sizes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = ["key", "low", "high"]
    return units.repartition(parts, *place).sortWithinPartitions(*place).mapInArrow(_in_blocks(rule), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, rule: Rule = Rule(), hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest id that links reach, the document's own included."""
    spark, mark = docs.sparkSession, staged_so_far()
    rows = staged(set_rows(docs, rule), "sets")
    members = rows.filter("segment is null").select("doc_id", "set_id", "n", "sizes")
    shared = staged(shared_keys(key_rows(docs, rule, sketch(rows), hot)), "shared")
    shared = staged(with_leaders(shared), "groups")
    named = shared.select("set_id").distinct()
    sets = staged(members.filter("doc_id is not null").join(named, "set_id", "left_semi").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sizes").alias("sizes")), "sets")
    pairs = staged(first_pairs(shared, rule), "pairs")
    links = verified(docs, sets, pairs, rule)
    labels = connected_components(links)
    more = staged(other_pairs(shared, labels, sets, rule).join(pairs, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        labels = connected_components(links.union(verified(docs, sets, more, rule)))
    nodes = members.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(labels, F.col("set_id") == F.col("node"), "left").select("set_id", "least", F.coalesce("label", "set_id").alias("label"))
    nodes = staged(nodes, "nodes")
    least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = nodes.join(least, "label").select("set_id", "component_id")
    out = members.join(classes, "set_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = staged(out, "components")
    discard(spark, mark, out)
    return out


ORACLE = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), shingles as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) end) as s from words
), grams as (select doc_id, len(s) as n, unnest(s) as x from shingles
), shared as (
  select a.doc_id as a, b.doc_id as b, any_value(a.n) as n_a, any_value(b.n) as n_b, count(*) as k from grams a join grams b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2
), links as (select a, b from shared where 100 * k >= 85 * (n_a + n_b - k)
), edges as (select a, b from links union select b, a from links
), reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on e.a = r.b)
select s.doc_id, len(s.s) as n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) as component_id
from shingles s left join reach r on r.a = s.doc_id group by s.doc_id, len(s.s)
"""
