"""Hard-negative mining by distributed radix selection over integer scores.

Vectors are whole numbers, a score is an inner product, so the rows that an anchor
asks for are those of a window of integers: all scores for its positives, a band
below a positive's score for its negatives. Which rows are the first k of a window
is found digit by digit: every task counts the next digit of the scores in the
windows' current ranges, keeping of each count what can reach k; the sums name the
digit in which the kth score lies, and the next pass looks into that digit only.
After the last digit the kth score is known, and one pass gathers the rows that
are no lower, of equal scores the smallest ids first, k of a window from a task at
most. What is shuffled follows windows, k and tasks, never pairs.

Anchors are a stated query set held against all rows in blocks: rows are dealt by a
hash of their id to parts of about PART rows, and anchors stream past the part that a
task holds. Scores are a matrix product, exact in the narrowest floating type whose
whole numbers hold the product of the largest norms, else in 64-bit integers.

Cases: rows with a null id, label or vector, or a null, infinite or not-a-number
component take no part; vectors of different lengths are filled up with zeros, and an
empty one scores 0; of rows of one id the one with the least (label, vector) counts;
equal scores go by smaller id; fewer than k rows are all returned; a positive with a
negative score has an empty band; an empty table gives an empty result. Components are
kept within 64 bits; only scores up to 2^61 in size are found. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: The band of negative scores, in percent of the positive's.
LOW, HIGH = 50, 95
#: Rows that a task holds at a time, about, and scores that it computes at a time.
PART, _SCORES = 1 << 15, 1 << 21
#: Bits of a digit.
DIGIT = 10
_WINDOW = "struct<w:int,hi:long,from:long,upto:long,need:int>"


def whole_vectors(rows: DataFrame, row_id: str, label: str | Column, vector: str, scale: int = SCALE) -> DataFrame:
    """The written rows (id, label, q) that take part, q the floored components as the narrowest integers that hold all of them."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    q = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    part = rows.select(F.col(row_id).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.when(finite, q).alias("q"))
    part = part.filter("id is not null and label is not null and q is not null").groupBy("id").agg(F.min(F.struct("label", "q")).alias("v"))
    part = staged(part.select("id", "v.label", "v.q"), "vectors")
    most = part.agg(F.max(F.greatest(F.array_max("q"), -F.array_min("q")))).first()[0] or 0
    kind = "smallint" if most < 1 << 15 else "int" if most < 1 << 31 else "bigint"
    return part.withColumn("q", F.col("q").cast(f"array<{kind}>"))


def norm_bound(vectors: DataFrame) -> int:
    """The largest squared norm: no score is further from zero."""
    square = F.aggregate("q", F.lit(0.0), lambda acc, c: acc + c.cast("double") * c.cast("double"))
    return min(int(vectors.agg(F.max(square)).first()[0] or 0) + 1, 1 << 61)


def _matrix(column: pa.ListArray, kind) -> np.ndarray:
    """The vectors as rows of one matrix, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return values.reshape(len(sizes), width).astype(kind)
    out = np.zeros((len(sizes), width), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    width = min(a.shape[1], b.shape[1])
    return (a[:, :width] @ b[:, :width].T).astype(np.int64)


def _past_parts(work, same: bool, bound: int):
    """A mapInArrow function over rows sorted by (part, kind, id): holds a part's vectors and yields work's rows for the anchors that stream past."""
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64

    def run(batches):
        here, held, part = None, [], None
        for batch in batches:
            place = batch.column("part").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.diff(place)) + 1
            for start, end in zip(np.r_[0, cuts], np.r_[cuts, len(place)], strict=True):
                if start == end:
                    continue
                number, anchors = divmod(int(place[start]), 2)
                if number != here:
                    here, held, part = number, [], None
                rows = batch.slice(start, end - start)
                if not anchors:
                    held.append(rows.select(["id", "label", "q"]))
                elif held:
                    if part is None:
                        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        part = whole.column("id").to_numpy(), whole.column("label").to_numpy(), _matrix(whole.column("q"), kind)
                    step = max(1, _SCORES // len(part[0]))
                    for at in range(0, rows.num_rows, step):
                        yield from _asked(rows.slice(at, step), *part)

    def _asked(rows, ids, labels, matrix):
        score = _scores(_matrix(rows.column("q"), kind), matrix)
        own, label = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        fits = (label[:, None] == labels[None, :]) == same
        fits &= own[:, None] != ids[None, :]
        windows = rows.column("windows")
        first, flat = windows.offsets.to_numpy() - windows.offsets[0].as_py(), windows.flatten()
        field = {k: flat.field(k).to_numpy() for k in ("w", "hi", "from", "upto", "need")}
        each = np.diff(first)
        for nth in range(int(each.max(initial=0))):  # the nth window of all anchors at once
            who = np.flatnonzero(each > nth)
            f = {k: v[first[:-1][who] + nth] for k, v in field.items()}
            below = f["hi"][:, None] - score[who]
            inside = fits[who] & (below >= f["from"][:, None]) & (below <= f["upto"][:, None])
            some = inside.any(1)
            if some.any():
                yield work(own[who][some], {k: v[some] for k, v in f.items()}, below[some], inside[some], ids)

    return run


def _least(values: np.ndarray, k: int) -> np.ndarray:
    """The k least of each row, ascending; all, if there are fewer."""
    k = min(k, values.shape[1])
    return np.sort(np.partition(values, k - 1, axis=1)[:, :k], axis=1)


_NONE = np.iinfo(np.int64).max


def _digits(shift: int):
    """work for a pass of counting: (id, w, digit, n), the least digits of a window that hold as many rows as it needs."""

    def work(own, f, below, inside, ids):
        values = _least(np.where(inside, (below - f["from"][:, None]) >> shift, _NONE), int(f["need"].max()))
        values[np.arange(values.shape[1])[None, :] >= f["need"][:, None]] = _NONE
        row, col = np.nonzero(values != _NONE)
        pairs, n = np.unique(np.stack([row, values[row, col]]), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(own[pairs[0]]), pa.array(f["w"][pairs[0]]), pa.array(pairs[1]), pa.array(n.astype(np.int64))], names=["id", "w", "digit", "n"])

    return work


def _gather(k: int):
    """work for the last pass: (id, w, found, score), the first k of a window, equal scores by id. Rows are in the order of their ids."""

    def work(own, f, below, inside, ids):
        n = len(ids)
        down = np.where(inside, below - f["from"][:, None], _NONE)
        if int(f["upto"].max() - f["from"].min()) < _NONE // n - 1:  # a score and a place fit one number
            values = _least(np.where(inside, down * n + np.arange(n)[None, :], _NONE), k)
            row, col = np.nonzero(values != _NONE)
            down, at = np.divmod(values[row, col], n)
        else:
            order = np.argsort(down, axis=1, kind="stable")[:, :k]
            row, col = np.nonzero(np.take_along_axis(inside, order, 1))
            at = order[row, col]
            down = down[row, at]
        return pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(f["w"][row]), pa.array(ids[at]), pa.array(f["hi"][row] - f["from"][row] - down)], names=["id", "w", "found", "score"])

    return work


def _pass(vectors: DataFrame, parts: int, asks: DataFrame, fn, schema: str) -> DataFrame:
    """fn over each part's vectors, followed by every anchor (id, label, q, windows)."""
    rows = vectors.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.lit(0).alias("kind"), "id", "label", "q", F.lit(None).cast(f"array<{_WINDOW}>").alias("windows"))
    asked = asks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(1).alias("kind"), "id", "label", "q", "windows")
    dealt = rows.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "kind", "id")
    return dealt.mapInArrow(fn, schema)


def select_first(vectors: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool, bound: int, width: int) -> DataFrame:
    """(id, w, rank, found, score): the first k rows of each window (id, w, lo, hi) of the scores of an anchor.

    anchors are rows of vectors, or like them. The rows of an anchor's own label are
    asked for if same, else those of other labels, itself excepted; higher scores
    first, ties by smaller id. width is the largest hi - lo, bound the largest score.
    """
    spark = vectors.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // PART))
    key = ["id", "w"]
    state = staged(windows.select(*key, "hi", F.lit(0).cast("long").alias("from"), (F.col("hi") - F.col("lo")).alias("upto"), F.lit(k).alias("need")), "windows")
    ended = None  # windows with fewer rows than they need: all of them qualify
    asks = lambda s: anchors.join(s.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("w", "hi", "from", "upto", "need").cast(_WINDOW))).alias("windows")), "id")
    shifts = list(range(max(0, width.bit_length() - DIGIT), 0, -DIGIT)) + [0]
    up = Window.partitionBy(*key).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for shift in shifts:
        counts = _pass(vectors, parts, asks(state), _past_parts(_digits(shift), same, bound), "id long, w int, digit long, n long")
        counts = counts.groupBy(*key, "digit").agg(F.sum("n").alias("n")).withColumn("so_far", F.sum("n").over(up))
        joined = counts.join(state, key)
        reached = joined.filter("so_far >= need").groupBy(*key).agg(F.min(F.struct("digit", (F.col("so_far") - F.col("n")).alias("before"))).alias("d"))
        start = F.col("from") + F.shiftleft(F.col("d.digit"), shift)
        new = state.join(reached, key, "left")
        new = new.select(*key, "hi", F.coalesce(start, F.lit(0).cast("long")).alias("from"), F.when(F.col("d").isNull(), F.col("upto")).otherwise(F.least(start + ((1 << shift) - 1), "upto")).alias("upto"), F.coalesce(F.col("need") - F.col("d.before"), F.lit(0)).cast("int").alias("need"))
        new = staged(new, "windows")
        done = new.filter("need = 0")
        ended = done if ended is None else ended.unionByName(done)
        state = new.filter("need > 0")
    found = state.unionByName(ended).select(*key, "hi", F.lit(0).cast("long").alias("from"), "upto", F.lit(k).alias("need"))
    rows = _pass(vectors, parts, asks(found), _past_parts(_gather(k), same, bound), "id long, w int, found long, score long")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "found")))
    return rows.filter(F.col("rank") <= k).select(*key, "rank", "found", "score")


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the first negatives of each of an anchor's first positives whose score lies in the band.

    vectors and anchors have (id, label, q), as whole_vectors writes them.
    """
    bound = norm_bound(vectors)
    everything = anchors.select("id", F.lit(0).alias("w"), F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"))
    good = staged(select_first(vectors, anchors, everything, positives, True, bound, 2 * bound), "positives")
    # Whole bounds of low * p <= 100 * s <= high * p.
    p = F.col("score")
    bands = good.select("id", F.col("rank").alias("w"), (-F.floor(-p * low / 100)).cast("long").alias("lo"), F.floor(p * high / 100).cast("long").alias("hi")).filter("lo <= hi")
    bands = staged(bands, "bands")
    widest = bands.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    bad = select_first(vectors, anchors, bands, negatives, False, bound, widest or 0)
    pairs = good.select(F.col("id").alias("anchor_id"), F.col("rank").alias("w"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    found = bad.select(F.col("id").alias("anchor_id"), "w", "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    return pairs.join(found, ["anchor_id", "w"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_embeddings(embeddings: DataFrame, every: int = 50, moved: int = 7, labels: int = 10) -> DataFrame:
    """Hard negatives of an embedding table (vec_id, embedding, label): anchors are the ids divisible by `every`; those divisible by `moved` have the next of `labels` labels."""
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    vectors = whole_vectors(embeddings, "vec_id", label, "embedding")
    return mine(vectors, vectors.filter(F.col("id") % every == 0))


ORACLE = """
with v as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
  select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_dot_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, row_number() over w as rank, s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scores s on s.anchor_id = p.anchor_id and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)
qualify row_number() over w <= 3
"""
