"""Target-distribution importance resampling: draw the documents whose hashed n-grams look like those of a target.

Every document becomes an array of n-gram buckets by higher-order functions. The
counts of buckets over all documents and over all target texts give each bucket a
gain, the logarithm of its share in the target over its share in the documents.
The gains are one literal array of as many entries as there are buckets, and a
document's weight is the mean of its entries: nothing is exploded or joined to
score. Bucket counts are summed before their shuffle, so a task sends one row a
bucket at most. A Gumbel number of the id's own hash is added to each weight; the
highest sums are a draw without replacement by weight.

Ranks come from the histogram of scores: a score's first rank is the number of
eligible documents above it, so only documents that can be drawn are shuffled, by
their score.

Cases: null and empty texts have no words, weight 0, and are not eligible; a text
with fewer words than an n-gram has none of it; a null id hashes as an empty one and
loses ties; repeated rows are rows of their own, each with a rank; an empty table
gives an empty result, an empty target gains from add-one counts alone. Only the id
and the text are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, staged

BUCKETS, GRAMS = 10_000, 1
#: Percent of the eligible documents to draw, and words that make one eligible.
PER_CENT, MIN_WORDS = 10, 20
SEED = 2024
#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Scores whose counts are summed together first; the number of such blocks follows from the range of scores, not from the rows.
_BLOCK = 1024


def words_of(text: Column) -> Column:
    """The words of a text, with A-Z in lower case; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, _BETWEEN), lambda w: w != "")


def gram_buckets(words: Column, grams: int = GRAMS, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to `grams` consecutive words, repeats included."""
    bucket = lambda x: (F.crc32(x) % buckets).cast("int")

    def longer(w: Column, k: int) -> Column:
        starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(w, i, k), " ")))

    def runs(w: Column) -> Column:
        return F.concat(F.transform(w, bucket), *[longer(w, k) for k in range(2, grams + 1)])

    return let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), runs(w).alias("buckets")))


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n) over the buckets arrays of rows."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain in thousandths of the natural logarithm, floored; both frames have buckets arrays."""
    spark = docs.sparkSession
    sides = bucket_counts(docs).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    sides = sides.unionByName(bucket_counts(target).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = staged(sides.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "counts")
    all_s, all_t = counts.agg(F.sum("s"), F.sum("t")).first()
    num = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets))
    den = (F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets))
    gains = counts.select("bucket", F.floor(F.lit(1000.0) * F.log(num / den)).cast("long").alias("gain"))
    return [r.gain for r in gains.orderBy("bucket").collect()]  # as many as there are buckets, a parameter


def mean_gain(buckets: Column, gains: list[int]) -> Column:
    """The floored mean of the gains of an array of buckets, 0 for none."""
    literal = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded into one literal array
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(literal, b + 1))
    n = F.size(buckets).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(let(total, lambda x: ((x - F.pmod(x, n)) / n).cast("long")))  # whole quotients: doubles hold them up to 2^53


def gumbel(key: Column, seed: int = SEED) -> Column:
    """A Gumbel number in thousandths, floored, from the SHA-256 of `seed:key`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def first_ranks(scores: DataFrame) -> DataFrame:
    """(score, above): how many rows of scores (score, n) lie above each; blocks of scores are summed first."""
    block = F.floor(F.col("score") / _BLOCK)
    rows = scores.withColumn("block", block)
    down = lambda w, by: w.orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(down(Window.partitionBy(), "block")), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(down(Window.partitionBy("block"), "score")), F.lit(0))
    return rows.withColumn("inside", inside).join(F.broadcast(blocks), "block").select("score", (F.col("before") + F.col("inside")).alias("above"))


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, per_cent: int = PER_CENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document of docs (doc_id, text); rank is null for those not drawn. target has a text column."""
    features = lambda df, *more: df.select(*more, gram_buckets(words_of(F.col("text")), grams, buckets).alias("f")).select(*more, "f.*")
    rows = staged(features(docs, "doc_id"), "features")
    gains = bucket_gains(rows, features(target), buckets)
    weight = mean_gain(F.col("buckets"), gains)
    scored = rows.select("doc_id", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"), (F.col("n_words") >= min_words).alias("eligible"))
    scored = staged(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    eligible = scored.filter("eligible")
    counts = staged(eligible.groupBy("score").agg(F.count("*").alias("n")), "scores")
    drawn = per_cent * (counts.agg(F.sum("n")).first()[0] or 0) // 100
    # Scores are a mean of gains, which are logarithms of 64-bit counts, and a Gumbel number of 32 bits: some 110,000 distinct values at most.
    above = F.broadcast(first_ranks(counts).filter(F.col("above") < drawn).withColumnRenamed("score", "at"))
    placed = scored.join(above, F.col("eligible") & (F.col("score") == F.col("at")), "left")
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "weight", "n_features")
    hit = placed.filter("above is not null").withColumn("rank", F.col("above") + F.row_number().over(order))
    out = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    return hit.select(*out, rank).unionByName(placed.filter("above is null").select(*out, F.lit(None).cast("long").alias("rank")))


#: The same in DuckDB; the checksum is built from its rule: 256 table entries of eight shifts each, then a fold over the word's bytes.
ORACLE = """
with recursive steps(b, k, v) as (
  select i, 0, i from range(256) t(i)
  union all select b, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end from steps where k < 8
), crc as (select list(v order by b) as t from steps where k = 8
), texts as (
  select 'd' as side, doc_id, coalesce(text, '') as text from documents union all select 'b', null, coalesce(text, '') from benchmark
), words as (
  select side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from texts
), tokens as (select side, doc_id, unnest(w) as word from words
), vocabulary as (select distinct word from tokens
), bytes as (select word, list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::int, 2))::bigint) as b from vocabulary
), hashed as (
  select word, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda a, x: xor(a // 256, crc.t[(xor(a % 256, x) + 1)::int])), 4294967295) % 10000 as bucket from bytes, crc
), placed as (select side, doc_id, bucket from tokens join hashed using (word)
), counts as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from placed group by bucket
), totals as (select coalesce(sum(s), 0)::double as s, coalesce(sum(t), 0)::double as t from counts
), gains as (
  select bucket, floor(1000 * ln((c.t + 1)::double * (totals.s + 10000) / ((c.s + 1)::double * (totals.t + 10000))))::bigint as gain from counts c, totals
), weights as (select doc_id, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight from placed join gains using (bucket) where side = 'd' group by doc_id
), scored as (
  select d.doc_id, coalesce(w.n, 0) as n_features, coalesce(w.weight, 0) as weight,
    coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from documents d left join weights w on w.doc_id = d.doc_id
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scored where n_features >= 20
)
select s.doc_id, s.n_features, s.weight, s.score, case when r <= 10 * n // 100 then r end as rank
from scored s left join ranked using (doc_id)
"""
