"""Exact dedup by an extendible-hash index on shared files; DataFrame operations only.

1. Every record's normalised text is hashed to 64 bits. The scan writes one
   narrow entry per record (row, id, hash, digest, length) to the shared folder.
2. The directory maps hash prefixes to buckets. It starts at one bucket and
   doubles: each doubling looks at one more hash bit and splits the buckets that
   hold more than `capacity` distinct hashes, until none does. A pass takes
   FIRST_BITS or NEXT_BITS doublings from one histogram of the hashes that are
   still in overfull buckets: a cell of it belongs to its shortest ancestor that
   is not overfull, and cells that are overfull themselves go to the next pass.
3. Entries get the bucket that the directory has for them, are range-partitioned
   by (bucket, hash, row), and are written as the index. An entry without a
   bucket is an error.
4. The owner of a key range finds the hashes with two entries and more. Only the
   texts of these are sent on, to (bucket, hash, bytes of the text): equal texts
   are one node of the hash's chain. They are combined before they are sent, so a
   third of all rows being one text is one row per task. Owners sort the nodes of
   their key ranges, number each chain, and write the chains.
5. Entries of the index meet the nodes of their bucket and hash.

Cases: null text is empty text; all empty texts are one group; a null id loses
ties; of rows that repeat an id and its text one is kept, and each has a row of
its own in the result; an empty table gives an empty result; further columns of
the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, discard, fresh_name, join_checked, staged, staged_so_far

#: Doublings of the first pass over the hashes, and of each further one over those in overfull buckets.
FIRST_BITS, NEXT_BITS = 14, 6
#: Distinct hashes that a bucket holds before it is split.
CAPACITY = 100_000


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _prefix(h: Column, bits: int) -> Column:
    """h with all but its first bits off."""
    return h.bitwiseAND(F.lit(-1 << (64 - bits))) if bits else F.lit(0).cast("long")


def directory(hashes: DataFrame, capacity: int = CAPACITY, first_bits: int = FIRST_BITS, next_bits: int = NEXT_BITS) -> list[tuple[int, DataFrame]]:
    """Per pass (bits, cells): cells has the bucket and the local depth of each prefix of so many bits that has one.

    hashes has a column h, one row per distinct hash. A bucket is the key range of
    the hashes whose first `depth` bits are those of `bucket`. A hash that a pass
    has no cell for is in a later one.
    """
    passes, known, bits = [], 0, min(first_bits, 64)
    while True:
        cells = staged(hashes.groupBy(_prefix(F.col("h"), bits).alias("cell")).agg(F.count("*").alias("n")), "cells")
        levels = cells.select("cell", "n", F.explode(F.sequence(F.lit(known), F.lit(bits))).alias("depth"))
        # 64 - depth low bits are turned off; shifting by all 64 would shift by none
        levels = levels.withColumn("bucket", F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(shiftrightunsigned(cell, 64 - depth), 64 - depth)")))
        fit = staged(levels.groupBy("depth", "bucket").agg(F.sum("n").alias("held")).filter((F.col("held") <= capacity) | (F.col("depth") == 64)).drop("held"), "fit")
        best = join_checked(levels, fit, ["depth", "bucket"], "inner", 12).groupBy("cell").agg(F.min(F.struct("depth", "bucket")).alias("best"))
        placed = staged(best.select("cell", "best.bucket", "best.depth"), "directory")
        passes.append((bits, placed))
        if placed.count() == cells.count():
            return passes
        overfull = staged(cells.join(placed, "cell", "left_anti").select("cell"), "overfull")
        hashes = staged(join_checked(hashes.withColumn("cell", _prefix(F.col("h"), bits)), overfull, "cell", "left_semi", 8).select("h"), "hashes")
        known, bits = bits, min(bits + next_bits, 64)


def placed(entries: DataFrame, passes: list[tuple[int, DataFrame]]) -> DataFrame:
    """entries with the bucket and depth that the directory has for their hash h; an entry without one fails the job."""
    out = entries.withColumns({"bucket": F.lit(None).cast("long"), "depth": F.lit(None).cast("int")})
    for bits, cells in passes:
        found = cells.select(F.col("cell"), F.col("bucket").alias("_b"), F.col("depth").alias("_d"))
        out = join_checked(out.withColumn("cell", _prefix(F.col("h"), bits)), found, "cell", "left", 20)
        out = out.withColumns({"bucket": F.coalesce("bucket", "_b"), "depth": F.coalesce("depth", "_d")}).drop("cell", "_b", "_d")
    return out.withColumn("bucket", F.coalesce("bucket", F.raise_error(F.lit("a hash has no bucket in the directory")).cast("long")))


def build_index(df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """The written index: row, id, h, digest, n_chars, bucket, depth, in key order over the files."""
    norm = normalised(F.col(text_col))
    rows = df.select(
        F.col(id_col).alias("id"),
        F.xxhash64(norm).alias("h"),
        F.sha2(norm.cast("binary"), 256).alias("digest"),
        F.char_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    entries = staged(rows, "entries")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = placed(entries, directory(entries.select("h").distinct(), capacity))
    return staged(keyed.repartitionByRange(parts, "bucket", "h", "row").sortWithinPartitions("bucket", "h", "row"), "index")


def build_chains(df: DataFrame, id_col: str, text_col: str, index: DataFrame) -> DataFrame:
    """The written chains of the hashes with two entries and more: bucket, h, place in the chain, digest, keep_id, keep_chars, group_size; a row per text."""
    heads = staged(index.groupBy("bucket", "h").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", "h"), "heads")
    norm = normalised(F.col(text_col))
    texts = df.select(F.col(id_col).alias("id"), norm.alias("norm"), F.xxhash64(norm).alias("h"), F.char_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_chars"))
    sent = join_checked(texts, heads, "h", "inner", 24)
    # ~id falls as id rises and never overflows; max() puts a null last.
    nodes = sent.groupBy("bucket", "h", "norm").agg(F.max(F.struct("n_chars", F.bitwise_not("id").alias("r"))).alias("best"), F.count("*").alias("group_size"))
    nodes = nodes.select("bucket", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("digest"), F.bitwise_not("best.r").alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), "group_size")
    # A chain has a node per different text of one 64-bit hash: nearly always one, whatever the copies.
    return staged(nodes.withColumn("place", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("digest"))), "chains")


def resolve(df: DataFrame, id_col: str, text_col: str, index: DataFrame) -> DataFrame:
    """One row per record of df: id, h, digest, n_chars, keep_id, group_size, kept."""
    chains = build_chains(df, id_col, text_col, index).drop("place")
    # Rows that repeat an id and its text: the first stays. The table is empty where ids are unique.
    repeated = index.groupBy("id", "h", "digest", "n_chars").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = staged(repeated.select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("digest").alias("_digest"), F.col("n_chars").alias("_n"), "first"), "repeated")
    rows = index.join(chains, ["bucket", "h", "digest"], "left")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")) & (F.col("digest") == F.col("_digest")) & (F.col("n_chars") == F.col("_n"))
    rows = join_checked(rows, repeated, same, "left", 120)
    alone = F.col("group_size").isNull()
    best = alone | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")) & (F.coalesce("first", "row") == F.col("row")))
    return rows.select("id", "h", "digest", "n_chars", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), best.alias("kept"))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Verdict of every record, dropped ones too."""
    return resolve(df, id_col, text_col, build_index(df, id_col, text_col, capacity))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns. Ids identify rows here; an id's repeated rows of one text become one."""
    mark = staged_so_far()
    verdicts = staged(exact_dedup(df, id_col, text_col), "verdicts")
    discard(df.sparkSession, mark, verdicts)
    gone = staged(verdicts.groupBy(F.col("id").alias(id_col)).agg(F.max("kept").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1"), "gone")
    lost = gone.filter("not stays").select(id_col)
    same = F.col(f"_g.{id_col}").eqNullSafe(F.col(f"_d.{id_col}"))
    out = join_checked(df.alias("_d"), staged(lost, "lost").alias("_g"), same, "left_anti", 16)
    if gone.filter("stays").isEmpty():
        return out
    # An id with several rows, one of which stays: the row with most code points, ties by the smaller digest.
    row = fresh_name("row", df)
    order = Window.partitionBy(id_col, F.xxhash64(normalised(F.col(text_col)))).orderBy(F.char_length(text_col).desc_nulls_last(), F.sha2(F.col(text_col).cast("binary"), 256))
    return out.withColumn(row, F.row_number().over(order)).filter(F.col(row) == 1).drop(row)


ORACLE = """
WITH n AS (SELECT doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
