"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Every record scores each shard by a hash of (key, shard) and goes to the
highest score, -weight / ln(u) with u uniform in (0, 1). A shard's score does
not depend on the others, so a new shard only takes records into itself, a
removed one only gives its own away, and shares follow the weights.

Cases: null keys are one key; repeated rows share a shard and have slots of
their own; an empty table gives an empty result; text may be null or of any
length (only its size and checksum leave the scan).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, prefix_sums, staged

LAW = "key"


def shard_of(keys: list[str], weights: Mapping[int, float]) -> Column:
    """The shard with the highest score; of equal scores, the smaller number."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive, for one shard at least")
    key = F.xxhash64(*keys)
    scores = []
    for shard, weight in sorted(weights.items()):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(int(shard)).cast("long")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-int(shard)).alias("neg")))
    return (-F.array_max(F.array(*scores))["neg"]).cast("int")


def shard_records(df: DataFrame, keys: list[str], weights: Mapping[int, float], order: list[str], grown: Mapping[int, float] | None = None) -> DataFrame:
    """Add shard, slot (gapless from 0 in each shard) and grown_shard (under the weights grown, else null).

    Slots are numbered in two steps: row numbers inside hash buckets of a shard,
    then running sums over bucket sizes, so no task holds a whole shard. A bucket
    hashes all of order, not only the keys: rows of one key spread. Columns of df
    named shard, grown_shard or slot are replaced; others are carried, whatever their names.
    """
    spark = df.sparkSession
    bucket, row, first, held = (fresh_name(x, df) for x in ("bucket", "row", "start", "n"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(
        df.withColumns(
            {
                "shard": shard_of(keys, weights),
                "grown_shard": shard_of(keys, grown) if grown else F.lit(None).cast("int"),
                bucket: F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"),
            }
        ),
        "shards",
    )
    counts = placed.groupBy("shard", bucket).agg(F.count("*").alias(held))
    starts = prefix_sums(counts, [bucket], held, first, ["shard"]).drop(held)
    inside = F.row_number().over(Window.partitionBy("shard", bucket).orderBy(*order))
    # At most shards x buckets rows: a size set by the cluster, not by the input.
    placed = placed.withColumn(row, inside).join(F.broadcast(starts), ["shard", bucket])
    return placed.withColumn("slot", (F.col(first) + F.col(row) - 1).cast("long")).drop(bucket, row, first)


def shard_documents(docs: DataFrame, shards: int = 16, weights: Mapping[int, float] | None = None) -> DataFrame:
    """Digest rows of a document table: size, checksum, law, shard, slot and the shard after one more is added."""
    weights = dict(weights or dict.fromkeys(range(shards), 1.0))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    out = shard_records(rows, ["doc_id"], weights, ["doc_id", "text_crc32", "size"], weights | {max(weights) + 1: 1.0})
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard")
