"""Exact ranks of a key's values by distributed selection: counts of buckets locate the rank, then only that bucket is looked into."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Buckets that a key's range is cut into in each round; a task sends at most so many counts of a key.
BUCKETS = 1024


def ranked_values(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], written: bool = False) -> DataFrame:
    """(keys, n, and a column for each of ranks): the value at a rank from 1 among a key's values in ascending order.

    ranks are expressions of n, the number of the key's values. A round counts the
    values between the bounds known so far by bucket; the bucket in which the counts
    reach the rank gives the next bounds, its least and greatest value. It ends when
    all bounds meet, so neither a sort of a key's values nor a list of them is needed.
    Null values don't count; rows with a null key are left out; keys without values
    have no row. Rows are read once a round, so they are written first unless they are already.
    """
    rows = rows.select(*keys, F.col(value).alias("_v")).filter("_v is not null").na.drop(subset=keys)
    rows = rows if written else cut(rows)
    start = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    asks = F.explode(F.array(*[F.struct(F.lit(name).alias("ask"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    state = cut(start.select(*keys, "n", "_lo", "_hi", asks.alias("a")).select(*keys, "n", "_lo", "_hi", "a.ask", "a.rank"))
    ended = state.filter("_lo = _hi")
    state = state.filter("_lo < _hi")
    up = Window.partitionBy(*keys, "ask").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    while not state.isEmpty():
        inside = rows.join(state, keys).filter("_v between _lo and _hi")
        share = (F.col("_v") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo")).cast("double")
        counts = inside.groupBy(*keys, "ask", "n", "rank", F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        counts = counts.withColumn("_upto", F.sum("_n").over(up))  # over at most BUCKETS rows
        hit = counts.filter("_upto >= rank and _upto - _n < rank")
        new = cut(hit.select(*keys, "n", "_lo", "_hi", "ask", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("rank")))
        ended = ended.unionByName(new.filter("_lo = _hi"))
        state = new.filter("_lo < _hi")
    return ended.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("ask") == name, F.col("_lo"))).alias(name) for name in ranks])


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys of two frames in which null equals null."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_k_{k}"]) for k in keys], F.lit(True))


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the further columns of groups, one row a key; null keys meet, rows without a group stay."""
    other = groups.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    if not keys:
        other = F.broadcast(other)  # one row
    return rows.join(other, same_key(rows, other, keys), "left").drop(*[f"_k_{k}" for k in keys])
