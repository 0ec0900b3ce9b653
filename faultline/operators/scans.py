"""Ordered scans in two levels: a large group is cut into successive chunks, scanned apart, and what one chunk hands to the next is a row a chunk.

Groups of up to CHUNK rows are one chunk. The bounds of a larger group's chunks are
percentiles of the leading column, from mergeable sketches over the large groups'
rows only; they decide who works on what, never the result. Rows with equal leading
values share a chunk, nulls come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import with_groups

#: Rows of a group from which on it is cut, and chunks that it is cut into.
CHUNK, CHUNKS = 100_000, 256


def chunked(rows: DataFrame, by: list[str], at: str, name: str = "_chunk") -> DataFrame:
    """Adds the number of the chunk that each row lies in by the numeric column `at`."""
    large = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > CHUNK)
    held = with_groups(rows.select(*by, at), large, by).filter("_n is not null")
    shares = F.array(*[F.lit(k / CHUNKS) for k in range(1, CHUNKS)])
    bounds = held.groupBy(*by).agg(F.percentile_approx(at, shares, F.lit(10_000)).alias("_bounds"))
    before = F.size(F.filter("_bounds", lambda b: b < F.col(at)))
    where = F.when(F.col("_bounds").isNull(), 0).when(F.col(at).isNull(), -1).otherwise(before)
    return with_groups(rows, bounds, by).withColumn(name, where.cast("int")).drop("_bounds")


def handed_on(chunks: DataFrame, by: list[str]) -> tuple:
    """Windows over a group's chunk rows: those before, and from here to the last."""
    w = Window.partitionBy(*by).orderBy("_chunk")
    return w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)


def running_sums(rows: DataFrame, by: list[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums of the given expressions, this row included, in each group's order; order begins with a numeric column."""
    rows = chunked(rows, by, order[0])
    inner = Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*by, "_chunk").agg(*[F.sum(x).alias(f"_t_{k}") for k, x in sums.items()])
    before, _ = handed_on(totals, by)
    starts = totals.select(*by, "_chunk", *[F.sum(f"_t_{k}").over(before).alias(f"_s_{k}") for k in sums])
    here = with_groups(rows.withColumns({k: F.sum(x).over(inner) for k, x in sums.items()}), starts, [*by, "_chunk"])
    return here.withColumns({k: F.col(k) + F.coalesce(f"_s_{k}", F.lit(0)) for k in sums}).drop("_chunk", *[f"_s_{k}" for k in sums])


def row_numbers(rows: DataFrame, by: list[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds the place of each row in its group's order, from 1."""
    return running_sums(rows, by, order, {name: F.lit(1).cast("long")})


def last_known(rows: DataFrame, by: list[str], order: Sequence[str], columns: list[str], reset: str | None = None) -> DataFrame:
    """Adds carried_<column>: the last non-null value so far in each group, forgotten at rows where reset holds.

    A chunk hands on its last values since its last reset, or what was handed to it where it has none.
    """
    rows = chunked(rows, by, order[0])
    inner = [*by, "_chunk"]
    upto = lambda keys, what: Window.partitionBy(*keys).orderBy(*what).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_part", F.sum(F.coalesce(F.expr(reset).cast("int"), F.lit(0))).over(upto(inner, order)) if reset else F.lit(0).cast("long"))
    rows = rows.withColumns({f"_c_{c}": F.last(c, ignorenulls=True).over(upto([*inner, "_part"], order)) for c in columns})
    place = F.struct(*order)
    ends = rows.groupBy(*inner).agg(F.max("_part").alias("_resets"), *[F.max_by(F.struct(f"_c_{c}"), place).alias(f"_e_{c}") for c in columns])
    ends = ends.withColumn("_era", F.sum((F.col("_resets") > 0).cast("int")).over(upto(by, ["_chunk"])))
    after = ends.withColumns({f"_a_{c}": F.last(F.col(f"_e_{c}")[f"_c_{c}"], ignorenulls=True).over(upto([*by, "_era"], ["_chunk"])) for c in columns})
    came = after.select(*inner, *[F.lag(f"_a_{c}").over(Window.partitionBy(*by).orderBy("_chunk")).alias(f"_i_{c}") for c in columns])
    out = with_groups(rows, came, inner)
    known = lambda c: F.coalesce(F.col(f"_c_{c}"), F.when(F.col("_part") == 0, F.col(f"_i_{c}")))
    return out.withColumns({f"carried_{c}": known(c) for c in columns}).drop("_chunk", "_part", *[f"{p}{c}" for c in columns for p in ("_c_", "_i_")])


def neighbours(rows: DataFrame, by: list[str], order: Sequence[str], value: str, following: str, left: str) -> DataFrame:
    """Adds the next row's value, null for the last, and how many rows are left, this one included."""
    rows = chunked(rows, by, order[0])
    w = Window.partitionBy(*by, "_chunk").orderBy(*order)
    chunks = rows.groupBy(*by, "_chunk").agg(F.count("*").alias("_n"), F.min_by(F.col(value), F.struct(*order)).alias("_first"))
    _, later = handed_on(chunks, by)
    chunks = chunks.select(*by, "_chunk", F.sum("_n").over(later).alias("_later"), F.lead("_first").over(Window.partitionBy(*by).orderBy("_chunk")).alias("_next"))
    here = rows.withColumns({following: F.lead(value).over(w), left: F.count("*").over(w.rowsBetween(0, Window.unboundedFollowing))})
    out = with_groups(here, chunks, [*by, "_chunk"])
    return out.withColumns({following: F.coalesce(following, "_next"), left: F.col(left) + F.coalesce("_later", F.lit(0))}).drop("_chunk", "_later", "_next")


def first_rows(rows: DataFrame, by: list[str], order: Sequence[Column], most: int, spread: Column, place: str, salts: int = 64) -> DataFrame:
    """The first `most` rows of each group with their place, in two steps: of each of its parts by the hash `spread` first, so that no task sorts a whole group."""
    parts = rows.withColumn("_part", F.pmod(spread, F.lit(salts)).cast("int"))
    inner = parts.withColumn(place, F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))).filter(F.col(place) <= most)
    return inner.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(place) <= most).drop("_part")
