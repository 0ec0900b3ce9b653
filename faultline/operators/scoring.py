"""Evidence to ranked hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import half_up

MOST_WEIGHT = 0.95


def distinct_evidence(evidence: DataFrame) -> DataFrame:
    """One row per hypothesis and reference: the highest weight, at the first position."""
    return evidence.groupBy("hypothesis", "component", "ref").agg(F.max("weight").alias("weight"), F.min("pos").alias("pos"))


def noisy_or(evidence: DataFrame, by: list[str]) -> DataFrame:
    """(by, confidence, pieces): 1 - product of (1 - weight), weights within 0 and 0.95; half at most with one piece; three places.

    The product is a sum of logarithms, so it is combined before the shuffle.
    """
    w = F.least(F.greatest("weight", F.lit(0.0)), F.lit(MOST_WEIGHT))
    out = evidence.groupBy(*by).agg(F.exp(F.sum(F.log1p(-w))).alias("none"), F.count("*").alias("pieces"))
    raw = F.least(1 - F.col("none"), F.lit(MOST_WEIGHT))
    return out.select(*by, half_up(F.when(F.col("pieces") < 2, F.least(raw, F.lit(0.5))).otherwise(raw), 3).alias("confidence"), "pieces")


def ranked(hypotheses: DataFrame, per_component: int = 3, most: int = 6) -> DataFrame:
    """At most per_component hypotheses of a component and `most` in all, best first."""
    order = [F.desc("confidence"), F.asc("hypothesis")]
    rows = hypotheses.withColumn("_rn", F.row_number().over(Window.partitionBy("component").orderBy(*order))).filter(F.col("_rn") <= per_component).drop("_rn")
    return rows.orderBy(*order, "component").limit(most)


def vote(votes: DataFrame) -> DataFrame:
    """The key with the highest sum of weights; of equal sums the smaller key."""
    return votes.groupBy("key").agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "key").limit(1)


def merged_across_clusters(hypotheses: DataFrame, extra: float = 0.1) -> DataFrame:
    """(category, name, confidence, clusters): the strongest cluster's score, raised by `extra` for each further one."""
    out = hypotheses.groupBy("category", "name").agg(F.max("confidence").alias("best"), F.count("*").alias("clusters"))
    raised = 1 - (1 - F.col("best")) * F.pow(F.lit(1 - extra), F.col("clusters") - 1)
    return out.select("category", "name", half_up(F.least(raised, F.lit(MOST_WEIGHT)), 3).alias("confidence"), "clusters")


def band(confidence):
    return F.when(confidence >= 0.75, "strong").when(confidence >= 0.5, "likely").when(confidence >= 0.35, "possible").otherwise("weak")
