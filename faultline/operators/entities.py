"""Entity hints to components: merging, reconciliation of half-known places, release names, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .graph import alias_closure


def merged(hints: DataFrame, by: list[str], most: int = 50) -> DataFrame:
    """One row per component: how many hints, whether any knew the cluster, and the first `most` namespaces in order."""
    return hints.groupBy(*by).agg(
        F.count("*").alias("hints"),
        F.bool_or("cluster_known").alias("cluster_known"),
        F.concat_ws(",", F.slice(F.array_sort(F.collect_set("namespace")), 1, most)).alias("namespaces"),
        F.min("seq").alias("first_seq"),
    )


def reconciled(hints: DataFrame) -> DataFrame:
    """(seq, name, cluster, target): where hints without a namespace belong, if all compatible candidates are in one place.

    A candidate has the name, a known namespace and the same cluster. Places are
    counted per name and cluster before the join, so no pairs of hints arise.
    """
    places = hints.filter("namespace is not null").groupBy("name", "cluster").agg(F.countDistinct("namespace").alias("places"), F.min("namespace").alias("target"))
    return hints.filter("namespace is null").join(places.filter("places = 1"), ["name", "cluster"]).select("seq", "name", "cluster", "target")


def release_targets(guesses: DataFrame, workloads: DataFrame) -> DataFrame:
    """(release, name): the one workload that has a release's name or begins with it and a hyphen.

    Every prefix of a workload's name that ends before a hyphen is a key, so the
    prefix test is an equi-join.
    """
    parts = F.split("name", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "-"))
    keys = workloads.select("name").distinct().select("name", F.explode(prefixes).alias("release"))
    hits = guesses.select("release").distinct().join(keys, "release")
    return hits.groupBy("release").agg(F.count("*").alias("n"), F.min("name").alias("name")).filter("n = 1").select("release", "name")


def cluster_rollup(components: DataFrame) -> DataFrame:
    """(cluster, components, failing, degraded, status)."""
    out = components.groupBy("cluster").agg(F.count("*").alias("components"), F.count_if(F.col("status").isin("root", "failing")).alias("failing"), F.count_if(F.col("status") == "degraded").alias("degraded"))
    return out.withColumn("status", F.when(F.col("failing") > 0, "failing").when(F.col("degraded") > 0, "degraded").otherwise("healthy"))


def shared_stores(calls: DataFrame) -> DataFrame:
    """(store, clusters): datastores that more than one cluster calls."""
    return calls.groupBy("store").agg(F.concat_ws(",", F.array_sort(F.collect_set("cluster"))).alias("clusters"), F.countDistinct("cluster").alias("n")).filter("n > 1").drop("n")


def dependency_hints(signals: DataFrame, most_ids: int = 20) -> DataFrame:
    """(from, to): count, kinds, first and last time, and the first most_ids signal ids."""
    from pyspark.sql import Window

    w = Window.partitionBy("from", "to").orderBy("seq")
    rows = signals.withColumn("_rn", F.row_number().over(w))
    return rows.groupBy("from", "to").agg(
        F.count("*").alias("calls"),
        F.concat_ws(",", F.array_sort(F.collect_set("kind"))).alias("kinds"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(F.col("_rn") <= most_ids, F.col("seq")))), lambda x: x.cast("string"))).alias("ids"),
    )


def unresolved(signals: DataFrame, components: DataFrame) -> DataFrame:
    """Components that signals name and the table lacks."""
    return signals.select("component").distinct().join(components.select("component"), "component", "left_anti")


# Types of which an entity that only resembles a component may turn out to be, in the order of preference.
REAL_TYPES = ["service", "datastore", "infra"]


def _fitting(asks: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """(id, target): for each of asks the candidate of the same keys, if all of these are in one place; its own type comes first, then by REAL_TYPES and id.

    Candidates are summed up per key before the join, so no pairs of hints arise.
    """
    place = F.concat_ws("/", F.coalesce("cluster", F.lit("?")), F.coalesce("namespace", F.lit("?")))
    first = [F.min(F.when(F.col("type") == t, F.col("id"))).alias(f"_{t}") for t in REAL_TYPES]
    groups = known.withColumn("_place", place).groupBy(*keys).agg(F.min("_place").alias("_least"), F.max("_place").alias("_most"), *first).filter("_least = _most")
    own = F.coalesce(*[F.when(F.col("type") == t, F.col(f"_{t}")) for t in REAL_TYPES], *[F.col(f"_{t}") for t in REAL_TYPES])
    return asks.join(groups, keys).select("id", own.alias("target")).filter("target is not null")


def reconciled_in_tiers(entities: DataFrame) -> DataFrame:
    """(id, target): where half-known entities belong, the best known first, so that vaguer ones see only what is left.

    entities: id, name, type, cluster, namespace, of which the last two are null where nothing states them. An entity
    moves onto one that agrees with all that it states and adds something, if all such are in one cluster and namespace;
    an external peer moves onto a real component of its name that agrees. Nodes and what is known in full stay.
    Chains are followed to their end. The order of rows doesn't matter.
    """
    e = entities.select("id", "name", "type", "cluster", "namespace").dropDuplicates(["id"])
    real, peers = e.filter(F.col("type").isin(REAL_TYPES)), e.filter("type = 'external'")
    kind = lambda df, cluster, namespace: df.filter(f"cluster is {'not ' * cluster}null and namespace is {'not ' * namespace}null")
    whole, spaced, placed, bare = (kind(real, *k) for k in ((1, 1), (0, 1), (1, 0), (0, 0)))
    moved = _fitting(spaced, whole, ["name", "namespace"]).unionByName(_fitting(placed, whole, ["name", "cluster"])).unionByName(_fitting(kind(peers, 1, 1), whole, ["name", "cluster", "namespace"]))
    moved = cut(moved)
    left = whole.unionByName(spaced.unionByName(placed).join(moved, "id", "left_anti").select(*whole.columns))
    found = [moved]
    step = _fitting(bare, left, ["name"])
    step = step.unionByName(_fitting(kind(peers, 0, 1), left.filter("namespace is not null"), ["name", "namespace"])).unionByName(_fitting(kind(peers, 1, 0), left.filter("cluster is not null"), ["name", "cluster"]))
    found.append(cut(step))
    left = left.unionByName(bare.join(found[1], "id", "left_anti").select(*whole.columns))
    found.append(_fitting(kind(peers, 0, 0), left, ["name"]))
    every = found[0].unionByName(found[1]).unionByName(found[2]).filter("id <> target")
    return alias_closure(every.select(F.col("id").alias("alias"), F.col("target").alias("id"))).select(F.col("alias").alias("id"), F.col("id").alias("target"))
