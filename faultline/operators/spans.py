"""Spans to edges: parent links, derived edges, edge health, trace statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .selection import ranked_values

FAILING, DEGRADED = 0.2, 0.02


def linked(spans: DataFrame) -> DataFrame:
    """Each span with parent_service (null for roots and missing parents) and has_child; of repeated span ids one parent counts."""
    parents = spans.groupBy(F.col("trace_id"), F.col("span_id").alias("parent_id")).agg(F.max("service").alias("parent_service"))
    with_child = spans.filter("parent_id is not null").select("trace_id", F.col("parent_id").alias("span_id")).distinct().withColumn("has_child", F.lit(True))
    out = spans.join(parents, ["trace_id", "parent_id"], "left").join(with_child, ["trace_id", "span_id"], "left")
    return out.withColumn("has_child", F.coalesce("has_child", F.lit(False)))


def derived_edges(spans: DataFrame) -> DataFrame:
    """One row per observed call (from, to, dur_ms, error, start_ms).

    A child in another service than its parent is a call, measured on the child.
    A childless client span with a database calls that database; else, with a
    peer, the peer, which is external unless a service has that name.
    """
    spans = linked(spans)
    measured = ["dur_ms", "error", "start_ms"]
    calls = spans.filter("parent_service is not null and parent_service <> service").select(F.col("parent_service").alias("from"), F.col("service").alias("to"), *measured)
    leaf = spans.filter("kind = 'client' and not has_child")
    stores = leaf.filter("db is not null").select(F.col("service").alias("from"), F.concat(F.lit("db:"), F.lower(F.coalesce("peer", "db"))).alias("to"), *measured)
    known = spans.select(F.lower("service").alias("peer_name"), F.col("service").alias("peer_service")).groupBy("peer_name").agg(F.min("peer_service").alias("peer_service"))
    peers = leaf.filter("db is null and peer is not null").withColumn("peer_name", F.lower("peer")).join(known, "peer_name", "left")
    peers = peers.select(F.col("service").alias("from"), F.coalesce("peer_service", F.concat(F.lit("external:"), F.col("peer_name"))).alias("to"), *measured)
    return calls.unionByName(stores).unionByName(peers).filter(F.col("from") != F.col("to"))


def edge_health(calls: DataFrame) -> DataFrame:
    """(from, to): calls, errors, error_rate, p95_ms (nearest rank), first_error_ms, status."""
    calls = cut(calls.select("from", "to", "dur_ms", "error", "start_ms"))
    out = calls.groupBy("from", "to").agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"), F.min(F.when(F.col("error"), F.col("start_ms"))).alias("first_error_ms"))
    p95 = ranked_values(calls, ["from", "to"], "dur_ms", {"p95_ms": F.floor((F.col("n") * 95 + 99) / 100)}, written=True)
    out = out.join(p95.drop("n"), ["from", "to"], "left").select("from", "to", "calls", "errors", "p95_ms", "first_error_ms")
    out = out.withColumn("error_rate", F.floor(F.col("errors") / F.col("calls") * 10000 + 0.5) / 10000)
    return out.withColumn("status", F.when(F.col("error_rate") >= FAILING, "failing").when(F.col("error_rate") >= DEGRADED, "degraded").otherwise("ok"))


def merge_edges(edges: DataFrame, canonical: DataFrame) -> DataFrame:
    """Edges after both ends are renamed by (alias, id): sums, highest p95, earliest error; an edge to itself goes."""
    names = lambda end: canonical.select(F.col("alias").alias(end), F.col("id").alias(f"{end}_id"))
    named = edges.join(names("from"), "from", "left").join(names("to"), "to", "left")
    named = named.select(F.coalesce("from_id", "from").alias("from"), F.coalesce("to_id", "to").alias("to"), "calls", "errors", "p95_ms", "first_error_ms")
    return named.filter(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.max("p95_ms").alias("p95_ms"), F.min("first_error_ms").alias("first_error_ms"))


def orphans(spans: DataFrame) -> DataFrame:
    """Spans that name a parent which no row has."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_id")).distinct()
    return spans.filter("parent_id is not null").join(parents, ["trace_id", "parent_id"], "left_anti")


def trace_stats(spans: DataFrame) -> DataFrame:
    """One row: traces, spans, error_traces, services, entry_error_ratio (roots)."""
    per_trace = spans.groupBy("trace_id").agg(F.count("*").alias("n"), F.bool_or("error").alias("bad"), F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(F.col("parent_id").isNull() & F.col("error")).alias("bad_roots"))
    totals = per_trace.agg(F.count("*").alias("traces"), F.coalesce(F.sum("n"), F.lit(0)).alias("spans"), F.count_if("bad").alias("error_traces"), (F.sum("bad_roots") / F.sum("roots")).alias("ratio"))
    services = spans.agg(F.countDistinct("service").alias("services"))
    return totals.crossJoin(F.broadcast(services)).select("traces", "spans", "error_traces", "services", (F.floor(F.col("ratio") * 10000 + 0.5) / 10000).alias("entry_error_ratio"))


def entry_points(spans: DataFrame) -> DataFrame:
    """(service, roots, errors) of root spans and of server spans whose parent is missing."""
    lone = orphans(spans).filter("kind = 'server'").select("service", "error")
    return spans.filter("parent_id is null").select("service", "error").unionByName(lone).groupBy("service").agg(F.count("*").alias("roots"), F.count_if("error").alias("errors"))


def slow_spans(spans: DataFrame, factor: float = 3.0, least_ms: float = 1000.0) -> DataFrame:
    """Spans of at least least_ms that took more than factor times the median of their service and operation."""
    n = F.col("n")
    middle = ranked_values(spans, ["service", "op"], "dur_ms", {"lower": F.floor((n + 1) / 2), "upper": F.floor(n / 2) + 1})
    medians = middle.select("service", "op", ((F.col("lower") + F.col("upper")) / 2).alias("median_ms"))
    return spans.join(medians, ["service", "op"]).filter((F.col("dur_ms") >= least_ms) & (F.col("dur_ms") > factor * F.col("median_ms")))


def related_spans(signals: DataFrame, most: int = 10) -> DataFrame:
    """(trace_id, span_id, related): the first `most` other failed spans of the same trace.

    Only the first most + 1 of a trace can be related to any of its rows, so no
    trace is gathered whole.
    """
    order = Window.partitionBy("trace_id").orderBy("span_id")
    heads = signals.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most + 1)
    lists = heads.groupBy("trace_id").agg(F.sort_array(F.collect_list("span_id")).alias("ids"))
    return signals.join(lists, "trace_id").select("trace_id", "span_id", F.slice(F.array_remove("ids", F.col("span_id")), 1, most).alias("related"))
