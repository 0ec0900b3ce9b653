"""Result orders, caps and set operations of an analysis, and aggregates over alerts, releases and panes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_of, rank
from .changes import risk_rank
from .timeline import SOURCES

# Orders of statuses, edge states, component types and levels.
STATUSES = ["root", "failing", "degraded", "at-risk", "healthy"]
EDGE_STATES = ["failing", "degraded", "ok"]
TYPES = ["service", "datastore", "external", "infra", "node"]
LEVELS = ["breaks", "strain", "ok"]


def place_in(value: Column, order: list[str]) -> Column:
    """0-based place of a value in a fixed order, after all if it is not there."""
    return F.coalesce(first_of([(value == v, F.lit(i)) for i, v in enumerate(order)]), F.lit(len(order)))


def signals_out(signals: DataFrame) -> DataFrame:
    """By time, unknown times last; then source and line."""
    return signals.orderBy(F.col("ts_ms").asc_nulls_last(), place_in(F.col("source"), SOURCES), "source_line", "seq")


def components_out(components: DataFrame) -> DataFrame:
    """Adds place: by status, impact and id within each cluster."""
    w = Window.partitionBy("cluster").orderBy(place_in(F.col("status"), STATUSES), F.desc("impact"), "id")
    return components.withColumn("place", F.row_number().over(w))


def clusters_out(components: DataFrame) -> DataFrame:
    """(cluster, components, failing, degraded, status) with place by status and name; a row per cluster."""
    g = components.groupBy("cluster").agg(F.count("*").alias("components"), F.count_if(F.col("status").isin("root", "failing")).alias("failing"), F.count_if(F.col("status") == "degraded").alias("degraded"))
    g = g.withColumn("status", F.when(F.col("failing") > 0, "failing").when(F.col("degraded") > 0, "degraded").otherwise("healthy"))
    return g.orderBy(place_in(F.col("status"), STATUSES), "cluster")


def nodes_out(components: DataFrame) -> DataFrame:
    """Adds place in its cluster: entries, ingress, status, type, name, id."""
    entry = F.coalesce(F.col("role") == "ingress", F.lit(False)) | F.col("user_facing")
    w = Window.partitionBy("cluster").orderBy((~entry).cast("int"), (F.coalesce("role", F.lit("")) != "ingress").cast("int"), place_in(F.col("status"), STATUSES), place_in(F.col("type"), TYPES), "name", "id")
    return components.withColumn("place", F.row_number().over(w))


def lanes(components: DataFrame) -> DataFrame:
    """(lane, main, infra): components of each cluster, infrastructure apart; those without a cluster are unassigned."""
    infra = F.col("type").isin("infra", "node")
    return components.groupBy(F.coalesce(F.nullif(F.col("cluster"), F.lit("")), F.lit("Unassigned")).alias("lane")).agg(F.count_if(~infra).alias("main"), F.count_if(infra).alias("infra"))


def evidence_out(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Adds place: by weight, then position."""
    return evidence.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("weight"), "pos")))


def changes_out(changes: DataFrame, by: list[str]) -> DataFrame:
    """Adds place: by risk, then line, then id."""
    return changes.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.coalesce(risk_rank(F.col("risk")), F.lit(4)), "line", "id")))


def flags_out(flags: DataFrame) -> DataFrame:
    """(id, flags): names of an id's flags, what breaks first, then as given."""
    one = F.struct(place_in(F.col("level"), LEVELS).alias("l"), F.col("pos"), F.col("flag"))
    return flags.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["flag"]), ",").alias("flags"))


def pack_edges(edges: DataFrame, most: int = 40) -> DataFrame:
    """The edges of an evidence pack: by state, then errors, calls and ends."""
    return edges.orderBy(place_in(F.col("status"), EDGE_STATES), F.desc("errors"), F.desc("calls"), "from", "to").limit(most)


def one_relation(*parts: DataFrame) -> DataFrame:
    """UNION ALL of hints by name, with the part that each row is of; columns that a part lacks are null."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def covering(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key): keys whose members, rows (key, member), are more than one and include all of wanted (member), a short list."""
    need = wanted.select("member").distinct()
    hit = sets.select("key", "member").distinct().join(need.withColumn("hit", F.lit(1)), "member", "left")
    found = hit.groupBy("key").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    return found.crossJoin(F.broadcast(need.agg(F.count("*").alias("all")))).filter("n > 1 and hits = all").select("key")


def warnings_out(warnings: DataFrame, most: int = 20) -> DataFrame:
    """(incident_id, pane, warning, place): distinct warnings, those on a wrong pane first, at most so many a pane; rows have seq and misplaced."""
    once = warnings.groupBy("incident_id", "pane", "warning").agg(F.min("seq").alias("seq"), F.bool_or("misplaced").alias("misplaced"))
    w = Window.partitionBy("incident_id", "pane").orderBy((~F.col("misplaced")).cast("int"), "seq")
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("incident_id", "pane", "warning", "place")


def worst_burn(alerts: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, burn_rate, error_ratio): the unresolved burn alert with the highest rate, the first of equals; a ratio it lacks comes from the next that has one.

    alerts: kind, status, burn_rate, error_ratio, seq, id.
    """
    live = alerts.filter("kind = 'slo_burn' and status <> 'resolved' and (burn_rate is not null or error_ratio is not null)")
    order = F.struct(F.coalesce("burn_rate", F.lit(0.0)).alias("r"), (-F.col("seq")).alias("s"))
    ratio = F.max_by("error_ratio", F.when(F.col("error_ratio").isNotNull(), order))
    return live.groupBy(*by).agg(F.max_by("id", order).alias("id"), F.max_by("burn_rate", order).alias("burn_rate"), F.coalesce(F.max_by("error_ratio", order), ratio).alias("error_ratio"))


def status_counts(alerts: DataFrame, by: list[str]) -> DataFrame:
    """(by, firing, resolved, pending)."""
    return alerts.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("firing", "resolved", "pending")])


def changes_per_release(changes: DataFrame) -> DataFrame:
    return changes.groupBy("release").agg(F.count("*").alias("changes"), F.count_if(F.col("risk") == "high").alias("high"))


def pane_stats(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, lines, parsed, skipped, signals): rows have parsed (whether a reader knew the line) and kind."""
    return lines.groupBy(*by).agg(F.count("*").alias("lines"), F.count_if("parsed").alias("parsed"), F.count_if(~F.col("parsed")).alias("skipped"), F.count("kind").alias("signals"))


def with_known_time(signals: DataFrame) -> DataFrame:
    """Adds known: the time is stated, not put at the time of reading."""
    return signals.withColumn("known", F.col("ts_ms").isNotNull() & ~F.coalesce("ts_unknown", F.lit(False)))


def valid_evidence(evidence: DataFrame, signals: DataFrame, changes: DataFrame) -> DataFrame:
    """Evidence that a signal, a change or a source line backs: the ids are looked up."""
    row = F.pmod(F.xxhash64("signal_id", "change_id", "source", "text", "line"), F.lit(1 << 20))
    rows = evidence
    for ids, name in ((signals, "signal_id"), (changes, "change_id")):
        known = ids.select(F.concat(F.lit("="), "id").alias(f"_of_{name}"), F.lit(True).alias(f"_has_{name}")).distinct()
        # Rows without an id, or with a line, ask for none: their keys are spread and meet nothing.
        asks = F.col(name).isNotNull() & F.col("line").isNull()
        rows = rows.withColumn(f"_of_{name}", F.when(asks, F.concat(F.lit("="), name)).otherwise(F.concat(F.lit("-"), row.cast("string")))).join(known, f"_of_{name}", "left")
    out = rows.filter(F.col("_has_signal_id").isNotNull() | F.col("_has_change_id").isNotNull() | F.col("line").isNotNull())
    return out.select(*evidence.columns)


def primary(evidence: DataFrame, least: float = 0.2) -> DataFrame:
    """Evidence of a change that weighs enough to be reverted."""
    return evidence.filter(F.col("change_id").isNotNull() & (F.col("weight") >= least))


def evidence_rows(signals: DataFrame, changes: DataFrame, facts: DataFrame) -> DataFrame:
    """One relation of typed evidence (signal_id, change_id, source, line, text, weight): from signals, changes and plain facts."""
    none = F.lit(None).cast("string")
    a = signals.select(F.col("id").alias("signal_id"), none.alias("change_id"), "source", F.col("source_line").alias("line"), "text", "weight")
    b = changes.select(none.alias("signal_id"), F.col("id").alias("change_id"), F.lit("helm").alias("source"), "line", F.col("summary").alias("text"), "weight")
    return a.unionByName(b).unionByName(facts.select(none.alias("signal_id"), none.alias("change_id"), "source", "line", "text", "weight"))


def public(rows: DataFrame) -> DataFrame:
    """rows without what is internal: columns that begin with an underscore."""
    return rows.select(*[f"`{c}`" for c in rows.columns if not c.startswith("_")])


def severe_first(signals: DataFrame, by: list[str], most: int) -> DataFrame:
    """The errors of an evidence pack: the most severe, then the earliest; at most so many of each group."""
    w = Window.partitionBy(*by).orderBy(rank(F.col("severity")).desc(), F.coalesce("ts_ms", F.lit(0)), "seq")
    return signals.filter(rank(F.col("severity")) >= 2).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
