"""Panes of many incidents to their analyses: one job for all, every relation keyed by incident_id.

The order is that of what depends on what: signals of all panes and their times; who
the components are, half-known ones folded into known ones; kernel kills given to the
workload that was killed; calls from traces and logs; states; when releases and changes
took effect; causes with their evidence and what speaks against them; mitigations; what
is gone of the error budget; warnings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import component_id, component_type, norm, parse_id, rollout_attributes
from ..functions.text import is_anomaly, rank
from ..operators import budget, correlate, entities, graph, hypotheses, orders, rules, spans, timeline
from ..session import cut
from ..sources import alerts, certificates, context, logs, releases, traces

PANES = "incident_id string, source string, text string"
I = "incident_id"  # noqa: E741
SIGNAL = [I, "source", "source_line", "ts_ms", "age_ms", "kind", "severity", "component", "name", "namespace", "cluster", "text", "trace_id", "target"]
#: Where nothing states a cluster.
UNSTATED = "cluster-1"
MOST_SIGNALS = 3000


def keyed(c: str) -> Column:
    return F.concat_ws("\x1f", I, c)


def unkeyed(df: DataFrame, *columns: str) -> DataFrame:
    """Take the incident out of keyed columns."""
    out = df.withColumn(I, F.split(columns[0], "\x1f")[0])
    return out.withColumns({c: F.split(c, "\x1f")[1] for c in columns})


def _empty(like: DataFrame, columns) -> DataFrame:
    """No rows, which the planner knows: what is joined with it is left out of plans."""
    return like.sparkSession.createDataFrame([], columns).limit(0)


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _id(name: str, cluster: Column, namespace: Column, kind: Column | None = None) -> Column:
    return component_id(component_type(F.col(name))["type"] if kind is None else kind, cluster, namespace, F.col(name))


def signals_of(log: DataFrame, span_rows: DataFrame, alert_rows: DataFrame, deploys: DataFrame) -> DataFrame:
    """One relation of signals: log lines, failed spans, alerts, deploys; ages placed by the incident's clock, ids by source and line."""
    bad = span_rows.filter("error")
    failed = bad.select(I, F.lit("traces").alias("source"), "source_line", F.col("start_ms").cast("long").alias("ts_ms"), _null("long").alias("age_ms"), F.lit("span_error").alias("kind"), F.lit("error").alias("severity"), "component",
                        "name", "namespace", F.coalesce("cluster", F.lit(UNSTATED)).alias("cluster"), F.col("op").alias("text"), "trace_id", F.col("peer").alias("target"))
    fired = alert_rows.filter("component is not null").select(I, F.lit("alerts").alias("source"), "source_line", F.col("starts_ms").alias("ts_ms"), _null("long").alias("age_ms"), "kind", "severity", F.col("component_id").alias("component"),
                     F.col("component").alias("name"), "namespace", F.coalesce("cluster", F.lit(UNSTATED)).alias("cluster"), F.coalesce("summary", "name").alias("text"), _null().alias("trace_id"), _null().alias("target"))
    rolled = deploys.select(I, F.lit("helm").alias("source"), F.lit(0).alias("source_line"), F.col("deployed_ms").alias("ts_ms"), _null("long").alias("age_ms"), F.lit("change").alias("kind"), F.lit("info").alias("severity"), "component", "name",
                            _null().alias("namespace"), F.lit(UNSTATED).alias("cluster"), F.concat(F.lit("release "), "release_id", F.lit(" r"), F.col("revision").cast("string")).alias("text"), _null().alias("trace_id"), _null().alias("target"))
    every = log.select(*SIGNAL).unionByName(failed).unionByName(fired).unionByName(rolled)
    clock = timeline.latest_clock(every.filter("ts_ms is not null"), [I])
    placed = every.join(clock, I, "left").withColumn("ts_ms", F.coalesce("ts_ms", F.col("now_ms") - F.col("age_ms"))).drop("now_ms", "age_ms")
    order = F.xxhash64("component", "kind", "ts_ms", "text", "trace_id")  # equal signals of a line are alike: any order does
    return timeline.numbered_ids(placed.withColumn("seq", order), [I])


def _release_homes(deploys: DataFrame, names: DataFrame) -> DataFrame:
    """deploys with name and component: the one workload that bears the release's name or begins with it, else one of that name."""
    found = unkeyed(entities.release_targets(deploys.select(keyed("release_id").alias("release")), names.select(keyed("name").alias("name"))), "release", "name").withColumnRenamed("release", "release_id")
    homes = names.groupBy(I, "name").agg(F.min("component").alias("home"))
    out = deploys.join(found, [I, "release_id"], "left").withColumn("name", F.coalesce("name", norm(F.col("release_id")))).join(homes, [I, "name"], "left")
    return out.withColumn("component", F.coalesce("home", _id("name", _null(), _null()))).drop("home")


def _aliases(signals: DataFrame, places: DataFrame, written: DataFrame) -> DataFrame:
    """(incident_id, component, target): half-known components folded into known ones, in tiers."""
    said = signals.select(I, "component", "name", F.nullif(F.col("cluster"), F.lit(UNSTATED)).alias("cluster"), "namespace")
    traced = places.select(I, "component", "name", "cluster", "namespace")
    one = said.unionByName(traced).unionByName(written).filter("component is not null").groupBy(I, "component", "name").agg(F.max("cluster").alias("cluster"), F.max("namespace").alias("namespace"))
    e = one.select(keyed("component").alias("id"), keyed("name").alias("name"), parse_id(F.col("component"))["type"].alias("type"), "cluster", "namespace")
    moved = unkeyed(entities.reconciled_in_tiers(e), "id", "target")
    return moved.select(I, F.col("id").alias("component"), "target")


def _moved(df: DataFrame, aliases: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        names = aliases.select(I, F.col("component").alias(c), F.col("target").alias("_to"))
        df = df.join(names, [I, c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return df


def _with_patients(signals: DataFrame) -> DataFrame:
    """signals with kernel kills on nodes given to the workload whose process was killed there, and moved_from."""
    typed = signals.withColumns({"type": parse_id(F.col("component"))["type"], "cluster": keyed("cluster")})
    work = signals.filter("component is not null").select(F.col("component").alias("id"), "name", keyed("cluster").alias("cluster"), parse_id(F.col("component"))["type"].alias("type")).distinct()
    return correlate.reattributed(typed, work).withColumn("cluster", F.split("cluster", "\x1f")[1]).drop("type")


def _with_targets(signals: DataFrame) -> DataFrame:
    """signals with target_id: the one component of the target's name in the cluster, else in the incident, else one of that name that nothing else shows."""
    known = signals.filter("component is not null").select(I, "name", "cluster", "component").distinct()
    near = known.groupBy(I, "cluster", "name").agg(F.min("component").alias("near"), F.max("component").alias("_n")).filter("near = _n").select(I, "cluster", F.col("name").alias("target"), "near")
    far = known.groupBy(I, "name").agg(F.min("component").alias("far"), F.max("component").alias("_f")).filter("far = _f").select(I, F.col("name").alias("target"), "far")
    rows = signals.withColumn("target", F.nullif(norm(F.col("target")), F.lit(""))).join(near, [I, "cluster", "target"], "left").join(far, [I, "target"], "left")
    other = F.when(F.col("target").isNotNull(), _id("target", F.col("cluster"), _null()))
    return rows.withColumn("target_id", F.nullif(F.coalesce("near", "far", other), F.col("component"))).drop("near", "far")


def _call_edges(by_name: DataFrame, signals: DataFrame, places: DataFrame, aliases: DataFrame) -> DataFrame:
    """Calls between component ids: traced ones (edge_health by name), and those that log lines name."""
    own = _moved(places.select(I, "name", "component").distinct(), aliases, "component")
    homes = own.unionByName(signals.filter("component is not null").select(I, "name", "component")).groupBy(I, "name").agg(F.min("component").alias("home"))
    out = unkeyed(by_name, "from", "to")
    for end in ("from", "to"):
        prefix = F.regexp_extract(end, "^(db|external):", 1)
        out = out.withColumns({"_kind": prefix, "name": norm(F.regexp_replace(end, "^(db|external):", ""))}).join(homes, [I, "name"], "left")
        kind = F.when(F.col("_kind") == "db", "datastore").when(F.col("_kind") == "external", "external").otherwise(component_type(F.col("name"))["type"])
        out = out.withColumn(end, F.coalesce("home", component_id(kind, _null(), _null(), F.col("name")))).drop("home", "name", "_kind")
    traced = out.filter(F.col("from") != F.col("to")).groupBy(I, "from", "to").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.max("p95_ms").alias("p95_ms"), F.min("first_error_ms").alias("first_error_ms"))
    hints = signals.filter("source = 'logs' and target_id is not null").groupBy(I, "component", "target_id").agg(F.collect_set("kind").alias("kinds"), F.count("*").alias("count"), F.min("ts_ms").alias("first_ms"))  # a closed vocabulary of kinds
    hints = hints.select(keyed("component").alias("from"), keyed("target_id").alias("to"), parse_id(F.col("target_id"))["type"].alias("to_type"), component_type(parse_id(F.col("component"))["name"])["role"].alias("from_role"), "kinds", "count", "first_ms")
    both = unkeyed(correlate.with_log_hints(traced.withColumns({"from": keyed("from"), "to": keyed("to")}), hints), "from", "to").join(traced.select(I, "from", "to", "p95_ms"), [I, "from", "to"], "left")
    rate = F.when(F.col("source") != "logs", F.floor(F.col("errors") / F.col("calls") * 10000 + 0.5) / 10000)
    return both.withColumn("error_rate", rate)


def _with_states(edges: DataFrame, failing: DataFrame) -> DataFrame:
    """edges with status: by error rate; a call that only logs name fails where its target does, and a traced one with errors in logs is strained at least."""
    ill = failing.select(I, F.col("component").alias("to"), F.lit(True).alias("ill")).distinct()
    said = F.when(F.col("ill"), "failing").otherwise("degraded")
    rate = F.col("error_rate")
    status = F.when(F.col("source") == "logs", said).when(rate >= spans.FAILING, "failing").when((rate >= spans.DEGRADED) | (F.col("log_errors") > 0), "degraded").otherwise("ok")
    return edges.join(ill, [I, "to"], "left").withColumn("status", status).drop("ill")


def analyze(panes: DataFrame, slo: float = 0.999, window_days: float = 30.0, only_causes: bool = False) -> dict[str, DataFrame]:
    """The relations of each incident's analysis; with only_causes, the hypotheses alone, without plans of what shows them.

    panes: incident_id, source (logs, traces, alerts, helm), text. Text that no
    reader knows gives no rows; an incident without evidence still has a budget
    and an "unknown" hypothesis.
    """
    panes = cut(panes)  # every reader begins with it
    of = lambda name: panes.filter(F.col("source") == name).select(I, "text")
    given = {r.source for r in panes.filter(F.col("source").isin(timeline.SOURCES)).select("source").distinct().collect()}
    read = lambda name, reader, columns: reader(of(name)) if name in given else _empty(panes, columns)
    kept = lambda name, df: cut(df) if name in given else _empty(df, df.schema)
    span_rows = kept("traces", read("traces", traces.read_spans, traces.SPANS).withColumns({"name": norm(F.col("service")), "component": _id("service", F.col("cluster"), F.col("namespace"))}))
    named = span_rows.withColumns({"trace_id": keyed("trace_id"), "service": keyed("service"), "peer": F.when(F.col("peer").isNotNull(), keyed("peer")), "start_ms": F.col("start_ms").cast("long")})
    calls = kept("traces", spans.edge_health(spans.derived_edges(named)))
    log = kept("logs", read("logs", logs.read_logs, logs.SIGNALS))
    alert_rows = kept("alerts", read("alerts", alerts.read_alerts, alerts.ALERTS).withColumn("component_id", _id("component", F.col("cluster"), F.col("namespace"))))
    histories = kept("helm", read("helm", releases.deploys, releases.DEPLOYS))
    # Who is there: names from all panes but releases, which stand in for the workload that they install.
    places = kept("traces", span_rows.select(I, "name", "component", "cluster", "namespace").distinct())  # spans are gone through once for all that asks who is there
    heard, traced = log.select(I, "name", "component"), places.select(I, "name", "component")
    alerted = alert_rows.filter("component is not null").select(I, F.col("component").alias("name"), F.col("component_id").alias("component"))
    raw_changes = kept("helm", read("helm", releases.changes, releases.CHANGES))
    where = F.nullif(F.col("namespace"), F.lit(""))
    written = kept("helm", raw_changes.filter("resource <> ''").select(I, norm(F.col("resource")).alias("name"), _id("resource", _null(), where).alias("component"), _null().alias("cluster"), where.alias("namespace")))
    names = cut(heard.unionByName(traced).unionByName(alerted).unionByName(written.select(I, "name", "component")).filter("component is not null").distinct())
    deploys = kept("helm", _release_homes(histories, names))
    signals = cut(signals_of(log, span_rows, alert_rows, deploys))
    aliases = cut(_aliases(signals, places, written))
    if aliases.isEmpty():
        aliases = _empty(aliases, aliases.schema)
    deploys = kept("helm", _moved(deploys, aliases, "component"))
    signals = _moved(signals, aliases, "component")
    # Kernel kills belong to the workload whose process was killed.
    if signals.filter((F.col("kind") == "oom_killed") & (parse_id(F.col("component"))["type"] == "node")).isEmpty():
        signals = signals.withColumn("moved_from", _null())
    else:
        signals = cut(_with_patients(cut(signals)))
    signals = cut(_with_targets(signals).withColumns({"cause": _null(), "ts_unknown": F.lit(False)}))

    edges = cut(_call_edges(calls, signals, places, aliases))
    anomalies = signals.filter(is_anomaly(F.col("kind"), F.col("severity")))
    errors = anomalies.filter(rank(F.col("severity")) >= 2)
    onset = cut(timeline.onset(errors.filter("ts_ms is not null"), [I]))
    within = timeline.in_window(anomalies, onset, [I])
    types = within.withColumn("type", parse_id(F.col("component"))["type"])
    gates = cut(unkeyed(correlate.node_counts(types.filter("component is not null").withColumn("component", keyed("component"))), "component"))
    own = gates.filter("hard > 0").select(keyed("component").alias("component"))
    key_edges = edges.withColumns({"from": keyed("from"), "to": keyed("to")})
    failing = cut(unkeyed(graph.failing_set(key_edges, own), "component"))
    edges = cut(_with_states(edges, failing))

    # Log edges have no rate: they count as failing where their target does.
    seen = edges.select(keyed("from").alias("from"), keyed("to").alias("to"), F.when(F.col("source") == "logs", F.when(F.col("status") == "failing", 1.0).otherwise(spans.DEGRADED)).otherwise(F.greatest("error_rate", F.when(F.col("log_errors") > 0, spans.DEGRADED).otherwise(0.0))).alias("error_rate"))
    bad = failing.select(keyed("component").alias("component"))
    soft = gates.filter("soft > 0").select(keyed("component").alias("component"))
    warned = within.filter(rank(F.col("severity")) == 1).select(keyed("component").alias("component")).union(soft)
    everyone = cut(signals.select(I, "component").union(signals.select(I, F.col("target_id"))).union(edges.select(I, "from")).union(edges.select(I, "to")).union(deploys.select(I, "component")).union(names.select(I, "component").join(aliases.select(I, "component"), [I, "component"], "left_anti")).filter("component is not null").distinct())
    states = unkeyed(graph.statuses(everyone.select(keyed("component").alias("component")), seen, bad, warned), "component")
    deepest = unkeyed(graph.deepest_failing(seen, bad), "component").withColumn("deepest", F.lit(True))
    first = errors.withColumn("order", rules.earliest()).filter("ts_ms is not null").groupBy(I, "component").agg(F.min_by("id", "order").alias("first_error_id"), F.min_by("ts_ms", "order").alias("first_error_ms"), F.count("*").alias("errors"))
    entries = spans.entry_points(named).withColumn(I, F.split("service", "\x1f")[0])
    faced = signals.filter("kind = 'slo_burn'").select(I, "component").distinct().withColumn("burns", F.lit(True))
    part = parse_id(F.col("component"))
    everyone = everyone.withColumns({k: part[k] for k in ("type", "cluster", "namespace", "name")}).filter("name is not null")
    components = everyone.join(states, [I, "component"]).join(first, [I, "component"], "left").join(deepest, [I, "component"], "left").join(faced, [I, "component"], "left")
    facing = F.coalesce("burns", F.lit(False)) | (F.coalesce(component_type(F.col("name"))["role"], F.lit("")) == "ingress")
    components = cut(components.withColumns({"user_facing": facing, "deepest": F.coalesce("deepest", F.lit(False)), "errors": F.coalesce("errors", F.lit(0))}).drop("burns"))

    # When releases and changes took effect: by history, else by the hand-off of replica sets.
    handed = kept("helm", timeline.handoffs(scalings(signals).withColumn("component", keyed("component"))))
    told = deploys.select(keyed("component").alias("component"), keyed("release_id").alias("release"), "revision", "previous", "deployed_ms", "rolled_back_ms", F.col("app_version").alias("app_to"), "chart", "assumed", I)
    marks = signals.filter("source = 'helm'").select(F.concat_ws("\x1f", I, F.regexp_extract("text", r"^release (.*) r\d+$", 1)).alias("release"), F.regexp_extract("text", r" r(\d+)$", 1).cast("long").alias("revision"), "seq", "id")
    timed = correlate.deploy_signals(correlate.deploy_times(told, handed), marks)
    resource = kept("helm", names.groupBy(I, "name").agg(F.min("component").alias("component")))
    resource = _moved(resource, aliases, "component")
    rel = deploys.select(I, "component", F.col("release_id").alias("release")).groupBy(I, "component").agg(F.min("release").alias("release"))
    changes = raw_changes.withColumn("name", norm(F.col("resource"))).join(resource, [I, "name"], "left").join(rel, [I, "component"], "left")
    timed = kept("helm", timed)
    changes = correlate.change_times(changes.withColumns({"component": keyed("component"), "release": F.when(F.col("release").isNotNull(), keyed("release"))}), timed.select("release", "component", "deployed_ms"))
    bare = lambda c: F.when(F.col(c).contains("\x1f"), F.split(c, "\x1f")[1])
    changes = kept("helm", changes.withColumns({"component": bare("component"), "release": bare("release"), "line": F.lit(None).cast("long"), "deployed_ms": F.col("changed_ms")}))
    rolled = kept("helm", timed.withColumns({"component": bare("component"), "release": bare("release"), "line": F.lit(None).cast("long")}))

    now = timeline.latest_clock(signals.filter("ts_ms is not null"), [I])
    certs = certificates.certificates(of("logs")).withColumns({"namespace": _null(), "keyed_name": keyed("name")})
    owners = components.filter("type <> 'node'").select(keyed("name").alias("name"), "namespace", F.col("component").alias("id"), "type")
    certs = correlate.certificate_owners(certs.withColumn("name", F.col("keyed_name")), owners).withColumns({"name": bare("name"), "not_after_line": F.lit(0).cast("long")}).drop("keyed_name")
    found = rules.hypotheses(signals, components, changes, rolled, edges, cut(certs), onset, now)
    none = panes.select(I).distinct().join(found["causes"].select(I).distinct(), I, "left_anti")
    zero = F.lit(0).cast("long")
    causes = found["causes"].unionByName(none.select(I, F.lit("unknown").alias("category"), F.lit("").alias("component"), F.lit(rules.UNKNOWN).alias("confidence"), F.lit(rules.UNKNOWN).alias("raw"), zero.alias("pieces"), zero.alias("changes"), F.lit(1).alias("rank")))
    causes = cut(causes)
    if only_causes:
        return {"hypotheses": causes}
    roots = causes.filter("rank = 1 and category <> 'unknown'").select(I, "component", F.lit(True).alias("is_root"))
    shown = components.join(roots, [I, "component"], "left").withColumn("status", F.when(F.col("is_root") & (F.col("status") == "failing"), "root").otherwise(F.col("status"))).drop("is_root")

    requests = logs.request_counts(logs.contexts(of("logs")))
    ratio = entries.groupBy(I).agg((F.sum("errors") / F.sum("roots")).alias("ratio"))
    lasted = signals.groupBy(I).agg(F.max("ts_ms").alias("last_ms")).join(onset, I, "left")
    base = panes.select(I).distinct().join(lasted, I, "left").join(ratio, I, "left").join(requests, I, "left")
    r = budget.error_ratio(_null("double"), _null("double"), F.col("ratio"), F.col("failed"), F.col("requests"))
    minutes = F.greatest(F.lit(0.0), (F.col("last_ms") - F.col("onset_ms")) / 60000.0)
    b = base.select(I, F.col(I).alias("id"), r["source"].alias("ratio_source"), budget.burn(r["ratio"], F.lit(slo)).alias("burn"), F.coalesce(minutes, F.lit(0.0)).alias("minutes"), F.lit(window_days).alias("window_days"), F.lit(0.0).alias("spent"))

    clusters = components.groupBy(I, "cluster").agg(F.count("*").alias("components"), F.count_if(F.col("status") == "failing").alias("failing"), F.count_if(F.col("status") == "degraded").alias("degraded"))
    evidence = orders.evidence_out(found["evidence"].withColumn("pos", F.coalesce("signal_id", "change_id", "clue")), rules.KEY).drop("pos")
    places = components.select(I, "component", "name", "cluster")
    against = hypotheses.counter_evidence(causes.join(places, [I, "component"]), changes, components)
    cited = found["evidence"].filter("signal_id is not null").select(I, F.col("signal_id").alias("id")).distinct().join(signals.select(I, "id", "seq"), [I, "id"])
    wrong = certificates.misplaced(panes).select(I, F.col("source").alias("pane"), F.concat(F.lit("this looks like "), "looks_like").alias("warning"), F.lit(0).alias("seq"), F.lit(True).alias("misplaced"))
    unread = context.unreadable(panes.filter("source <> 'logs'").select(I, "text")).select(I, F.lit("documents").alias("pane"), F.col("error").alias("warning"), F.col("first_line").cast("int").alias("seq"), F.lit(False).alias("misplaced"))
    return {
        "signals": signals.drop("cause", "ts_unknown"),
        "stored": timeline.capped(signals, [I], MOST_SIGNALS, cited).drop("cause", "ts_unknown"),
        "spans": span_rows,
        "alerts": alert_rows,
        "alert_counts": orders.status_counts(alert_rows, [I]),
        "edges": edges,
        "components": shown,
        "clusters": clusters,
        "deploys": rolled.withColumnRenamed("release", "release_id"),
        "changes": orders.changes_out(changes, [I]),
        "timeline": timeline.first_per_kind(signals.withColumn("component", keyed("component"))).withColumn("component", bare("component")),
        "evidence": evidence,
        "hypotheses": causes,
        "against": against,
        "covers": hypotheses.covers(causes, edges, failing),
        "certificates": certs,
        "warnings": orders.warnings_out(wrong.unionByName(unread)),
        "options": hypotheses.options(causes, rolled, changes, clusters),
        "budget": b,
        "alert_rows": budget.alert_rows(b),
        "projections": budget.projections(b),
        "series": budget.series(b),
    }


def scalings(signals: DataFrame) -> DataFrame:
    """(component, set, direction, ts_ms) of the lines that tell of replica sets scaled up or down."""
    rows = signals.filter("kind = 'rollout' and ts_ms is not null").withColumn("r", rollout_attributes(F.col("text")))
    return rows.filter("r.direction is not null").select(I, "component", F.col("r.replica_set").alias("set"), "r.direction", "ts_ms")
