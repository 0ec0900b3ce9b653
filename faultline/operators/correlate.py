"""Relations held against each other: stores across clusters, log hints and traced edges, releases and changes, who calls whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rank

# Kinds that make a node fail, kinds that leave no server span, causes that a failed span stands for, kinds that a client of an exhausted store shows.
NODE_KINDS = ["node_not_ready", "node_pressure", "evicted"]
NO_SERVER_SPAN = ["oom_killed", "crash_loop", "image_pull", "config_error", "conn_refused", "tls_error", "dns_failure"]
SPAN_CAUSES = ["dns_failure", "tls_error", "conn_exhaustion"]
CLIENT_KINDS = ["conn_exhaustion", "db_error", "hpa_maxed"]
UNHEALTHY = ["root", "failing", "degraded"]
_KILLED = r"(?i)Killed process \d+ \(([^)]+)\)"
_INVOKED = r"(?i)\b([a-z0-9][\w.-]*) invoked oom-killer"
_TASK = r"(?i)task=([^,\s]+)"


def _only(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and their value, where there is only one."""
    return df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_most")).filter(F.col(value) == F.col("_most")).drop("_most")


def mechanism(kind: Column, cause: Column) -> Column:
    """The kind that a signal counts as: a failed span whose cause has a rule of its own counts as that."""
    return F.when((kind == "span_error") & cause.isin(SPAN_CAUSES), cause).otherwise(kind)


def node_counts(signals: DataFrame) -> DataFrame:
    """(component, hard, soft): errors that make it fail; on a node other kinds than NODE_KINDS are soft. signals: component, type, kind, severity."""
    bad = signals.filter(rank(F.col("severity")) >= 2)
    hard = (F.col("type") != "node") | F.col("kind").isin(NODE_KINDS)
    return bad.groupBy("component").agg(F.count_if(hard).alias("hard"), F.count_if(~hard).alias("soft"))


def folded_stores(stores: DataFrame, hints: DataFrame) -> DataFrame:
    """(id, target): stores that traces alone name, without a namespace, and the one store of that name that log hints tie their cluster to.

    stores: id, name, cluster, namespace, traced_only; hints: from_cluster, to_id, to_name, to_cluster. A name with another store in its cluster stays.
    """
    reach = _only(hints.filter("from_cluster <> to_cluster").select(F.col("from_cluster").alias("cluster"), F.col("to_name").alias("name"), F.col("to_id").alias("target")), ["cluster", "name"], "target")
    alone = stores.groupBy("name", "cluster").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.bool_and(F.col("traced_only") & F.col("namespace").isNull()).alias("open")).filter("n = 1 and open")
    return alone.join(reach, ["cluster", "name"]).filter("id <> target").select("id", "target")


def killed_process(text: Column) -> Column:
    """The process that a kernel memory record names, in lower case."""
    found = [F.regexp_extract(text, p, 1) for p in (_KILLED, _INVOKED, _TASK)]
    return F.lower(F.coalesce(*[F.when(x != "", x) for x in found]))


def reattributed(signals: DataFrame, components: DataFrame) -> DataFrame:
    """signals (component, cluster, kind, text, type) with component moved from a node to the one workload whose process was killed there, and moved_from."""
    work = _only(components.filter("type <> 'node'").select(F.col("name").alias("process"), "cluster", F.col("id").alias("patient")), ["process", "cluster"], "patient")
    on_node = (F.col("kind") == "oom_killed") & (F.col("type") == "node")
    out = signals.withColumn("process", F.when(on_node, killed_process(F.col("text")))).join(work, ["process", "cluster"], "left").drop("process")
    return out.withColumns({"component": F.coalesce("patient", "component"), "moved_from": F.when(F.col("patient").isNotNull(), F.col("component"))}).drop("patient")


def with_log_hints(edges: DataFrame, hints: DataFrame) -> DataFrame:
    """(from, to, calls, errors, log_errors, first_error_ms, source): traced edges and log hints together.

    hints: from, to, to_type, from_role, kinds, count, first_ms. A failed name lookup only makes an edge to cluster DNS; an
    ingress that logs an external host has none. A hint on a traced edge adds log errors; else it is an edge of its own.
    """
    dns = F.size(F.array_except("kinds", F.array(F.lit("dns_failure")))) == 0
    good = hints.filter((F.col("from") != F.col("to")) & (~dns | F.col("to").contains("coredns")) & ~((F.coalesce("from_role", F.lit("")) == "ingress") & (F.col("to_type") == "external")))
    said = good.groupBy("from", "to").agg(F.sum("count").alias("n"), F.min("first_ms").alias("hint_ms"))
    out = edges.select("from", "to", "calls", "errors", "first_error_ms").withColumn("traced", F.lit(True)).join(said, ["from", "to"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    traced = F.col("traced").isNotNull()
    return out.select(
        "from", "to", F.when(traced, F.col("calls")).otherwise(F.col("n")).alias("calls"), F.when(traced, F.col("errors")).otherwise(F.col("n")).alias("errors"), zero("n").alias("log_errors"),
        F.when(traced, F.col("first_error_ms")).otherwise(F.col("hint_ms")).alias("first_error_ms"), F.when(~traced, "logs").when(F.col("n").isNotNull(), "both").otherwise("traces").alias("source"),
    )


def upstream_counts(lines: DataFrame) -> DataFrame:
    """(from, token, calls, errors, first_error_ms) of access lines: from, token, status, ts_ms."""
    bad = F.col("status") >= 500
    return lines.groupBy("from", "token").agg(F.count("*").alias("calls"), F.count_if(bad).alias("errors"), F.min(F.when(bad, F.col("ts_ms"))).alias("first_error_ms"))


def upstream_targets(upstreams: DataFrame, components: DataFrame) -> DataFrame:
    """upstreams (cluster, token and others) with target: the one service or store of the cluster that a cut of the token, namespace-name, names."""
    tokens = upstreams.select("cluster", "token").distinct()
    parts = F.split("token", "-")
    cuts = tokens.filter(F.size(parts) > 1).withColumn("i", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)))
    cuts = cuts.select("cluster", "token", F.array_join(F.slice(parts, 1, F.col("i")), "-").alias("namespace"), F.array_join(F.slice(parts, F.col("i") + 1, F.size(parts)), "-").alias("name"))
    hits = cuts.join(components.filter("type in ('service', 'datastore')").select("cluster", "namespace", "name", F.col("id").alias("target")), ["cluster", "namespace", "name"])
    return upstreams.join(_only(hits, ["cluster", "token"], "target"), ["cluster", "token"])


def deploy_signals(deploys: DataFrame, signals: DataFrame) -> DataFrame:
    """deploys with signal_id: the first of the deploy signals (release, revision, seq, id) of the same release and revision; of equal seq the smallest id."""
    first = signals.groupBy("release", "revision").agg(F.min_by("id", F.struct("seq", "id")).alias("signal_id"))
    return deploys.join(first, ["release", "revision"], "left")


def deploy_times(deploys: DataFrame, handoffs: DataFrame) -> DataFrame:
    """deploys (component, deployed_ms) with unknown times taken from the component's first ReplicaSet hand-off (component, ts_ms), and time_source."""
    first = handoffs.groupBy("component").agg(F.min("ts_ms").alias("rollout_ms"))
    out = deploys.join(first, "component", "left")
    source = F.when(F.col("deployed_ms").isNotNull(), "history").when(F.col("rollout_ms").isNotNull(), "rollout-event")
    return out.withColumns({"time_source": source, "deployed_ms": F.coalesce("deployed_ms", "rollout_ms")}).drop("rollout_ms")


def change_times(changes: DataFrame, deploys: DataFrame) -> DataFrame:
    """changes with changed_ms: the time of the newest deploy of their release, else of their component."""
    newest = lambda by: deploys.filter(F.col(by).isNotNull()).groupBy(by).agg(F.max(F.struct(F.coalesce("deployed_ms", F.lit(-(1 << 62))).alias("k"), "deployed_ms")).alias("d")).select(by, F.col("d.deployed_ms").alias(f"{by}_ms"), F.lit(True).alias(f"{by}_hit"))
    out = changes.join(newest("release"), "release", "left").join(newest("component"), "component", "left")
    return out.withColumn("changed_ms", F.when(F.col("release_hit"), F.col("release_ms")).otherwise(F.col("component_ms"))).drop("release_ms", "component_ms", "release_hit", "component_hit")


def certificate_owners(certificates: DataFrame, components: DataFrame) -> DataFrame:
    """certificates (name, namespace) with component: the least id that bears the name without -tls, -mtls, -cert or -certificate, in that namespace if it is known."""
    base = certificates.withColumn("base", F.regexp_replace("name", r"(?i)-(m?tls|cert|certificate|tls-cert)$", ""))
    c = components.filter("type <> 'node'").select(F.col("name").alias("base"), F.col("namespace").alias("ns"), "id")
    placed = c.groupBy("base", "ns").agg(F.min("id").alias("there"))
    anywhere = c.groupBy("base").agg(F.min("id").alias("any"))
    out = base.join(placed.withColumnRenamed("ns", "namespace"), ["base", "namespace"], "left").join(anywhere, "base", "left")
    return out.withColumn("component", F.when(F.col("namespace").isNull(), F.col("any")).otherwise(F.col("there"))).drop("base", "there", "any")


def policy_blast(policies: DataFrame, signals: DataFrame) -> DataFrame:
    """(policy, blocked, first_ms): failed connections to or from the namespace of each changed network policy.

    signals: seq, kind, ts_ms, namespace, target_namespace. Two equi-joins, of which a signal counts once.
    """
    bad = signals.filter(F.col("kind").isin("conn_refused", "timeout", "span_error"))
    ends = bad.select("seq", "ts_ms", "namespace").union(bad.select("seq", "ts_ms", F.col("target_namespace"))).distinct()
    counted = ends.filter("namespace is not null").groupBy("namespace").agg(F.count("*").alias("blocked"), F.min("ts_ms").alias("first_ms"))
    return policies.select("policy", "namespace").join(counted, "namespace", "left").select("policy", F.coalesce("blocked", F.lit(0)).cast("long").alias("blocked"), "first_ms")


def image_tag(ref: Column) -> Column:
    """The tag of an image reference, or the word itself."""
    tag = F.regexp_extract(ref, r":([^:@/]+)$", 1)
    return F.when(tag != "", tag).when(ref.rlike(r"^[\w.-]+$"), ref)


def mistyped_tags(changes: DataFrame, deploys: DataFrame) -> DataFrame:
    """(id, tag, app_to): image changes whose new tag differs from the chart's app version by a leading v only."""
    d = deploys.filter("app_to is not null").select("release", "app_to").distinct()
    c = changes.filter("category = 'image'").select("id", "release", image_tag(F.col("after")).alias("tag")).join(d, "release")
    bare = lambda x: F.regexp_replace(x, "(?i)^v", "")
    return c.filter((F.col("tag") != F.col("app_to")) & (bare("tag") == bare("app_to"))).select("id", "tag", "app_to")


def pull_groups(pulls: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, components, pulls, images): image pulls of components that the same tag change explains; others by component.

    pulls: component, cluster; changes: component, release, category, field, before, after, line. A container's image comes before others.
    """
    order = Window.partitionBy("component").orderBy((~F.coalesce("field", F.lit("")).contains("containers[")).cast("int"), "line")
    image = changes.filter("category = 'image'").withColumn("_rn", F.row_number().over(order)).filter("_rn = 1")
    image = image.select("component", F.concat(F.coalesce("release", F.lit("")), F.lit("|")).alias("rel"), F.concat(F.lit("|"), F.coalesce(image_tag(F.col("before")), F.lit("null")), F.lit(">"), F.coalesce(image_tag(F.col("after")), F.lit("null"))).alias("tags"))
    n = pulls.groupBy("component", "cluster").agg(F.count("*").alias("n"))
    keyed = n.join(image, "component", "left").withColumn("key", F.coalesce(F.concat("rel", "cluster", "tags"), "component"))
    return keyed.groupBy("key").agg(F.count("*").alias("components"), F.sum("n").alias("pulls"), F.count("tags").alias("images"))


def rollback_siblings(deploys: DataFrame, components: DataFrame, notes: DataFrame) -> DataFrame:
    """(release, revision, cluster, noted): other clusters where a deploy's component is unhealthy, and whether a note there names the same revision."""
    ill = components.filter(F.col("status").isin(UNHEALTHY)).select("name", "cluster").distinct()
    there = deploys.select("release", "revision", F.col("name"), F.col("cluster").alias("own")).join(ill, "name").filter("cluster <> own").select("release", "revision", "cluster").distinct()
    said = notes.select("cluster", "revision", F.coalesce("release", F.lit("")).alias("rel")).distinct()
    exact, any_ = said.filter("rel <> ''").select("cluster", "revision", F.col("rel").alias("release"), F.lit(1).alias("x")), said.filter("rel = ''").select("cluster", "revision", F.lit(1).alias("y"))
    return there.join(exact, ["cluster", "revision", "release"], "left").join(any_, ["cluster", "revision"], "left").select("release", "revision", "cluster", F.coalesce("x", "y").isNotNull().alias("noted"))


def line_signals(lines: DataFrame, signals: DataFrame) -> DataFrame:
    """lines (source, line) with signal_id: the first signal of that line."""
    first = signals.groupBy("source", F.col("source_line").alias("line")).agg(F.min_by("id", "seq").alias("signal_id"))
    return lines.join(first, ["source", "line"], "left")


def telling_line(signals: DataFrame, by: list[str], pattern: str) -> DataFrame:
    """(by, seq): the first signal whose text matches; else the earliest with a known time; else the earliest; else the first."""
    order = F.struct((~F.coalesce(F.col("text").rlike(pattern), F.lit(False))).alias("miss"), F.when(F.col("text").rlike(pattern), 0).when(F.col("ts_ms").isNull(), 2).otherwise(F.col("ts_unknown").cast("int")).alias("tier"), F.when(F.col("text").rlike(pattern), 0).otherwise(F.coalesce("ts_ms", F.lit(0))).alias("ts"), F.col("seq"))
    return signals.groupBy(*by).agg(F.min_by("seq", order).alias("seq"))


def silent_components(components: DataFrame, signals: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, untraced, silent): failing workloads that no trace has, and traced ones with errors elsewhere, no error span, and no caller that saw any.

    components: id, type, status, traced; signals: component, kind, severity, source; edges: to, errors, status.
    """
    bad = signals.filter((rank(F.col("severity")) >= 2) & ~F.col("kind").isin("change", "alert_resolved")).groupBy(F.col("component").alias("id")).agg(F.count_if(F.col("source") == "traces").alias("span_errors"), F.count_if(F.col("source") != "traces").alias("other_errors"))
    spanless = signals.filter(F.col("kind").isin(NO_SERVER_SPAN)).select(F.col("component").alias("id")).distinct().withColumn("spanless", F.lit(True))
    into = edges.filter("errors > 0 or status = 'failing'").select(F.col("to").alias("id")).distinct().withColumn("seen", F.lit(True))
    work = components.filter("status in ('root', 'failing') and type in ('service', 'infra')")
    out = work.join(bad, "id", "left").join(spanless, "id", "left").join(into, "id", "left")
    silent = F.col("traced") & (F.coalesce("other_errors", F.lit(0)) > 0) & (F.coalesce("span_errors", F.lit(0)) == 0) & F.col("seen").isNull() & F.col("spanless").isNull()
    return out.select("id", (~F.col("traced")).alias("untraced"), silent.alias("silent"))


def dns_components(failed_spans: DataFrame, components: DataFrame) -> DataFrame:
    """(id, cluster): the cluster DNS of each cluster whose spans fail on names, where it is not known yet. failed_spans: cluster, type, cause."""
    named = failed_spans.filter("cause = 'dns_failure' and type <> 'node'").select("cluster").distinct()
    named = named.select(F.concat(F.lit("infra:"), "cluster", F.lit("/kube-system/coredns")).alias("id"), "cluster")
    return named.join(components.select("id"), "id", "left_anti")


def clients_of(targets: DataFrame, components: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, client): who uses a component: itself if it is a service; unhealthy services that call it; where there are none, unhealthy
    services of its cluster that show CLIENT_KINDS; and clients of the same name elsewhere that show them.

    targets: id; components: id, name, type, role, cluster, status, kinds (array); edges: from, to.
    """
    ill = components.filter("type = 'service' and status <> 'healthy'")
    shows = ill.filter(F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in CLIENT_KINDS])))
    t = targets.join(components.select("id", "type", "cluster"), "id").select(F.col("id").alias("target"), "type", "cluster")
    own = t.filter("type = 'service'").select("target", F.col("target").alias("client"))
    others = t.filter("type <> 'service'")
    calls = edges.select(F.col("to").alias("target"), F.col("from").alias("client")).distinct()
    callers = calls.join(others.select("target"), "target", "left_semi").join(ill.select(F.col("id").alias("client")), "client", "left_semi").select("target", "client")
    near = others.join(callers.select("target").distinct(), "target", "left_anti").join(shows.filter("coalesce(role, '') <> 'ingress'").select("cluster", F.col("id").alias("client")), "cluster").select("target", "client")
    found = own.union(callers).union(near).distinct()
    named = found.join(components.select(F.col("id").alias("client"), "name"), "client").select("target", "name").distinct()
    return found.union(named.join(shows.select("name", F.col("id").alias("client")), "name").select("target", "client")).distinct()


def representative(signals: DataFrame, known: DataFrame, kinds: list[str]) -> DataFrame:
    """(component, pod): of its signals in time the first pod that showed the kinds, else the first pod, else the known one. known: component, pod."""
    with_pod = signals.filter("pod is not null")
    order = F.struct((~F.col("kind").isin(kinds)).cast("int"), F.col("ts_ms").isNull(), "ts_ms", "seq")
    best = with_pod.groupBy("component").agg(F.min_by("pod", order).alias("seen"))
    return known.join(best, "component", "full").select("component", F.coalesce("seen", "pod").alias("pod"))


def remapped_counts(counts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(component, errors, warns, infos): counts added up under the names that aliases (alias, id) lead to."""
    named = counts.join(aliases, counts["component"] == aliases["alias"], "left").withColumn("component", F.coalesce("id", "component"))
    return named.groupBy("component").agg(*[F.sum(c).alias(c) for c in ("errors", "warns", "infos")])


def other_source_counts(signals: DataFrame) -> DataFrame:
    """(component, errors, warns, infos) of signals that are not log lines."""
    r = rank(F.col("severity"))
    return signals.filter("source <> 'logs'").groupBy("component").agg(F.count_if(r >= 2).alias("errors"), F.count_if(r == 1).alias("warns"), F.count_if(r == 0).alias("infos"))
