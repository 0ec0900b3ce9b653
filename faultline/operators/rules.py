"""The rules of an analysis as relations: what each component showed and what changed on it become one wide row, and rules are columns of clues over it.

Every clue is a row (incident_id, category, component, clue, signal_id, change_id, line,
weight). One signal or change is one piece of evidence, the heaviest clue that cites it
counts; weights add up as independent chances. What a component showed is summed up by
kind before any rule looks at it, so a rule reads a map of kinds, never a list of signals.
All groups are of one incident.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_anomaly, rank
from ..functions.times import half_up
from ..session import cut
from .correlate import image_tag, mechanism
from .hypotheses import GROWING, HOURS_2, UNKNOWN, UNKNOWN_BELOW
from .scoring import MOST_WEIGHT

I = "incident_id"  # noqa: E741
#: Categories from the most specific, which wins at equal scores.
CATEGORIES = ["tls-cert", "dns", "image-pull", "config-error", "resource-limits", "connection-exhaustion", "network-policy", "probe-misconfig", "node-pressure", "scheduling-capacity", "rate-limiting", "bad-deploy", "dependency-failure", "unknown"]
PER_COMPONENT, PER_INCIDENT = 3, 6
MINUTE = 60_000
CORE_DNS = "kube-system/coredns"

# Patterns of texts and of changed fields that rules look for.
CPU, TO_ZERO, EXPIRED = r"(?i)cpu", r"(?i)scaled down replica set \S+ to 0\b", r"(?i)expired"
POOL, FULL, PULLED = r"(?i)pool|Hikari|not available|too many", r"(?i)too many clients|remaining connection slots|max_connections", r"(?i)rpc error|failed to pull|failed to resolve|manifest|unauthori|denied|forbidden|timeout|no such host"
HUNGRY = r"(?i)cache|warm|buffer|heap|memory|prefetch|batch|preload|pool"
DEMAND = r"(?i)pool|max_?conn|maxconn|connections"


def _clue(category: str, clue: str, weight, signal: Column | None = None, change: Column | None = None, line: Column | None = None) -> Column:
    cell = lambda c, kind, name: F.expr(f"cast(null as {kind}) as {name}") if c is None else c.cast(kind).alias(name)
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.struct(F.expr(f"'{category}' as category"), F.expr(f"'{clue}' as clue"), cell(signal, "string", "signal_id"), cell(change, "string", "change_id"), cell(line, "long", "line"), cell(w, "double", "weight"))


CLUES = [I, "category", "component", "clue", "signal_id", "change_id", "line", "weight"]


def _rows(df: DataFrame, clues: list[tuple[Column, Column]], component: str = "component") -> DataFrame:
    """The clues whose condition holds, of each row."""
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), x) for c, x in clues]), lambda x: x.isNotNull())
    return df.select(I, F.col(component).alias("component"), F.explode(found).alias("x")).select(I, "x.category", "component", "x.clue", "x.signal_id", "x.change_id", "x.line", "x.weight")


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def earliest() -> Column:
    """Signals with a known time come first, then by time, then as read."""
    return F.struct((F.col("ts_ms").isNull() | F.coalesce("ts_unknown", F.lit(False))).alias("u"), "ts_ms", "seq")


def prepared(signals: DataFrame) -> DataFrame:
    """signals with counts_as, the names under which rules know them: the kind itself and what its text adds."""
    k, text = F.col("mech"), F.coalesce("text", F.lit(""))
    extra = [F.when((k == "throttled") & text.rlike(CPU), "throttled_cpu"), F.when((k == "http_429") | ((k == "throttled") & ~text.rlike(CPU)), "rate_limited"), F.when((k == "oom_killed") & F.col("moved_from").isNotNull(), "oom_kernel"), F.when((k == "rollout") & text.rlike(TO_ZERO), "to_zero")]
    extra += [F.when((k == "tls_error") & text.rlike(EXPIRED), "tls_expired"), F.when((k == "conn_exhaustion") & text.rlike(POOL), "conn_pool"), F.when((k == "conn_exhaustion") & text.rlike(FULL), "conn_full"), F.when((k == "image_pull") & text.rlike(PULLED), "pull_reason")]
    extra += [F.when((rank(F.col("severity")) >= 2) & is_anomaly(F.col("kind"), F.col("severity")), "any_error")]
    return signals.withColumn("mech", mechanism(F.col("kind"), F.col("cause"))).withColumns({"counts_as": F.array_compact(F.array(k, *extra)), "alert": F.col("source") == "alerts", "order": earliest()})


def shown(signals: DataFrame, by: list[str]) -> DataFrame:
    """(by, kinds): a map of names to n, first, last, logs, first_log, alerts, first_alert. A closed vocabulary bounds the map."""
    rows = signals.select(*by, F.explode("counts_as").alias("name"), "id", "order", "alert")
    log, alert = F.when(~F.col("alert"), F.col("order")), F.when(F.col("alert"), F.col("order"))
    one = rows.groupBy(*by, "name").agg(
        F.count("*").alias("n"), F.min_by("id", "order").alias("first"), F.max_by("id", "order").alias("last"), F.min("order").alias("at"), F.count_if(~F.col("alert")).alias("logs"), F.min_by("id", log).alias("first_log"), F.count_if("alert").alias("alerts"), F.min_by("id", alert).alias("first_alert"), F.max_by("id", alert).alias("last_alert")
    )
    return one.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("n", "first", "last", "at", "logs", "first_log", "alerts", "first_alert", "last_alert")))).alias("kinds"))


def changed(changes: DataFrame) -> DataFrame:
    """(incident_id, component, changed): a map of names of changes that rules know to id, ms and risk of the first by risk, line and id."""
    c, f = F.col("category"), F.coalesce("field", F.lit(""))
    number = lambda x: F.col(x).try_cast("double")
    down, more = F.coalesce(F.col("direction") == "down", F.lit(False)), F.coalesce(number("after") > number("before"), F.lit(False))
    settings = c.isin("env", "configmap")
    names = [
        F.when((c == "resources") & f.rlike(r"limits\.memory$") & down, "memory_cut"), F.when((c == "resources") & f.rlike(r"requests\.memory$") & down, "request_cut"), F.when((c == "resources") & f.rlike(r"limits\.cpu$") & down, "cpu_cut"),
        F.when(settings & F.col("before").isNull() & f.rlike(HUNGRY), "hungry"), F.when(c.isin("configmap", "env", "secret"), "settings"), F.when(c == "probe", "probe"), F.when(c.isin("hpa", "replicas"), "replicas"),
        F.when((c == "image") & f.contains("containers["), "image_of_container"), F.when(c == "image", "image"), F.when((c == "configmap") & (F.col("risk") != "low"), "dns_config"), F.when(F.col("risk") != "low", "not_low"),
        F.when(((c == "hpa") & f.rlike("(?i)maxreplicas|minreplicas") & more) | ((c == "replicas") & more) | (settings & f.rlike(DEMAND) & (F.col("before").isNull() | more)), "demand"),
    ]
    rows = changes.filter("component is not null").withColumn("name", F.explode(F.array_compact(F.array(*names))))
    # What changed a setting: high risk first; others as they stand in the diff.
    by_risk = F.col("name").isin("settings", "probe") & (F.col("risk") != "high")
    first = F.struct(by_risk.cast("int"), F.col("line"), F.col("id"))
    one = rows.groupBy(I, "component", "name").agg(F.min_by(F.struct("id", F.col("changed_ms").alias("ms"), "risk", "release", "before", "after", F.lit(True).alias("there")), first).alias("c"), F.count("*").alias("n"))
    return one.groupBy(I, "component").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("c.*", "n")))).alias("changed"))


class Wide:
    """The wide rows: components with kinds and changed, and short names for what is in them."""

    def __init__(self, components: DataFrame, signals: DataFrame, changes: DataFrame):
        kinds = shown(signals.filter("component is not null"), [I, "component"])
        self.rows = components.join(kinds, [I, "component"], "left").join(changed(changes), [I, "component"], "left")

    @staticmethod
    def k(name: str, field: str = "n") -> Column:
        x = f"try_element_at(kinds, '{name}').{field}"  # as text: rules name hundreds of these
        return F.expr(f"coalesce({x}, 0)" if field in ("n", "logs", "alerts") else x)

    @staticmethod
    def c(name: str, field: str = "id") -> Column:
        return F.expr(f"try_element_at(changed, '{name}').{field}")


def local_rules(wide: DataFrame) -> DataFrame:
    """Clues of rules that look at one component: memory and CPU limits, configuration, probes, capacity, rate limits."""
    k, c = Wide.k, Wide.c
    has = lambda name: c(name).isNotNull()
    memory, cpu = k("oom_killed") > 0, (k("throttled_cpu") > 0) & has("cpu_cut")
    cited = k("oom_killed", "first_log")
    kernel = F.when(k("oom_kernel", "first") != cited, k("oom_kernel", "first")).when(k("oom_kernel") > 1, k("oom_kernel", "last"))
    limits = ~F.col("type").isin("node", "external") & (memory | cpu)
    sched, pvc = k("scheduling_failed"), k("pvc_pending") > 0
    _, _, least, each, most = GROWING[1]
    capacity = (F.col("type") != "node") & ((sched > 0) | pvc)
    return _rows(wide, [
        (limits & (k("oom_killed", "logs") > 0), _clue("resource-limits", "killed", 0.5, cited)),
        (limits & has("memory_cut"), _clue("resource-limits", "limit-lowered", 0.45, change=c("memory_cut"))),
        (limits & has("memory_cut") & has("request_cut"), _clue("resource-limits", "request-lowered", 0.05, change=c("request_cut"))),
        (limits & memory & (k("crash_loop") > 0), _clue("resource-limits", "crash-loop", 0.15, k("crash_loop", "first"))),
        (limits & (k("oom_killed", "alerts") > 0), _clue("resource-limits", "alert", F.when(k("oom_killed", "logs") > 0, 0.15).otherwise(0.4), k("oom_killed", "first_alert"))),
        (limits & kernel.isNotNull() & (k("oom_killed", "logs") > k("oom_kernel")), _clue("resource-limits", "kernel", 0.1, kernel)),
        (limits & memory & has("hungry"), _clue("resource-limits", "needs-more", 0.1, change=c("hungry"))),
        (limits & cpu, _clue("resource-limits", "throttled", 0.3, k("throttled_cpu", "first"))),
        (limits & cpu, _clue("resource-limits", "cpu-lowered", 0.35, change=c("cpu_cut"))),
        (k("config_error") > 0, _clue("config-error", "fails", 0.5, k("config_error", "first"))),
        ((k("config_error") > 0) & has("settings"), _clue("config-error", "changed", 0.35, change=c("settings"))),
        (k("probe_failed") > 0, _clue("probe-misconfig", "fails", 0.25, k("probe_failed", "first"))),
        ((k("probe_failed") > 0) & has("probe"), _clue("probe-misconfig", "changed", F.when(c("probe", "risk") == "high", 0.45).otherwise(0.25), change=c("probe"))),
        (capacity & (sched > 0), _clue("scheduling-capacity", "pending", F.least(F.lit(most), F.lit(least) + F.lit(each) * (sched - 1)), k("scheduling_failed", "first"))),
        (capacity & pvc, _clue("scheduling-capacity", "volumes", 0.4, k("pvc_pending", "first"))),
        (capacity & (k("hpa_maxed") > 0), _clue("scheduling-capacity", "at-maximum", 0.2, k("hpa_maxed", "first"))),
        (capacity & has("replicas"), _clue("scheduling-capacity", "replicas", 0.2, change=c("replicas"))),
        (k("rate_limited") > 0, _clue("rate-limiting", "limited", 0.45, k("rate_limited", "first"))),
        (k("rate_limited", "alerts") > 0, _clue("rate-limiting", "alert", 0.2, k("rate_limited", "first_alert"))),
    ])


def local_anchors(wide: DataFrame) -> DataFrame:
    """(incident_id, category, component, anchor_ms, anchored_by) of local rules: when the change that explains it was rolled out."""
    k, c = Wide.k, Wide.c
    cpu = F.when(k("throttled_cpu") > 0, c("cpu_cut", "ms"))
    of = lambda category, ms: F.struct(F.lit(category).alias("category"), ms.alias("anchor_ms"))
    rows = F.array(of("resource-limits", F.coalesce(c("memory_cut", "ms"), F.when(k("oom_killed") > 0, c("hungry", "ms")), cpu)), of("config-error", c("settings", "ms")), of("probe-misconfig", c("probe", "ms")), of("scheduling-capacity", c("replicas", "ms")))
    return wide.select(I, "component", F.explode(rows).alias("x")).select(I, "x.category", "component", "x.anchor_ms", F.lit("change").alias("anchored_by")).filter("anchor_ms is not null")


def image_rules(wide: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clues, anchors and covers of image pulls: components that one tag change of a release broke in a cluster are one cause, led by what users face or what fails most."""
    k, c = Wide.k, Wide.c
    image = F.coalesce(F.try_element_at(F.col("changed"), F.lit("image_of_container")), F.try_element_at(F.col("changed"), F.lit("image")))
    key = F.concat_ws("|", F.coalesce(image["release"], F.lit("")), "cluster", F.concat(F.coalesce(image_tag(image["before"]), F.lit("null")), F.lit(">"), F.coalesce(image_tag(image["after"]), F.lit("null"))))
    p = wide.filter(k("image_pull") > 0).select(I, "component", F.when(image["id"].isNotNull(), key).otherwise(F.col("component")).alias("key"), image["id"].alias("image_id"), image["ms"].alias("ms"), "user_facing", k("image_pull").alias("n"), k("image_pull", "first").alias("first"), k("image_pull", "at").alias("at"), k("pull_reason", "first").alias("reason"), k("pull_reason", "at").alias("reason_at"), k("to_zero", "first").alias("zero"))
    lead = F.struct((~F.coalesce("user_facing", F.lit(False))).cast("int"), -F.col("n"), F.col("component"))
    g = p.groupBy(I, "key").agg(F.min_by("component", lead).alias("lead"), F.min_by("reason", "reason_at").alias("reason"), F.min_by("first", "at").alias("first"), F.min_by(F.struct("image_id", "ms"), F.when(F.col("image_id").isNotNull(), lead)).alias("image"))
    own = g.withColumnRenamed("lead", "component")
    clues = _rows(own, [(F.lit(True), _clue("image-pull", "cannot-pull", 0.55, F.coalesce("reason", "first"))), (F.col("image.image_id").isNotNull(), _clue("image-pull", "image-changed", 0.35, change=F.col("image.image_id")))])
    each = p.select(I, "key", F.col("component").alias("member"), F.col("first").alias("own"), "zero").join(g.select(I, "key", F.col("lead").alias("component")), [I, "key"])
    clues = _union(clues, _rows(each, [(F.col("member") != F.col("component"), _clue("image-pull", "same-way", 0.1, F.col("own"))), (F.col("zero").isNotNull(), _clue("image-pull", "stopped-first", 0.05, F.col("zero")))]))
    anchors = own.select(I, F.lit("image-pull").alias("category"), "component", F.col("image.ms").alias("anchor_ms"), F.lit("change").alias("anchored_by")).filter("anchor_ms is not null")
    return clues, anchors, each.select(I, F.lit("image-pull").alias("category"), "component", F.col("member").alias("covered"))


def dns_rules(wide: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clues, anchors and covers of failed name lookups in a cluster: cluster DNS is the cause where it is known and ill or two clients see it, else the client that fails most."""
    k, c = Wide.k, Wide.c
    place = [I, "cluster"]
    core_id = F.concat(F.lit("infra:"), "cluster", F.lit(f"/{CORE_DNS}"))
    rows = wide.withColumn("is_core", F.col("component") == core_id)
    fails = rows.filter(k("dns_failure") > 0).select(*place, "component", "is_core", k("dns_failure").alias("n"), k("dns_failure", "first").alias("first"), k("dns_failure", "at").alias("at"), k("dns_failure", "alerts").alias("alerts"), k("dns_failure", "first_alert").alias("alert"))
    client, one = ~F.col("is_core"), F.struct("at", "component", "first")
    per = fails.groupBy(*place).agg(F.count_if(client).alias("affected"), F.min(F.when(client, one)).alias("f"), F.min(one).alias("any"), F.min_by("component", F.when(client, F.struct(-F.col("n"), F.col("component")))).alias("most"), F.min_by("alert", F.when(F.col("alerts") > 0, F.col("at"))).alias("alert"))
    second = fails.filter(client).join(per.select(*place, F.col("f.component").alias("f_component")), place).filter("component <> f_component").groupBy(*place).agg(F.min(one).alias("s"))
    core = rows.filter("is_core").select(*place, F.col("component").alias("core"), (F.col("status") != "healthy").alias("ill"), k("any_error").alias("errors"), k("any_error", "first").alias("core_first"), k("oom_killed").alias("ooms"), k("oom_killed", "first").alias("oom"), k("oom_killed", "last").alias("oom_last"), c("dns_config").alias("config"), c("dns_config", "ms").alias("config_ms"), c("not_low").alias("other"), c("not_low", "ms").alias("other_ms"))
    g = per.join(second, place, "left").join(core, place, "left")
    by_core = F.col("core").isNotNull() & ((F.col("affected") >= 2) | (F.col("errors") > 0) | F.col("ill"))
    g = g.withColumn("component", F.when(by_core, F.col("core")).otherwise(F.col("most"))).filter("component is not null").withColumn("by_core", F.coalesce(by_core, F.lit(False)))
    _, _, least, each, most = GROWING[0]
    first = F.coalesce("f", "any")["first"]
    oom = F.when(F.col("oom") != F.col("core_first"), F.col("oom")).when(F.col("ooms") > 1, F.col("oom_last"))
    clues = _rows(g, [
        (F.lit(True), _clue("dns", "lookups-fail", F.least(F.lit(most), F.lit(least) + F.lit(each) * F.greatest(F.lit(0), F.col("affected") - 1)), first)),
        (F.col("by_core") & (F.col("affected") >= 2), _clue("dns", "from-another", 0.15, F.col("s.first"))),
        (F.col("by_core") & (F.col("errors") > 0), _clue("dns", "itself-fails", 0.3, F.col("core_first"))),
        (F.col("by_core") & oom.isNotNull(), _clue("dns", "killed", 0.1, oom)),
        (F.col("by_core") & F.coalesce("config", "other").isNotNull(), _clue("dns", "changed", F.when(F.col("config").isNotNull(), 0.35).otherwise(0.2), change=F.coalesce("config", "other"))),
        (F.col("alert").isNotNull(), _clue("dns", "alert", 0.2, F.col("alert"))),
    ])
    anchor = F.when(F.col("config").isNotNull(), F.col("config_ms")).otherwise(F.col("other_ms"))
    anchors = g.filter("by_core").select(I, F.lit("dns").alias("category"), "component", anchor.alias("anchor_ms"), F.lit("change").alias("anchored_by")).filter("anchor_ms is not null")
    covers = fails.filter(client).select(*place, F.col("component").alias("covered")).join(g.filter("by_core").select(*place, "component"), place).select(I, F.lit("dns").alias("category"), "component", "covered")
    return clues, anchors, covers


def tls_rules(signals: DataFrame, certificates: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clues and anchors of certificates: what most errors point at is taken, alerts and certificates count three times.

    certificates: incident_id, component, not_after_ms, failed_attempts, issuer_line, name; now: incident_id, now_ms.
    """
    tls = signals.filter("mech = 'tls_error' and component is not null").withColumn("points_at", F.coalesce("target_id", "component"))
    votes = tls.select(I, F.col("points_at").alias("component"), F.when(F.col("alert"), 3).otherwise(1).alias("v"))
    votes = votes.unionByName(certificates.filter("component is not null").join(tls.select(I).distinct(), I, "left_semi").select(I, "component", F.lit(3).alias("v")))
    best = votes.groupBy(I, "component").agg(F.sum("v").alias("v")).groupBy(I).agg(F.min_by("component", F.struct(-F.col("v"), F.col("component"))).alias("best"))
    ends = tls.select(I, "id", "order", "alert", "counts_as", F.explode(F.array_distinct(F.array_compact(F.array("component", "target_id")))).alias("end"))
    related = ends.join(best, I).filter("end = best")
    log, telling = ~F.col("alert"), F.array_contains("counts_as", "tls_expired")
    g = related.groupBy(I, F.col("best").alias("component")).agg(F.min_by("id", F.when(log, F.struct(~telling, F.col("order")))).alias("line_id"), F.min_by("id", F.when(~log, F.col("order"))).alias("alert"), F.min(F.when(~log, F.col("order"))).alias("alert_at"))
    again = related.join(g.select(I, "alert_at"), I).filter(~log & (F.col("order") > F.col("alert_at"))).groupBy(I).agg(F.min_by("id", "order").alias("alert_2"))
    cert = certificates.join(best, I).groupBy(I).agg(F.min_by(F.struct("not_after_ms", "issuer_line", "not_after_line"), F.struct(F.coalesce(F.col("component") != F.col("best"), F.lit(True)), F.col("name"))).alias("cert"))
    g = g.join(again, I, "left").join(cert, I, "left").join(now, I, "left")
    over = F.coalesce(F.col("cert.not_after_ms") <= F.col("now_ms"), F.lit(True))
    clues = _rows(g, [
        (F.col("line_id").isNotNull(), _clue("tls-cert", "errors", 0.45, F.col("line_id"))), (F.col("alert").isNotNull(), _clue("tls-cert", "alert", 0.3, F.col("alert"))), (F.col("alert_2").isNotNull(), _clue("tls-cert", "second-alert", 0.15, F.col("alert_2"))),
        (F.col("cert.not_after_ms").isNotNull(), _clue("tls-cert", "certificate", F.when(over, 0.3).otherwise(0.1), line=F.col("cert.not_after_line"))), (F.col("cert.issuer_line").isNotNull(), _clue("tls-cert", "renewal", 0.15, line=F.col("cert.issuer_line"))),
    ])
    anchors = g.filter(F.col("cert.not_after_ms").isNotNull() & over).select(I, F.lit("tls-cert").alias("category"), "component", F.col("cert.not_after_ms").alias("anchor_ms"), F.lit("event").alias("anchored_by"))
    return clues, anchors


def connection_rules(wide: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clues, anchors and covers of exhausted connections: what raised the demand, else the client that fails most, else the store; clients of a target's name in other clusters too."""
    k, c = Wide.k, Wide.c
    n = k("conn_exhaustion")
    ill = wide.filter(n > 0).select(I, "component", "name", "type", "cluster", n.alias("n"), F.coalesce(k("conn_pool", "first"), k("conn_exhaustion", "first")).alias("line_id"), F.coalesce(k("conn_full", "first"), k("conn_exhaustion", "first")).alias("db_line"), k("conn_exhaustion", "at").alias("at"), k("conn_exhaustion", "first").alias("first"), k("conn_exhaustion", "first_alert").alias("alert"))
    store = F.col("type") == "datastore"
    lead = F.struct(-F.col("n"), F.col("component"))
    of = ill.groupBy(I).agg(F.min_by("component", F.when(~store, lead)).alias("client"), F.min_by("component", F.when(store, F.col("at"))).alias("db"), F.min_by("alert", F.when(F.col("alert").isNotNull(), F.col("at"))).alias("alert"))
    wants = wide.filter(c("demand").isNotNull()).select(I, "component", "name", "cluster", c("demand").alias("demand"), c("demand", "ms").alias("ms")).join(of.select(I), I, "left_semi")
    rest = of.join(wants.select(I).distinct(), I, "left_anti").select(I, F.coalesce("client", "db").alias("component"))
    targets = wants.select(I, "component").union(rest)
    names = targets.join(wide.select(I, "component", "name"), [I, "component"]).select(I, "name").distinct()
    targets = targets.union(ill.filter(~store).join(names, [I, "name"], "left_semi").select(I, "component")).distinct()
    t = targets.join(wide.select(I, "component", "name", "cluster", k("hpa_maxed", "first").alias("maxed")), [I, "component"]).join(ill.select(I, "component", "line_id"), [I, "component"], "left")
    # The store of the target's own cluster that refuses most, else the one that refuses most anywhere.
    near = ill.filter(store).groupBy(I, "cluster").agg(F.min_by("db_line", lead).alias("near"))
    far = ill.filter(store).groupBy(I).agg(F.min_by("db_line", lead).alias("far"))
    own = wants.select(I, "component", F.col("demand").alias("own_id"), F.col("ms").alias("own_ms"))
    kin = wants.groupBy(I, "name").agg(F.min_by(F.struct("demand", "ms"), "component").alias("kin"))
    # Another client is one of another name: the least and the greatest name tell, so no pairs arise.
    other = ill.filter(~store).groupBy(I).agg(F.min(F.struct("name", "first")).alias("low"), F.max(F.struct("name", "first")).alias("high"))
    t = t.join(near, [I, "cluster"], "left").join(far, I, "left").join(own, [I, "component"], "left").join(kin, [I, "name"], "left").join(other, I, "left").join(of.select(I, "alert"), I, "left")
    demand, ms = F.coalesce("own_id", F.col("kin.demand")), F.when(F.col("own_id").isNotNull(), F.col("own_ms")).otherwise(F.col("kin.ms"))
    another = F.when(F.col("low.name") != F.col("name"), F.col("low.first")).when(F.col("high.name") != F.col("name"), F.col("high.first"))
    db = F.coalesce("near", "far")
    clues = _rows(t, [
        (F.col("line_id").isNotNull(), _clue("connection-exhaustion", "no-connections", 0.4, F.col("line_id"))), (db.isNotNull(), _clue("connection-exhaustion", "store-refuses", 0.35, db)), (demand.isNotNull(), _clue("connection-exhaustion", "demand-raised", 0.35, change=demand)),
        (F.col("maxed").isNotNull(), _clue("connection-exhaustion", "at-maximum", 0.15, F.col("maxed"))), (another.isNotNull(), _clue("connection-exhaustion", "other-clients", 0.1, another)), (F.col("alert").isNotNull(), _clue("connection-exhaustion", "alert", 0.15, F.col("alert"))),
    ])
    anchors = t.select(I, F.lit("connection-exhaustion").alias("category"), "component", ms.alias("anchor_ms"), F.lit("change").alias("anchored_by")).filter("anchor_ms is not null")
    bad = edges.filter("status <> 'ok'").select(I, F.col("from").alias("component"), F.col("to").alias("covered")).join(wide.filter(store).select(I, F.col("component").alias("covered")), [I, "covered"], "left_semi")
    covers = t.select(I, "component").join(ill.filter(store).select(I, F.col("component").alias("covered")), I).unionByName(t.select(I, "component").join(bad, [I, "component"]).select(I, "component", "covered"))
    return clues, anchors, covers.select(I, F.lit("connection-exhaustion").alias("category"), "component", "covered").distinct()


def policy_rules(signals: DataFrame, changes: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clues and anchors of changed network policies: failed connections to or from the namespace speak for them."""
    places = components.select(I, F.col("component").alias("target_id"), F.col("namespace").alias("to_namespace"))
    bad = signals.filter(F.col("kind").isin("conn_refused", "timeout", "span_error")).join(places, [I, "target_id"], "left")
    ends = bad.select(I, "id", "order", F.coalesce("target_id", "component").alias("victim"), F.explode(F.array_distinct(F.array_compact(F.array("namespace", "to_namespace")))).alias("namespace"))
    blocked = ends.groupBy(I, "namespace").agg(F.min_by("id", "order").alias("blocked"), F.min_by("victim", "order").alias("victim"))
    p = changes.filter("category = 'networkpolicy'").join(blocked, [I, "namespace"], "left")
    p = p.withColumn("component", F.coalesce("component", "victim")).filter("component is not null")
    # Several policies of one component are one cause: the clues of each count.
    clues = _rows(p, [(F.lit(True), _clue("network-policy", "changed", 0.4, change=F.col("id"))), (F.col("blocked").isNotNull(), _clue("network-policy", "blocked", 0.35, F.col("blocked")))])
    anchors = p.groupBy(I, "component").agg(F.min("changed_ms").alias("anchor_ms")).select(I, F.lit("network-policy").alias("category"), "component", "anchor_ms", F.lit("change").alias("anchored_by"))
    return clues, anchors.filter("anchor_ms is not null")


def node_rules(wide: DataFrame) -> DataFrame:
    """Clues of nodes under pressure: the node with most records, pods that were evicted, an alert."""
    k = Wide.k
    n = k("node_not_ready") + k("node_pressure")
    kind = lambda name: F.when(k(name) > 0, F.struct(k(name, "at").alias("at"), k(name, "first").alias("first")))
    alert = F.coalesce(k("node_not_ready", "first_alert"), k("node_pressure", "first_alert"))
    rows = wide.filter((n > 0) | (k("evicted") > 0)).select(I, "component", n.alias("n"), F.array_min(F.array_compact(F.array(kind("node_not_ready"), kind("node_pressure")))).alias("f"), kind("evicted").alias("e"), alert.alias("alert"))
    node = F.col("n") > 0
    g = rows.groupBy(I).agg(F.min_by(F.struct("component", F.col("f.first").alias("first")), F.when(node, F.struct(-F.col("n"), F.col("component")))).alias("node"), F.min_by(F.struct("component", F.col("e.first").alias("first")), F.when(F.col("e").isNotNull(), F.col("e"))).alias("gone"), F.min_by("alert", F.when(F.col("alert").isNotNull(), F.col("f"))).alias("alert"))
    g = g.withColumn("component", F.coalesce("node.component", "gone.component"))
    return _rows(g, [(F.col("node.first").isNotNull(), _clue("node-pressure", "condition", 0.45, F.col("node.first"))), (F.col("gone.first").isNotNull(), _clue("node-pressure", "evicted", 0.25, F.col("gone.first"))), (F.col("alert").isNotNull(), _clue("node-pressure", "alert", 0.2, F.col("alert")))])


def deploy_rules(wide: DataFrame, deploys: DataFrame, changes: DataFrame, signals: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clues and anchors of deploys: the release, a failure soon after it, its migration, its risky changes, its rollout. A component without errors, called without failures, scales all down."""
    k = Wide.k
    into = edges.filter("status = 'failing'").select(I, F.col("to").alias("component")).distinct().withColumn("called_badly", F.lit(True))
    d = deploys.filter("component is not null").join(wide.select(I, "component", "status", "first_error_ms", "first_error_id", k("db_error", "first").alias("db"), k("rollout", "first").alias("rollout")), [I, "component"]).join(into, [I, "component"], "left")
    at = lambda c: F.when(c, F.struct((F.col("risk") != "high").cast("int"), F.col("line"), F.col("id")))
    mig, risky, mid = F.col("category") == "migration-hook", F.col("risk") == "high", F.col("risk") == "medium"
    summed = [F.min_by("id", at(mig)).alias("mig"), F.array_sort(F.collect_list(F.when(risky & ~mig, F.struct("line", "id")))).alias("high"), F.array_sort(F.collect_list(F.when(mid & ~mig, F.struct("line", "id")))).alias("med")]
    ordered = changes.withColumn("_rn", F.row_number().over(Window.partitionBy(I, F.coalesce("release", F.lit("")), F.coalesce("component", F.lit("")), "risk", mig).orderBy("line", "id"))).filter("_rn <= 2")
    by_release = ordered.filter("release is not null").groupBy(I, "release").agg(*summed)
    by_component = ordered.filter("component is not null").groupBy(I, "component").agg(*summed)
    d = d.join(by_release.withColumn("r", F.struct("mig", "high", "med")).select(I, "release", "r"), [I, "release"], "left").join(by_component.withColumn("o", F.struct("mig", "high", "med")).select(I, "component", "o"), [I, "component"], "left")
    x = F.when(F.col("release").isNotNull(), F.col("r")).otherwise(F.col("o"))
    broke = signals.filter((F.col("kind") == "migration") & (rank(F.col("severity")) >= 2)).groupBy(I).agg(F.min_by("id", "order").alias("mig_error"))
    d = d.join(broke, I, "left").withColumn("x", x)
    ill = F.col("status").isin("failing", "root", "degraded") | F.coalesce("called_badly", F.lit(False))
    s = F.when(ill, 1.0).otherwise(0.4)
    soon = (F.col("first_error_ms") >= F.col("deployed_ms") - MINUTE) & (F.col("first_error_ms") - F.col("deployed_ms") <= HOURS_2)
    nth = lambda name, i: F.get(F.col(f"x.{name}"), F.lit(i))["id"]
    has_mig = F.col("x.mig").isNotNull()
    clues = _rows(d, [
        (F.lit(True), _clue("bad-deploy", "release", 0.2 * s, F.col("signal_id"), line=F.col("line"))),
        (soon, _clue("bad-deploy", "failed-after", 0.3 * s, F.col("first_error_id"))),
        (has_mig, _clue("bad-deploy", "migration", 0.2 * s, change=F.col("x.mig"))),
        (has_mig & F.col("mig_error").isNotNull(), _clue("bad-deploy", "migration-failed", 0.3 * s, F.col("mig_error"))),
        (has_mig & F.col("mig_error").isNull() & F.col("db").isNotNull(), _clue("bad-deploy", "errors-after-migration", 0.25 * s, F.col("db"))),
        (nth("high", 0).isNotNull(), _clue("bad-deploy", "high-risk", 0.15 * s, change=nth("high", 0))), (~has_mig & nth("high", 1).isNotNull(), _clue("bad-deploy", "high-risk", 0.15 * s, change=nth("high", 1))),
        (nth("med", 0).isNotNull(), _clue("bad-deploy", "also-changed", 0.05 * s, change=nth("med", 0))), (nth("med", 1).isNotNull(), _clue("bad-deploy", "also-changed", 0.05 * s, change=nth("med", 1))),
        (F.col("rollout").isNotNull() & (F.coalesce("time_source", F.lit("")) != "rollout-event"), _clue("bad-deploy", "rolled-out", 0.1 * s, F.col("rollout"))),
    ])
    anchors = d.groupBy(I, "component").agg(F.max("deployed_ms").alias("anchor_ms")).select(I, F.lit("bad-deploy").alias("category"), "component", "anchor_ms", F.lit("change").alias("anchored_by"))
    return clues, anchors.filter("anchor_ms is not null")


def dependency_rules(wide: DataFrame, signals: DataFrame, edges: DataFrame, covered: DataFrame) -> DataFrame:
    """Clues of failing dependencies: what failing calls lead to and that calls nothing that fails, unless a cause of its own explains it; stores and external peers are named beside one."""
    deep = wide.filter("deepest").select(I, "component", "type", Wide.k("any_error", "first").alias("own")).join(covered.select(I, F.col("covered").alias("component")).distinct().withColumn("explained", F.lit(True)), [I, "component"], "left")
    deep = deep.filter(F.col("explained").isNull() | F.col("type").isin("external", "datastore"))
    into = edges.filter("status = 'failing'").select(I, F.col("to").alias("component"), "from", "errors", (F.col("source") != "logs").alias("traced"))
    worst = into.groupBy(I, "component").agg(F.min_by("from", F.when(F.col("traced"), F.struct(-F.col("errors"), F.col("from")))).alias("from"))
    # What shows the calls: the caller's failed span to it, any signal of the caller that names it, any failed span, the caller's first error.
    spans = F.col("source") == "traces"
    naming = signals.filter("target_id is not null").groupBy(I, F.col("component").alias("from"), F.col("target_id").alias("component")).agg(F.min_by("id", F.struct(~spans, F.col("order"))).alias("naming"))
    any_span = signals.filter(spans & (F.col("kind") == "span_error")).groupBy(I, F.col("component").alias("from")).agg(F.min_by("id", "order").alias("any_span"))
    first = wide.select(I, F.col("component").alias("from"), F.col("first_error_id").alias("caller_first"))
    said = signals.filter((F.col("source") == "logs") & (rank(F.col("severity")) >= 2) & F.col("target_id").isNotNull()).groupBy(I, F.col("target_id").alias("component")).agg(F.min_by("id", "order").alias("said"))
    d = deep.join(worst, [I, "component"]).join(naming, [I, "from", "component"], "left").join(any_span, [I, "from"], "left").join(first, [I, "from"], "left").join(said, [I, "component"], "left")
    shows = F.coalesce("naming", "any_span", "caller_first")
    return _rows(d, [(F.col("from").isNotNull() & shows.isNotNull(), _clue("dependency-failure", "calls-fail", 0.35, shows)), (F.col("said").isNotNull(), _clue("dependency-failure", "callers-say", 0.3, F.col("said"))), (F.col("own").isNotNull(), _clue("dependency-failure", "own-errors", 0.2, F.col("own")))])


KEY = [I, "category", "component"]


def backed(clues: DataFrame) -> DataFrame:
    """Clues that cite a signal, a change or a line; of those of one hypothesis that cite the same, the heaviest."""
    cites = F.coalesce(F.concat(F.lit("s:"), "signal_id"), F.concat(F.lit("c:"), "change_id"), F.concat(F.lit("l:"), F.col("line").cast("string"), F.lit(":"), "clue"))
    rows = clues.withColumn("cites", cites).filter("cites is not null")
    one = rows.groupBy(*KEY, "cites").agg(F.max(F.struct("weight", "clue", "signal_id", "change_id", "line")).alias("x"))
    return one.select(*KEY, "cites", "x.*")


def raw_scores(clues: DataFrame, anchors: DataFrame, components: DataFrame, onset: DataFrame) -> DataFrame:
    """(key, pieces, raw): combined weights, a sixth more where the errors follow the anchor within an hour, much less where they came before a change, a tenth more for the deepest failing."""
    w = F.least(F.greatest("weight", F.lit(0.0)), F.lit(MOST_WEIGHT))
    h = clues.groupBy(*KEY).agg((1 - F.exp(F.sum(F.log1p(-w)))).alias("base"), F.count("*").alias("pieces"))
    h = h.join(anchors, KEY, "left").join(components.select(I, "component", "first_error_ms", "deepest"), [I, "component"], "left").join(onset, I, "left")
    lag = F.coalesce("first_error_ms", "onset_ms") - F.col("anchor_ms")
    timing = F.when((lag >= -MINUTE) & (lag <= 60 * MINUTE), 1.15).when((lag < -MINUTE) & (F.col("anchored_by") == "change"), 0.6).otherwise(1.0)
    return h.select(*KEY, "pieces", (F.col("base") * timing * F.when(F.coalesce("deepest", F.lit(False)), 1.1).otherwise(1.0)).alias("raw"))


def confidence(raw: Column, pieces: Column) -> Column:
    kept = F.least(raw, F.lit(MOST_WEIGHT))
    return half_up(F.when(pieces < 2, F.least(kept, F.lit(0.5))).otherwise(kept), 3)


def folded(scores: DataFrame, clues: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, into) of hypotheses that are the same of another cluster, and a clue of a tenth for each in the one that leads: the strongest of a category, type and name."""
    place = components.select(I, "component", "name", "type", "cluster")
    s = scores.join(place, [I, "component"], "left").withColumn("same", F.coalesce(F.concat_ws(":", "type", "name"), "component"))
    lead = s.groupBy(I, "category", "same").agg(F.min_by(F.struct("component", "cluster"), F.struct(-F.col("raw"), F.col("component"))).alias("lead"))
    moved = s.join(lead, [I, "category", "same"]).filter("component <> lead.component and cluster <> lead.cluster").select(*KEY, F.col("lead.component").alias("into"))
    cited = clues.filter("signal_id is not null").groupBy(*KEY).agg(F.max_by("signal_id", F.struct("weight", "signal_id")).alias("signal_id"))
    none = F.lit(None).cast("string")
    more = moved.join(cited, KEY).select(I, "category", F.col("into").alias("component"), F.concat(F.lit("s:"), "signal_id").alias("cites"), F.lit(0.1).alias("weight"), F.lit("same-elsewhere").alias("clue"), "signal_id", none.alias("change_id"), F.lit(None).cast("long").alias("line"))
    return moved, more


def hypotheses(signals: DataFrame, components: DataFrame, changes: DataFrame, deploys: DataFrame, edges: DataFrame, certificates: DataFrame, onset: DataFrame, now: DataFrame) -> dict[str, DataFrame]:
    """evidence, causes (ranked, PER_INCIDENT an incident) and covers of each incident, by all rules.

    signals: incident_id, id, seq, component, target_id, kind, cause, severity, source, ts_ms, ts_unknown, text, cluster, namespace, moved_from;
    components: incident_id, component, name, type, cluster, namespace, status, user_facing, deepest, errors, first_error_ms, first_error_id;
    changes: incident_id, id, component, release, category, risk, direction, field, before, after, namespace, line, changed_ms;
    deploys: incident_id, component, release, deployed_ms, time_source, signal_id, line; edges: incident_id, from, to, errors, status, source.
    """
    signals = cut(prepared(signals))
    wide = cut(Wide(components, signals, changes).rows)
    image, image_at, image_covers = image_rules(wide)
    dns, dns_at, dns_covers = dns_rules(wide)
    tls, tls_at = tls_rules(signals, certificates, now)
    conn, conn_at, conn_covers = connection_rules(wide, edges)
    policy, policy_at = policy_rules(signals, changes, components)
    late, late_at = deploy_rules(wide, deploys, changes, signals, edges)
    specific = cut(_union(local_rules(wide), image, dns, tls, conn, policy, node_rules(wide)))
    covers = cut(_union(specific.select(*KEY, F.col("component").alias("covered")), image_covers, dns_covers, conn_covers).distinct())
    clues = backed(_union(specific, late, dependency_rules(wide, signals, edges, covers)))
    clues = cut(clues)
    anchors = cut(_union(local_anchors(wide), image_at, dns_at, tls_at, conn_at, policy_at, late_at).groupBy(*KEY).agg(F.max("anchor_ms").alias("anchor_ms"), F.max("anchored_by").alias("anchored_by")))
    scores = raw_scores(clues, anchors, components, onset)
    moved, more = folded(scores, clues, components)
    moved = cut(moved)
    again = clues.join(moved.select(*KEY), KEY, "left_anti").unionByName(more)
    again = cut(again.groupBy(*KEY, "cites").agg(F.max(F.struct("weight", "clue", "signal_id", "change_id", "line")).alias("x")).select(*KEY, "cites", "x.*"))
    scores = raw_scores(again, anchors, components, onset)
    explained = covers.select(I, F.col("covered").alias("component")).distinct().withColumn("explained", F.lit(0.6))
    scores = scores.join(explained, [I, "component"], "left")
    scores = scores.withColumn("lowered", (F.col("category") == "dependency-failure") & F.col("explained").isNotNull()).withColumn("raw", F.when(F.col("lowered"), F.col("raw") * 0.6).otherwise(F.col("raw")))
    scores = cut(scores.select(*KEY, "raw", "pieces", F.when(F.col("lowered"), half_up(F.least("raw", F.lit(MOST_WEIGHT)), 3)).otherwise(confidence(F.col("raw"), F.col("pieces"))).alias("confidence")))
    unknown = unknown_rules(scores, components, wide)
    return {"evidence": again.select(*CLUES), "causes": ranked(scores.unionByName(unknown), clues), "covers": covers}


def unknown_rules(scores: DataFrame, components: DataFrame, wide: DataFrame) -> DataFrame:
    """The failing component with most errors, where no cause is likely; without a failing component, no component."""
    best = scores.groupBy(I).agg(F.max("confidence").alias("best"))
    weak = components.select(I).distinct().join(best, I, "left").filter(F.coalesce("best", F.lit(0.0)) < UNKNOWN_BELOW).select(I)
    ill = components.filter("status in ('failing', 'root') and type <> 'node'").groupBy(I).agg(F.min_by("component", F.struct(-F.col("errors"), F.col("component"))).alias("component"))
    return weak.join(ill, I).select(I, F.lit("unknown").alias("category"), "component", F.lit(UNKNOWN).alias("raw"), F.lit(1).cast("long").alias("pieces"), F.lit(UNKNOWN).alias("confidence"))


def ranked(scores: DataFrame, clues: DataFrame) -> DataFrame:
    """(key, confidence, raw, pieces, changes, rank): the first PER_INCIDENT by confidence, raw score, how specific the category is, and id, at most PER_COMPONENT of a component."""
    changes = clues.filter("change_id is not null").groupBy(*KEY).agg(F.count("*").alias("changes"))
    specific = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    order = [F.desc("confidence"), F.desc(F.round("raw", 9)), specific, "component"]
    rows = scores.withColumn("_rn", F.row_number().over(Window.partitionBy(I, "component").orderBy(*order))).filter(F.col("_rn") <= PER_COMPONENT).drop("_rn")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(I).orderBy(*order))).filter(F.col("rank") <= PER_INCIDENT)
    return rows.join(changes, KEY, "left").select(*KEY, "confidence", half_up(F.col("raw"), 3).alias("raw"), "pieces", F.coalesce("changes", F.lit(0)).cast("long").alias("changes"), "rank")
