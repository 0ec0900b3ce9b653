"""Queries of formats and scalar rules: tables, span and alert documents, histories, certificates, names, severities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text, times
from ..operators import budget, changes, entities, graph, stackfit, timeline
from ..session import spread
from ..sources import alerts, certificates, logs, releases, traces
from ..sources.adapters import pick, view
from ..streaming import live
from .catalog import ANOMALY, RANK, query
from .catalog_readers import INC, SECONDS, pane, stamp


def expected(number: str, values: list) -> str:
    """values[number % n] as SQL; None is null."""
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


# --- tables ------------------------------------------------------------------------------------------

STATUSES = ["OOMKilled", "CrashLoopBackOff", "Running", "ImagePullBackOff", "Running", "Evicted", "Completed"]


@query("signals", sql=f"""r AS (SELECT seq, component, {expected('seq', STATUSES)} AS status, seq % 7 = 4 AS ready, CASE WHEN seq % 7 = 6 THEN 0 ELSE seq % 3 END AS restarts FROM signals),
k AS (SELECT *, CASE status WHEN 'OOMKilled' THEN 'oom_killed' WHEN 'CrashLoopBackOff' THEN 'crash_loop' WHEN 'ImagePullBackOff' THEN 'image_pull' WHEN 'Evicted' THEN 'evicted' ELSE CASE WHEN status = 'Running' AND NOT ready THEN 'probe_failed' WHEN restarts > 0 THEN 'restart' END END AS kind FROM r)
SELECT {INC} AS incident_id, component AS name, kind, count(*) AS n, max((CASE WHEN kind = 'restart' THEN seq % 40 + 1 ELSE CASE WHEN restarts > 0 THEN seq % 40 + 1 ELSE 90 END END) * 60000)::BIGINT AS oldest_ms FROM k WHERE kind IS NOT NULL GROUP BY ALL""")
def read_pod_tables(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    restarts = F.when(F.col("seq") % 7 == 6, 0).otherwise(F.col("seq") % 3)
    line = F.concat_ws("  ", F.concat("component", F.lit("-7d9f8b6c5-x2k4j")), F.when(F.col("seq") % 7 == 4, "1/1").otherwise("0/1"), F.expr(pick("seq", STATUSES)), F.concat(restarts.cast("string"), F.when(restarts > 0, F.concat(F.lit(" ("), (F.col("seq") % 40 + 1).cast("string"), F.lit("m ago)"))).otherwise("")), F.lit("90m"))
    got = logs.pod_rows(logs.contexts(pane(s, line, F.lit("NAME  READY  STATUS  RESTARTS  AGE"))))
    return got.groupBy("incident_id", "name", "kind").agg(F.count("*").alias("n"), F.max("age_ms").alias("oldest_ms"))


@query("signals", sql=f"SELECT {INC} AS incident_id, 'node-' || seq % 40 AS name, 'node_not_ready' AS kind, count(*) AS n FROM signals WHERE seq % 3 <> 0 GROUP BY ALL")
def read_node_tables(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    status = F.when(F.col("seq") % 3 == 0, "Ready").when(F.col("seq") % 3 == 1, "NotReady,SchedulingDisabled").otherwise("Unknown")
    line = F.concat_ws("   ", F.concat(F.lit("node-"), (F.col("seq") % 40).cast("string")), status, F.lit("<none>   12d   v1.31.2"))
    return logs.node_rows(logs.contexts(pane(s, line, F.lit("NAME  STATUS  ROLES  AGE  VERSION")))).groupBy("incident_id", "name", "kind").agg(F.count("*").alias("n"))


@query("signals", sql=f"SELECT {INC} AS incident_id, component AS name, 'hpa_maxed' AS kind, count(*) AS n FROM signals WHERE seq % 11 + 3 >= 9 GROUP BY ALL")
def read_autoscaler_tables(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    line = F.concat(F.lit("h1   Deployment/"), "component", F.lit("   cpu: 93%/80%   2   9   "), (F.col("seq") % 11 + 3).cast("string"), F.lit("   3d"))
    return logs.hpa_rows(logs.contexts(pane(s, line, F.lit("NAME  REFERENCE  TARGETS  MINPODS  MAXPODS  REPLICAS  AGE")))).groupBy("incident_id", "name", "kind").agg(F.count("*").alias("n"))


@query("signals", sql=f"""SELECT {INC} AS incident_id, component AS name, CASE WHEN seq % 2 = 0 THEN 'probe_failed' ELSE 'error_generic' END AS kind, count(*) AS n, max((seq % 30 + 1) * 60000)::BIGINT AS oldest_ms FROM signals GROUP BY ALL""")
def read_event_tables(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    age = F.concat((F.col("seq") % 30 + 1).cast("string"), F.lit("m"))
    line = F.concat_ws("   ", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("5s (x3 over "), age, F.lit(")"))).otherwise(age), F.lit("Warning"), F.when(F.col("seq") % 2 == 0, "Unhealthy").otherwise("Odd"), F.concat(F.lit("deployment/"), "component"), F.when(F.col("seq") % 2 == 0, "Readiness probe failed: nothing").otherwise("something else"))
    got = logs.event_rows(logs.contexts(pane(s, line, F.lit("LAST SEEN   TYPE   REASON   OBJECT   MESSAGE"))))
    return got.groupBy("incident_id", "name", "kind").agg(F.count("*").alias("n"), F.max("age_ms").alias("oldest_ms"))


# --- documents ---------------------------------------------------------------------------------------

SPAN_SQL = "SELECT 'inc-' || trace_id // 200 AS incident_id, 't' || trace_id AS trace_id, 's' || span_id AS span_id, CASE WHEN parent_id IS NOT NULL AND parent_id <> 0 THEN 's' || parent_id END AS parent_id, service, dur_ms, error, start_ms::DOUBLE AS start_ms FROM spans"


def _spans(spark, sf_dir):
    s = view(spark, sf_dir, "spans")
    named = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    return s.withColumns({"incident_id": F.concat(F.lit("inc-"), F.expr("cast(trace_id div 200 as string)")), "t": F.concat(F.lit("t"), F.col("trace_id").cast("string")), "s": named("span_id"), "p": F.when(F.col("parent_id") != 0, named("parent_id"))})


def _docs(rows, doc):
    """(incident_id, first_line, doc): a document for each trace."""
    return rows.groupBy("incident_id", "t").agg(doc.alias("doc")).select("incident_id", F.lit(1).alias("first_line"), "doc")


_SPAN = ["incident_id", "trace_id", "span_id", "parent_id", "service", "dur_ms", "error", "start_ms"]


@query("spans", sql=SPAN_SQL.replace("dur_ms, error", "floor(dur_ms)::DOUBLE AS dur_ms, error"))
def read_otlp(spark, sf_dir):
    s = _spans(spark, sf_dir)
    nanos = lambda ms: (ms.cast("decimal(20,0)") * 1_000_000).cast("decimal(30,0)").cast("string")
    span = F.struct(F.col("t").alias("traceId"), F.col("s").alias("spanId"), F.col("p").alias("parentSpanId"), F.lit("op").alias("name"), F.lit("2").alias("kind"), nanos(F.col("start_ms")).alias("startTimeUnixNano"), nanos(F.col("start_ms") + F.floor("dur_ms")).alias("endTimeUnixNano"), F.struct(F.when(F.col("error"), "STATUS_CODE_ERROR").alias("code")).alias("status"))
    named = F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value")))
    resource = F.struct(F.struct(named.alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))
    docs = _docs(s, F.to_json(F.struct(F.collect_list(resource).alias("resourceSpans"))))
    return traces.otlp_spans(docs).select(*_SPAN)


@query("spans", sql=SPAN_SQL)
def read_jaeger(spark, sf_dir):
    s = _spans(spark, sf_dir)
    refs = F.when(F.col("p").isNotNull(), F.array(F.struct(F.lit("FOLLOWS_FROM").alias("refType"), F.lit("other").alias("spanID")), F.struct(F.lit("CHILD_OF").alias("refType"), F.col("p").alias("spanID"))))
    span = F.struct(F.col("t").alias("traceID"), F.col("s").alias("spanID"), F.lit("op").alias("operationName"), refs.alias("references"), (F.col("start_ms") * 1000.0).alias("startTime"), (F.col("dur_ms") * 1000.0).alias("duration"), F.array(F.struct(F.lit("error").alias("key"), F.col("error").cast("string").alias("value"))).alias("tags"), F.col("service").alias("processID"))
    processes = F.map_from_entries(F.collect_set(F.struct("service", F.struct(F.col("service").alias("serviceName")).alias("p"))))
    doc = F.to_json(F.struct(F.array(F.struct(F.min("t").alias("traceID"), F.collect_list(span).alias("spans"), processes.alias("processes"))).alias("data")))
    got = traces.jaeger_spans(_docs(s, doc))
    return got.withColumns({"dur_ms": F.round("dur_ms", 6), "start_ms": F.round("start_ms", 3)}).select(*_SPAN)


@query("spans", sql=SPAN_SQL.replace("dur_ms, error", "floor(dur_ms)::DOUBLE AS dur_ms, error").replace("start_ms::DOUBLE AS start_ms", "(start_ms // 1000 * 1000)::DOUBLE AS start_ms"))
def read_text_spans(spark, sf_dir):
    s = _spans(spark, sf_dir).withColumn("ts_ms", F.col("start_ms"))
    line = F.concat(stamp(), F.lit(" trace="), "t", F.lit(" span="), "s", F.lit(" parent="), F.coalesce("p", F.lit("-")), F.lit(" service="), "service", F.lit(' op="a b" dur='), F.floor("dur_ms").cast("string"), F.lit("ms status="), F.when(F.col("error"), "error").otherwise("ok"))
    panes = spread(s.select("incident_id", line.alias("line")), "incident_id").groupBy("incident_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list("line"))).alias("text"))
    return traces.text_spans(panes).select(*_SPAN)


@query("signals", sql=f"SELECT {INC} AS incident_id, 'Down' AS name, CASE WHEN seq % 2 = 0 THEN 'resolved' ELSE 'firing' END AS status, component, cluster, ({SECONDS})::BIGINT AS starts_ms, 'note ' || seq AS summary FROM signals")
def read_alert_webhooks(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    alert = F.struct(F.when(F.col("seq") % 2 == 0, "resolved").otherwise("firing").alias("status"), F.create_map(F.lit("service"), F.col("component")).alias("labels"), F.create_map(F.lit("summary"), F.concat(F.lit("note "), F.col("seq").cast("string"))).alias("annotations"), stamp().alias("startsAt"))
    doc = F.to_json(F.struct(F.array(alert).alias("alerts"), F.create_map(F.lit("alertname"), F.lit("Down"), F.lit("cluster"), F.col("cluster"), F.lit("service"), F.lit("overlaid")).alias("commonLabels")))
    got = alerts.json_alerts(s.select(F.concat(F.lit("inc-"), F.expr("cast(seq div 200 as string)")).alias("incident_id"), F.lit(1).alias("first_line"), doc.alias("doc")))
    return got.select("incident_id", "name", "status", "component", "cluster", "starts_ms", "summary")


@query("signals", sql=f"SELECT {INC} AS incident_id, 'Up' AS name, CASE seq % 3 WHEN 1 THEN 'firing' ELSE 'pending' END AS status, component, (seq % 91)::DOUBLE AS value FROM signals WHERE seq % 3 <> 0")
def read_alert_rules(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    alert = F.struct(F.when(F.col("seq") % 3 == 0, "inactive").when(F.col("seq") % 3 == 1, "firing").otherwise("pending").alias("state"), F.create_map(F.lit("alertname"), F.lit("Up"), F.lit("service"), F.col("component")).alias("labels"), stamp().alias("activeAt"), (F.col("seq") % 91).cast("string").alias("value"))
    rules = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct(F.lit("r").alias("name"), F.array(alert).alias("alerts"))).alias("rules"))).alias("groups")).alias("data")))
    plain = F.to_json(F.struct(F.struct(F.array(alert).alias("alerts")).alias("data")))
    got = alerts.json_alerts(s.select(F.concat(F.lit("inc-"), F.expr("cast(seq div 200 as string)")).alias("incident_id"), F.lit(1).alias("first_line"), F.when(F.col("seq") % 2 == 0, rules).otherwise(plain).alias("doc")))
    return got.select("incident_id", "name", "status", "component", "value")


@query("releases", sql="SELECT 'inc-' || release_id AS incident_id, 'app' AS release_id, revision, status, ts_ms // 1000 * 1000 AS ts_ms, CASE WHEN revision % 4 = 0 THEN revision - 1 END AS rolled_back_to FROM releases")
def read_histories(spark, sf_dir):
    r = view(spark, sf_dir, "releases")
    said = F.when(F.col("revision") % 4 == 0, F.concat(F.lit("Rollback to "), (F.col("revision") - 1).cast("string"))).otherwise("Upgrade complete")
    at = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss 'UTC'")
    row = F.concat_ws("   ", F.col("revision").cast("string"), F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "status", F.lit("app-1.2.3"), F.lit("9"), said)
    item = F.to_json(F.struct("revision", F.concat(at, F.lit("")).alias("updated"), "status", F.lit("app-1.2.3").alias("chart"), F.lit("9").alias("app_version"), said.alias("description")))
    line = F.when(F.col("release_id") % 2 == 0, row).otherwise(F.concat(F.lit("["), F.replace(item, F.lit(" UTC"), F.lit("Z")), F.lit("]")))
    r = spread(r.select(F.concat(F.lit("inc-"), F.col("release_id").cast("string")).alias("incident_id"), F.struct("revision", line.alias("l")).alias("x")), "incident_id")
    panes = r.groupBy("incident_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["l"]), "\n").alias("text"))
    return releases.history(panes).select("incident_id", "release_id", "revision", "status", "ts_ms", "rolled_back_to")


@query("signals", sql=f"""c AS (SELECT {INC} AS incident_id, 'cert-' || seq AS name, ({SECONDS})::BIGINT AS t, seq FROM signals) SELECT incident_id, name, t AS not_after_ms, CASE WHEN seq % 3 = 0 THEN (seq % 5)::INT END AS failed_attempts, seq % 4 = 0 AS issuer FROM c""")
def read_certificates(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    line = F.concat(F.lit("Name:  cert-"), F.col("seq").cast("string"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("\n  Not After: "), stamp())).otherwise(F.concat(F.lit("\nnotAfter="), F.date_format(F.timestamp_millis("ts_ms"), "MMM d HH:mm:ss yyyy 'GMT'"))), F.when(F.col("seq") % 3 == 0, F.concat(F.lit("\n  Failed Issuance Attempts: "), (F.col("seq") % 5).cast("string"))).otherwise(""), F.when(F.col("seq") % 4 == 0, "\n  the issuer answered: denied").otherwise(""))
    got = certificates.certificates(pane(s, line))
    return got.select("incident_id", "name", "not_after_ms", "failed_attempts", F.col("issuer_line").isNotNull().alias("issuer"))


TELLS = ["NAME   READY   STATUS", "a trace=1 span=2", "[FIRING:1] X", "REVISION   UPDATED   STATUS", "nothing"]


@query("signals", sql=f"""p AS (SELECT 'i' || seq AS incident_id, {expected('seq // 5', ['logs', 'traces', 'alerts', 'helm'])} AS source, {expected('seq', ['logs', 'traces', 'alerts', 'helm', None])} AS looks_like FROM signals) SELECT * FROM p WHERE looks_like IS NOT NULL AND looks_like <> source""")
def misplaced_panes(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    return certificates.misplaced(s.select(F.concat(F.lit("i"), F.col("seq").cast("string")).alias("incident_id"), F.expr(pick("(seq div 5)", ["logs", "traces", "alerts", "helm"])).alias("source"), F.concat(F.lit("x\n"), F.expr(pick("seq", TELLS))).alias("text")))


# --- scalars -----------------------------------------------------------------------------------------


def sampled(name: str, fields: dict):
    """Register a query of (seq, fields): each field is a function of a sample, the samples, and what it gives for each."""
    sql = "SELECT seq, " + ", ".join(f"{expected('seq', want)}{cast} AS {k}" for k, (_, _, want, cast) in fields.items()) + " FROM signals"

    def run(spark, sf_dir):
        s = view(spark, sf_dir, "signals")
        return s.select("seq", *[f(F.expr(pick("seq", given))).alias(k) for k, (f, given, _, _) in fields.items()])

    run.__name__ = name
    return query("signals", sql=sql)(run)


sampled("duration_forms", {"ms": (times.duration_ms, ["250", "1.5s", "2m", "3h", "900us", "1m30s", "soon", "2000000ns"], [250, 1500, 120000, 10800000, 0.9, 90000, None, 2], "::DOUBLE")})
sampled("window_lengths", {"minutes": (times.window_minutes, ["1h", "3 days", "30m", "6 hours", "x", "90 min", "1.5h"], [60, 4320, 30, 360, None, 90, 90], "::DOUBLE")})
sampled("alert_kinds", {"kind": (text.alert_kind, ["KubePodCrashLooping", "ContainerOOMKilled", "ErrorBudgetBurn", "CoreDNSDown", "CertificateExpiringSoon", "HighErrorRate5xx", "NodeNotReady", "KubeHpaMaxedOut", "APILatencyHigh", "PostgresqlTooManyConnections", "PodEvicted", "Watchdog"], ["crash_loop", "oom_killed", "slo_burn", "dns_failure", "tls_error", "http_5xx", "node_not_ready", "hpa_maxed", "span_slow", "conn_exhaustion", "evicted", "alert_firing"], "")})
sampled("alert_severities", {"firing": (lambda c: text.alert_severity(c, F.lit("firing")), ["critical", "P2", "warning", "none", "purple", "sev1", "medium"], ["critical", "error", "warn", "info", "warn", "critical", "warn"], ""), "resolved": (lambda c: text.alert_severity(c, F.lit("resolved")), ["critical", "page"], ["info", "info"], ""), "pending": (lambda c: text.alert_severity(c, F.lit("pending")), ["purple", "error"], ["info", "error"], "")})
sampled("chart_names", {"release": (names.chart_release, ["payments-api-1.4.2", "redis-v18.0.1-rc.1", "ingress-nginx-4", "plain"], ["payments-api", "redis", "ingress-nginx", "plain"], ""), "tag": (names.image_tag, ["shop/app:v1.2", "r.example.com:5000/app", "app:1@sha256:ab", "app"], ["v1.2", None, "1", None], "")})
sampled("call_targets", {"target": (lambda c: names.target_in(c)["name"], ["dial tcp payments-api:8443: refused", "lookup orders-db.shop.svc.cluster.local: no such host", "GET https://api.example.com/x failed", "error in main.go:42", "upstream: cart-api timed out", "dial tcp 10.0.0.7:5432 (ledger-db)"], ["payments-api", "orders-db", "api.example.com", None, "cart-api", "ledger-db"], "")})
sampled("leading_stamps", {"ts_ms": (lambda c: times.leading_stamp(c)["ts_ms"], ["2026-10-05T21:00:00Z up", "[2026-10-05 23:00:00,250+02:00] up", "1791234000 up", "1791234000123 up", "Oct  5 21:00:00 up", "no stamp"], [1791234000000, 1791234000250, 1791234000000, 1791234000123, 24008400000, None], "::BIGINT"), "rest": (lambda c: times.leading_stamp(c)["rest"], ["2026-10-05T21:00:00Z up", "1791234000 up 2", "no stamp"], ["up", "up 2", "no stamp"], "")})
sampled("secret_values", {"secret": (lambda c: text.looks_secret(F.split(c, "=")[0], F.split(c, "=")[1]), ["db_password=x", "replicas=3", "note=mail a.b@example.com", "API_KEY=y", "color=blue"], [True, False, True, True, False], "::BOOLEAN")})
sampled("component_ids", {"id": (lambda c: names.component_id(F.lit("service"), F.lit("c1"), F.lit("shop"), c), [" Cart-API ", '"ledger"', "x"], ["service:c1/shop/cart-api", "service:c1/shop/ledger", "service:c1/shop/x"], ""), "dns": (lambda c: names.component_id(F.lit("infra"), F.lit("c1"), F.lit("a"), c), ["coredns", "kube-proxy"], ["infra:c1/kube-system/coredns", "infra:c1/a/kube-proxy"], ""), "parsed": (lambda c: names.parse_id(c)["namespace"], ["service:c1/shop/cart", "node:c2//n1", "odd"], ["shop", "", None], "")})
sampled("stated_objectives", {"slo": (lambda c: budget.normalised_slo(c.cast("double"), F.lit(28), F.lit(10), F.lit(5.0))["slo"], ["99.5", "0.99", "0", "-1"], [0.995, 0.99, 0.999, 0.999], "::DOUBLE"), "days": (lambda c: budget.normalised_slo(F.lit(0.9), c.cast("double"), F.lit(10), F.lit(5.0))["window_days"], ["28", "400", "0"], [28, 30, 30], "::DOUBLE"), "spent": (lambda c: budget.normalised_slo(F.lit(0.9), F.lit(1), F.lit(10), c.cast("double"))["spent"], ["12.5", "-3", "250"], [12.5, 0, 100], "::DOUBLE")})

_PATHS = ["spec.template.spec.containers[web].resources.limits.memory", "spec.replicas", "containers[web].image", "data.config", "spec.template.spec.containers[web].readinessProbe.timeoutSeconds", "spec.egress", "metadata.labels.team", "containers[api].env[X]"]
_KINDS = ["Deployment", "Deployment", "Deployment", "ConfigMap", "Deployment", "NetworkPolicy", "Deployment", "Deployment"]
_BEFORE, _AFTER = ["512Mi", "3", "a:1", "x", "5", "a", "a", "1"], ["256Mi", "1", "a:2", "y", "1", "b", "b", "2"]


@query("signals", sql="SELECT seq, " + ", ".join(f"{expected('seq', v)} AS {k}" for k, v in (("category", ["resources", "replicas", "image", "configmap", "probe", "networkpolicy", "other", "env"]), ("risk", ["high", "high", "medium", "medium", "high", "high", "low", "medium"]), ("direction", ["down", None, None, None, None, None, None, None]))) + " FROM signals")
def change_categories(spark, sf_dir):
    one = lambda v: F.expr(pick("seq", v))
    c = changes.classify_change(one(_PATHS), one(_KINDS), one(_BEFORE), one(_AFTER), F.lit("shop"), F.lit(False))
    return view(spark, sf_dir, "signals").select("seq", c["category"].alias("category"), c["risk"].alias("risk"), c["direction"].alias("direction"))


@query("signals", sql="g AS (SELECT component, count(*) AS n, CASE WHEN component NOT LIKE '%4' THEN max(ts_ms) - min(ts_ms) END AS span FROM signals GROUP BY component) SELECT component, CASE WHEN span IS NOT NULL THEN floor(n / greatest(span / 60000.0, 1.0) * 10 + 0.5) / 10 END AS per_minute FROM (SELECT component, n * 1000 AS n, span FROM g)")
def rates_per_minute(spark, sf_dir):
    g = view(spark, sf_dir, "signals").groupBy("component").agg((F.count("*") * 1000).alias("n"), (F.max("ts_ms") - F.min("ts_ms")).alias("span"))
    return g.select("component", stackfit.per_minute(F.col("n"), F.when(~F.col("component").endswith("4"), F.col("span"))).alias("per_minute"))


@query("faults", "components", sql="SELECT DISTINCT f.component FROM faults f ANTI JOIN components c ON c.id = f.component")
def unresolved_components(spark, sf_dir):
    return entities.unresolved(view(spark, sf_dir, "faults"), view(spark, sf_dir, "components").select(F.col("id").alias("component")))


@query("faults", sql="""e AS (SELECT component AS "from", coalesce(target_namespace, 'x') AS "to", count(*) AS errors FROM faults WHERE severity = 'error' GROUP BY ALL), d AS (SELECT component AS "from", coalesce(target_namespace, 'x') AS "to", count(*) AS n FROM faults WHERE severity = 'error' AND cause = 'dns_failure' GROUP BY ALL)
SELECT "from", "to", errors, errors > 0 AND coalesce(n, 0) >= errors AS dns_only FROM e LEFT JOIN d USING ("from", "to")""")
def dns_only_edges(spark, sf_dir):
    f = view(spark, sf_dir, "faults").filter("severity = 'error'").select(F.col("component").alias("from"), F.coalesce("target_namespace", F.lit("x")).alias("to"), "cause")
    edges = f.groupBy("from", "to").agg(F.count("*").alias("errors"))
    return graph.edge_dns_only(edges, f.filter("cause = 'dns_failure'")).select("from", "to", "errors", "dns_only")


@query("faults", sql="o AS (SELECT component, min(ts_ms) AS own FROM faults WHERE severity = 'critical' AND seq % 3 = 0 GROUP BY ALL), r AS (SELECT component, min(ts_ms) AS other FROM faults WHERE severity = 'error' GROUP BY ALL) SELECT component, coalesce(own, other) AS since_ms FROM o FULL JOIN r USING (component)")
def status_since(spark, sf_dir):
    f = view(spark, sf_dir, "faults")
    return timeline.since(f.filter("severity = 'critical' and seq % 3 = 0"), f.filter("severity = 'error'"))


@query("signals", sql="SELECT DISTINCT component, kind, seq // 2 AS seq FROM signals")
def distinct_signals(spark, sf_dir):
    s = live.with_instant(view(spark, sf_dir, "signals")).withColumn("seq", F.expr("seq div 2"))
    return live.distinct_signals(s).select("component", "kind", "seq")


@query("signals", sql=f"SELECT seq, {ANOMALY} AND {RANK} >= 2 AS is_error, {ANOMALY} AND {RANK} = 1 AS is_warn FROM signals")
def anomaly_classes(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    odd, r = text.is_anomaly(F.col("kind"), F.col("severity")), text.rank(F.col("severity"))
    return s.select("seq", (odd & (r >= 2)).alias("is_error"), (odd & (r == 1)).alias("is_warn"))
