"""Queries of the functions that make text for people."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as D
from ..sources.adapters import pick, view
from .catalog import query

H = "floor({} + 0.5)"
TWO = lambda big, small, most, a, b: f"(SELECT n::BIGINT || ' {a}' || CASE WHEN r > 0 THEN ' ' || r::BIGINT || ' {b}' ELSE '' END FROM (SELECT CASE WHEN q = {most} THEN p + 1 ELSE p END AS n, CASE WHEN q = {most} THEN 0 ELSE q END AS r FROM (SELECT floor(a / {big}) AS p, floor((a - floor(a / {big}) * {big}) / {small} + 0.5) AS q)))"
DURATION = f"""CASE WHEN ms IS NULL THEN '—' ELSE CASE WHEN ms < 0 THEN '−' ELSE '' END || CASE WHEN a < 1000 THEN floor(a + 0.5)::BIGINT || ' ms' WHEN a < 10000 THEN regexp_replace(printf('%.1f', floor(a / 100 + 0.5) / 10), '\\.0$', '') || ' s'
  WHEN a < 60000 THEN floor(a / 1000 + 0.5)::BIGINT || ' s' WHEN a < 3600000 THEN CASE WHEN s1 > 0 AND s1 < 60 AND m1 < 10 THEN m1::BIGINT || ' min ' || s1::BIGINT || ' s' ELSE floor(a / 60000 + 0.5)::BIGINT || ' min' END
  WHEN a < 172800000 THEN {TWO('3600000', '60000', 60, 'h', 'min')} ELSE {TWO('86400000', '3600000', 24, 'd', 'h')} END END"""
SPREAD = "CASE seq % 7 WHEN 0 THEN NULL WHEN 1 THEN floor(value * 9) WHEN 2 THEN floor(value * 600) WHEN 3 THEN -floor(value * 40000) WHEN 4 THEN floor(value * 1700000) WHEN 5 THEN floor(value * 3000000) ELSE floor(value * 36000) END"


@query("signals", sql=f"v AS (SELECT seq, {SPREAD}::DOUBLE AS ms FROM signals), w AS (SELECT *, abs(ms) AS a, floor(abs(ms) / 60000) AS m1, floor((abs(ms) - floor(abs(ms) / 60000) * 60000) / 1000 + 0.5) AS s1 FROM v) SELECT seq, {DURATION} AS text FROM w")
def duration_text(spark, sf_dir):
    return view(spark, sf_dir, "signals").select("seq", D.duration(F.expr(f"cast({SPREAD} as double)")).alias("text"))


PCT = "CASE WHEN p IS NULL THEN '—' WHEN p = 0 THEN '0%' WHEN abs(p) >= 100 THEN printf('%.0f', p) || '%' WHEN abs(p) >= 1 THEN regexp_replace(printf('%.1f', p), '\\.?0+$', '') || '%' WHEN abs(p) >= 0.1 THEN regexp_replace(printf('%.2f', p), '\\.?0+$', '') || '%' WHEN abs(p) >= 0.0005 THEN regexp_replace(printf('%.3f', p), '\\.?0+$', '') || '%' WHEN p > 0 THEN '<0.001%' ELSE '>−0.001%' END"
SHARES = "CASE seq % 6 WHEN 0 THEN NULL WHEN 1 THEN seq / 7.0 WHEN 2 THEN -(seq % 997) / 313.0 WHEN 3 THEN (seq % 89) / 8111.0 WHEN 4 THEN (seq % 11) / 70001.0 ELSE 0 END"


@query("signals", sql=f"v AS (SELECT seq, ({SHARES})::DOUBLE AS p FROM signals) SELECT seq, {PCT} AS pct, {PCT.replace('p)', 'p * 100)').replace('p IS', 'p * 100 IS').replace('p = 0', 'p * 100 = 0').replace('p > 0', 'p * 100 > 0')} AS ratio FROM v")
def percent_text(spark, sf_dir):
    p = F.expr(f"cast({SHARES.replace('.0', 'D')} as double)")
    return view(spark, sf_dir, "signals").select("seq", D.percent(p).alias("pct"), D.ratio(p).alias("ratio"))


@query("signals", sql="""o AS (SELECT seq, ts_ms, CASE seq % 4 WHEN 0 THEN 0 WHEN 1 THEN 330 WHEN 2 THEN -210 END AS mins FROM signals), t AS (SELECT *, make_timestamp((ts_ms + coalesce(mins, 0) * 60000) * 1000) AS t FROM o)
SELECT seq, strftime(t, '%H:%M:%S') AS clock, strftime(t, '%Y-%m-%d %H:%M:%S') || CASE WHEN coalesce(mins, 0) = 0 THEN 'Z' ELSE CASE WHEN mins < 0 THEN '-' ELSE '+' END || lpad((abs(mins) // 60)::VARCHAR, 2, '0') || ':' || lpad((abs(mins) % 60)::VARCHAR, 2, '0') END AS dated,
strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM t""")
def clock_text(spark, sf_dir):
    m = F.when(F.col("seq") % 4 == 0, 0).when(F.col("seq") % 4 == 1, 330).when(F.col("seq") % 4 == 2, -210)
    return view(spark, sf_dir, "signals").select("seq", D.clock(F.col("ts_ms"), m).alias("clock"), D.dated(F.col("ts_ms"), m).alias("dated"), D.iso(F.col("ts_ms")).alias("iso"))


@query("log_lines", sql="""SELECT seq, CASE WHEN length(body) > 30 THEN body[1:29] || '…' ELSE body END AS short, '"' || CASE WHEN length(trim(body)) > 40 THEN trim(body)[1:39] || '…' ELSE trim(body) END || '"' AS quoted,
replace(replace(replace(replace(replace(body, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html, least(greatest(seq % 90 - 20, 0.0), 50.0)::DOUBLE AS held FROM log_lines""")
def shortened_text(spark, sf_dir):
    b = F.col("body")
    return view(spark, sf_dir, "log_lines").select("seq", D.truncated(b, 30).alias("short"), D.quoted(b, 40).alias("quoted"), D.html(b).alias("html"), D.clamp((F.col("seq") % 90 - 20).cast("double"), 0.0, 50.0).alias("held"))


@query("faults", sql="""c AS (SELECT component, count(*) AS n, list(DISTINCT kind) AS k FROM faults WHERE seq % 3 = 0 OR kind = 'timeout' GROUP BY ALL)
SELECT component, n || CASE WHEN n = 1 THEN ' error' ELSE ' errors' END AS many, CASE WHEN n = 1 THEN 'once' ELSE n || ' times' END AS often, CASE """ + " ".join(f"WHEN list_contains(k, '{k}') THEN '{v}'" for k, v in D.STATES) + " ELSE 'failing' END AS state FROM c")
def state_sentences(spark, sf_dir):
    g = view(spark, sf_dir, "faults").filter("seq % 3 = 0 or kind = 'timeout'").groupBy("component").agg(F.count("*").alias("n"), F.collect_set("kind").alias("k"))
    return g.select("component", D.counted(F.col("n"), "error").alias("many"), D.times(F.col("n")).alias("often"), D.state_words(F.col("k")).alias("state"))


@query("components", sql="""SELECT id, 'kubectl' || CASE WHEN traced THEN ' --context ' || cluster ELSE '' END || CASE WHEN type <> 'node' THEN ' -n ' || namespace ELSE '' END AS checks, 'kubectl --context ' || CASE WHEN traced THEN cluster ELSE '<kube-context>' END || ' -n ' || namespace AS changes,
' -n ' || namespace || CASE WHEN traced THEN ' --kube-context ' || cluster ELSE '' END AS flags, CASE WHEN type = 'datastore' THEN 'statefulset/' WHEN type = 'infra' THEN 'daemonset/' ELSE 'deployment/' END || name AS workload,
'Pause auto-sync of a GitOps controller first: argocd app set <app> --sync-policy none, or flux suspend helmrelease ' || CASE WHEN user_facing THEN '<name>' ELSE release END || ' -n ' || namespace AS caveat FROM components""")
def command_templates(spark, sf_dir):
    c = view(spark, sf_dir, "components")
    cluster, known, ns = F.col("cluster"), F.col("traced"), F.col("namespace")
    controller = F.when(F.col("type") == "datastore", "StatefulSet").when(F.col("type") == "infra", "DaemonSet")
    return c.select("id", D.check_command(cluster, known, ns, F.col("type")).alias("checks"), D.change_command(cluster, known, ns).alias("changes"), D.release_flags(cluster, known, ns).alias("flags"), D.workload_ref(controller, F.col("name")).alias("workload"), D.gitops_caveat(F.when(~F.col("user_facing"), F.col("release")), ns).alias("caveat"))


ISSUER = ["  Message:   Vault failed to sign  certificate: Error making API request. URL: PUT https://v.example.com/v1/pki Code: 403. Errors: * permission denied #", "order #: ACME order is invalid", "x failed to renew certificate #", "no telling words here #"]


@query("signals", sql=f"""m AS (SELECT seq, replace({pick('seq', ISSUER)}, '#', user_id::VARCHAR) AS line FROM signals), a AS (SELECT seq, trim(regexp_replace(regexp_replace(line, '^\\s*Message:\\s*', ''), '\\s+', ' ', 'g')) AS t FROM m),
b AS (SELECT seq, regexp_replace(regexp_replace(regexp_replace(t, 'Error making API request\\.?\\s*', '', 'gi'), 'URL: \\S+ \\S+\\s*', '', 'gi'), '\\*\\s*', '', 'g') AS t FROM a)
SELECT seq, coalesce(nullif(regexp_extract(t, '(?i)((?:Vault|issuer|ACME|failed to (?:sign|issue|renew)).*)$', 1), ''), t) AS error FROM b""")
def issuer_errors(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    return s.select("seq", D.issuer_error(F.replace(F.expr(pick("seq", ISSUER).replace("\\", "\\\\")), F.lit("#"), F.col("user_id").cast("string"))).alias("error"))


SAID = [("very high", "High", " HIGH "), ("60 %", "OOM", "low"), ("0.4", "connection pool", "none"), ("85", "tls_cert", "Medium"), ("perhaps", "Bad Release", ""), ("moderate", "dns", "High"), ("250", "Config", "low")]


@query("signals", sql="SELECT seq, " + ", ".join(f"CASE seq % {len(SAID)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(vs)) + f" END AS {n}" for n, vs in (("confidence", ["0.8::DOUBLE", "0.6", "0.4", "0.85", "NULL", "0.55", "1.0"]), ("category", ["'high'", "'resource-limits'", "'connection-exhaustion'", "'tls-cert'", "'bad-deploy'", "'dns'", "'config-error'"]), ("risk", ["'high'", "'low'", "''", "'medium'", "''", "'high'", "'low'"]))) + " FROM signals")
def stated_values(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    said = lambda i: F.expr(pick("seq", [x[i] for x in SAID]))
    return s.select("seq", D.confidence_of(said(0)).alias("confidence"), D.category_of(said(1)).alias("category"), D.risk_of(said(2)).alias("risk"))


FIELDS = ["spec.template.spec.containers[web].resources.limits.memory", "containers[web].image", "spec.containers[api].env[DB_HOST]", "spec.replicas", "containers[web].readinessProbe.timeoutSeconds", "data.password", "data.config", "spec.type"]
KINDS = ["resources", "image", "env", "replicas", "probe", "secret", "configmap", "service"]
MOVED = "CASE WHEN b IS NULL THEN 'set to ' || a WHEN a IS NULL THEN 'removed' ELSE b || ' → ' || a END"


@query("changes", sql=f"""c AS (SELECT id, split_part(id, '-', 2)::BIGINT AS k, CASE WHEN line % 5 <> 0 THEN before END AS b, CASE WHEN line % 5 = 0 OR line % 7 <> 0 THEN after END AS a FROM changes)
SELECT id, CASE k % 8 WHEN 0 THEN 'web memory limit ' || CASE WHEN a IS NULL THEN b || ' removed' ELSE {MOVED} END WHEN 1 THEN 'web image ' || {MOVED} WHEN 2 THEN CASE WHEN b IS NULL THEN 'env DB_HOST added' WHEN a IS NULL THEN 'env DB_HOST removed' ELSE 'env DB_HOST: ' || {MOVED} END
WHEN 3 THEN 'Deployment app replicas ' || {MOVED} WHEN 4 THEN 'web readiness probe timeoutSeconds ' || {MOVED} WHEN 5 THEN 'Deployment app password' || CASE WHEN b IS NULL THEN ' added' WHEN a IS NULL THEN ' removed' ELSE ' changed' END || ' (value redacted)'
WHEN 6 THEN 'Deployment app config: ' || CASE WHEN b IS NULL THEN 'added' ELSE {MOVED} END ELSE 'Deployment app spec.type ' || CASE WHEN b IS NULL THEN 'added' ELSE {MOVED} END END AS summary FROM c""")
def change_summaries(spark, sf_dir):
    c = view(spark, sf_dir, "changes").withColumn("k", F.split("id", "-")[1].cast("long"))
    before, after = F.when(F.col("line") % 5 != 0, F.col("before")), F.when((F.col("line") % 5 == 0) | (F.col("line") % 7 != 0), F.col("after"))
    return c.select("id", D.change_summary(F.expr(pick("k", KINDS)), F.expr(pick("k", FIELDS)), F.lit("Deployment"), F.lit("app"), before, after).alias("summary"))
