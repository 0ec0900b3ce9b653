"""Queries of scalar rules over texts that are built from the tables' numbers, so that there are as many as rows and each has a known reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, text, times
from ..operators import lookup
from ..sources.adapters import pick, view
from .catalog import query


def both(expression: str) -> tuple[str, str]:
    """An expression for DuckDB and for Spark: varchar(20) and // there, div here."""
    return expression, expression.replace("//", "div")


S = lambda x: f"cast({x} as varchar(20))"
D, H, M = "user_id % 30", "seq % 24", "seq // 24 % 60"
AGE_SQL, AGE = both(f"CASE seq % 5 WHEN 0 THEN concat({S(D)}, 'd', {S(H)}, 'h') WHEN 1 THEN concat({S(H)}, 'h', {S(M)}, 'm') WHEN 2 THEN concat({S(M)}, '.5s') WHEN 3 THEN concat({S('seq')}, 'ms (x3 over 1h)') ELSE concat('about ', {S(M)}, 'm') END")


@query("signals", sql=f"SELECT seq, CASE seq % 5 WHEN 0 THEN {D} * 86400000 + {H} * 3600000 WHEN 1 THEN {H} * 3600000 + {M} * 60000 WHEN 2 THEN {M} * 1000 + 500 WHEN 3 THEN seq END::BIGINT AS age_ms FROM signals")
def ages_of_numbers(spark, sf_dir):
    return view(spark, sf_dir, "signals").select("seq", F.expr(AGE).alias("t")).select("seq", times.age_ms(F.col("t")).alias("age_ms"))


@query("signals", sql="SELECT seq, CASE WHEN seq % 17 <= 14 THEN CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END * (seq % 17 * 60 + user_id % 60) END::INT AS minutes FROM signals")
def offsets_of_numbers(spark, sf_dir):
    colon = F.when(F.col("seq") % 3 == 0, "").otherwise(":")
    zone = F.concat(F.when(F.col("seq") % 4 == 0, "UTC").otherwise(""), F.when(F.col("user_id") % 2 == 0, "+").otherwise("-"), F.lpad((F.col("seq") % 17).cast("string"), 2, "0"), colon, F.lpad((F.col("user_id") % 60).cast("string"), 2, "0"))
    return view(spark, sf_dir, "signals").select("seq", zone.alias("t")).select("seq", times.offset_minutes(F.col("t")).cast("int").alias("minutes"))


UNITS = [("Ki", 1024), ("Mi", 1024**2), ("Gi", 1024**3), ("m", 0.001), ("", 1), ("k", 1000), ("M", 1_000_000), ("bytes", None)]


@query("signals", sql="SELECT seq, user_id::DOUBLE * CASE seq % 8 " + " ".join(f"WHEN {i} THEN {'NULL' if f is None else f}::DOUBLE" for i, (_, f) in enumerate(UNITS)) + " END AS number FROM signals")
def quantities_of_numbers(spark, sf_dir):
    rows = view(spark, sf_dir, "signals").select("seq", F.concat(F.col("user_id").cast("string"), F.expr(pick("seq", [u for u, _ in UNITS]))).alias("t"))
    return rows.select("seq", times.quantity(F.col("t")).alias("number"))


WORK = "concat('app-', cast(user_id as varchar(20)), '-api')"
SET = "lpad(cast(seq % 100000000 as varchar(20)), 9, '7')"
POD = f"CASE seq % 4 WHEN 0 THEN concat({WORK}, '-', {SET}, '-x', lpad(cast(seq % 10000 as varchar(20)), 4, '0')) WHEN 1 THEN concat({WORK}, '-x', lpad(cast(seq % 10000 as varchar(20)), 4, '0')) WHEN 2 THEN concat({WORK}, '-', cast(seq % 1000 as varchar(20))) ELSE upper({WORK}) END"


@query("signals", sql=f"SELECT seq, {WORK} AS workload, CASE seq % 4 WHEN 0 THEN 'Deployment' WHEN 1 THEN 'DaemonSet' WHEN 2 THEN 'StatefulSet' END AS controller, CASE WHEN seq % 4 = 0 THEN concat({WORK}, '-', {SET}) END AS replica_set FROM signals")
def pods_of_names(spark, sf_dir):
    o = names.pod_owner(F.col("t"))
    return view(spark, sf_dir, "signals").select("seq", F.expr(POD).alias("t")).select("seq", o["workload"].alias("workload"), o["controller"].alias("controller"), o["replica_set"].alias("replica_set"))


HOST = f"CASE seq % 5 WHEN 0 THEN concat('http://', {WORK}, '.', cluster, '.svc.cluster.local:8080/x') WHEN 1 THEN concat({WORK}, '.example.com') WHEN 2 THEN concat('10.0.', cast(user_id % 256 as varchar(20)), '.', cast(seq % 256 as varchar(20)), ':443') WHEN 3 THEN concat('HTTPS://', {WORK}, ':', cast(seq % 9000 as varchar(20))) ELSE concat({WORK}, '.', cluster, '.svc') END"


@query("signals", sql=f"SELECT seq, CASE seq % 5 WHEN 1 THEN {WORK} || '.example.com' WHEN 2 THEN NULL ELSE {WORK} END AS name, CASE WHEN seq % 5 IN (0, 4) THEN cluster END AS namespace, CASE WHEN seq % 5 <> 2 THEN seq % 5 = 1 END AS external FROM signals")
def hosts_of_names(spark, sf_dir):
    h = names.host_parts(F.col("t"))
    return view(spark, sf_dir, "signals").select("seq", F.expr(HOST).alias("t")).select("seq", h["name"].alias("name"), h["namespace"].alias("namespace"), h["external"].alias("external"))


ROLLED = f"CASE seq % 4 WHEN 0 THEN concat('Scaled up replica set ', {WORK}, '-', {SET}, ' to ', cast(user_id % 9 as varchar(20))) WHEN 1 THEN concat('Scaled down replica set ', upper({WORK}), '-', {SET}, ' from 4 to ', cast(user_id % 9 as varchar(20))) WHEN 2 THEN concat('Created pod: ', {WORK}, '-', {SET}, '-x', lpad(cast(seq % 10000 as varchar(20)), 4, '0')) ELSE 'Started container web' END"


@query("signals", sql=f"SELECT seq, CASE WHEN seq % 4 < 3 THEN {WORK} || '-' || {SET} END AS replica_set, CASE WHEN seq % 4 < 2 THEN user_id % 9 END::INT AS replicas, CASE seq % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS direction, CASE WHEN seq % 4 = 2 THEN {WORK} || '-' || {SET} || '-x' || lpad((seq % 10000)::VARCHAR, 4, '0') END AS pod FROM signals")
def rollout_attributes(spark, sf_dir):
    return view(spark, sf_dir, "signals").select("seq", names.rollout_attributes(F.expr(ROLLED)).alias("r")).select("seq", "r.*")


NAMED = f"CASE seq % 6 WHEN 0 THEN {WORK} WHEN 1 THEN concat('orders-db-', cast(user_id as varchar(20))) WHEN 2 THEN 'coredns' ELSE '' END"


@query("signals", sql=f"""n AS (SELECT seq, component, cluster AS cl, CASE seq % 6 WHEN 0 THEN {WORK} WHEN 1 THEN 'orders-db-' || user_id WHEN 2 THEN 'coredns' WHEN 3 THEN {WORK} WHEN 4 THEN 'node-' || user_id END AS name,
  CASE seq % 6 WHEN 1 THEN 'datastore' WHEN 2 THEN 'infra' WHEN 4 THEN 'node' ELSE 'service' END AS type, CASE WHEN seq % 6 = 4 THEN '' WHEN seq % 6 = 2 THEN 'kube-system' WHEN seq % 5 <> 0 THEN component END AS ns, CASE WHEN seq % 3 <> 0 THEN cluster END AS c FROM signals)
SELECT seq, type || ':' || coalesce(c, 'cluster-1') || '/' || coalesce(ns, 'default') || '/' || name AS id, type, name, c IS NOT NULL AS cluster_known, ns IS NOT NULL AS ns_known, CASE WHEN seq % 6 = 3 THEN 'Deployment' END AS controller FROM n WHERE name IS NOT NULL""")
def entity_hints(spark, sf_dir):
    s, n = view(spark, sf_dir, "signals"), F.col("seq")
    pod = F.when(n % 6 == 3, F.expr(f"concat({WORK}, '-', {SET}, '-x', lpad(cast(seq % 10000 as varchar(20)), 4, '0'))"))
    node = F.when(n % 6 == 4, F.concat(F.lit("node-"), F.col("user_id").cast("string")))
    hint = names.entity_hint(F.expr(NAMED), F.when(n % 5 != 0, F.col("component")), F.when(n % 3 != 0, F.col("cluster")), pod, node, F.when(n % 6 == 1, "service"))
    return s.select("seq", hint.alias("h")).filter("h is not null").select("seq", "h.id", "h.type", "h.name", "h.cluster_known", "h.ns_known", "h.controller")


@query("log_lines", sql="SELECT seq, regexp_replace(regexp_replace(body, '[^ ]+@example.com', '[REDACTED:email]'), 'token=.*efgh', 'token=[REDACTED:secret-value]') AS body FROM log_lines WHERE seq % 20 = 19 ORDER BY seq LIMIT 40")
def search_redacted(spark, sf_dir):
    """Nothing is found by a secret's own text, which is replaced before the search."""
    rows = view(spark, sf_dir, "log_lines").withColumn("source", F.lit("logs"))
    return lookup.search(rows, "token=[redacted", source="logs", redact=True).select("seq", "body").unionByName(lookup.search(rows, "abcd", source="logs", redact=True).select("seq", "body"))


@query("signals", sql="SELECT seq, 'a' || seq || chr(10) || '[REDACTED:private-key]' || repeat(chr(10), (seq % 4 + 2)::INT) || 'mail [REDACTED:email] now' AS body, 1 AS keys, 1 AS emails, 'u' || seq || '@example.com' AS id FROM signals")
def scrubbed_panes(spark, sf_dir):
    """Panes with keys of several lines: redacted, with as many lines as before; ids are left alone."""
    s = view(spark, sf_dir, "signals")
    key = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.repeat(F.lit("MIIE\n"), (F.col("seq") % 4 + 1).cast("int")), F.lit("-----END RSA PRIVATE KEY-----"))
    mail = F.concat(F.lit("u"), F.col("seq").cast("string"), F.lit("@example.com"))
    panes = s.select("seq", F.concat(F.lit("a"), F.col("seq").cast("string"), F.lit("\n"), key, F.lit("mail "), mail, F.lit(" now")).alias("body"), mail.alias("id"))
    out = text.redacted_pane(text.scrubbed(panes.select("seq", "id")).join(panes.select("seq", "body"), "seq"), "body")
    return out.select("seq", "body", F.col("counts")["private-key"].cast("int").alias("keys"), F.col("counts")["email"].cast("int").alias("emails"), "id")
