"""Queries of the operators that hold relations against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate as C
from ..operators import entities as E
from ..sources.adapters import view
from .catalog import RANK, query, read


@query("faults", sql="SELECT seq, CASE WHEN kind = 'span_error' AND cause IN ('dns_failure', 'tls_error', 'conn_exhaustion') THEN cause ELSE kind END AS counts_as FROM faults")
def span_mechanism(spark, sf_dir):
    return view(spark, sf_dir, "faults").select("seq", C.mechanism(F.col("kind"), F.col("cause")).alias("counts_as"))


@query("faults", sql=f"SELECT component, count(*) FILTER (type <> 'node' OR kind IN ('node_not_ready', 'node_pressure', 'evicted')) AS hard, count(*) FILTER (type = 'node' AND kind NOT IN ('node_not_ready', 'node_pressure', 'evicted')) AS soft FROM faults WHERE {RANK} >= 2 GROUP BY ALL")
def node_error_gate(spark, sf_dir):
    return C.node_counts(view(spark, sf_dir, "faults"))


STORES = """st AS (SELECT min(id) AS id, name, cluster, CASE WHEN bool_and(traced) THEN NULL ELSE min(namespace) END AS namespace, bool_or(traced) AS traced_only FROM components GROUP BY ALL),
hi AS (SELECT DISTINCT f.cluster AS from_cluster, st.id AS to_id, st.name AS to_name, st.cluster AS to_cluster FROM faults f JOIN st ON st.name = f.name AND st.cluster = 'c' || (f.seq % 2 + 1) WHERE f.type = 'datastore' AND (f.seq % 2 = f.seq // 2 % 2 OR f.cluster = 'c2')),"""


def _stores(spark, sf_dir):
    g = view(spark, sf_dir, "components").groupBy("name", "cluster").agg(F.min("id").alias("id"), F.bool_and("traced").alias("all"), F.min("namespace").alias("ns"), F.bool_or("traced").alias("traced_only"))
    return g.select("id", "name", "cluster", F.when(~F.col("all"), F.col("ns")).alias("namespace"), "traced_only")


def _store_hints(spark, sf_dir):
    f = view(spark, sf_dir, "faults").filter("type = 'datastore' and (seq % 2 = (seq div 2) % 2 or cluster = 'c2')").select("name", F.col("cluster").alias("from_cluster"), F.concat(F.lit("c"), (F.col("seq") % 2 + 1).cast("string")).alias("to_cluster")).distinct()
    c = _stores(spark, sf_dir).select("name", F.col("id").alias("to_id"), F.col("cluster").alias("to_cluster"))
    return f.join(c, ["name", "to_cluster"]).select("from_cluster", "to_id", F.col("name").alias("to_name"), "to_cluster")


@query("components", "faults", sql=STORES + """
re AS (SELECT from_cluster AS cluster, to_name AS name, min(to_id) AS target FROM hi WHERE from_cluster <> to_cluster GROUP BY ALL HAVING count(DISTINCT to_id) = 1),
al AS (SELECT name, cluster, min(id) AS id FROM st GROUP BY ALL HAVING count(*) = 1 AND bool_and(traced_only AND namespace IS NULL)) SELECT id, target FROM al JOIN re USING (name, cluster) WHERE id <> target""")
def cross_cluster_stores(spark, sf_dir):
    return C.folded_stores(_stores(spark, sf_dir), _store_hints(spark, sf_dir))


@query("faults", "components", sql=r"""w AS (SELECT name AS process, cluster, min(id) AS patient FROM components WHERE type <> 'node' GROUP BY ALL HAVING count(DISTINCT id) = 1),
p AS (SELECT *, CASE WHEN kind = 'oom_killed' AND type = 'node' THEN lower(coalesce(nullif(regexp_extract(text, 'Killed process \d+ \(([^)]+)\)', 1), ''), nullif(regexp_extract(text, '\b([a-z0-9][\w.-]*) invoked oom-killer', 1), ''), nullif(regexp_extract(text, 'task=([^,\s]+)', 1), ''))) END AS process FROM faults)
SELECT seq, coalesce(patient, component) AS component, CASE WHEN patient IS NOT NULL THEN component END AS moved_from FROM p LEFT JOIN w USING (process, cluster)""")
def oom_reattributed(spark, sf_dir):
    return C.reattributed(view(spark, sf_dir, "faults"), view(spark, sf_dir, "components")).select("seq", "component", "moved_from")


HINTS = """hn AS (SELECT component AS "from", CASE WHEN seq % 9 = 0 THEN 'infra:' || cluster || '/kube-system/coredns' ELSE 'service:' || cluster || '/' || coalesce(target_namespace, 'x') || '/app-' || (seq % 20) END AS "to",
  CASE WHEN seq % 4 = 0 THEN 'external' ELSE 'service' END AS to_type, CASE WHEN seq % 5 = 0 THEN 'ingress' END AS from_role, CASE WHEN seq % 2 = 0 THEN 'dns_failure' ELSE kind END AS kind, ts_ms FROM faults),
h AS (SELECT "from", "to", to_type, from_role, list_sort(list(DISTINCT kind)) AS kinds, count(*) AS n, min(ts_ms) AS first_ms FROM hn GROUP BY ALL),
e AS (SELECT component AS "from", 'service:' || cluster || '/' || coalesce(target_namespace, 'x') || '/app-' || (seq % 20) AS "to", count(*) AS calls, count(*) FILTER (severity = 'error') AS errors, min(CASE WHEN severity = 'error' THEN ts_ms END) AS first_error_ms FROM faults WHERE source = 'traces' GROUP BY ALL)"""


def _hinted(spark, sf_dir):
    f = view(spark, sf_dir, "faults")
    to = F.concat(F.lit("service:"), "cluster", F.lit("/"), F.coalesce("target_namespace", F.lit("x")), F.lit("/app-"), (F.col("seq") % 20).cast("string"))
    edges = f.filter("source = 'traces'").select(F.col("component").alias("from"), to.alias("to"), "severity", "ts_ms").groupBy("from", "to")
    edges = edges.agg(F.count("*").alias("calls"), F.count_if(F.col("severity") == "error").alias("errors"), F.min(F.when(F.col("severity") == "error", F.col("ts_ms"))).alias("first_error_ms"))
    h = f.select(
        F.col("component").alias("from"), F.when(F.col("seq") % 9 == 0, F.concat(F.lit("infra:"), "cluster", F.lit("/kube-system/coredns"))).otherwise(to).alias("to"), F.when(F.col("seq") % 4 == 0, "external").otherwise("service").alias("to_type"),
        F.when(F.col("seq") % 5 == 0, "ingress").alias("from_role"), F.when(F.col("seq") % 2 == 0, "dns_failure").otherwise(F.col("kind")).alias("kind"), "ts_ms",
    )
    return edges, h.groupBy("from", "to", "to_type", "from_role").agg(F.collect_set("kind").alias("kinds"), F.count("*").alias("count"), F.min("ts_ms").alias("first_ms"))


@query("faults", sql=HINTS + """, g AS (SELECT "from", "to", sum(n)::BIGINT AS n, min(first_ms) AS hint_ms FROM h WHERE "from" <> "to" AND (kinds <> ['dns_failure'] OR contains("to", 'coredns')) AND NOT (coalesce(from_role, '') = 'ingress' AND to_type = 'external') GROUP BY ALL)
SELECT "from", "to", coalesce(calls, n) AS calls, coalesce(errors, n) AS errors, coalesce(n, 0) AS log_errors, CASE WHEN calls IS NOT NULL THEN first_error_ms ELSE hint_ms END AS first_error_ms,
CASE WHEN calls IS NULL THEN 'logs' WHEN n IS NOT NULL THEN 'both' ELSE 'traces' END AS source FROM e FULL JOIN g USING ("from", "to")""")
def edges_with_log_hints(spark, sf_dir):
    return C.with_log_hints(*_hinted(spark, sf_dir))


ACCESS = """al AS (SELECT component AS "from", cluster, namespace || '-' || CASE WHEN seq % 4 = 0 THEN 'app' ELSE 'app-' || (seq % 60) END AS token, CASE WHEN severity = 'error' THEN 502 ELSE 200 END AS status, ts_ms FROM faults),
up AS (SELECT "from", cluster, token, count(*) AS calls, count(*) FILTER (status >= 500) AS errors, min(CASE WHEN status >= 500 THEN ts_ms END) AS first_error_ms FROM al GROUP BY ALL)"""


def _access(spark, sf_dir):
    token = F.concat("namespace", F.lit("-"), F.when(F.col("seq") % 4 == 0, "app").otherwise(F.concat(F.lit("app-"), (F.col("seq") % 60).cast("string"))))
    return view(spark, sf_dir, "faults").select(F.col("component").alias("from"), "cluster", token.alias("token"), F.when(F.col("severity") == "error", 502).otherwise(200).alias("status"), "ts_ms")


@query("faults", sql=ACCESS + """ SELECT "from", token, sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors, min(first_error_ms) AS first_error_ms FROM up GROUP BY ALL""")
def upstream_access(spark, sf_dir):
    return C.upstream_counts(_access(spark, sf_dir))


@query("faults", "components", sql=ACCESS + """, hit AS (SELECT t.cluster, t.token, min(c.id) AS target FROM (SELECT DISTINCT cluster, token FROM up) t JOIN components c ON c.cluster = t.cluster AND c.namespace || '-' || c.name = t.token AND c.type IN ('service', 'datastore') GROUP BY ALL HAVING count(DISTINCT c.id) = 1)
SELECT DISTINCT "from", token, target FROM up JOIN hit USING (cluster, token)""")
def upstream_edges(spark, sf_dir):
    tokens = _access(spark, sf_dir).select("from", "cluster", "token").distinct()
    return C.upstream_targets(tokens, view(spark, sf_dir, "components")).select("from", "token", "target")


@query("deploys", "changes", sql="""s AS (SELECT release, line::BIGINT % 50 AS revision, arg_min(id, line * 1000000 + split_part(id, '-', 2)::BIGINT % 1000000) AS signal_id FROM changes GROUP BY ALL)
SELECT seq, signal_id FROM deploys LEFT JOIN s USING (release, revision)""")
def deploy_signal_ids(spark, sf_dir):
    number = F.split("id", "-")[1].cast("long")
    # Numbers that are equal modulo a million tie: the first in the table's order stays.
    s = view(spark, sf_dir, "changes").select("id", "release", (F.col("line").cast("long") % 50).alias("revision"), F.struct((F.col("line") * 1000000 + number % 1000000).alias("place"), number.alias("number")).alias("seq"))
    return C.deploy_signals(view(spark, sf_dir, "deploys"), s).select("seq", "signal_id")


@query("deploys", "faults", sql="""h AS (SELECT name, min(ts_ms) AS rollout_ms FROM faults WHERE kind = 'rollout' GROUP BY ALL)
SELECT seq, coalesce(deployed_ms, rollout_ms) AS deployed_ms, CASE WHEN deployed_ms IS NOT NULL THEN 'history' WHEN rollout_ms IS NOT NULL THEN 'rollout-event' END AS time_source FROM deploys LEFT JOIN h USING (name)""")
def deploy_handoff_times(spark, sf_dir):
    d = view(spark, sf_dir, "deploys").withColumnRenamed("name", "component")
    return C.deploy_times(d, view(spark, sf_dir, "faults").filter("kind = 'rollout'").select(F.col("name").alias("component"), "ts_ms")).select("seq", "deployed_ms", "time_source")


@query("changes", "deploys", sql="""d AS (SELECT * FROM deploys WHERE seq % 6 <> 0), r AS (SELECT release, max(deployed_ms) AS rm FROM d WHERE release NOT LIKE '%7' GROUP BY ALL), n AS (SELECT name, max(deployed_ms) AS nm FROM d GROUP BY ALL)
SELECT id, CASE WHEN r.release IS NOT NULL THEN rm ELSE nm END AS changed_ms FROM changes LEFT JOIN r USING (release) LEFT JOIN n USING (name)""")
def change_deploy_times(spark, sf_dir):
    d = view(spark, sf_dir, "deploys").filter("seq % 6 <> 0").select(F.when(~F.col("release").endswith("7"), F.col("release")).alias("release"), F.col("name").alias("component"), "deployed_ms")
    return C.change_times(view(spark, sf_dir, "changes").withColumnRenamed("name", "component"), d).select("id", "changed_ms")


@query("components", "faults", sql=r"""ct AS (SELECT seq, name || CASE seq % 4 WHEN 0 THEN '-tls' WHEN 1 THEN '-mtls' WHEN 2 THEN '-Cert' ELSE '' END AS cert, target_namespace AS ns FROM faults), b AS (SELECT *, regexp_replace(cert, '(?i)-(m?tls|cert|certificate|tls-cert)$', '') AS base FROM ct),
p AS (SELECT name AS base, namespace AS ns, min(id) AS there FROM components WHERE type <> 'node' GROUP BY ALL), a AS (SELECT name AS base, min(id) AS anywhere FROM components WHERE type <> 'node' GROUP BY ALL)
SELECT seq, cert AS name, CASE WHEN b.ns IS NULL THEN anywhere ELSE there END AS component FROM b LEFT JOIN p USING (base, ns) LEFT JOIN a USING (base)""")
def certificate_components(spark, sf_dir):
    ends = F.when(F.col("seq") % 4 == 0, "-tls").when(F.col("seq") % 4 == 1, "-mtls").when(F.col("seq") % 4 == 2, "-Cert").otherwise("")
    certs = view(spark, sf_dir, "faults").select("seq", F.concat("name", ends).alias("name"), F.col("target_namespace").alias("namespace"))
    return C.certificate_owners(certs, view(spark, sf_dir, "components")).select("seq", "name", "component")


@query("faults", "changes", sql="""b AS (SELECT * FROM faults WHERE kind IN ('conn_refused', 'timeout', 'span_error')), e AS (SELECT seq, ts_ms, namespace AS ns FROM b UNION SELECT seq, ts_ms, target_namespace FROM b),
c AS (SELECT ns, count(*) AS blocked, min(ts_ms) AS first_ms FROM e WHERE ns IS NOT NULL GROUP BY ALL) SELECT id AS policy, coalesce(blocked, 0) AS blocked, first_ms FROM changes LEFT JOIN c ON namespace = ns WHERE category = 'networkpolicy'""")
def network_policy_blast(spark, sf_dir):
    policies = view(spark, sf_dir, "changes").filter("category = 'networkpolicy'").select(F.col("id").alias("policy"), "namespace")
    return C.policy_blast(policies, view(spark, sf_dir, "faults"))


@query("changes", "deploys", sql="""d AS (SELECT DISTINCT release, app_to FROM deploys WHERE app_to IS NOT NULL), c AS (SELECT id, release, regexp_extract(after, ':([^:@/]+)$', 1) AS tag FROM changes WHERE category = 'image')
SELECT id, tag, app_to FROM c JOIN d USING (release) WHERE tag <> app_to AND regexp_replace(tag, '^[vV]', '') = regexp_replace(app_to, '^[vV]', '')""")
def image_tag_typos(spark, sf_dir):
    return C.mistyped_tags(view(spark, sf_dir, "changes"), view(spark, sf_dir, "deploys"))


@query("faults", "changes", sql="""n AS (SELECT name, cluster, count(*) AS n FROM faults WHERE kind = 'image_pull' GROUP BY ALL),
i AS (SELECT name, release, before, after FROM changes WHERE category = 'image' QUALIFY row_number() OVER (PARTITION BY name ORDER BY (NOT contains(field, 'containers['))::INT, line, id) = 1),
k AS (SELECT n.*, before IS NOT NULL AS has, CASE WHEN before IS NULL THEN name ELSE release || '|' || cluster || '|' || split_part(before, ':', 2) || '>' || split_part(after, ':', 2) END AS key FROM n LEFT JOIN i USING (name))
SELECT key, count(*) AS components, sum(n)::BIGINT AS pulls, count(*) FILTER (has) AS images FROM k GROUP BY ALL""")
def image_pull_groups(spark, sf_dir):
    pulls = view(spark, sf_dir, "faults").filter("kind = 'image_pull'").select(F.col("name").alias("component"), "cluster")
    rows = view(spark, sf_dir, "changes").withColumnRenamed("name", "component")
    # lines repeat here: the id decides
    return C.pull_groups(pulls, rows.withColumn("line", F.struct("line", "id")))


@query("deploys", "components", "changes", sql="""il AS (SELECT DISTINCT name, cluster FROM components WHERE status IN ('root', 'failing', 'degraded')), t AS (SELECT DISTINCT release, revision, il.cluster FROM deploys d JOIN il USING (name) WHERE il.cluster <> d.cluster),
no AS (SELECT DISTINCT 'c' || (line % 3) AS cluster, (line % 50)::BIGINT AS revision, CASE WHEN line % 7 = 0 THEN '' ELSE release END AS rel FROM changes)
SELECT release, revision, cluster, EXISTS (SELECT 1 FROM no WHERE no.cluster = t.cluster AND no.revision = t.revision AND (no.rel = '' OR no.rel = t.release)) AS noted FROM t""")
def rollback_sibling_clusters(spark, sf_dir):
    notes = view(spark, sf_dir, "changes").select(F.concat(F.lit("c"), (F.col("line") % 3).cast("string")).alias("cluster"), (F.col("line") % 50).cast("long").alias("revision"), F.when(F.col("line") % 7 != 0, F.col("release")).alias("release"))
    return C.rollback_siblings(view(spark, sf_dir, "deploys"), view(spark, sf_dir, "components"), notes)


@query("faults", sql="""s AS (SELECT source, source_line AS line, arg_min('sig-' || seq, seq) AS signal_id FROM faults WHERE kind <> 'change' GROUP BY ALL), l AS (SELECT DISTINCT source, source_line + 1 AS line FROM faults) SELECT source, line, signal_id FROM l LEFT JOIN s USING (source, line)""")
def line_signal_ids(spark, sf_dir):
    f = view(spark, sf_dir, "faults")
    lines = f.select("source", (F.col("source_line") + 1).alias("line")).distinct()
    return C.line_signals(lines, f.filter("kind <> 'change'").withColumn("id", F.concat(F.lit("sig-"), F.col("seq").cast("string"))))


@query("faults", sql="""m AS (SELECT component, seq, contains(text, 'expired') AS hit, ts_ms, ts_unknown FROM faults)
SELECT component, arg_min(seq, (CASE WHEN hit THEN 0 ELSE 1 END, CASE WHEN hit THEN 0 WHEN ts_ms IS NULL THEN 2 ELSE ts_unknown::INT END, CASE WHEN hit THEN 0 ELSE coalesce(ts_ms, 0) END, seq)) AS seq FROM m GROUP BY ALL""")
def telling_lines(spark, sf_dir):
    return C.telling_line(view(spark, sf_dir, "faults"), ["component"], "expired")


@query("components", "faults", sql=f"""b AS (SELECT component AS id, count(*) FILTER (source = 'traces') AS se, count(*) FILTER (source <> 'traces') AS oe FROM faults WHERE {RANK} >= 2 AND kind NOT IN ('change', 'alert_resolved') GROUP BY ALL),
k AS (SELECT DISTINCT component AS id FROM faults WHERE kind IN ('oom_killed', 'crash_loop', 'image_pull', 'config_error', 'conn_refused', 'tls_error', 'dns_failure')), i AS (SELECT DISTINCT component AS id FROM faults WHERE seq % 50 = 0)
SELECT c.id, NOT traced AS untraced, traced AND coalesce(oe, 0) > 0 AND coalesce(se, 0) = 0 AND c.id NOT IN (SELECT id FROM i) AND c.id NOT IN (SELECT id FROM k) AS silent FROM components c LEFT JOIN b USING (id) WHERE status IN ('root', 'failing') AND type IN ('service', 'infra')""")
def traced_but_silent(spark, sf_dir):
    f = view(spark, sf_dir, "faults")
    edges = f.filter("seq % 50 = 0").select(F.col("component").alias("to"), F.lit(1).alias("errors"), F.lit("ok").alias("status"))
    return C.silent_components(view(spark, sf_dir, "components"), f, edges)


@query("faults", "components", sql="""SELECT DISTINCT 'infra:' || f.cluster || '/kube-system/coredns' AS id, f.cluster FROM (SELECT * REPLACE (cluster || (seq % 4) AS cluster) FROM faults) f WHERE kind = 'span_error' AND cause = 'dns_failure' AND type <> 'node' AND f.cluster <> 'c12'""")
def coredns_nodes(spark, sf_dir):
    f = view(spark, sf_dir, "faults").filter("kind = 'span_error'").withColumn("cluster", F.concat("cluster", (F.col("seq") % 4).cast("string")))
    known = view(spark, sf_dir, "components").select("id").union(spark.createDataFrame([("infra:c12/kube-system/coredns",)], "id string"))
    return C.dns_components(f, known)


CLIENTS = """cp AS (SELECT c.*, coalesce(k.kinds, []) AS kinds FROM components c LEFT JOIN (SELECT component AS id, list(DISTINCT kind) AS kinds FROM faults GROUP BY ALL) k USING (id)),
ed AS (SELECT DISTINCT 'service:' || cluster || '/' || namespace || '/app-' || (seq % 6 + 4) AS "from", component AS "to" FROM faults WHERE seq % 40 = 0),
ill AS (SELECT * FROM cp WHERE type = 'service' AND status <> 'healthy'), sh AS (SELECT * FROM ill WHERE list_has_any(kinds, ['conn_exhaustion', 'db_error', 'hpa_maxed'])),
own AS (SELECT id AS target, id AS client FROM cp WHERE type = 'service'), cal AS (SELECT DISTINCT "to" AS target, "from" AS client FROM ed JOIN cp ON cp.id = "to" AND cp.type <> 'service' WHERE "from" IN (SELECT id FROM ill)),
nea AS (SELECT cp.id AS target, sh.id AS client FROM cp JOIN sh USING (cluster) WHERE cp.type <> 'service' AND cp.id NOT IN (SELECT target FROM cal) AND coalesce(sh.role, '') <> 'ingress'),
fnd AS (SELECT * FROM own UNION SELECT * FROM cal UNION SELECT * FROM nea)"""


@query("components", "faults", sql=CLIENTS + """ SELECT * FROM fnd UNION SELECT target, sh.id FROM fnd JOIN cp ON cp.id = client JOIN sh ON sh.name = cp.name""")
def clients_of_components(spark, sf_dir):
    f = view(spark, sf_dir, "faults")
    kinds = f.groupBy(F.col("component").alias("id")).agg(F.collect_set("kind").alias("kinds"))
    c = view(spark, sf_dir, "components").join(kinds, "id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    edges = f.filter("seq % 40 = 0").select(F.concat(F.lit("service:"), "cluster", F.lit("/"), "namespace", F.lit("/app-"), (F.col("seq") % 6 + 4).cast("string")).alias("from"), F.col("component").alias("to"))
    return C.clients_of(c.select("id"), c, edges)


@query("faults", sql="""b AS (SELECT component, arg_min(pod, ((kind NOT IN ('oom_killed', 'crash_loop'))::INT, (ts_ms IS NULL)::INT, coalesce(ts_ms, 0), seq)) AS seen FROM faults WHERE pod IS NOT NULL GROUP BY ALL), k AS (SELECT component, min(name || '-known') AS pod FROM faults GROUP BY ALL)
SELECT component, coalesce(seen, pod) AS pod FROM k FULL JOIN b USING (component)""")
def representative_pods(spark, sf_dir):
    f = view(spark, sf_dir, "faults")
    return C.representative(f, f.groupBy("component").agg(F.min(F.concat("name", F.lit("-known"))).alias("pod")), ["oom_killed", "crash_loop"])


@query("faults", sql=f"""c AS (SELECT name AS component, count(*) FILTER ({RANK} >= 2) AS errors, count(*) FILTER ({RANK} = 1) AS warns, count(*) FILTER ({RANK} = 0) AS infos FROM faults GROUP BY ALL)
SELECT CASE WHEN component LIKE 'app-1%' THEN 'app-1x' ELSE component END AS component, sum(errors)::BIGINT AS errors, sum(warns)::BIGINT AS warns, sum(infos)::BIGINT AS infos FROM c GROUP BY ALL""")
def counts_remapped(spark, sf_dir):
    from ..operators import timeline

    f = view(spark, sf_dir, "faults").withColumn("component", F.col("name"))
    aliases = f.filter("component like 'app-1%'").select(F.col("component").alias("alias"), F.lit("app-1x").alias("id")).distinct()
    return C.remapped_counts(timeline.level_counts(f, ["component"]).drop("total"), aliases)


@query("faults", sql=f"SELECT component, count(*) FILTER ({RANK} >= 2) AS errors, count(*) FILTER ({RANK} = 1) AS warns, count(*) FILTER ({RANK} = 0) AS infos FROM faults WHERE source <> 'logs' GROUP BY ALL")
def counts_of_other_sources(spark, sf_dir):
    return C.other_source_counts(view(spark, sf_dir, "faults"))




_PICK = "SELECT id, arg_min(t, ((ct <> et)::INT, CASE ct WHEN 'service' THEN 0 WHEN 'datastore' THEN 1 ELSE 2 END, t)) AS t FROM {} GROUP BY id HAVING count(DISTINCT place) = 1"
_PAIRS = "SELECT e.id, c.id AS t, c.type AS ct, e.type AS et, coalesce(c.cluster, '?') || '/' || coalesce(c.namespace, '?') AS place FROM h e JOIN {} c ON c.name = e.name AND (e.cluster IS NULL OR c.cluster = e.cluster) AND (e.namespace IS NULL OR c.namespace = e.namespace)"
_HINTS = """SELECT DISTINCT concat(type, ':', coalesce(cluster, '?'), '/', coalesce(namespace, '?'), '/', name) AS id, name, type, cluster, namespace FROM (
  SELECT concat('app-', cast(c_custkey % 200 AS varchar(9))) AS name, CASE c_custkey % 7 WHEN 0 THEN 'external' WHEN 1 THEN 'datastore' WHEN 2 THEN 'node' WHEN 3 THEN 'infra' ELSE 'service' END AS type,
  CASE WHEN c_custkey % 5 < 3 THEN concat('c', cast(c_nationkey % 2 AS varchar(9))) END AS cluster, CASE WHEN c_custkey % 11 < 6 THEN concat('ns', cast(c_nationkey % 3 AS varchar(9))) END AS namespace FROM {}) x"""


@query(sql=f"""WITH RECURSIVE h AS ({_HINTS.format("customer")}), r AS (SELECT * FROM h WHERE type IN ('service', 'datastore', 'infra')), full_ AS (SELECT * FROM r WHERE cluster IS NOT NULL AND namespace IS NOT NULL),
p1 AS ({_PAIRS.format("full_")} WHERE (e.type IN ('service', 'datastore', 'infra') AND (e.cluster IS NULL) <> (e.namespace IS NULL)) OR (e.type = 'external' AND e.cluster IS NOT NULL AND e.namespace IS NOT NULL)), m1 AS ({_PICK.format("p1")}),
l1 AS (SELECT * FROM r WHERE (cluster IS NOT NULL OR namespace IS NOT NULL) AND id NOT IN (SELECT id FROM m1)),
p2 AS ({_PAIRS.format("l1")} WHERE (e.type IN ('service', 'datastore', 'infra') AND e.cluster IS NULL AND e.namespace IS NULL) OR (e.type = 'external' AND (e.cluster IS NULL) <> (e.namespace IS NULL))), m2 AS ({_PICK.format("p2")}),
l2 AS (SELECT * FROM l1 UNION ALL SELECT * FROM r WHERE cluster IS NULL AND namespace IS NULL AND id NOT IN (SELECT id FROM m2)),
p3 AS ({_PAIRS.format("l2")} WHERE e.type = 'external' AND e.cluster IS NULL AND e.namespace IS NULL), m3 AS ({_PICK.format("p3")}),
m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3), walk AS (SELECT id, t, 1 AS d FROM m UNION ALL SELECT w.id, m.t, d + 1 FROM walk w JOIN m ON w.t = m.id)
SELECT id, arg_max(t, d) AS target FROM walk GROUP BY id""")
def reconcile_tiers(spark, sf_dir):
    """Hints with and without a cluster and a namespace, of all types, from the best known to the vaguest."""
    return E.reconciled_in_tiers(spark.sql(_HINTS.format("{customer}"), customer=read(spark, sf_dir, "customer")))
