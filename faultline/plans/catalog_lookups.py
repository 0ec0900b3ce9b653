"""Queries of lookups, replies and the stack fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup, stackfit
from ..sources.adapters import pick, view
from .catalog import NOISY, _hypotheses, cases, query
from .catalog_orders import RISK_RANK, STATUS_PLACE

REFS = ["service:c1/ns1/app-5", "APP-14", "ns2/app-9", "c0/ns3/app-34", "app-5", "-datastore", "datastore:", "no such thing"]


@query("components", sql=f"""w AS (SELECT unnest([{', '.join(repr(r) for r in REFS)}]) AS ref), t AS (SELECT *, lower(ref) AS low, regexp_replace(lower(ref), '^[^:]*:', '') AS tail FROM w),
h AS (SELECT ref, c.*, CASE WHEN id = ref THEN 0 WHEN lower(name) = low OR lower(id) = low OR regexp_replace(lower(id), '^[^:]*:', '') = tail OR ends_with(lower(id), '/' || tail) OR lower(namespace) || '/' || lower(name) = low THEN 1 WHEN contains(lower(id), low) THEN 2 END AS tier FROM components c CROSS JOIN t),
p AS (SELECT ref, tier, first(id ORDER BY {STATUS_PLACE}, impact DESC, id) AS id, count(*) - 1 AS others FROM h WHERE tier IS NOT NULL GROUP BY ALL) SELECT ref, id, others FROM p QUALIFY row_number() OVER (PARTITION BY ref ORDER BY tier) = 1""")
def component_references(spark, sf_dir):
    return lookup.resolved(view(spark, sf_dir, "components"), spark.createDataFrame([(r,) for r in REFS], "ref string"))


def _fitted(source: str, by: str, order: str) -> str:
    return f"u AS (SELECT {by}, j, sum(strlen(j) + 1) OVER w AS used, row_number() OVER w AS place FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY {order})) SELECT {by}, '[' || coalesce(string_agg(j, ',' ORDER BY place) FILTER (used <= 8000), '') || ']' AS result, count(*) FILTER (used <= 8000) AS shown, count(*) AS total FROM u GROUP BY ALL"


@query("components", sql="""c AS (SELECT *, '{"id":"' || id || '","name":"' || name || '","type":"' || type || '"' || CASE WHEN role IS NOT NULL THEN ',"role":"' || role || '"' ELSE '' END || ',"namespace":"' || namespace || '","status":"' || status || '","user_facing":' || user_facing || ',"errors":' || errors || ',"impact":' || impact || ',"release":"' || release || '"}' AS j FROM components), """ + _fitted("c", "cluster", f"{STATUS_PLACE}, impact DESC, id"))
def component_list(spark, sf_dir):
    return lookup.look_up({"components": view(spark, sf_dir, "components")}, "list_components", {})


@query("changes", sql="""c AS (SELECT *, '{"id":"' || id || '","category":"' || category || '","risk":"' || risk || '","field":"' || field || '","before":"' || before || '","after":"' || after || '","line":' || line || '}' AS j FROM changes), """ + _fitted("c", "release", f"{RISK_RANK}, line, id"))
def change_list(spark, sf_dir):
    return lookup.look_up({"changes": view(spark, sf_dir, "changes")}, "get_changes", {})


@query("signals", sql="""b AS (SELECT component AS id, CASE WHEN component LIKE '%3' THEN NULL ELSE (count(*) FILTER (severity = 'error'))::DOUBLE END AS burn, (count(*) * 10)::DOUBLE AS minutes FROM signals GROUP BY component), r AS (SELECT *, round(burn * minutes / (30 * 1440) * 100, 4) AS used FROM b)
SELECT id, CASE WHEN burn IS NULL THEN '{"hasEvidence":false,"note":"no error-rate evidence"}' ELSE '{"hasEvidence":true,"burnRate":' || burn || ',"incidentMinutes":' || minutes || ',"windowDays":30.0,"consumedPct":' || used || '}' END AS result FROM r""")
def budget_view(spark, sf_dir):
    g = view(spark, sf_dir, "signals").groupBy(F.col("component").alias("id")).agg(F.count_if(F.col("severity") == "error").cast("double").alias("burn"), (F.count("*") * 10).cast("double").alias("minutes"))
    rows = g.select("id", F.when(~F.col("id").endswith("3"), F.col("burn")).alias("burn"), "minutes", F.lit(30.0).alias("window_days"))
    return lookup.look_up({"budgets": rows}, "get_budget", {})


@query("signals", sql="SELECT 'there is no lookup drop_tables; there are search_evidence, get_component_signals, list_components, get_changes, get_dependencies, get_budget' AS message UNION ALL SELECT 'get_dependencies needs component' UNION ALL SELECT 'get_changes has nothing to read: changes' UNION ALL SELECT 'rows ' || count(*) FROM (SELECT 1 FROM signals WHERE component = 'svc-3' AND kind = 'timeout' LIMIT 7)")
def lookup_dispatch(spark, sf_dir):
    r = {"signals": view(spark, sf_dir, "signals"), "edges": view(spark, sf_dir, "signals")}
    said = [lookup.look_up(r, *x) for x in (("drop_tables", {}), ("get_dependencies", {}), ("get_changes", {}))]
    rows = lookup.look_up(r, "get_component_signals", {"component": "svc-3", "kinds": ["timeout"], "limit": 7}).agg(F.concat(F.lit("rows "), F.count("*").cast("string")).alias("message"))
    return said[0].union(said[1]).union(said[2]).union(rows)


@query("components", "evidence", sql=NOISY + f""", o AS (SELECT *, 'c' || (component[5:]::INT % 3) AS cluster FROM h), r AS (SELECT *, status <> 'healthy' AS ill, row_number() OVER (PARTITION BY cluster, status <> 'healthy' ORDER BY {STATUS_PLACE}, impact DESC, id) AS place FROM components),
p AS (SELECT cluster, string_agg(name || ' ' || status, ', ' ORDER BY place) FILTER (ill AND place <= 25) AS unhealthy, string_agg(name, ', ' ORDER BY place) FILTER (NOT ill AND place <= 40) AS healthy FROM r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY confidence DESC, hypothesis, component) AS n FROM o), t AS (SELECT cluster, string_agg(hypothesis || ' at ' || component, ', ' ORDER BY n) AS causes FROM k WHERE n <= 3 GROUP BY ALL) SELECT cluster, unhealthy, healthy, causes FROM p LEFT JOIN t USING (cluster)""")
def overview_text(spark, sf_dir):
    h = _hypotheses(spark, sf_dir).withColumn("cluster", F.concat(F.lit("c"), (F.split("component", "-")[1].cast("int") % 3).cast("string"))).withColumnRenamed("hypothesis", "category")
    return lookup.overview(view(spark, sf_dir, "components"), h, "cluster")


@query("components", "evidence", sql=NOISY + """, q AS (SELECT hypothesis || component AS cause, confidence * ((component[5:]::INT % 4) + 1) / 4 AS confidence, (SELECT min(id) FROM components WHERE name = 'app-' || component[5:]) AS component, component AS src FROM h), op AS (SELECT 'opt-' || (hypothesis[2:]::INT % 30) AS option, hypothesis || component AS cause, hypothesis = 'h7' AS recommended FROM h)
SELECT option, bool_and(confidence < 0.35 OR coalesce(status = 'healthy', false)) AND NOT bool_or(recommended) AS unlikely FROM op JOIN q USING (cause) LEFT JOIN components c ON c.id = q.component GROUP BY ALL""")
def unlikely_options(spark, sf_dir):
    c = view(spark, sf_dir, "components")
    first = c.groupBy(F.regexp_replace("name", "app-", "svc-").alias("component")).agg(F.min("id").alias("id"))
    h = _hypotheses(spark, sf_dir).withColumn("cause", F.concat("hypothesis", "component"))
    n = F.split("component", "-")[1].cast("int")
    options = h.select(F.concat(F.lit("opt-"), (F.substring("hypothesis", 2, 9).cast("int") % 30).cast("string")).alias("option"), "cause", (F.col("hypothesis") == "h7").alias("recommended"))
    return lookup.unlikely_options(options, h.join(first, "component", "left").select("cause", (F.col("confidence") * (n % 4 + 1) / 4).alias("confidence"), F.col("id").alias("component")), c)


@query("evidence", sql=NOISY + """, q AS (SELECT component AS incident, hypothesis AS category, 'c' || (hypothesis[2:]::INT % 3) AS component, confidence FROM h), rd AS (SELECT DISTINCT incident, 'h' || (incident[5:]::INT * 3) AS category, 'c' || (incident[5:]::INT % 3) AS component FROM q),
k AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY confidence DESC, category, component) AS rank FROM q QUALIFY rank <= 6), t AS (SELECT incident, component AS tc, category AS tk FROM k WHERE rank = 1)
SELECT rd.incident, rd.component = tc AND rd.category = tk AS agree, rd.component = tc AS same_component, rd.category = tk AS same_category, rank::INT AS match_rank FROM rd JOIN t USING (incident) LEFT JOIN k ON k.incident = rd.incident AND k.component = rd.component AND k.category = rd.category""")
def second_opinions(spark, sf_dir):
    h = _hypotheses(spark, sf_dir).select(F.col("component").alias("incident"), F.col("hypothesis").alias("category"), F.concat(F.lit("c"), (F.substring("hypothesis", 2, 9).cast("int") % 3).cast("string")).alias("component"), "confidence")
    n = F.split("incident", "-")[1].cast("int")
    reads = h.select("incident").distinct().select("incident", F.concat(F.lit("h"), (n * 3).cast("string")).alias("category"), F.concat(F.lit("c"), (n % 3).cast("string")).alias("component"))
    return lookup.compared_reads(reads, h)


IDS = ["[sig-1]", " 'chg-2'.", "N/A", "log-3;", "(null)", "\"abc\"", "-"]
CLEAN = ["'sig-1'", "'chg-2'", "NULL", "'log-3'", "NULL", "'abc'", "NULL"]
CAPS = {"evidence": 12, "ruled-out": 8, "remediation": 8, "questions": 8}


@query("faults", sql="p AS (SELECT component AS reply, " + pick("seq", list(CAPS)) + " AS part, seq AS pos, CASE WHEN seq % 9 = 0 THEN ' ' ELSE text END AS text, CASE seq % 7 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(CLEAN)) + " END AS ref FROM faults), r AS (SELECT *, row_number() OVER (PARTITION BY reply, part ORDER BY pos) AS n FROM p) SELECT reply, part, pos, text, ref, part = 'remediation' AS needs_approval FROM r WHERE n <= " + cases("part", CAPS.items(), "0") + " AND trim(text) <> ''")
def reply_parts(spark, sf_dir):
    f = view(spark, sf_dir, "faults")
    rows = f.select(F.col("component").alias("reply"), F.expr(pick("seq", list(CAPS))).alias("part"), F.col("seq").alias("pos"), F.when(F.col("seq") % 9 == 0, " ").otherwise(F.col("text")).alias("text"), lookup.clean_ids(F.expr(pick("seq", IDS))).alias("ref"))
    return lookup.capped_parts(rows, CAPS)


@query("faults", sql="SELECT cluster AS id, count(DISTINCT component) || '|' || coalesce(min(ts_ms)::VARCHAR, '') || '|' || count(*) AS fingerprint FROM faults GROUP BY ALL")
def snapshot_fingerprints(spark, sf_dir):
    g = view(spark, sf_dir, "faults").groupBy(F.col("cluster").alias("id")).agg(F.count("*").alias("signals"), F.countDistinct("component").alias("components"), F.min("ts_ms").alias("first_ms"))
    return lookup.fingerprints_of(g.select("id", "components", "first_ms", "signals"))


TYPED = {"nodes": ["40", "1,200", "-3", "", "7.6", "many"], "logs_gb": ["50", "400.5", "1_000", "x", "0", "2"], "series": ["150 000", "999999", "2500000", "1e4", "", "3"], "apm_hosts": ["20", "0", "1", "7", "", "9.5"]}
READ = {"nodes": [40, 1200, 40, 40, 8, 40], "logs_gb": [50, 400.5, 1000, 50, 0, 2], "series": [150000, 999999, 2500000, 10000, 500000, 3], "apm_hosts": [20, 0, 1, 7, 20, 10]}
PRIME = {"nodes": 1, "logs_gb": 2, "series": 3, "apm_hosts": 5}
SCALES = "sc AS (SELECT seq AS id, " + ", ".join(f"CASE seq // {PRIME[k]} % 6 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(READ[k])) + f" END::DOUBLE AS {k}" for k in TYPED) + """,
  (seq % 3)::BIGINT AS infra, (seq // 3 % 2)::BIGINT AS request, seq % 5 = 0 AS silent, seq % 4 = 0 AS multi, seq % 2 = 0 AS has_logs, seq % 7 <> 0 AS has_traces, (seq % 6)::BIGINT AS untraced FROM signals)"""


def _scales(spark, sf_dir):
    s = F.col("seq")
    typed = view(spark, sf_dir, "signals").select(
        s.alias("id"), *[F.expr(pick(f"(seq div {PRIME[k]})", v)).alias(k) for k, v in TYPED.items()], (s % 3).alias("infra"), F.expr("seq div 3 % 2").alias("request"), (s % 5 == 0).alias("silent"), (s % 4 == 0).alias("multi"), (s % 2 == 0).alias("has_logs"), (s % 7 != 0).alias("has_traces"), (s % 6).alias("untraced"),
    )
    return stackfit.normalised_scale(typed)


@query("signals", sql=SCALES + " SELECT id, nodes, logs_gb, series, apm_hosts FROM sc")
def stated_scales(spark, sf_dir):
    return _scales(spark, sf_dir).select("id", *stackfit.SCALE)


@query("signals", sql="""l AS (SELECT component AS id, unnest([kind, 'pod', CASE WHEN user_id % 2 = 0 THEN 'Node_Name' ELSE 'user_' || (user_id % 4) END, '']) AS key FROM signals)
SELECT id, count(DISTINCT key) FILTER (lower(key) IN ('pod', 'node_name')) AS infra, count(DISTINCT key) FILTER (lower(key) NOT IN ('pod', 'node_name')) AS request FROM l WHERE key <> '' GROUP BY ALL""")
def label_traits(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    keys = F.array("kind", F.lit("pod"), F.when(F.col("user_id") % 2 == 0, "Node_Name").otherwise(F.concat(F.lit("user_"), (F.col("user_id") % 4).cast("string"))), F.lit(""))
    return stackfit.label_traits(s.select(F.col("component").alias("id"), F.explode(keys).alias("key")))


FLAG_SQL = {
    ("hosted", 0, "custom-metrics"): "CASE WHEN hc OR series > nodes * 100 THEN 'strain' ELSE 'ok' END", ("hosted", 1, "error-sampler"): "CASE WHEN silent THEN 'ok' END", ("hosted", 2, "sampling-cost"): "CASE WHEN silent THEN 'strain' END", ("hosted", 3, "span-retention"): "CASE WHEN has_traces OR silent THEN 'strain' END",
    ("hosted", 4, "index-quota"): "CASE WHEN has_logs THEN 'strain' END", ("hosted", 5, "cluster-view"): "CASE WHEN multi THEN 'ok' END", ("self-hosted", 0, "tenant-series"): "CASE WHEN series > 150000 OR hc THEN 'strain' ELSE 'ok' END", ("self-hosted", 1, "stream-labels"): "CASE WHEN hc THEN 'strain' END",
    ("self-hosted", 2, "log-rate"): "CASE WHEN logs_gb * 1000 / 86400 >= 2 THEN 'strain' ELSE 'ok' END", ("self-hosted", 3, "kept-traces"): "CASE WHEN silent THEN 'strain' END", ("self-hosted", 4, "shared-tenant"): "CASE WHEN multi THEN 'strain' END", ("self-hosted", 5, "churn-bill"): "CASE WHEN hc THEN 'strain' END",
    ("collector", 0, "head-sampling"): "CASE WHEN silent THEN 'breaks' WHEN has_traces THEN 'ok' END", ("collector", 1, "label-limit"): "CASE WHEN hc THEN 'strain' END", ("collector", 2, "untraced-parts"): "CASE WHEN untraced > 0 THEN 'strain' END", ("collector", 3, "cluster-labels"): "CASE WHEN multi THEN 'strain' END", ("collector", 4, "refused-data"): "'strain'",
    ("managed", 0, "workspace-series"): "CASE WHEN series >= 1000000 THEN 'breaks' WHEN series >= 695000 OR hc THEN 'strain' ELSE 'ok' END", ("managed", 1, "burst"): "CASE WHEN series >= 2000000 THEN 'strain' WHEN hc THEN 'ok' END", ("managed", 2, "billed-series"): "CASE WHEN hc THEN 'strain' END", ("managed", 3, "metrics-only"): "CASE WHEN silent THEN 'strain' END", ("managed", 4, "shared-workspace"): "CASE WHEN multi THEN 'strain' END",
}
FLAGS = SCALES + ", hc AS (SELECT *, infra + request > 0 AS hc FROM sc), fl AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT id, '{s}' AS stack, {i} AS pos, '{f}' AS flag, {x} AS level FROM hc" for (s, i, f), x in FLAG_SQL.items()) + ") WHERE level IS NOT NULL)"


@query("signals", sql=FLAGS + " SELECT * FROM fl")
def stack_flags(spark, sf_dir):
    return stackfit.stack_flags(_scales(spark, sf_dir))


@query("signals", sql=FLAGS + """, v AS (SELECT id, stack, CASE WHEN count(*) FILTER (level = 'breaks') > 0 THEN 'Strained' WHEN count(*) FILTER (level = 'strain') >= 2 THEN 'Workable' ELSE 'Good fit' END AS verdict, first(flag ORDER BY CASE level WHEN 'breaks' THEN 0 WHEN 'strain' THEN 1 ELSE 2 END, pos) AS why FROM fl GROUP BY ALL) SELECT * FROM v""")
def stack_assembly(spark, sf_dir):
    return stackfit.assembled(stackfit.stack_flags(_scales(spark, sf_dir)))


COST_SQL = [
    ("hosted", "nodes", "nodes * 15"), ("hosted", "apm", "apm_hosts * 31"), ("hosted", "log-ingest", "logs_gb * 30 * 0.1::DOUBLE"), ("hosted", "log-index", "NULL"), ("hosted", "custom-metrics", "CASE WHEN series <= nodes * 100 THEN 0 END"), ("self-hosted", "plan", "19"), ("self-hosted", "metrics", "greatest(0, series - 10000) / 1000 * 6.5::DOUBLE"),
    ("self-hosted", "logs-processed", "logs_gb * 30 * 0.05::DOUBLE"), ("self-hosted", "logs-written", "greatest(0, logs_gb * 30 - 50) * 0.4::DOUBLE"), ("collector", "points", "series * 43200 * 450 / 1e9 * 0.5::DOUBLE"),
    ("managed", "samples", "greatest(least(series * 43200, 50e9), 0) / 1e6 * 0.06::DOUBLE + greatest(least(series * 43200, 250e9) - 50e9, 0) / 1e6 * 0.048::DOUBLE + greatest(least(series * 43200, 500e9) - 250e9, 0) / 1e6 * 0.036::DOUBLE + greatest(series * 43200 - 500e9, 0) / 1e6 * 0.024::DOUBLE"),
]


@query("signals", sql=SCALES + ", co AS (" + " UNION ALL ".join(f"SELECT id, '{s}' AS stack, '{n}' AS line, ({x})::DOUBLE AS u FROM sc" for s, n, x in COST_SQL) + ") SELECT id, stack, line, CASE WHEN u >= 100 THEN floor(u + 0.5) ELSE floor(u * 100 + 0.5) / 100 END AS usd FROM co")
def stack_costs(spark, sf_dir):
    return stackfit.stack_costs(_scales(spark, sf_dir))


_CATALOGUE = ", ".join(f"('{s}', '{i}', {'NULL' if v is None else v}::DOUBLE, '{u}')" for s, i, v, u in stackfit.CATALOGUE)


@query("signals", sql=SCALES + f", ca AS (SELECT * FROM (VALUES {_CATALOGUE}) t(stack, item, value, unit)) SELECT stack, item, value, unit, CASE WHEN unit = 'series' THEN count(*) FILTER (series > value) END AS over FROM ca CROSS JOIN sc GROUP BY stack, item, value, unit")
def stack_catalogue(spark, sf_dir):
    return stackfit.stack_catalogue(_scales(spark, sf_dir))
