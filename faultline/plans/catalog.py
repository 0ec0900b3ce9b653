"""Queries over the adapters: each applies one operator; ORACLES has the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text, times
from ..functions import vocabulary as V
from ..operators import budget, changes, entities, graph, lookup, rules, scoring, spans, stackfit, timeline
from ..session import cut, spread
from ..sources import lines, logs
from ..sources.adapters import view, with_views
from ..streaming import live
from .analyze import analyze

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(*adapters: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its oracle over the named adapters."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, *adapters) if adapters else sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(column: str, pairs, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in pairs) + f" ELSE {default} END"


RANK = cases("severity", [(s, i) for i, s in enumerate(V.SEVERITIES)], "0")
ANOMALY = "(kind NOT IN ('change', 'rollout', 'alert_resolved') AND NOT (kind = 'restart' AND severity = 'info'))"
SOURCE = cases("source", [(s, i + 1) for i, s in enumerate(timeline.SOURCES)])
ERRORS = f"errors AS (SELECT * FROM signals WHERE {ANOMALY} AND {RANK} >= 2)"

# --- spans and edges ---------------------------------------------------------------------------------

LINKED = """
parents AS (SELECT trace_id, span_id AS parent_id, max(service) AS parent_service FROM spans GROUP BY ALL),
kids AS (SELECT DISTINCT trace_id, parent_id AS span_id, true AS has_child FROM spans WHERE parent_id IS NOT NULL),
linked AS (SELECT s.*, p.parent_service, coalesce(k.has_child, false) AS has_child FROM spans s LEFT JOIN parents p USING (trace_id, parent_id) LEFT JOIN kids k USING (trace_id, span_id)),
known AS (SELECT lower(service) AS peer_name, min(service) AS peer_service FROM spans GROUP BY ALL),
calls AS (SELECT parent_service AS "from", service AS "to", dur_ms, error, start_ms FROM linked WHERE parent_service <> service
  UNION ALL SELECT service, 'db:' || lower(coalesce(peer, db)), dur_ms, error, start_ms FROM linked WHERE kind = 'client' AND NOT has_child AND db IS NOT NULL
  UNION ALL SELECT service, coalesce(peer_service, 'external:' || lower(peer)), dur_ms, error, start_ms FROM linked LEFT JOIN known ON lower(peer) = peer_name
  WHERE kind = 'client' AND NOT has_child AND db IS NULL AND peer IS NOT NULL),
edges AS (SELECT *, CASE WHEN error_rate >= 0.2 THEN 'failing' WHEN error_rate >= 0.02 THEN 'degraded' ELSE 'ok' END AS status FROM (
  SELECT "from", "to", count(*) AS calls, count(*) FILTER (error) AS errors, quantile_disc(dur_ms, 0.95) AS p95_ms, min(CASE WHEN error THEN start_ms END) AS first_error_ms,
  floor(count(*) FILTER (error) / count(*) * 10000 + 0.5) / 10000 AS error_rate FROM calls WHERE "from" <> "to" GROUP BY ALL))"""
FAIL = """, failing AS (SELECT DISTINCT "to" AS component FROM edges WHERE error_rate >= 0.2)"""


def _edges(spark, sf_dir):
    return spans.edge_health(spans.derived_edges(view(spark, sf_dir, "spans")))


def _failing(edges):
    return graph.failing_set(edges, edges.select(F.col("to").alias("component")).limit(0))


@query("spans", sql=LINKED.lstrip() + ' SELECT * FROM edges')
def edge_health(spark, sf_dir):
    return _edges(spark, sf_dir)


@query("spans", sql="SELECT s.trace_id, s.span_id, s.parent_id, s.service FROM spans s ANTI JOIN spans p ON p.trace_id = s.trace_id AND p.span_id = s.parent_id WHERE s.parent_id IS NOT NULL")
def span_orphans(spark, sf_dir):
    return spans.orphans(view(spark, sf_dir, "spans")).select("trace_id", "span_id", "parent_id", "service")


@query("spans", sql="""SELECT count(DISTINCT trace_id) AS traces, count(*) AS spans, count(DISTINCT CASE WHEN error THEN trace_id END) AS error_traces, count(DISTINCT service) AS services,
  floor(count(*) FILTER (parent_id IS NULL AND error) / count(*) FILTER (parent_id IS NULL) * 10000 + 0.5) / 10000 AS entry_error_ratio FROM spans""")
def trace_stats(spark, sf_dir):
    return spans.trace_stats(view(spark, sf_dir, "spans"))


@query("spans", sql="""SELECT service, count(*) AS roots, count(*) FILTER (error) AS errors FROM spans s WHERE parent_id IS NULL OR (kind = 'server' AND NOT EXISTS (
  SELECT 1 FROM spans p WHERE p.trace_id = s.trace_id AND p.span_id = s.parent_id)) GROUP BY ALL""")
def entry_points(spark, sf_dir):
    return spans.entry_points(view(spark, sf_dir, "spans"))


@query("spans", sql="""s AS (SELECT * REPLACE (dur_ms * CASE WHEN (trace_id + span_id) % 37 = 0 THEN 6 ELSE 1 END AS dur_ms) FROM spans), m AS (SELECT service, op, median(dur_ms) AS median_ms FROM s GROUP BY ALL)
SELECT trace_id, span_id, s.service, s.op, dur_ms, median_ms FROM s JOIN m USING (service, op) WHERE dur_ms >= 1000 AND dur_ms > 3 * median_ms""")
def slow_spans(spark, sf_dir):
    s = view(spark, sf_dir, "spans")
    return spans.slow_spans(s.withColumn("dur_ms", F.col("dur_ms") * F.when((F.col("trace_id") + F.col("span_id")) % 37 == 0, 6).otherwise(1))).select("trace_id", "span_id", "service", "op", "dur_ms", "median_ms")


@query("spans", sql="""bad AS (SELECT trace_id, span_id FROM spans WHERE error), pairs AS (SELECT a.trace_id, a.span_id, b.span_id AS other,
  row_number() OVER (PARTITION BY a.trace_id, a.span_id ORDER BY b.span_id) AS rn FROM bad a JOIN bad b ON a.trace_id = b.trace_id AND a.span_id <> b.span_id)
SELECT bad.trace_id, bad.span_id, coalesce(string_agg(other::varchar, ',' ORDER BY other), '') AS related FROM bad LEFT JOIN pairs ON bad.trace_id = pairs.trace_id AND bad.span_id = pairs.span_id AND rn <= 10 GROUP BY ALL""")
def related_spans(spark, sf_dir):
    bad = view(spark, sf_dir, "spans").filter("error").select("trace_id", "span_id")
    return spans.related_spans(bad).withColumn("related", F.concat_ws(",", F.transform("related", lambda x: x.cast("string"))))


@query("spans", sql=LINKED.lstrip() + """, named AS (SELECT CASE WHEN "from" LIKE 'supp-1%' THEN 'supp-1x' ELSE "from" END AS f, CASE WHEN "to" LIKE 'supp-1%' THEN 'supp-1x' ELSE "to" END AS t, * FROM edges)
SELECT f AS "from", t AS "to", sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors, max(p95_ms) AS p95_ms, min(first_error_ms) AS first_error_ms FROM named WHERE f <> t GROUP BY ALL""")
def edge_merge_canonical(spark, sf_dir):
    edges = cut(_edges(spark, sf_dir))
    ends = edges.select(F.col("from").alias("alias")).union(edges.select("to")).distinct()
    return spans.merge_edges(edges, ends.filter("alias like 'supp-1%'").withColumn("id", F.lit("supp-1x")))


# --- graph -------------------------------------------------------------------------------------------


@query("spans", sql=LINKED.lstrip() + FAIL + " SELECT component FROM failing")
def failing_set(spark, sf_dir):
    return _failing(_edges(spark, sf_dir))


RISK = """, one AS (SELECT DISTINCT "from" AS component, 1 AS hops FROM edges JOIN failing ON "to" = component),
two AS (SELECT DISTINCT "from" AS component, 2 AS hops FROM edges JOIN one ON "to" = component),
risk AS (SELECT component, min(hops)::INT AS hops FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE component NOT IN (SELECT component FROM failing) GROUP BY ALL)"""


@query("spans", sql=LINKED.lstrip() + FAIL + RISK + " SELECT * FROM risk")
def at_risk_two_hop(spark, sf_dir):
    edges = cut(_edges(spark, sf_dir))
    return graph.at_risk(edges, _failing(edges))


@query("spans", sql=LINKED.lstrip() + FAIL + """ SELECT component FROM failing WHERE NOT EXISTS (SELECT 1 FROM edges e JOIN failing f2 ON e."to" = f2.component WHERE e."from" = failing.component)""")
def deepest_failing(spark, sf_dir):
    edges = cut(_edges(spark, sf_dir))
    return graph.deepest_failing(edges, _failing(edges))


STATUS = """, all_c AS (SELECT "from" AS component FROM edges UNION SELECT "to" FROM edges),
bad_callers AS (SELECT DISTINCT "from" AS component FROM edges JOIN failing ON "to" = component WHERE error_rate >= 0.02),
state AS (SELECT component, CASE WHEN component IN (SELECT component FROM failing) THEN 'failing' WHEN component IN (SELECT component FROM bad_callers) THEN 'degraded'
  WHEN component IN (SELECT component FROM risk) THEN 'at-risk' ELSE 'healthy' END AS status FROM all_c)"""


def _states(spark, sf_dir):
    edges = cut(_edges(spark, sf_dir))
    components = edges.select(F.col("from").alias("component")).union(edges.select("to"))
    return edges, graph.statuses(components, edges, _failing(edges), components.limit(0))


@query("spans", sql=LINKED.lstrip() + FAIL + RISK + STATUS + " SELECT * FROM state")
def component_status(spark, sf_dir):
    return _states(spark, sf_dir)[1]


@query("spans", sql=LINKED.lstrip() + FAIL + RISK + STATUS + """, e AS (SELECT "to" AS component, sum(errors)::BIGINT AS errors FROM edges GROUP BY ALL)
SELECT component, floor((CASE status WHEN 'failing' THEN 0.75 WHEN 'degraded' THEN 0.45 WHEN 'at-risk' THEN 0.2 ELSE 0.0 END::DOUBLE + CASE WHEN component LIKE 'edge-%' THEN 0.05 ELSE 0.0 END::DOUBLE
  + 0.05::DOUBLE * coalesce(errors / nullif((SELECT max(errors) FROM e), 0), 0.0)) * 100 + 0.5) / 100 AS impact FROM state LEFT JOIN e USING (component)""")
def impact_score(spark, sf_dir):
    edges, states = _states(spark, sf_dir)
    errors = edges.groupBy(F.col("to").alias("component")).agg(F.sum("errors").alias("errors"))
    rows = states.join(errors, "component", "left").withColumn("user_facing", F.col("component").startswith("edge-"))
    return graph.impact(rows).select("component", "impact")


CHAIN = "chain AS (SELECT concat('n', n_nationkey) AS alias, concat('n', n_nationkey + n_regionkey + 1) AS id FROM nation)"


@query(sql=f"""WITH RECURSIVE {CHAIN}, walk AS (SELECT alias, id, 1 AS d FROM chain UNION ALL SELECT w.alias, c.id, d + 1 FROM walk w JOIN chain c ON w.id = c.alias)
SELECT alias, arg_max(id, d) AS id FROM walk GROUP BY alias""")
def alias_closure(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return graph.alias_closure(n.select(F.concat(F.lit("n"), "n_nationkey").alias("alias"), F.concat(F.lit("n"), (F.col("n_nationkey") + F.col("n_regionkey") + 1).cast("string")).alias("id")))


@query(sql="""WITH RECURSIVE e AS (SELECT concat('r', n_regionkey) AS f, concat('n', n_nationkey) AS t FROM nation UNION SELECT concat('n', n_nationkey), concat('n', n_nationkey + 1 + n_regionkey) FROM nation),
w AS (SELECT f AS node, 0 AS layer FROM e UNION SELECT t, 0 FROM e UNION SELECT e.t, layer + 1 FROM w JOIN e ON w.node = e.f) SELECT node, max(layer)::INT AS layer FROM w GROUP BY node""")
def layering_longest_path(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    node = lambda c: F.concat(F.lit("n"), c.cast("string"))
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("from"), node(F.col("n_nationkey")).alias("to"))
    return graph.layers(edges.union(n.select(node(F.col("n_nationkey")), node(F.col("n_nationkey") + 1 + F.col("n_regionkey")))))


CYCLES = """e AS (SELECT DISTINCT 'a' || lpad((c_custkey % 60)::VARCHAR, 2, '0') AS f, 'a' || lpad((CASE WHEN c_custkey % 4 = 0 AND c_custkey % 60 < 54 THEN c_custkey % 60 + 6 ELSE c_custkey % 60 // 6 * 6 + (c_custkey + 1 + c_nationkey % 2) % 6 END)::VARCHAR, 2, '0') AS t FROM customer),
reach AS (SELECT f, t FROM e UNION SELECT r.f, e.t FROM reach r JOIN e ON r.t = e.f), same AS (SELECT a.f, a.t FROM reach a JOIN reach b ON a.f = b.t AND a.t = b.f),
kept AS (SELECT f, t FROM e WHERE f < t OR (f, t) NOT IN (SELECT (f, t) FROM same))"""


def _linked_cycles(spark, sf_dir):
    """Groups of six names that call each other in cycles, and calls from group to group."""
    k, n = F.col("c_custkey") % 60, F.col("c_custkey")
    name = lambda c: F.concat(F.lit("a"), F.lpad(F.floor(c).cast("string"), 2, "0"))
    to = F.when((n % 4 == 0) & (k < 54), k + 6).otherwise(F.floor(k / 6) * 6 + (n + 1 + F.col("c_nationkey") % 2) % 6)
    return read(spark, sf_dir, "customer").select(name(k).alias("from"), name(to).alias("to"))


@query(sql=f"WITH RECURSIVE {CYCLES} SELECT f AS \"from\", t AS \"to\" FROM kept")
def broken_cycles(spark, sf_dir):
    return graph.acyclic(_linked_cycles(spark, sf_dir))


@query(sql=f"WITH RECURSIVE {CYCLES} SELECT f AS node, max(t) AS root FROM same GROUP BY f HAVING count(*) > 1")
def strong_components(spark, sf_dir):
    return graph.strong_components(_linked_cycles(spark, sf_dir)).select("node", "root")


@query(sql=f"""WITH RECURSIVE {CYCLES}, w AS (SELECT f AS node, 0 AS layer FROM e UNION SELECT t, 0 FROM e UNION SELECT kept.t, layer + 1 FROM w JOIN kept ON w.node = kept.f) SELECT node, max(layer)::INT AS layer FROM w GROUP BY node""")
def layering_with_cycles(spark, sf_dir):
    return graph.layers(_linked_cycles(spark, sf_dir))


@query("entities", sql="""s AS (SELECT name, cluster, CASE WHEN count(*) > 1 THEN 'failing' ELSE 'healthy' END AS status FROM entities GROUP BY ALL)
SELECT a.name, a.cluster, b.cluster AS sibling_cluster FROM s a JOIN s b ON a.name = b.name AND a.cluster <> b.cluster WHERE a.status <> 'healthy' AND b.status = 'healthy'""")
def healthy_siblings(spark, sf_dir):
    c = view(spark, sf_dir, "entities").groupBy("name", "cluster").agg(F.when(F.count("*") > 1, "failing").otherwise("healthy").alias("status"))
    return graph.healthy_siblings(c).select("name", "cluster", "sibling_cluster")


@query("spans", sql=LINKED.lstrip() + """, own AS (SELECT "to" AS component, min(first_error_ms) AS since_ms FROM edges WHERE first_error_ms IS NOT NULL GROUP BY ALL),
one AS (SELECT "from" AS component, min(since_ms) AS since_ms FROM edges JOIN own ON "to" = component GROUP BY ALL), two AS (SELECT "from" AS component, min(since_ms) AS since_ms FROM edges JOIN one ON "to" = component GROUP BY ALL)
SELECT component, min(since_ms) AS reveal_ms FROM (SELECT * FROM own UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL""")
def reveal_times(spark, sf_dir):
    edges = cut(_edges(spark, sf_dir))
    own = edges.filter("first_error_ms is not null").groupBy(F.col("to").alias("component")).agg(F.min("first_error_ms").alias("since_ms"))
    return graph.reveal_times(own, edges)


# --- signals -----------------------------------------------------------------------------------------


@query("signals", sql=f"SELECT component, count(*) FILTER ({RANK} >= 2) AS errors, count(*) FILTER ({RANK} = 1) AS warns, count(*) FILTER ({RANK} = 0) AS infos, count(*) AS total FROM signals GROUP BY ALL")
def signal_counts_by_component(spark, sf_dir):
    return timeline.level_counts(view(spark, sf_dir, "signals"), ["component"])


@query("signals", sql="""c AS (SELECT component, kind, count(*) AS n FROM signals GROUP BY ALL)
SELECT component, string_agg(kind, ',' ORDER BY (kind IN ('change', 'rollout', 'alert_resolved', 'restart'))::INT, n DESC, kind) AS kinds FROM c GROUP BY ALL""")
def kinds_ranked(spark, sf_dir):
    return timeline.kinds_ranked(view(spark, sf_dir, "signals"))


@query("signals", sql=f"SELECT component, min(ts_ms) AS first_error_ms, max(ts_ms) AS last_error_ms FROM signals WHERE {ANOMALY} AND {RANK} >= 2 GROUP BY ALL")
def first_last_error(spark, sf_dir):
    return timeline.first_last_error(view(spark, sf_dir, "signals"))


@query("signals", sql=f"SELECT component, kind, seq, ts_ms, source FROM signals QUALIFY row_number() OVER (PARTITION BY component, kind ORDER BY ts_ms NULLS LAST, {SOURCE}, source_line, seq) = 1")
def timeline_first_per_kind(spark, sf_dir):
    return timeline.first_per_kind(view(spark, sf_dir, "signals")).select("component", "kind", "seq", "ts_ms", "source")


@query("signals", sql="""n AS (SELECT seq, component, source || '-' || source_line AS stem, row_number() OVER (PARTITION BY component, source, source_line ORDER BY seq) - 1 AS k FROM signals)
SELECT seq, component, CASE WHEN k = 0 THEN stem ELSE stem || '.' || k END AS id FROM n""")
def signal_ids_suffix(spark, sf_dir):
    return timeline.numbered_ids(view(spark, sf_dir, "signals"), ["component"]).select("seq", "component", "id")


@query("signals", sql="""p AS (SELECT *, sum((kind = 'change')::INT) OVER (PARTITION BY component ORDER BY seq) AS part, CASE WHEN kind = 'http_5xx' THEN cluster END AS seen FROM signals)
SELECT seq, component, last_value(seen IGNORE NULLS) OVER (PARTITION BY component, part ORDER BY seq ROWS UNBOUNDED PRECEDING) AS carried_seen FROM p""")
def carry_forward_context(spark, sf_dir):
    s = view(spark, sf_dir, "signals").withColumn("seen", F.when(F.col("kind") == "http_5xx", F.col("cluster")))
    return timeline.carried(s, ["component"], ["seq"], ["seen"], "kind = 'change'").select("seq", "component", "carried_seen")


ONSET = f"""{ERRORS}, w AS (SELECT component, ts_ms, lead(ts_ms) OVER k AS nxt, count(*) OVER (PARTITION BY component ORDER BY ts_ms, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft
  FROM errors WINDOW k AS (PARTITION BY component ORDER BY ts_ms, seq)), onsets AS (SELECT component, min(ts_ms) AS onset_ms FROM w WHERE nxt IS NULL OR nxt - ts_ms <= 3600000 OR lft < 3 GROUP BY ALL)"""


def _onsets(s):
    errors = s.filter(text.is_anomaly(F.col("kind"), F.col("severity")) & (text.rank(F.col("severity")) >= 2))
    return timeline.onset(errors, ["component"])


@query("signals", sql=ONSET + " SELECT * FROM onsets")
def anomaly_onset_trimmed(spark, sf_dir):
    return _onsets(view(spark, sf_dir, "signals"))


@query("signals", sql=ONSET + " SELECT s.seq, s.component FROM signals s LEFT JOIN onsets USING (component) WHERE ts_ms IS NULL OR onset_ms IS NULL OR ts_ms >= onset_ms - 900000")
def incident_window_signals(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    return timeline.in_window(s, _onsets(s), ["component"]).select("seq", "component")


@query("signals", sql="""r AS (SELECT component, ts_ms, count(*) AS n FROM signals GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY component) AS al, sum(n) OVER (PARTITION BY component ORDER BY ts_ms DESC ROWS UNBOUNDED PRECEDING) AS gone, lead(ts_ms) OVER (PARTITION BY component ORDER BY ts_ms DESC) AS nxt FROM r),
d AS (SELECT *, min((nxt IS NOT NULL AND ts_ms - nxt > 21600000 AND gone <= greatest(1, floor(al * 0.05)) AND al - (gone - n) >= 3)::INT) OVER (PARTITION BY component ORDER BY ts_ms DESC ROWS UNBOUNDED PRECEDING) AS drops FROM w)
SELECT component, max(ts_ms) AS now_ms FROM d WHERE drops = 0 GROUP BY ALL""")
def clock_latest_trimmed(spark, sf_dir):
    return timeline.latest_clock(view(spark, sf_dir, "signals"), ["component"])


@query("signals", sql=f"""e AS (SELECT component, count(*) FILTER ({RANK} >= 2) AS ne FROM signals GROUP BY ALL),
r AS (SELECT s.*, row_number() OVER (PARTITION BY component ORDER BY {RANK} DESC, ts_ms DESC, seq) AS rn FROM signals s WHERE {RANK} < 2)
SELECT seq, component FROM signals WHERE {RANK} >= 2 UNION ALL SELECT seq, component FROM r JOIN e USING (component) WHERE rn <= 100 - ne""")
def signal_cap_topk(spark, sf_dir):
    return timeline.capped(view(spark, sf_dir, "signals"), ["component"], 100).select("seq", "component")


@query("signals", sql="""x AS (SELECT component, cluster || '-' || user_id || '-' || ts_ms // 86400000 AS s, CASE WHEN value > 40 THEN 'up' ELSE 'down' END AS dir, ts_ms FROM signals),
sets AS (SELECT component, s, bool_or(dir = 'up') AS up, bool_or(dir = 'down') AS dn, min(ts_ms) AS ts_ms FROM x GROUP BY ALL),
n AS (SELECT component, arg_min(s, (ts_ms, s)) AS new, min(ts_ms) AS ts_ms FROM sets WHERE up AND NOT dn GROUP BY ALL), o AS (SELECT component, arg_min(s, (ts_ms, s)) AS old FROM sets WHERE dn GROUP BY ALL)
SELECT component, old, new, ts_ms FROM n JOIN o USING (component)""")
def replicaset_handoff(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    rows = s.select("component", F.concat_ws("-", "cluster", F.col("user_id").cast("string"), F.expr("cast(ts_ms div 86400000 as string)")).alias("set"), F.when(F.col("value") > 40, "up").otherwise("down").alias("direction"), "ts_ms")
    return timeline.handoffs(rows)


@query("signals", sql=f"""{ERRORS}, f AS (SELECT component, min(ts_ms) AS reveal_ms FROM errors GROUP BY ALL), t AS (SELECT DISTINCT ts_ms // 86400000 * 86400000 AS t_ms FROM signals)
SELECT t_ms, count(*) FILTER (reveal_ms <= t_ms) AS visible FROM t CROSS JOIN f GROUP BY ALL""")
def status_at_time(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    reveals = timeline.first_last_error(s).select("component", F.col("first_error_ms").alias("reveal_ms"))
    return timeline.visible_at(reveals, s.select(F.expr("ts_ms div 86400000 * 86400000").alias("t_ms")).distinct())


@query("signals", sql="""SELECT component, cluster, count(*) AS calls, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms,
  array_to_string((list(seq ORDER BY seq))[1:20], ',') AS ids FROM signals GROUP BY ALL""")
def dependency_hints(spark, sf_dir):
    s = view(spark, sf_dir, "signals").withColumnsRenamed({"component": "from", "cluster": "to"})
    return entities.dependency_hints(s).withColumnsRenamed({"from": "component", "to": "cluster"})


@query("signals", sql="""s AS (SELECT component, cluster, CASE WHEN count(*) FILTER (severity = 'error') > 20 THEN 'failing' WHEN count(*) FILTER (severity = 'warn') > 10 THEN 'degraded' ELSE 'healthy' END AS status FROM signals GROUP BY ALL),
r AS (SELECT cluster, count(*) AS components, count(*) FILTER (status = 'failing') AS failing, count(*) FILTER (status = 'degraded') AS degraded FROM s GROUP BY ALL)
SELECT *, CASE WHEN failing > 0 THEN 'failing' WHEN degraded > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM r""")
def cluster_rollup(spark, sf_dir):
    c = view(spark, sf_dir, "signals").groupBy("component", "cluster").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warn").alias("w"))
    return entities.cluster_rollup(c.withColumn("status", F.when(F.col("e") > 20, "failing").when(F.col("w") > 10, "degraded").otherwise("healthy")))


# --- releases, evidence, entities --------------------------------------------------------------------


@query("releases", sql="""SELECT release_id, revision, coalesce(last_value(CASE WHEN status IN ('superseded', 'deployed') THEN revision END IGNORE NULLS) OVER (PARTITION BY release_id ORDER BY revision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  lag(revision) OVER (PARTITION BY release_id ORDER BY revision)) AS previous FROM releases""")
def prev_revision(spark, sf_dir):
    return changes.previous_revision(view(spark, sf_dir, "releases")).select("release_id", "revision", "previous")


@query("releases", sql="SELECT release_id, revision, ts_ms FROM releases QUALIFY row_number() OVER (PARTITION BY release_id ORDER BY ts_ms DESC NULLS LAST, revision DESC) = 1")
def latest_deploy(spark, sf_dir):
    return changes.latest_deploy(view(spark, sf_dir, "releases")).select("release_id", "revision", "ts_ms")


@query("releases", sql="""m AS (SELECT priority, release_id % 50 AS place, CASE WHEN change_id % 2 = 0 THEN '-' ELSE '+' END AS sign, change_id AS pos, amount AS value FROM releases),
n AS (SELECT *, row_number() OVER (PARTITION BY priority, place, sign ORDER BY pos)::INT AS n FROM m), a AS (SELECT * FROM n WHERE sign = '-'), b AS (SELECT * FROM n WHERE sign = '+')
SELECT priority, place, n, a.value AS before, b.value AS after FROM a FULL JOIN b USING (priority, place, n)""")
def nth_pairing(spark, sf_dir):
    marks = view(spark, sf_dir, "releases").select("priority", (F.col("release_id") % 50).alias("place"), F.when(F.col("change_id") % 2 == 0, "-").otherwise("+").alias("sign"), F.col("change_id").alias("pos"), F.col("amount").alias("value"))
    return changes.paired(marks, ["priority", "place"])


RISK_RANK = cases("risk", [(r, i + 1) for i, r in enumerate(changes.RISKS)])


@query("releases", sql=f"""c AS (SELECT release_id % 100 AS resource, change_id AS pos, risk, row_number() OVER (PARTITION BY release_id % 100 ORDER BY {RISK_RANK}, change_id) AS rn FROM releases)
SELECT resource, pos, risk, 1::BIGINT AS folded FROM c WHERE rn <= 40 UNION ALL SELECT resource, max(pos), arg_min(risk, {RISK_RANK}), count(*) FROM c WHERE rn > 40 GROUP BY resource""")
def change_cap_fold(spark, sf_dir):
    rows = view(spark, sf_dir, "releases").select((F.col("release_id") % 100).alias("resource"), F.col("change_id").alias("pos"), "risk")
    return changes.capped_changes(rows, ["resource"])


@query("releases", "signals", sql="""rb AS (SELECT release_id % 25 AS release_id, min(ts_ms) + 700000000000 AS rolled_back_ms FROM releases GROUP BY ALL), e AS (SELECT user_id % 25 AS release_id, ts_ms FROM signals WHERE severity = 'error')
SELECT release_id, count(*) AS errors, max(ts_ms) AS last_ms FROM e JOIN rb USING (release_id) WHERE ts_ms > rolled_back_ms + 120000 GROUP BY ALL""")
def post_event_errors_range_join(spark, sf_dir):
    rb = view(spark, sf_dir, "releases").groupBy((F.col("release_id") % 25).alias("release_id")).agg((F.min("ts_ms") + 700000000000).alias("rolled_back_ms"))
    errors = view(spark, sf_dir, "signals").filter("severity = 'error'").select((F.col("user_id") % 25).alias("release_id"), "ts_ms")
    return changes.after_rollback(errors, rb)


@query("signals", sql="""a AS (SELECT component, min(CASE WHEN kind = 'change' THEN ts_ms END) AS anchor, min(CASE WHEN severity = 'error' THEN ts_ms END) AS err FROM signals GROUP BY ALL)
SELECT component, CASE WHEN err - anchor BETWEEN -60000 AND 3600000 THEN 1.15 WHEN err - anchor < -60000 THEN 0.6 ELSE 1.0 END::DOUBLE AS factor FROM a""")
def anchor_interval(spark, sf_dir):
    a = view(spark, sf_dir, "signals").groupBy("component").agg(F.min(F.when(F.col("kind") == "change", F.col("ts_ms"))).alias("a"), F.min(F.when(F.col("severity") == "error", F.col("ts_ms"))).alias("e"))
    return a.select("component", changes.anchor_factor(F.col("a"), F.col("e")).alias("factor"))


@query("evidence", sql="SELECT hypothesis, component, ref, max(weight) AS weight, min(pos) AS pos FROM evidence GROUP BY ALL")
def evidence_dedup(spark, sf_dir):
    return scoring.distinct_evidence(view(spark, sf_dir, "evidence"))


NOISY = """c AS (SELECT hypothesis, component, least(1 - exp(sum(ln(1 - least(greatest(weight / 20, 0.0), 0.95)))), 0.95) AS raw, count(*) AS pieces FROM evidence GROUP BY ALL),
h AS (SELECT hypothesis, component, floor(CASE WHEN pieces < 2 THEN least(raw, 0.5) ELSE raw END * 1000 + 0.5) / 1000 AS confidence, pieces FROM c)"""


def _hypotheses(spark, sf_dir):
    return scoring.noisy_or(view(spark, sf_dir, "evidence").withColumn("weight", F.col("weight") / 20), ["hypothesis", "component"])


@query("evidence", sql=NOISY + " SELECT * FROM h")
def noisy_or_confidence(spark, sf_dir):
    return _hypotheses(spark, sf_dir)


@query("evidence", sql=NOISY + """, p AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY component ORDER BY confidence DESC, hypothesis) <= 3)
SELECT hypothesis, component, confidence, CASE WHEN confidence >= 0.75 THEN 'strong' WHEN confidence >= 0.5 THEN 'likely' WHEN confidence >= 0.35 THEN 'possible' ELSE 'weak' END AS band FROM p ORDER BY confidence DESC, hypothesis, component LIMIT 6""")
def per_component_cap(spark, sf_dir):
    return scoring.ranked(_hypotheses(spark, sf_dir)).select("hypothesis", "component", "confidence", scoring.band(F.col("confidence")).alias("band"))


@query("evidence", sql="SELECT component AS key, round(sum(weight), 6) AS weight FROM evidence GROUP BY ALL ORDER BY weight DESC, key LIMIT 1")
def weighted_vote_top1(spark, sf_dir):
    return scoring.vote(view(spark, sf_dir, "evidence").select(F.col("component").alias("key"), "weight")).withColumn("weight", F.round("weight", 6))


@query("evidence", sql=NOISY + """, g AS (SELECT hypothesis AS category, component[5:] AS name, confidence FROM h), m AS (SELECT category, name, max(confidence) AS best, count(*) AS clusters FROM (SELECT category, (name::INT % 2)::VARCHAR AS name, confidence FROM g) GROUP BY ALL)
SELECT category, name, floor(least(1 - (1 - best) * pow(0.9, clusters - 1), 0.95) * 1000 + 0.5) / 1000 AS confidence, clusters FROM m""")
def merged_across_clusters(spark, sf_dir):
    h = _hypotheses(spark, sf_dir).select(F.col("hypothesis").alias("category"), (F.split("component", "-")[1].cast("int") % 2).cast("string").alias("name"), "confidence")
    return scoring.merged_across_clusters(h)


@query("entities", sql="""SELECT name, cluster, count(*) AS hints, bool_or(cluster_known) AS cluster_known, coalesce(string_agg(DISTINCT namespace, ',' ORDER BY namespace), '') AS namespaces, min(seq) AS first_seq FROM entities GROUP BY ALL""")
def entity_merge(spark, sf_dir):
    return entities.merged(view(spark, sf_dir, "entities"), ["name", "cluster"])


@query("entities", sql="""p AS (SELECT name, cluster, count(DISTINCT namespace) AS places, min(namespace) AS target FROM entities WHERE namespace IS NOT NULL GROUP BY ALL)
SELECT seq, name, cluster, target FROM entities JOIN p USING (name, cluster) WHERE namespace IS NULL AND places = 1""")
def reconcile_unique_place(spark, sf_dir):
    return entities.reconciled(view(spark, sf_dir, "entities"))


@query(sql="""WITH w AS (SELECT DISTINCT concat('shop-', p_brand, '-', p_size) AS name FROM part), g AS (SELECT DISTINCT concat('shop-', p_brand, '-', p_partkey % 60) AS rel FROM part UNION SELECT DISTINCT concat('shop-', p_brand) FROM part)
SELECT rel AS release, min(name) AS name FROM g JOIN w ON w.name = rel OR starts_with(w.name, rel || '-') GROUP BY rel HAVING count(*) = 1""")
def release_prefix_fold(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    release = lambda *c: p.select(F.concat(F.lit("shop-"), *c).alias("release"))
    guesses = release("p_brand", F.lit("-"), (F.col("p_partkey") % 60).cast("string")).union(release("p_brand"))
    return entities.release_targets(guesses, p.select(F.concat(F.lit("shop-"), "p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("name")))


@query("entities", sql="SELECT name AS store, string_agg(DISTINCT cluster, ',' ORDER BY cluster) AS clusters FROM entities GROUP BY name HAVING count(DISTINCT cluster) > 1")
def shared_datastores(spark, sf_dir):
    return entities.shared_stores(view(spark, sf_dir, "entities").withColumnRenamed("name", "store"))


# --- budgets and stack fit ---------------------------------------------------------------------------

BUDGETS = """b AS (SELECT component AS id, count(*) FILTER (severity = 'error') / count(*) / 20 / (1 - 0.999) AS burn, count(*)::DOUBLE AS minutes, 30.0::DOUBLE AS window_days, 12.5::DOUBLE AS spent FROM signals GROUP BY ALL)"""


def _budgets(spark, sf_dir):
    n = view(spark, sf_dir, "signals").groupBy(F.col("component").alias("id")).agg(F.count_if(F.col("severity") == "error").alias("e"), F.count("*").alias("n"))
    return n.select("id", budget.burn(F.col("e") / F.col("n") / 20, F.lit(0.999)).alias("burn"), F.col("n").cast("double").alias("minutes"), F.lit(30.0).alias("window_days"), F.lit(12.5).alias("spent"))


@query("signals", sql=BUDGETS + """, r AS (SELECT id, burn, window_days, unnest([struct_pack(share := 0.02::DOUBLE, long_h := 1.0::DOUBLE, act := 'page'), struct_pack(share := 0.05::DOUBLE, long_h := 6.0::DOUBLE, act := 'page'), struct_pack(share := 0.1::DOUBLE, long_h := 72.0::DOUBLE, act := 'ticket')]) AS x FROM b),
t AS (SELECT id, burn, x.share AS share, x.long_h AS long_h, x.act AS action, x.share * window_days * 24 / x.long_h AS threshold FROM r)
SELECT id, share, long_h, action, floor(threshold * 10000 + 0.5) / 10000 AS threshold, burn >= threshold - 1e-9 AS would_fire, CASE WHEN burn >= threshold - 1e-9 THEN floor(long_h * 60 * threshold / burn * 100 + 0.5) / 100 END AS fires_after_min FROM t""")
def burn_rate_rows(spark, sf_dir):
    return budget.alert_rows(_budgets(spark, sf_dir))


@query("signals", sql=BUDGETS + """, a AS (SELECT *, unnest([0.0, 30.0, 120.0])::DOUBLE AS ahead_min FROM b), u AS (SELECT *, burn * (minutes + ahead_min) / (window_days * 1440) * 100 AS used FROM a)
SELECT id, ahead_min, floor(used * 1000 + 0.5) / 1000 AS consumed_pct, floor(greatest(0.0, 100 - spent - used) * 1000 + 0.5) / 1000 AS remaining_pct FROM u""")
def budget_projection(spark, sf_dir):
    return budget.projections(_budgets(spark, sf_dir))


@query("signals", sql=BUDGETS + """, a AS (SELECT *, unnest(range(0, 25))::INT AS point FROM b), m AS (SELECT *, (minutes + 120) * point / 24 AS minute FROM a)
SELECT id, point, floor(minute * 100 + 0.5) / 100 AS minute, floor(greatest(0.0, 100 - spent - burn * minute / (window_days * 1440) * 100) * 1000 + 0.5) / 1000 AS remaining_pct FROM m""")
def budget_series(spark, sf_dir):
    return budget.series(_budgets(spark, sf_dir))


@query("signals", sql="""g AS (SELECT component, user_id, CASE WHEN user_id % 5 = 0 THEN 0.02 END AS o, CASE WHEN user_id % 4 = 0 THEN 0.03 END AS a, CASE WHEN user_id % 3 = 0 THEN 0.04 END AS t, count(*) FILTER (severity = 'error') AS e, count(*) AS n FROM signals GROUP BY ALL)
SELECT user_id, round(coalesce(o, a, t, CASE WHEN n >= 20 THEN e / n END, 0.01), 6)::DOUBLE AS ratio, CASE WHEN o IS NOT NULL THEN 'override' WHEN a IS NOT NULL THEN 'alert' WHEN t IS NOT NULL THEN 'traces' WHEN n >= 20 THEN 'logs' ELSE 'default' END AS source FROM g""")
def error_ratio_resolution(spark, sf_dir):
    g = view(spark, sf_dir, "signals").groupBy("user_id").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count("*").alias("n"))
    every = lambda k, v: F.when(F.col("user_id") % k == 0, v)
    r = budget.error_ratio(every(5, 0.02), every(4, 0.03), every(3, 0.04), F.col("e"), F.col("n"))
    return g.select("user_id", F.round(r["ratio"], 6).alias("ratio"), r["source"].alias("source"))


@query("signals", sql=BUDGETS + """ SELECT id, CASE WHEN burn >= 0.02 * 24 / 1.0 * window_days AND id LIKE '%1' THEN 'SEV1' WHEN burn >= 0.05 * 24 / 6.0 * window_days THEN 'SEV2' WHEN burn > 0 THEN 'SEV3' ELSE 'SEV4' END AS severity,
  CASE WHEN burn > 0 THEN round(87.5 / 100 * window_days * 24 / burn, 6) END AS exhaustion_hours, round(burn * greatest(0.0, 120.0 - 6) / (window_days * 1440) * 100 * 0.5, 6) AS saved_pct FROM b""")
def incident_severity(spark, sf_dir):
    b = F.col("burn")
    sev = budget.severity_level(b, F.col("window_days"), F.col("id").endswith("1"), b > 0, F.lit(False))
    return _budgets(spark, sf_dir).select("id", sev.alias("severity"), F.round(budget.exhaustion_hours(b, 100 - F.col("spent"), F.col("window_days")), 6).alias("exhaustion_hours"), F.round(budget.saved_pct(b, F.lit(6.0), F.col("window_days"), F.lit(0.5)), 6).alias("saved_pct"))


TIERS = [(0.0, 1000.0, 0.9), (1000.0, 5000.0, 0.35), (5000.0, None, 0.16)]


@query(sql="""SELECT c_custkey AS id, floor((greatest(least(a, 1000) - 0, 0) * 0.9::DOUBLE + greatest(least(a, 5000) - 1000, 0) * 0.35::DOUBLE + greatest(a - 5000, 0) * 0.16::DOUBLE) * 10000 + 0.5) / 10000 AS cost FROM (SELECT c_custkey, c_acctbal AS a FROM customer)""")
def tiered_cost(spark, sf_dir):
    return stackfit.tiered_cost(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount")), TIERS)


@query("signals", sql="""l AS (SELECT 'component' AS key, component AS value FROM signals UNION ALL SELECT 'cluster', cluster FROM signals UNION ALL SELECT 'user_id', user_id::VARCHAR FROM signals UNION ALL SELECT 'kind', kind FROM signals)
SELECT key, count(DISTINCT value) AS "values", regexp_matches(key, '(?i)(^|[_-])(id|uuid|guid|user|session|request|trace|email|ip|url|path)([_-]|\\z)') AS id_like FROM l GROUP BY key HAVING count(DISTINCT value) >= 20 OR id_like""")
def high_cardinality_keys(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    pairs = F.explode(F.create_map(*[x for k in ("component", "cluster", "user_id", "kind") for x in (F.lit(k), F.col(k).cast("string"))]))
    return stackfit.high_cardinality(s.select(pairs))


@query("signals", sql="""f AS (SELECT component AS id, CASE WHEN kind = 'http_5xx' AND value > 99 THEN 'breaks' WHEN kind = 'timeout' AND value > 90 THEN 'strain' ELSE 'ok' END AS level FROM signals)
SELECT id, CASE WHEN count(*) FILTER (level = 'breaks') > 0 THEN 'Strained' WHEN count(*) FILTER (level = 'strain') >= 2 THEN 'Workable' ELSE 'Good fit' END AS verdict FROM f GROUP BY ALL""")
def stack_verdict(spark, sf_dir):
    level = F.when((F.col("kind") == "http_5xx") & (F.col("value") > 99), "breaks").when((F.col("kind") == "timeout") & (F.col("value") > 90), "strain").otherwise("ok")
    return stackfit.verdict(view(spark, sf_dir, "signals").select(F.col("component").alias("id"), level.alias("level")))


# --- text --------------------------------------------------------------------------------------------


def _sql_pattern(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _classify_sql(c: str) -> str:
    m = lambda p, flags="": f"regexp_matches({c}, {_sql_pattern(flags + p)})"
    five = " OR ".join([m(V.STATUS_FIELD + r"5\d\d\b", "(?i)"), m(r"\bHTTP/\d(?:\.\d)?\"?\s+5\d\d\b"), m(V.REASON_5XX, "(?i)"), m(V.ANSWERED_5XX, "(?i)"), f"({m(r' 5\d\d(?: |\z)')} AND {m(V.HTTP_WORDS, '(?i)')} AND NOT {m(V.COUNTED_UNITS, '(?i)')})"])
    limit = " OR ".join([m(V.RATE_WORDS, "(?i)"), m(V.STATUS_FIELD + r"429\b", "(?i)"), m(r"\bHTTP/\d(?:\.\d)?\"?\s+429\b"), m(r"\b(?:code|response|returned)[=: ]+429\b", "(?i)"), f"({m(r'(?:^|\s)429(?:\s|\z)')} AND {m(V.HTTP_WORDS_429, '(?i)')})"])
    whens = " ".join(f"WHEN {m(p, '(?i)') if p else (limit if k == 'http_429' else five)} THEN '{k}'" for k, p in V.LOG_PATTERNS)
    return f"CASE {whens} END"


@query("log_lines", sql=f"SELECT seq, {_classify_sql('body')} AS kind FROM log_lines")
def text_classify(spark, sf_dir):
    return view(spark, sf_dir, "log_lines").select("seq", text.classify(F.col("body")).alias("kind"))


LEVEL_SQL = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(x) for x in words)}) THEN '{s}'" for s, words in V.LEVEL_WORDS.items()) + " END"


@query("log_lines", sql=f"""h AS (SELECT seq, nullif(regexp_extract(left(body, 90), {_sql_pattern(V.LEVEL_UPPER)}, 1), '') AS u, nullif(regexp_extract(left(body, 90), {_sql_pattern(V.LEVEL_LEADING)}, 1) || regexp_extract(left(body, 90), {_sql_pattern(V.LEVEL_LEADING)}, 2), '') AS l FROM log_lines),
w AS (SELECT seq, lower(coalesce(u, l)) AS w FROM h) SELECT seq, {LEVEL_SQL} AS level FROM w""")
def level_detect(spark, sf_dir):
    return view(spark, sf_dir, "log_lines").select("seq", text.level_in(F.col("body")).alias("level"))


NUMBER_SQL = "CASE WHEN n >= 60 THEN 'critical' WHEN n >= 50 THEN 'error' WHEN n >= 40 THEN 'warn' WHEN n >= 10 THEN 'info' WHEN n <= 2 THEN 'critical' WHEN n = 3 THEN 'error' WHEN n = 4 THEN 'warn' WHEN n >= 5 THEN 'info' END"


@query("name_samples", sql=f"w AS (SELECT seq, lower(trim(level)) AS w, CASE WHEN regexp_matches(level, '^\\d{{1,9}}$') THEN level::INT END AS n FROM name_samples) SELECT seq, coalesce({NUMBER_SQL}, {LEVEL_SQL}) AS level FROM w")
def level_words(spark, sf_dir):
    return view(spark, sf_dir, "name_samples").select("seq", text.level_of(F.col("level")).alias("level"))


FLOOR_SQL = "CASE " + " ".join(f"WHEN kind = '{k}' THEN {V.SEVERITIES.index(s)}" for k, s in V.FLOOR.items()) + " WHEN kind IS NULL THEN 0 ELSE 2 END"


@query("log_lines", sql=f"""k AS (SELECT seq, {_classify_sql('body')} AS kind FROM log_lines) SELECT seq, kind, (['info', 'warn', 'error', 'critical'])[greatest({FLOOR_SQL}, 1) + 1] AS severity FROM k""")
def severity_floor(spark, sf_dir):
    k = view(spark, sf_dir, "log_lines").select("seq", text.classify(F.col("body")).alias("kind"))
    return k.withColumn("severity", text.with_floor(F.col("kind"), F.lit("warn")))


EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"


@query(sql=f"SELECT doc_id, sha256(regexp_replace(text, {_sql_pattern(EMAIL)}, '[REDACTED:email]', 'g')) AS redacted, len(regexp_extract_all(text, {_sql_pattern(EMAIL)}))::INT AS emails FROM documents")
def redact_emails(spark, sf_dir):
    kind, pattern, new = next(p for p in text.redaction_passes() if p[0] == "email")
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.regexp_replace("text", pattern, new), 256).alias("redacted"), F.regexp_count("text", F.lit(pattern)).alias("emails"))


REDACTED_SQL = {
    "private_key": (r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[\s\S]*?(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|\z)", "[REDACTED:private-key]"),
    "jwt": (r"\beyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]*", "[REDACTED:jwt]"),
    "bearer": (r"\b(Bearer)(\s+)([A-Za-z0-9._~+/=-]{8,})", r"\1\2[REDACTED:bearer]"),
    "basic": (r"\b(Basic)(\s+)([A-Za-z0-9._~+/=-]{8,})", r"\1\2[REDACTED:basic-auth]"),
    "aws_key": (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[REDACTED:aws-key]"),
    "url_credential": (r"(?i)\b([a-z][a-z0-9+.-]*://)([^:/@\s\[]+):([^@\s/\[]+)@", r"\1\2:[REDACTED:url-credential]@"),
    # RE2 has neither look-ahead nor references: quoted and bare values apart, values of 6 and more characters that aren't digits alone.
    "quoted": (rf"(?i)([\"']?\b{text.SECRET_KEY}[\"']?[ \t]*[:=][ \t]*)\"([^\s\"',;&}}\[$<{{]{{6,}})\"", r'\1"[REDACTED:secret-value]"'),
    "bare": (rf"(?i)([\"']?\b{text.SECRET_KEY}[\"']?[ \t]*[:=][ \t]*)([^\s\"',;&}}\[$<{{][^\s\"',;&}}]{{5,}})", r"\1[REDACTED:secret-value]"),
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", "[REDACTED:email]"),
}


def _redaction_sql() -> str:
    """The passes in RE2's pattern language, over the shapes that documents hold; no document has 40 base64 characters in a row beside a digest."""
    parts, now = ["t0 AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"], 0
    for name, (pattern, new) in REDACTED_SQL.items():
        p = _sql_pattern(pattern)
        parts.append(f"t{now + 1} AS (SELECT * REPLACE (regexp_replace(t, {p}, {_sql_pattern(new)}, 'g') AS t), len(regexp_extract_all(t, {p})) AS n_{name} FROM t{now})")
        now += 1
    counts = "n_private_key::INT AS private_key, n_jwt::INT AS jwt, (n_bearer + n_basic)::INT AS bearer, n_aws_key::INT AS aws_key, n_url_credential::INT AS url_credential, (n_quoted + n_bare)::INT AS secret_value, n_email::INT AS email, 0::INT AS base64"
    return f"WITH {', '.join(parts)} SELECT doc_id, sha256(t) AS redacted, {counts} FROM t{now}"


@query(sql=_redaction_sql())
def redact_all(spark, sf_dir):
    d = text.redacted(read(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", F.sha2("text", 256).alias("redacted"), *[F.col("counts")[k].alias(k.replace("-", "_")) for k in dict.fromkeys(p[0] for p in text.redaction_passes())])


@query("log_lines", sql="""SELECT seq, nullif(regexp_extract(body, '(?:^|\\s)level=([^\\s"]*)', 1), '') AS level, nullif(regexp_extract(body, '(?:^|\\s)msg="([^"]*)"', 1), '') AS msg, nullif(regexp_extract(body, '(?:^|\\s)status=([^\\s"]*)', 1), '') AS status FROM log_lines""")
def logfmt_pairs(spark, sf_dir):
    m = view(spark, sf_dir, "log_lines").select("seq", text.logfmt(F.col("body")).alias("m"))
    return m.select("seq", *[F.col("m")[k].alias(k) for k in ("level", "msg", "status")])


@query(sql="SELECT doc_id, count(*) AS n_lines, max(length(line))::INT AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL")
def pane_lines(spark, sf_dir):
    rows = lines.split_lines(read(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"))


@query("name_samples", sql=r"""n AS (SELECT seq, lower(regexp_replace(trim(pod), '^["'']|["'']$', '', 'g')) AS p FROM name_samples),
m AS (SELECT seq, p, regexp_extract(p, '^(.+)-([a-z0-9]{8,10})-([a-z0-9]{5})$', ['a', 'b', 'c']) AS d, regexp_extract(p, '^(.+)-([a-z0-9]{5})$', ['a', 'b']) AS s, regexp_extract(p, '^(.+)-(\d{1,4})$', ['a', 'b']) AS o FROM n),
g AS (SELECT *, d.b <> '' AND regexp_matches(d.b, '^[bcdfghjklmnpqrstvwxz2456789]+$|\d') AS dep, s.b <> '' AND regexp_matches(s.b, '^[bcdfghjklmnpqrstvwxz2456789]+$|\d') AS dae FROM m)
SELECT seq, CASE WHEN dep THEN d.a WHEN dae THEN s.a WHEN o.b <> '' THEN o.a ELSE p END AS workload, CASE WHEN dep THEN 'Deployment' WHEN dae THEN 'DaemonSet' WHEN o.b <> '' THEN 'StatefulSet' END AS controller FROM g""")
def pod_to_workload(spark, sf_dir):
    o = names.pod_owner(F.col("pod"))
    return view(spark, sf_dir, "name_samples").select("seq", o["workload"].alias("workload"), o["controller"].alias("controller"))


@query("name_samples", sql=f"""n AS (SELECT seq, lower(regexp_replace(trim(pod), '^["'']|["'']$', '', 'g')) AS p FROM name_samples),
c AS (SELECT seq, regexp_matches(p, {_sql_pattern(V.CORE_DNS)}) OR regexp_matches(p, {_sql_pattern(V.INFRA)}) AS i, regexp_matches(p, {_sql_pattern(V.INGRESS)}) AS g, regexp_matches(p, {_sql_pattern(V.DATASTORE)}) AND NOT regexp_matches(p, {_sql_pattern(V.NOT_DATASTORE)}) AS d FROM n)
SELECT seq, CASE WHEN i THEN 'infra' WHEN NOT g AND d THEN 'datastore' ELSE 'service' END AS type, CASE WHEN NOT i AND g THEN 'ingress' END AS role FROM c""")
def name_class(spark, sf_dir):
    t = names.component_type(F.col("pod"))
    return view(spark, sf_dir, "name_samples").select("seq", t["type"].alias("type"), t["role"].alias("role"))


@query("name_samples", sql=r"""h AS (SELECT seq, regexp_replace(regexp_replace(lower(trim(host)), '^[a-z][a-z0-9+.-]*://', ''), '[:/].*$', '') AS h FROM name_samples),
m AS (SELECT seq, h, regexp_extract(h, '^([a-z0-9][a-z0-9-]*)\.([a-z0-9][a-z0-9-]*)\.svc(\.[a-z0-9.-]+)?$', ['a', 'b', 'c']) AS s, h <> '' AND h <> 'localhost' AND NOT regexp_matches(h, '^\d{1,3}(\.\d{1,3}){3}$') AS ok FROM h)
SELECT seq, CASE WHEN ok THEN CASE WHEN s.a <> '' THEN s.a ELSE h END END AS name, CASE WHEN ok AND s.a <> '' THEN s.b END AS namespace, CASE WHEN ok THEN s.a = '' AND contains(h, '.') END AS external FROM m""")
def host_parts(spark, sf_dir):
    h = names.host_parts(F.col("host"))
    return view(spark, sf_dir, "name_samples").select("seq", h["name"].alias("name"), h["namespace"].alias("namespace"), h["external"].alias("external"))


@query("signals", sql="""c AS (SELECT seq, component || '|' || kind AS k FROM signals), h AS (SELECT seq, list_reduce(list_prepend(2166136261::BIGINT, [ascii(x)::BIGINT for x in string_split(k, '')]), lambda a, x: (xor(a, x) * 16777619) & 4294967295) AS h FROM c)
SELECT seq, lower(to_base(h, 36)) AS id FROM h""")
def fnv_hash_id(spark, sf_dir):
    return view(spark, sf_dir, "signals").select("seq", names.fnv_id(F.concat_ws("|", "component", "kind")).alias("id"))


@query("name_samples", sql="SELECT seq, CASE age " + " ".join(f"WHEN '{a}' THEN {v}" for a, v in [("3m12s", 192000), ("5d4h", 446400000), ("1.5s", 1500), ("45s", 45000), ("2m (x5 over 10m)", 120000), ("300ms", 300), ("2y3w", 64886400000), ("12us", 0)]) + " END::BIGINT AS age_ms FROM name_samples")
def age_to_ms(spark, sf_dir):
    return view(spark, sf_dir, "name_samples").select("seq", times.age_ms(F.col("age")).alias("age_ms"))


@query("signals", sql="""n AS (SELECT seq, CASE seq % 4 WHEN 0 THEN ts_ms // 1000 WHEN 1 THEN ts_ms WHEN 2 THEN ts_ms * 1000 ELSE ts_ms * 1000000 END AS n FROM signals)
SELECT seq, floor(CASE WHEN n < 1e11 THEN n::DOUBLE * 1000 WHEN n < 1e14 THEN n::DOUBLE WHEN n < 1e17 THEN n::DOUBLE / 1000 ELSE n::DOUBLE / 1e6 END + 0.5)::BIGINT AS ms FROM n""")
def epoch_unit(spark, sf_dir):
    t = F.col("ts_ms")
    n = F.when(F.col("seq") % 4 == 0, F.floor(t / 1000)).when(F.col("seq") % 4 == 1, t).when(F.col("seq") % 4 == 2, t * 1000).otherwise(t * 1000000)
    return view(spark, sf_dir, "signals").select("seq", times.epoch_ms(n).alias("ms"))


@query("name_samples", sql="SELECT seq, CASE zone " + " ".join(f"WHEN '{a}' THEN {v}" for a, v in [("Z", 0), ("UTC", 0), ("+02:00", 120), ("-0530", -330), ("UTC+2", 120), ("CEST", 120), ("", 0), ("pst", -480)]) + " END::INT AS minutes FROM name_samples")
def tz_offset(spark, sf_dir):
    return view(spark, sf_dir, "name_samples").select("seq", times.offset_minutes(F.col("zone")).cast("int").alias("minutes"))


@query("name_samples", sql="SELECT seq, CASE quantity " + " ".join(f"WHEN '{a}' THEN {v}" for a, v in [("512Mi", 536870912), ("500m", 0.5), ("2", 2), ("1Gi", 1073741824), ('"250m"', 0.25), ("1.5k", 1500), ("3T", 3e12), ("64Ki", 65536), ("0", 0)]) + " END::DOUBLE AS number FROM name_samples")
def k8s_quantity(spark, sf_dir):
    return view(spark, sf_dir, "name_samples").select("seq", times.quantity(F.col("quantity")).alias("number"))


@query("log_lines", sql="SELECT seq, body FROM log_lines WHERE contains(lower(body), 'connection') ORDER BY seq LIMIT 40")
def search_evidence(spark, sf_dir):
    return lookup.search(view(spark, sf_dir, "log_lines"), "CONNECTION").select("seq", "body")


@query("signals", sql=f"SELECT seq, ts_ms, severity FROM signals WHERE component = 'svc-7' ORDER BY {RANK} DESC, ts_ms, seq LIMIT 25")
def component_signals_topk(spark, sf_dir):
    return lookup.component_signals(view(spark, sf_dir, "signals"), "svc-7").select("seq", "ts_ms", "severity")


@query("spans", sql=LINKED.lstrip() + """, d AS (SELECT 'caller' AS direction, "from" AS other, calls, errors FROM edges WHERE "to" = 'supp-3' UNION ALL SELECT 'callee', "to", calls, errors FROM edges WHERE "from" = 'supp-3')
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY direction ORDER BY errors DESC, calls DESC, other) <= 30""")
def dependencies(spark, sf_dir):
    return lookup.dependencies(cut(_edges(spark, sf_dir)), "supp-3")


@query("log_lines", sql="c AS (SELECT seq, component, sum(strlen(body)) OVER (PARTITION BY component ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS used_bytes FROM log_lines) SELECT * FROM c WHERE used_bytes <= 8000")
def byte_budget_prefix(spark, sf_dir):
    return lookup.within_bytes(view(spark, sf_dir, "log_lines"), ["component"], ["seq"], "body", 8000).select("seq", "component", "used_bytes")


@query("signals", "log_lines", sql="u AS (SELECT seq, ts_ms, component, 0 AS src_ord FROM signals UNION ALL SELECT seq, ts_ms, component, 1 FROM log_lines) SELECT component, src_ord, count(*) AS n, min(ts_ms) AS first_ms FROM u GROUP BY ALL")
def union_panes(spark, sf_dir):
    part = lambda name, i: view(spark, sf_dir, name).select("seq", "ts_ms", "component", F.lit(i).alias("src_ord"))
    return part("signals", 0).unionByName(part("log_lines", 1)).groupBy("component", "src_ord").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"))


# --- live windows (extensions), whole analyses -------------------------------------------------------


@query("signals", sql=f"SELECT component, ts_ms // 300000 * 300000 AS start_ms, count(*) FILTER ({RANK} >= 2) AS errors, count(*) AS total FROM signals GROUP BY ALL")
def live_counts(spark, sf_dir):
    return live.counts(live.with_instant(view(spark, sf_dir, "signals")))


@query("signals", sql=f"""w AS (SELECT component, severity, unnest([ts_ms // 1800000 * 1800000, ts_ms // 1800000 * 1800000 - 1800000]) AS start_ms FROM signals)
SELECT component, start_ms, round(count(*) FILTER ({RANK} >= 2) / count(*) / (1 - 0.999), 6) AS burn FROM w GROUP BY ALL""")
def live_burn_rates(spark, sf_dir):
    return live.burn_rates(live.with_instant(view(spark, sf_dir, "signals")))


@query("signals", sql=f"""a AS (SELECT component, ts_ms, seq FROM signals WHERE {ANOMALY} AND {RANK} >= 1), g AS (SELECT *, ts_ms - lag(ts_ms) OVER k >= 1800000 AS cut FROM a WINDOW k AS (PARTITION BY component ORDER BY ts_ms, seq)),
s AS (SELECT component, ts_ms, sum(coalesce(cut, true)::INT) OVER (PARTITION BY component ORDER BY ts_ms, seq) AS no FROM g) SELECT component, min(ts_ms) AS start_ms, max(ts_ms) + 1800000 AS end_ms, count(*) AS n FROM s GROUP BY component, no""")
def live_sessions(spark, sf_dir):
    return live.sessions(live.with_instant(view(spark, sf_dir, "signals")))


def _panes(spark, sf_dir):
    """Incidents of 200 successive log lines and of the spans of 200 successive traces, so that they grow in number with the tables, not in size."""
    lines_ = view(spark, sf_dir, "log_lines").withColumn("incident_id", F.concat(F.lit("inc-"), F.expr("cast(seq div 200 as string)")))
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    keyed = lambda df, line, key: spread(df.select("incident_id", F.struct(F.col(key).alias("k"), line.alias("l")).alias("x")), "incident_id")
    ordered = lambda df, line, key: keyed(df, line, key).groupBy("incident_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["l"]), "\n").alias("text"))
    log = ordered(lines_, F.concat(F.lit("[pod/"), "component", F.lit("-7d9f8b6c5-x2k4j/app] "), stamp, F.lit(" "), "body"), "seq").withColumn("source", F.lit("logs"))
    s = view(spark, sf_dir, "spans").withColumns({"incident_id": F.concat(F.lit("inc-"), F.expr("cast(trace_id div 200 as string)")), "ts_ms": F.col("start_ms")})
    span = F.concat(stamp, F.lit(" trace="), F.col("trace_id").cast("string"), F.lit(" span="), (F.col("span_id") + 1).cast("string"), F.lit(" parent="), F.coalesce((F.col("parent_id") + 1).cast("string"), F.lit("-")), F.lit(" service="), "service", F.lit(" kind="), "kind", F.lit(" op="), "op", F.lit(" dur="), F.col("dur_ms").cast("long").cast("string"), F.lit("ms status="), F.when(F.col("error"), "error").otherwise("ok"))
    trace = ordered(s.withColumn("line_key", F.struct("trace_id", "span_id")), span, "line_key").withColumn("source", F.lit("traces"))
    return log.unionByName(trace).select("incident_id", "source", "text")


#: What the log reader makes of LOG_TEXTS, by place: kind and severity.
_SHOWN = ["oom_killed error", "crash_loop error", "image_pull error", "probe_failed warn", "dns_failure error", "tls_error error", "conn_exhaustion critical", "migration error", "conn_refused error", "timeout error", "http_429 warn", "", "http_5xx error", "throttled warn", "rollout info", "restart info", "scheduling_failed warn", "panic critical", "hpa_maxed warn", ""]
_HOME = "'service:cluster-1/default/' || "
_ANALYSIS = f"""k AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{x.split()[0]}', '{x.split()[1]}')" for i, x in enumerate(_SHOWN) if x)}) t(idx, kind, severity)),
sig AS (SELECT seq // 200 AS i, component AS c, kind, severity, ts_ms // 1000 * 1000 AS ts FROM log_lines JOIN k ON seq % 20 = idx UNION ALL SELECT trace_id // 200, service, 'span_error', 'error', start_ms // 1000 * 1000 FROM spans WHERE error),
err AS (SELECT * FROM sig WHERE {ANOMALY} AND {RANK} >= 2), lead_ AS (SELECT i, ts, lead(ts) OVER w AS nxt, count(*) OVER (PARTITION BY i ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft FROM err WINDOW w AS (PARTITION BY i ORDER BY ts)),
onset AS (SELECT i, min(ts) AS onset_ms FROM lead_ WHERE nxt IS NULL OR nxt - ts <= 3600000 OR lft < 3 GROUP BY i),
parents AS (SELECT trace_id, span_id AS parent_id, max(service) AS parent_service FROM spans GROUP BY ALL),
edges AS (SELECT s.trace_id // 200 AS i, parent_service AS f, service AS t, count(*) AS calls, count(*) FILTER (error) AS errors, floor(count(*) FILTER (error) / count(*) * 10000 + 0.5) / 10000 AS rate FROM spans s JOIN parents USING (trace_id, parent_id) WHERE parent_service <> service GROUP BY ALL),
failing AS (SELECT DISTINCT i, c FROM err JOIN onset USING (i) WHERE ts >= onset_ms - 900000 UNION SELECT i, t FROM edges WHERE rate >= 0.2),
deep AS (SELECT DISTINCT i, c FROM failing JOIN edges e USING (i) WHERE e.t = c AND rate >= 0.2 AND (i, c) NOT IN (SELECT (o.i, o.f) FROM edges o JOIN failing x ON x.i = o.i AND x.c = o.t)),
n AS (SELECT i, c, kind, count(*) AS n FROM sig GROUP BY ALL), one AS (SELECT i, kind, arg_min(c, (-n, c)) AS c, count(*) AS clients FROM n WHERE kind IN ('dns_failure', 'tls_error', 'conn_exhaustion') GROUP BY ALL),
has AS (SELECT i, c, sum(n) FILTER (kind = 'crash_loop') AS crash, sum(n) FILTER (kind = 'hpa_maxed') AS maxed, count(*) FILTER (kind = 'span_error' OR kind IN (SELECT kind FROM err)) AS own FROM n GROUP BY ALL),
worst AS (SELECT e.i, e.t AS c, arg_min(e.f, (-errors, e.f)) AS f FROM edges e JOIN deep d ON d.i = e.i AND d.c = e.t WHERE rate >= 0.2 GROUP BY ALL),
clue AS (SELECT i, 'resource-limits' AS category, c, 0.5 AS w FROM n WHERE kind = 'oom_killed' UNION ALL SELECT n.i, 'resource-limits', n.c, 0.15 FROM n JOIN has USING (i, c) WHERE kind = 'oom_killed' AND crash > 0
  UNION ALL SELECT i, 'image-pull', c, 0.55 FROM n WHERE kind = 'image_pull' UNION ALL SELECT i, 'probe-misconfig', c, 0.25 FROM n WHERE kind = 'probe_failed' UNION ALL SELECT i, 'rate-limiting', c, 0.45 FROM n WHERE kind = 'http_429'
  UNION ALL SELECT i, 'scheduling-capacity', c, least(0.4, 0.2 + 0.05 * (n - 1)) FROM n WHERE kind = 'scheduling_failed' UNION ALL SELECT n.i, 'scheduling-capacity', n.c, 0.2 FROM n JOIN has USING (i, c) WHERE kind = 'scheduling_failed' AND maxed > 0
  UNION ALL SELECT i, 'dns', c, least(0.55, 0.35 + 0.05 * (clients - 1)) FROM one WHERE kind = 'dns_failure' UNION ALL SELECT i, 'tls-cert', c, 0.45 FROM one WHERE kind = 'tls_error'
  UNION ALL SELECT i, 'connection-exhaustion', c, 0.4 FROM one WHERE kind = 'conn_exhaustion' UNION ALL SELECT i, 'connection-exhaustion', c, 0.1 FROM one WHERE kind = 'conn_exhaustion' AND clients > 1 UNION ALL SELECT o.i, 'connection-exhaustion', o.c, 0.15 FROM one o JOIN has USING (i, c) WHERE o.kind = 'conn_exhaustion' AND maxed > 0
  UNION ALL SELECT w.i, 'dependency-failure', w.c, 0.35 FROM worst w WHERE (w.i, w.f) IN (SELECT (i, c) FROM err) UNION ALL SELECT d.i, 'dependency-failure', d.c, 0.2 FROM deep d JOIN worst USING (i, c) WHERE (d.i, d.c) IN (SELECT (i, c) FROM err)),
raw AS (SELECT g.i, category, g.c, pieces, base * CASE WHEN deep.c IS NOT NULL THEN 1.1 ELSE 1 END AS raw FROM (SELECT i, category, c, count(*) AS pieces, 1 - exp(sum(ln(1 - w::DOUBLE))) AS base FROM clue GROUP BY ALL) g LEFT JOIN deep ON deep.i = g.i AND deep.c = g.c),
scored AS (SELECT i, category, c, pieces, raw, floor(CASE WHEN pieces < 2 THEN least(raw, 0.5) ELSE least(raw, 0.95) END * 1000 + 0.5) / 1000 AS confidence FROM raw),
weak AS (SELECT i FROM (SELECT DISTINCT seq // 200 AS i FROM log_lines UNION SELECT DISTINCT trace_id // 200 FROM spans) LEFT JOIN scored USING (i) GROUP BY i HAVING coalesce(max(confidence), 0) < 0.35),
most AS (SELECT f.i, arg_min(f.c, (-coalesce(e.n, 0), f.c)) AS c FROM failing f JOIN weak USING (i) LEFT JOIN (SELECT i, c, count(*) AS n FROM err GROUP BY ALL) e ON e.i = f.i AND e.c = f.c GROUP BY f.i),
every AS (SELECT i, category, {_HOME} c AS c, confidence, raw, pieces FROM scored UNION ALL SELECT i, 'unknown', {_HOME} c, 0.3, 0.3, 1 FROM most
  UNION ALL SELECT i, 'unknown', '', 0.3, 0.3, 0 FROM weak WHERE i NOT IN (SELECT i FROM most) AND i NOT IN (SELECT i FROM scored)),
placed AS (SELECT *, list_position({rules.CATEGORIES}, category) AS sp FROM every), few AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY i, c ORDER BY confidence DESC, round(raw, 9) DESC, sp) <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY confidence DESC, round(raw, 9) DESC, sp, c) AS rank FROM few)
SELECT 'inc-' || i AS incident_id, category, c AS component, confidence, floor(raw * 1000 + 0.5) / 1000 AS raw, pieces, 0::BIGINT AS changes, rank::INT AS rank FROM r WHERE rank <= 6"""


@query("log_lines", "spans", sql=_ANALYSIS)
def analysis_hypotheses(spark, sf_dir):
    """Ranked causes of incidents built from the tables, through all readers and rules."""
    return analyze(_panes(spark, sf_dir), only_causes=True)["hypotheses"]


@query()
def analysis_log_signals(spark, sf_dir):
    panes = _panes(spark, sf_dir).filter("source = 'logs'")
    return logs.read_logs(panes.select("incident_id", "text")).groupBy("incident_id", "kind", "severity").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"))
