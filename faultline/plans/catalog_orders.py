"""Queries of result orders, set operations and aggregates over alerts, releases and panes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget, orders
from ..session import cut
from ..sources.adapters import view
from .catalog import LINKED, RANK, RISK_RANK, _edges, cases, query

STATUS_PLACE = cases("status", [(s, i) for i, s in enumerate(orders.STATUSES)], "5")
TYPE_PLACE = cases("type", [(s, i) for i, s in enumerate(orders.TYPES)], "5")


@query("faults", sql="SELECT seq, ts_ms, " + cases("source", [("helm", 0), ("alerts", 1), ("logs", 2), ("traces", 3)]) + " AS source_place, source_line FROM faults ORDER BY ts_ms NULLS LAST, source_place, source_line, seq")
def signals_in_order(spark, sf_dir):
    from ..operators.timeline import SOURCES

    return orders.signals_out(view(spark, sf_dir, "faults")).select("seq", "ts_ms", orders.place_in(F.col("source"), SOURCES).alias("source_place"), "source_line")


@query("components", sql=f"SELECT id, status, impact, row_number() OVER (PARTITION BY cluster ORDER BY {STATUS_PLACE}, impact DESC, id) AS place FROM components")
def components_in_order(spark, sf_dir):
    return orders.components_out(view(spark, sf_dir, "components")).select("id", "status", "impact", "place")


@query("components", sql="""g AS (SELECT cluster, count(*) AS components, count(*) FILTER (status IN ('root', 'failing')) AS failing, count(*) FILTER (status = 'degraded') AS degraded FROM components GROUP BY ALL)
SELECT *, CASE WHEN failing > 0 THEN 'failing' WHEN degraded > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM g""")
def clusters_in_order(spark, sf_dir):
    return orders.clusters_out(view(spark, sf_dir, "components"))


@query("components", sql=f"SELECT id, row_number() OVER (PARTITION BY cluster ORDER BY (NOT (coalesce(role = 'ingress', false) OR user_facing))::INT, (coalesce(role, '') <> 'ingress')::INT, {STATUS_PLACE}, {TYPE_PLACE}, name, id) AS place FROM components")
def nodes_in_order(spark, sf_dir):
    return orders.nodes_out(view(spark, sf_dir, "components")).select("id", "place")


@query("components", sql="SELECT coalesce(nullif(CASE WHEN n % 3 = 0 THEN '' ELSE cluster END, ''), 'Unassigned') AS lane, count(*) FILTER (type NOT IN ('infra', 'node')) AS main, count(*) FILTER (type IN ('infra', 'node')) AS infra FROM (SELECT *, errors AS n FROM components) GROUP BY ALL")
def map_lanes(spark, sf_dir):
    return orders.lanes(view(spark, sf_dir, "components").withColumn("cluster", F.when(F.col("errors") % 3 != 0, F.col("cluster"))))


@query("evidence", sql="SELECT hypothesis, component, pos, row_number() OVER (PARTITION BY hypothesis, component ORDER BY weight DESC, pos) AS place FROM evidence")
def evidence_in_order(spark, sf_dir):
    return orders.evidence_out(view(spark, sf_dir, "evidence"), ["hypothesis", "component"]).select("hypothesis", "component", "pos", "place")


@query("changes", sql=f"SELECT id, release, risk, line, row_number() OVER (PARTITION BY release ORDER BY {RISK_RANK}, line, id) AS place FROM changes")
def changes_in_order(spark, sf_dir):
    return orders.changes_out(view(spark, sf_dir, "changes"), ["release"]).select("id", "release", "risk", "line", "place")


@query("components", sql="""f AS (SELECT cluster || namespace AS id, CASE errors % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'strain' ELSE 'breaks' END AS level, id AS flag FROM components)
SELECT id, string_agg(flag, ',' ORDER BY """ + cases("level", [(s, i) for i, s in enumerate(orders.LEVELS)]) + ", flag) AS flags FROM f GROUP BY ALL")
def flags_in_order(spark, sf_dir):
    level = F.when(F.col("errors") % 3 == 0, "ok").when(F.col("errors") % 3 == 1, "strain").otherwise("breaks")
    return orders.flags_out(view(spark, sf_dir, "components").select(F.concat("cluster", "namespace").alias("id"), level.alias("level"), F.col("id").alias("pos"), F.col("id").alias("flag")))


@query("spans", sql=LINKED.lstrip() + ' SELECT "from", "to", status, errors FROM edges ORDER BY ' + cases("status", [(s, i) for i, s in enumerate(orders.EDGE_STATES)], "3") + ', errors DESC, calls DESC, "from", "to" LIMIT 40')
def pack_edges_topk(spark, sf_dir):
    return orders.pack_edges(cut(_edges(spark, sf_dir))).select("from", "to", "status", "errors")


@query("faults", "entities", sql="SELECT name, cluster, 0 AS part, count(*) AS n, NULL::BOOLEAN AS known FROM faults GROUP BY ALL UNION ALL SELECT name, cluster, 1, count(*), bool_or(cluster_known) FROM entities GROUP BY ALL")
def entity_hint_union(spark, sf_dir):
    u = orders.one_relation(view(spark, sf_dir, "faults").select("name", "cluster"), view(spark, sf_dir, "entities").select("name", "cluster", "cluster_known"))
    return u.groupBy("name", "cluster", "part").agg(F.count("*").alias("n"), F.bool_or("cluster_known").alias("known"))


@query("entities", sql="""w AS (SELECT unnest(['europe', 'asia']) AS member) SELECT name AS key FROM entities GROUP BY ALL HAVING count(DISTINCT cluster) > 1 AND list_has_all(list(DISTINCT cluster), (SELECT list(member) FROM w))""")
def stores_covering_clusters(spark, sf_dir):
    sets = view(spark, sf_dir, "entities").select(F.col("name").alias("key"), F.col("cluster").alias("member"))
    return orders.covering(sets, spark.createDataFrame([("europe",), ("asia",)], "member string"))


@query("faults", sql="""o AS (SELECT cluster AS incident_id, source AS pane, text AS warning, min(seq) AS seq, bool_or(seq % 40 = 0) AS misplaced FROM faults GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY incident_id, pane ORDER BY (NOT misplaced)::INT, seq) AS place FROM o) SELECT incident_id, pane, warning, place FROM p WHERE place <= 20""")
def warnings_in_order(spark, sf_dir):
    f = view(spark, sf_dir, "faults")
    return orders.warnings_out(f.select(F.col("cluster").alias("incident_id"), F.col("source").alias("pane"), F.col("text").alias("warning"), "seq", (F.col("seq") % 40 == 0).alias("misplaced")))


ALERTS = "al AS (SELECT cluster, seq, 'a' || seq AS id, CASE WHEN seq % 3 = 0 THEN 'slo_burn' ELSE kind END AS kind, CASE seq % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'pending' ELSE 'firing' END AS status, CASE WHEN seq % 4 <> 0 THEN (seq % 977)::DOUBLE END AS burn_rate, CASE WHEN seq % 7 = 0 THEN (seq % 50) / 1000.0::DOUBLE END AS error_ratio FROM faults)"


def _alerts(spark, sf_dir):
    s = F.col("seq")
    return view(spark, sf_dir, "faults").select(
        "cluster", "seq", F.concat(F.lit("a"), s.cast("string")).alias("id"), F.when(s % 3 == 0, "slo_burn").otherwise(F.col("kind")).alias("kind"), F.when(s % 5 == 0, "resolved").when(s % 5 == 1, "pending").otherwise("firing").alias("status"),
        F.when(s % 4 != 0, (s % 977).cast("double")).alias("burn_rate"), F.when(s % 7 == 0, (s % 50) / 1000.0).alias("error_ratio"),
    )


@query("faults", sql=ALERTS + """, l AS (SELECT * FROM al WHERE kind = 'slo_burn' AND status <> 'resolved' AND (burn_rate IS NOT NULL OR error_ratio IS NOT NULL)),
t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY coalesce(burn_rate, 0) DESC, seq) = 1), r AS (SELECT cluster, error_ratio AS er FROM l WHERE error_ratio IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY coalesce(burn_rate, 0) DESC, seq) = 1)
SELECT cluster, id, burn_rate, coalesce(error_ratio, er) AS error_ratio FROM t LEFT JOIN r USING (cluster)""")
def worst_burn_alert(spark, sf_dir):
    return orders.worst_burn(_alerts(spark, sf_dir), ["cluster"])


@query("faults", sql=ALERTS + " SELECT cluster, count(*) FILTER (status = 'firing') AS firing, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'pending') AS pending FROM al GROUP BY ALL")
def alert_status_counts(spark, sf_dir):
    return orders.status_counts(_alerts(spark, sf_dir), ["cluster"])


@query("changes", sql="SELECT release, count(*) AS changes, count(*) FILTER (risk = 'high') AS high FROM changes GROUP BY ALL")
def changes_per_release(spark, sf_dir):
    return orders.changes_per_release(view(spark, sf_dir, "changes"))


@query("faults", sql="SELECT source, cluster, count(*) AS lines, count(*) FILTER (seq % 9 <> 0) AS parsed, count(*) FILTER (seq % 9 = 0) AS skipped, count(*) FILTER (kind <> 'rollout') AS signals FROM faults GROUP BY ALL")
def pane_statistics(spark, sf_dir):
    f = view(spark, sf_dir, "faults").select("source", "cluster", (F.col("seq") % 9 != 0).alias("parsed"), F.when(F.col("kind") != "rollout", F.col("kind")).alias("kind"))
    return orders.pane_stats(f, ["source", "cluster"])


@query("faults", sql="SELECT seq, ts_ms IS NOT NULL AND NOT ts_unknown AS known FROM faults")
def known_times(spark, sf_dir):
    return orders.public(orders.with_known_time(view(spark, sf_dir, "faults").withColumn("_own", F.lit(1)))).select("seq", "known")


EVIDENCE = """ev AS (SELECT 's' || seq AS signal_id, NULL::VARCHAR AS change_id, source, source_line AS line, text, 0.3::DOUBLE AS weight FROM faults WHERE seq % 3 = 0
  UNION ALL SELECT NULL, id, 'helm', line, category, CASE WHEN risk = 'high' THEN 0.35 ELSE 0.1 END::DOUBLE FROM changes UNION ALL SELECT NULL, NULL, 'logs', CASE WHEN k % 2 = 0 THEN k::INT END, 'fact ' || k, 0.2::DOUBLE FROM (SELECT DISTINCT source_line AS k FROM faults))"""


def _typed(spark, sf_dir):
    f, c = view(spark, sf_dir, "faults"), view(spark, sf_dir, "changes")
    facts = f.select(F.col("source_line").alias("k")).distinct().select(F.lit("logs").alias("source"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("line"), F.concat(F.lit("fact "), F.col("k").cast("string")).alias("text"), F.lit(0.2).alias("weight"))
    s = f.filter("seq % 3 = 0").select(F.concat(F.lit("s"), F.col("seq").cast("string")).alias("id"), "source", "source_line", "text", F.lit(0.3).alias("weight"))
    return orders.evidence_rows(s, c.select("id", "line", F.col("category").alias("summary"), F.when(F.col("risk") == "high", 0.35).otherwise(0.1).alias("weight")), facts)


@query("faults", "changes", sql=EVIDENCE + " SELECT * FROM ev")
def typed_evidence(spark, sf_dir):
    return _typed(spark, sf_dir)


@query("faults", "changes", sql=EVIDENCE + " SELECT signal_id, change_id, source, line, text, weight FROM ev WHERE (signal_id IS NOT NULL AND signal_id[2:]::BIGINT % 2 = 0) OR (change_id IS NOT NULL AND change_id NOT LIKE '%7') OR line IS NOT NULL")
def backed_evidence(spark, sf_dir):
    s = view(spark, sf_dir, "faults").filter("seq % 2 = 0").select(F.concat(F.lit("s"), F.col("seq").cast("string")).alias("id"))
    return orders.valid_evidence(_typed(spark, sf_dir), s, view(spark, sf_dir, "changes").filter("id not like '%7'").select("id"))


@query("faults", "changes", sql=EVIDENCE + " SELECT change_id, weight FROM ev WHERE change_id IS NOT NULL AND weight >= 0.2")
def primary_changes(spark, sf_dir):
    return orders.primary(_typed(spark, sf_dir)).select("change_id", "weight")


@query("faults", sql=f"e AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY {RANK} DESC, coalesce(ts_ms, 0), seq) AS place FROM faults WHERE {RANK} >= 2) SELECT component, seq, place FROM e WHERE place <= 5")
def pack_signals(spark, sf_dir):
    return orders.severe_first(view(spark, sf_dir, "faults"), ["component"], 5).select("component", "seq", "place")


@query("signals", sql="""b AS (SELECT component AS id, user_id AS u, count(*) FILTER (severity = 'error') / count(*) AS ratio, count(*)::DOUBLE AS minutes FROM signals GROUP BY ALL)
SELECT id, u, floor(ratio * 1000 * minutes + 0.5)::BIGINT AS bad_requests, floor((1 - 0.999) * 1000 * 30 * 1440 + 0.5)::BIGINT AS budget_requests FROM b""")
def request_budget(spark, sf_dir):
    b = view(spark, sf_dir, "signals").groupBy(F.col("component").alias("id"), F.col("user_id").alias("u")).agg((F.count_if(F.col("severity") == "error") / F.count("*")).alias("ratio"), F.count("*").cast("double").alias("minutes"))
    n = budget.requests(F.col("ratio"), F.lit(0.999), F.lit(1000.0), F.col("minutes"), F.lit(30.0))
    return b.select("id", "u", n["bad"].alias("bad_requests"), n["budget"].alias("budget_requests"))


STATES = """b AS (SELECT seq AS id, value / 4 AS burn, (seq % 500)::DOUBLE AS minutes, 30.0::DOUBLE AS wd, CASE seq % 4 WHEN 0 THEN 60.0 WHEN 1 THEN 360.0 END::DOUBLE AS ow, CASE WHEN seq % 3 <> 0 THEN value / 2 END AS ob FROM signals),
r AS (SELECT *, unnest([struct_pack(i := 0, s := 0.02::DOUBLE, h := 1.0::DOUBLE), struct_pack(i := 1, s := 0.05::DOUBLE, h := 6.0::DOUBLE), struct_pack(i := 2, s := 0.1::DOUBLE, h := 72.0::DOUBLE)]) AS x FROM b),
t AS (SELECT *, x.s * wd * 24 / x.h AS thr FROM r), f AS (SELECT *, burn > 0 AND burn >= thr - 1e-9 AS above, coalesce(abs(ow - x.h * 60) < 1 AND ob >= thr - 1e-9, false) AS seen FROM t),
g AS (SELECT *, CASE WHEN above THEN floor(x.h * 60 * thr / burn * 100 + 0.5) / 100 END AS after FROM f)
SELECT id, x.h AS long_h, CASE WHEN seen THEN 'firing-observed' WHEN above AND minutes >= after - 1e-9 THEN 'firing-estimate' WHEN above THEN 'pending' ELSE 'not-at-this-burn' END AS state, CASE WHEN above THEN floor(greatest(0.0, after - minutes) * 100 + 0.5) / 100 END AS fires_in_min FROM g"""


@query("signals", sql=STATES)
def alert_row_states(spark, sf_dir):
    b = view(spark, sf_dir, "signals").select(F.col("seq").alias("id"), (F.col("value") / 4).alias("burn"), (F.col("seq") % 500).cast("double").alias("minutes"), F.lit(30.0).alias("window_days"), F.when(F.col("seq") % 4 == 0, 60.0).when(F.col("seq") % 4 == 1, 360.0).alias("observed_min"), F.when(F.col("seq") % 3 != 0, F.col("value") / 2).alias("observed_burn"))
    return budget.alert_states(b).select("id", "long_h", "state", "fires_in_min")


@query("signals", sql=STATES.replace("SELECT id, x.h AS long_h", ", st AS (SELECT id, ob, minutes, x, burn, thr, after, above, seen, ow").replace("FROM g", "FROM g)") + """,
first AS (SELECT id, arg_min(struct_pack(h := x.h, mf := above AND minutes >= after - 1e-9, fa := coalesce(after, 0)), x.i) AS e FROM st WHERE seen OR (ow IS NULL AND ob >= thr - 1e-9) GROUP BY ALL),
page AS (SELECT id, above AND NOT (above AND minutes >= after - 1e-9) AND NOT seen AS waits FROM st WHERE x.i = 0)
SELECT id, CASE WHEN e IS NOT NULL AND NOT e.mf AND id % 50 < e.fa AND id % 2 = 0 THEN 'change-too-recent' WHEN e IS NOT NULL AND NOT e.mf THEN 'started-earlier' WHEN waits THEN 'page-pending' END AS note FROM page LEFT JOIN first USING (id)""")
def budget_notes(spark, sf_dir):
    b = view(spark, sf_dir, "signals").select(F.col("seq").alias("id"), (F.col("value") / 4).alias("burn"), (F.col("seq") % 500).cast("double").alias("minutes"), F.lit(30.0).alias("window_days"), F.when(F.col("seq") % 4 == 0, 60.0).when(F.col("seq") % 4 == 1, 360.0).alias("observed_min"), F.when(F.col("seq") % 3 != 0, F.col("value") / 2).alias("observed_burn"), F.when(F.col("seq") % 2 == 0, (F.col("seq") % 50).cast("double")).alias("since_change_min"))
    return budget.notes(b)


