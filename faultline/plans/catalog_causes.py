"""Queries of causes and mitigations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hypotheses as H
from ..sources.adapters import view
from .catalog import cases, query

INCIDENTS = 200
CATEGORIES = list(dict.fromkeys(c for _, cats, *_ in H.OPTIONS for c in cats))


def _hypotheses(spark, sf_dir):
    """Ranked causes of incidents of INCIDENTS successive faults: kinds as categories, the more of them the higher."""
    f = view(spark, sf_dir, "faults").withColumn("i", F.expr(f"seq div {INCIDENTS}"))
    h = f.groupBy("i", F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.pmod("source_line", F.lit(len(CATEGORIES))) + 1).cast("int")).alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("seq") % 5 == 0).alias("changes"))
    from pyspark.sql import Window

    return h.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "category"))).filter("rank <= 6").select(F.col("i").alias("incident_id"), "category", "rank", "changes")


HYP = f"""cat AS (SELECT ['{"', '".join(CATEGORIES)}'] AS c), g AS (SELECT seq // {INCIDENTS} AS i, c[source_line % {len(CATEGORIES)} + 1] AS category, count(*) AS n, count(*) FILTER (seq % 5 = 0) AS changes FROM faults CROSS JOIN cat GROUP BY ALL),
h AS (SELECT i, category, row_number() OVER (PARTITION BY i ORDER BY n DESC, category) AS rank, changes FROM g QUALIFY rank <= 6)"""
ABLE = """ab AS (SELECT DISTINCT i, i % 2 = 0 AS previous, i % 3 = 0 AS canary, i % 5 <> 0 AS image, i % 4 = 0 AS cut, i % 7 = 0 AS migration, i % 6 = 1 AS heavy, i % 3 = 1 AS split FROM h)"""
TABLE = "ot AS (SELECT * FROM (VALUES " + ", ".join(f"({H.PREFERRED.index(k)}, '{k}', {cats!r}, {eta}::DOUBLE, '{risk}', {eff}::DOUBLE, '{need}')" for k, cats, eta, risk, eff, need in H.OPTIONS) + ") t(pref, kind, cats, eta, risk, effect, need))"


@query("faults", sql=HYP + ", " + ABLE + ", " + TABLE + """, r AS (SELECT h.i, kind, pref, category, rank, effect, CASE WHEN kind = 'helm-rollback' AND migration THEN 8 ELSE eta END AS eta_min, CASE WHEN kind = 'helm-rollback' AND migration THEN 'high' WHEN kind = 'helm-rollback' AND heavy THEN 'medium' ELSE risk END AS risk
  FROM h JOIN ab USING (i) JOIN ot ON list_contains(cats, category) WHERE CASE need WHEN '' THEN true WHEN 'change' THEN changes > 0 WHEN 'previous' THEN previous WHEN 'canary' THEN canary WHEN 'image' THEN image WHEN 'cut' THEN cut WHEN 'migration' THEN migration ELSE split END),
o AS (SELECT i, kind, pref, eta_min, risk, effect, min(rank) AS top, string_agg(DISTINCT category, ',' ORDER BY category) AS fixes FROM r GROUP BY ALL), m AS (SELECT *, min(top) OVER (PARTITION BY i) AS first FROM o)
SELECT i AS incident_id, kind, fixes, eta_min, risk, effect, row_number() OVER (PARTITION BY i ORDER BY (top <> first)::INT, pref + CASE WHEN risk = 'high' THEN 8 ELSE 0 END, """ + cases("risk", [("low", 0), ("medium", 1)], "2") + ", eta_min, kind) = 1 AS recommended FROM m")
def mitigation_options(spark, sf_dir):
    h = _hypotheses(spark, sf_dir)
    i, yes = F.col("incident_id"), lambda c: F.when(c, 1)
    ids = h.select("incident_id").distinct()
    deploys = ids.select("incident_id", yes(i % 2 == 0).alias("previous"), F.lit(None).cast("long").alias("rolled_back_ms"))
    flags = [(i % 3 == 0, "Rollout", "other", None), (i % 5 != 0, "Deployment", "image", None), (i % 4 == 0, "Deployment", "resources", "down"), (i % 7 == 0, "Job", "migration-hook", None), (i % 6 == 1, "Secret", "secret", None)]
    changes = None
    for c, kind, category, direction in flags:
        part = ids.filter(c).select("incident_id", F.lit(kind).alias("kind"), F.lit(category).alias("category"), F.lit(direction).cast("string").alias("direction"), F.lit("x").alias("before"))
        changes = part if changes is None else changes.unionByName(part)
    clusters = ids.select("incident_id", F.explode(F.array(F.struct(F.lit("a").alias("cluster"), F.lit(1).alias("failing")), F.struct(F.lit("b").alias("cluster"), F.when(i % 3 == 1, 0).otherwise(2).alias("failing")))).alias("x")).select("incident_id", "x.*")
    return H.options(h, deploys, changes, clusters).withColumn("fixes", F.array_join("fixes", ","))


GROWN = " UNION ALL ".join(
    [f"SELECT i, '{c}' AS category, component, least({most}, {least} + {each} * (sum(n) OVER w - 1)) + CASE WHEN count(*) OVER w > 1 THEN {H.SECOND_SERVICE} ELSE 0 END AS weight, n AS pieces FROM k WHERE kind IN ({', '.join(map(repr, ks))}) WINDOW w AS (PARTITION BY i, cluster)" for c, ks, least, each, most in H.GROWING]
    + [f"SELECT i, '{c}', component, least(n, {most}) * {w}, n FROM k WHERE kind IN ({', '.join(map(repr, ks))})" for c, ks, w, most in H.BESIDE]
)


@query("faults", sql=f"k AS (SELECT seq // {INCIDENTS} AS i, cluster, component, kind, count(*) AS n FROM faults GROUP BY ALL), e AS ({GROWN}) SELECT i AS incident_id, category, component, round(weight::DOUBLE, 6) AS weight, pieces FROM e")
def counted_evidence(spark, sf_dir):
    f = view(spark, sf_dir, "faults").withColumn("incident_id", F.expr(f"seq div {INCIDENTS}"))
    return H.growing_evidence(f).withColumn("weight", F.round("weight", 6))


EXPECTED = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in H.EXPECTED.items())


@query("faults", "changes", "components", sql=f"""h AS (SELECT DISTINCT seq // {INCIDENTS} AS i, CASE kind WHEN 'oom_killed' THEN 'resource-limits' WHEN 'image_pull' THEN 'image-pull' WHEN 'dns_failure' THEN 'dns' ELSE 'unknown' END AS category, component, name, cluster FROM faults),
c AS (SELECT DISTINCT substr(id, 5)::BIGINT // {INCIDENTS} AS i, name, category FROM changes), x AS (SELECT h.*, CASE category {EXPECTED} END AS ex FROM h), w AS (SELECT DISTINCT name, cluster AS other FROM components WHERE status = 'healthy')
SELECT i AS incident_id, category, component, 'no-such-change' AS against FROM x WHERE ex IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.i = x.i AND c.name = x.name AND list_contains(ex, c.category)) UNION ALL SELECT DISTINCT i, category, component, 'healthy-sibling' FROM x JOIN w ON w.name = x.name AND other <> cluster""")
def counter_evidence(spark, sf_dir):
    f = view(spark, sf_dir, "faults")
    category = F.when(F.col("kind") == "oom_killed", "resource-limits").when(F.col("kind") == "image_pull", "image-pull").when(F.col("kind") == "dns_failure", "dns").otherwise("unknown")
    h = f.select(F.expr(f"seq div {INCIDENTS}").alias("incident_id"), category.alias("category"), "component", "name", "cluster").distinct()
    changes = view(spark, sf_dir, "changes").withColumn("incident_id", F.expr(f"cast(substring(id, 5) as bigint) div {INCIDENTS}"))
    return H.counter_evidence(h, changes, view(spark, sf_dir, "components"))


@query("faults", sql=f"""e AS (SELECT DISTINCT seq // {INCIDENTS} AS i, component AS f, 'service:' || cluster || '/' || namespace || '/app-' || (seq % 6 + 4) AS t FROM faults), h AS (SELECT DISTINCT i, 'x' AS category, t AS component FROM e WHERE i % 2 = 0), b AS (SELECT DISTINCT seq // {INCIDENTS} AS i, component FROM faults WHERE severity IN ('error', 'critical')),
o AS (SELECT DISTINCT h.i, category, component, e.f AS covered FROM h JOIN e ON e.i = h.i AND e.t = component WHERE (e.i, e.f) IN (SELECT (i, component) FROM b)), t AS (SELECT DISTINCT o.i, category, component, e.f AS covered FROM o JOIN e ON e.i = o.i AND e.t = covered WHERE (e.i, e.f) IN (SELECT (i, component) FROM b))
SELECT i AS incident_id, category, component, component AS covered FROM h UNION SELECT * FROM o UNION SELECT * FROM t""")
def covered_components(spark, sf_dir):
    f = view(spark, sf_dir, "faults").withColumn("incident_id", F.expr(f"seq div {INCIDENTS}"))
    edges = f.select("incident_id", F.col("component").alias("from"), F.concat(F.lit("service:"), "cluster", F.lit("/"), "namespace", F.lit("/app-"), (F.col("seq") % 6 + 4).cast("string")).alias("to")).distinct()
    h = edges.filter("incident_id % 2 = 0").select("incident_id", F.lit("x").alias("category"), F.col("to").alias("component")).distinct()
    return H.covers(h, edges, f.filter("severity in ('error', 'critical')").select("incident_id", "component"))
