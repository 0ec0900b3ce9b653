"""Rules to hypotheses: each rule is a row of weights; evidence is one table; scores are aggregated, never looped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import half_up
from .changes import anchor_factor, risk_rank
from .scoring import MOST_WEIGHT

# Category, kinds of its signals and their weight, change categories that cause it and their weight, weight of an alert.
RULES = [
    ("tls-cert", ["tls_error"], 0.45, [], 0.0, 0.3),
    ("dns", ["dns_failure"], 0.40, ["configmap"], 0.35, 0.2),
    ("image-pull", ["image_pull"], 0.55, ["image"], 0.35, 0.15),
    ("config-error", ["config_error"], 0.50, ["configmap", "env", "secret"], 0.35, 0.15),
    ("resource-limits", ["oom_killed"], 0.50, ["resources"], 0.45, 0.15),
    ("connection-exhaustion", ["conn_exhaustion"], 0.40, ["hpa", "replicas", "env"], 0.35, 0.15),
    ("probe-misconfig", ["probe_failed"], 0.25, ["probe"], 0.45, 0.15),
    ("node-pressure", ["node_not_ready", "node_pressure", "evicted"], 0.45, [], 0.0, 0.2),
    ("scheduling-capacity", ["scheduling_failed", "pvc_pending"], 0.25, ["replicas"], 0.2, 0.2),
    ("rate-limiting", ["http_429", "throttled"], 0.45, [], 0.0, 0.2),
    ("network-policy", ["conn_refused", "timeout"], 0.0, ["networkpolicy"], 0.4, 0.0),
]
DEPLOY, FIRST_ERROR, HIGH_CHANGE, MIGRATION, DEPENDENCY, CALLERS = 0.2, 0.3, 0.15, 0.2, 0.35, 0.3
UNKNOWN_BELOW, UNKNOWN = 0.35, 0.3
HOURS_2 = 7_200_000

# Mitigations: kind, categories that it fixes, minutes, risk, effect, what it needs; kinds in the order of preference.
OPTIONS = [
    ("canary-abort", ["bad-deploy"], 2.0, "low", 1.0, "canary"),
    ("helm-rollback", ["bad-deploy", "resource-limits", "image-pull", "config-error", "probe-misconfig", "dns", "connection-exhaustion", "network-policy"], 6.0, "low", 1.0, "previous"),
    ("config-revert", ["config-error", "dns", "network-policy"], 5.0, "medium", 1.0, "change"),
    ("rollout-undo", ["image-pull", "bad-deploy"], 4.0, "low", 1.0, "change"),
    ("set-image", ["image-pull", "bad-deploy"], 4.0, "low", 1.0, "image"),
    ("resource-restore", ["resource-limits"], 5.0, "medium", 1.0, "cut"),
    ("scale", ["connection-exhaustion", "scheduling-capacity", "rate-limiting"], 5.0, "medium", 0.7, ""),
    ("roll-forward", ["image-pull"], 10.0, "low", 1.0, ""),
    ("roll-forward", ["tls-cert", "dns"], 15.0, "medium", 1.0, ""),
    ("roll-forward", ["config-error"], 5.0, "low", 1.0, ""),
    ("roll-forward", ["node-pressure"], 12.0, "medium", 1.0, ""),
    ("roll-forward", ["bad-deploy"], 30.0, "medium", 1.0, "migration"),
    ("traffic-shift", ["bad-deploy", "resource-limits", "config-error", "dns", "connection-exhaustion", "node-pressure", "dependency-failure"], 10.0, "medium", 0.8, "split"),
    ("restart", ["node-pressure", "dependency-failure", "unknown", "resource-limits"], 3.0, "low", 0.3, ""),
]
PREFERRED = list(dict.fromkeys(k for k, *_ in OPTIONS))
# A rollback past a migration: minutes and risk; past resource definitions or secrets: risk. What a high risk costs in the order.
ROLLBACK_MIGRATION, ROLLBACK_HEAVY, HIGH_COST = (8.0, "high"), "medium", 8


def evidence(signals: DataFrame, changes: DataFrame, deploys: DataFrame, deepest: DataFrame, callers: DataFrame) -> DataFrame:
    """(incident_id, category, component, ref, weight, anchor_ms): what speaks for each category at each component.

    signals: incident_id, component, name, kind, source, ts_ms, id; changes and deploys are joined by workload name;
    deepest: failing components that call no failing one; callers: what names a component from outside.
    """
    places = signals.select("incident_id", "component", "name").distinct()
    local = changes.join(places, (changes["incident_id"] == places["incident_id"]) & (changes["resource"] == places["name"])).select(changes["incident_id"], "component", "id", "category", "risk", "direction", "deployed_ms")
    none = F.lit(None).cast("long")
    parts = []
    first = Window.partitionBy("incident_id", "component", "kind", "is_alert").orderBy(F.col("ts_ms").asc_nulls_last(), "id")
    firsts = signals.withColumn("is_alert", F.col("source") == "alerts").withColumn("_rn", F.row_number().over(first)).filter("_rn = 1")
    for category, kinds, weight, causes, cause, alert in RULES:
        mine = firsts.filter(F.col("kind").isin(kinds))
        row = lambda df, w, ref, anchor, category=category: df.select("incident_id", F.lit(category).alias("category"), "component", ref.alias("ref"), w.alias("weight"), anchor.alias("anchor_ms"))
        if weight:
            parts.append(row(mine, F.when(F.col("is_alert"), alert).otherwise(weight), F.col("id"), none))
        if causes:
            ill = mine.select("incident_id", "component").distinct()
            why = local.filter(F.col("category").isin(causes))
            if category == "resource-limits":
                why = why.filter("direction = 'down'")
            parts.append(row(why.drop("category").join(ill, ["incident_id", "component"], "left_semi"), F.lit(cause), F.col("id"), F.col("deployed_ms")))
    errors = signals.filter("severity in ('error', 'critical')").groupBy("incident_id", "component", "name").agg(F.min("ts_ms").alias("ts_ms"))
    d = deploys.select("incident_id", F.col("release_id").alias("name"), F.col("revision").cast("string").alias("rev"), "deployed_ms").join(places, ["incident_id", "name"])
    bad = lambda df, w, ref: df.select("incident_id", F.lit("bad-deploy").alias("category"), "component", ref.alias("ref"), F.lit(w).alias("weight"), F.col("deployed_ms").alias("anchor_ms"))
    parts.append(bad(d, DEPLOY, F.concat(F.lit("deploy-"), "rev")))
    soon = d.join(errors, ["incident_id", "component", "name"]).filter((F.col("ts_ms") >= F.col("deployed_ms") - 60_000) & (F.col("ts_ms") <= F.col("deployed_ms") + HOURS_2))
    parts.append(bad(soon, FIRST_ERROR, F.concat(F.lit("onset-"), "rev")))
    worst = local.filter("risk = 'high'").withColumn("_rn", F.row_number().over(Window.partitionBy("incident_id", "component").orderBy(risk_rank(F.col("risk")), "id"))).filter("_rn <= 2")
    deployed = d.select("incident_id", "component").distinct()
    parts.append(bad(worst.join(deployed, ["incident_id", "component"], "left_semi"), HIGH_CHANGE, F.col("id")))
    parts.append(bad(local.filter("category = 'migration-hook'").join(deployed, ["incident_id", "component"], "left_semi"), MIGRATION, F.concat(F.lit("hook-"), "id")))
    dep = lambda df, w, ref: df.select("incident_id", F.lit("dependency-failure").alias("category"), "component", ref.alias("ref"), F.lit(w).alias("weight"), none.alias("anchor_ms"))
    parts.append(dep(deepest, DEPENDENCY, F.lit("edges")))
    parts.append(dep(callers.join(deepest, ["incident_id", "component"], "left_semi"), CALLERS, F.lit("callers")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def scored(rows: DataFrame, onsets: DataFrame, deepest: DataFrame) -> DataFrame:
    """(incident_id, category, component, confidence, pieces, changes): evidence deduplicated, combined and adjusted.

    onsets has the first error of each component; the deepest failing one counts a tenth more.
    """
    keys = ["incident_id", "category", "component"]
    once = rows.groupBy(*keys, "ref").agg(F.max("weight").alias("weight"), F.min("anchor_ms").alias("anchor_ms"))
    w = F.least(F.greatest("weight", F.lit(0.0)), F.lit(MOST_WEIGHT))
    h = once.groupBy(*keys).agg(F.exp(F.sum(F.log1p(-w))).alias("none"), F.count("*").alias("pieces"), F.min("anchor_ms").alias("anchor_ms"), F.count_if(F.col("ref").startswith("chg-")).alias("changes"))
    deep = deepest.select("incident_id", "component").distinct().withColumn("deep", F.lit(1.1))
    h = h.join(onsets, ["incident_id", "component"], "left").join(deep, ["incident_id", "component"], "left")
    raw = (1 - F.col("none")) * anchor_factor(F.col("anchor_ms"), F.col("first_error_ms")) * F.coalesce("deep", F.lit(1.0))
    raw = F.least(raw, F.lit(MOST_WEIGHT))
    return h.select(*keys, half_up(F.when(F.col("pieces") < 2, F.least(raw, F.lit(0.5))).otherwise(raw), 3).alias("confidence"), "pieces", "changes")


def ranked(hypotheses: DataFrame, incidents: DataFrame, per_component: int = 3, most: int = 6) -> DataFrame:
    """Hypotheses with rank per incident, and "unknown" where the best is weak."""
    best = hypotheses.groupBy("incident_id").agg(F.max("confidence").alias("best"))
    weak = incidents.select("incident_id").distinct().join(best, "incident_id", "left").filter(F.coalesce("best", F.lit(0.0)) < UNKNOWN_BELOW)
    rows = hypotheses.unionByName(weak.select("incident_id", F.lit("unknown").alias("category"), F.lit("").alias("component"), F.lit(UNKNOWN).alias("confidence"), F.lit(0).cast("long").alias("pieces"), F.lit(0).cast("long").alias("changes")))
    order = [F.desc("confidence"), "category", "component"]
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("incident_id", "component").orderBy(*order))).filter(F.col("_rn") <= per_component).drop("_rn")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("incident_id").orderBy(*order))).filter(F.col("rank") <= most)


def abilities(deploys: DataFrame, changes: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """(incident_id, previous, canary, image, cut, migration, heavy, split): what an incident's releases, changes and clusters allow.

    changes: incident_id, kind, category, direction, before; clusters: incident_id, cluster, failing.
    """
    out = deploys.groupBy("incident_id").agg(F.bool_or(F.col("previous").isNotNull() & F.col("rolled_back_ms").isNull()).alias("previous"))
    if changes is not None:
        c, has = changes, lambda condition, name: F.bool_or(F.coalesce(condition, F.lit(False))).alias(name)
        found = c.groupBy("incident_id").agg(
            has(F.col("kind") == "Rollout", "canary"), has((F.col("category") == "image") & F.col("before").isNotNull(), "image"), has((F.col("category") == "resources") & (F.col("direction") == "down"), "cut"),
            has(F.col("category") == "migration-hook", "migration"), has(F.col("category").isin("crd", "secret"), "heavy"),
        )
        out = out.join(found, "incident_id", "full")
    if clusters is not None:
        out = out.join(clusters.groupBy("incident_id").agg((F.bool_or(F.col("failing") > 0) & F.bool_or(F.col("failing") == 0)).alias("split")), "incident_id", "full")
    flags = ("previous", "canary", "image", "cut", "migration", "heavy", "split")
    return out.select("incident_id", *[(F.coalesce(F.col(k), F.lit(False)) if k in out.columns else F.lit(False)).alias(k) for k in flags])


def options(hypotheses: DataFrame, deploys: DataFrame, changes: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """(incident_id, kind, fixes, eta_min, risk, effect, recommended): mitigations of the ranked causes; of those that fix the first, one is recommended.

    A rollback needs an earlier revision that isn't restored already, and takes longer past a migration; a revert
    needs a change in evidence, and so on: see OPTIONS.
    """
    h = hypotheses.join(abilities(deploys, changes, clusters), "incident_id", "left")
    table = F.explode(F.array(*[F.struct(F.lit(PREFERRED.index(k)).alias("pref"), F.lit(k).alias("kind"), F.array(*[F.lit(c) for c in cats]).alias("cats"), F.lit(eta).alias("eta_min"), F.lit(risk).alias("risk"), F.lit(eff).alias("effect"), F.lit(need).alias("need")) for k, cats, eta, risk, eff, need in OPTIONS]))
    rows = h.select("*", table.alias("o")).filter(F.expr("array_contains(o.cats, category)"))
    able = F.when(F.col("o.need") == "", True).when(F.col("o.need") == "change", F.col("changes") > 0)
    for k in ("previous", "canary", "image", "cut", "migration", "split"):
        able = able.when(F.col("o.need") == k, F.coalesce(F.col(k), F.lit(False)))
    back, past = F.col("o.kind") == "helm-rollback", F.coalesce("migration", F.lit(False))
    rows = rows.filter(able).withColumns({"eta": F.when(back & past, ROLLBACK_MIGRATION[0]).otherwise(F.col("o.eta_min")), "danger": F.when(back & past, ROLLBACK_MIGRATION[1]).when(back & F.coalesce("heavy", F.lit(False)), ROLLBACK_HEAVY).otherwise(F.col("o.risk"))})
    out = rows.groupBy("incident_id", "o.kind", "o.pref", F.col("eta").alias("eta_min"), F.col("danger").alias("risk"), "o.effect").agg(F.min("rank").alias("top"), F.sort_array(F.collect_set("category")).alias("fixes"))
    level = F.when(F.col("risk") == "low", 0).when(F.col("risk") == "medium", 1).otherwise(2)
    w = Window.partitionBy("incident_id").orderBy((F.col("top") != F.min("top").over(Window.partitionBy("incident_id"))).cast("int"), F.col("pref") + F.when(F.col("risk") == "high", HIGH_COST).otherwise(0), level, "eta_min", "kind")
    return out.withColumn("recommended", F.row_number().over(w) == 1).select("incident_id", "kind", "fixes", "eta_min", "risk", "effect", "recommended")


# Rules whose weight grows with what was seen: category, kinds, least weight, weight of each further signal, most.
GROWING = [("dns", ["dns_failure"], 0.35, 0.05, 0.55), ("scheduling-capacity", ["scheduling_failed"], 0.2, 0.05, 0.4)]
# Further evidence of a category: kinds beside those that name it, their weight, and how many pieces count.
BESIDE = [("resource-limits", ["crash_loop"], 0.15, 1), ("connection-exhaustion", ["hpa_maxed"], 0.15, 1), ("node-pressure", ["evicted"], 0.25, 1), ("scheduling-capacity", ["hpa_maxed"], 0.2, 1), ("scheduling-capacity", ["pvc_pending"], 0.4, 1)]
SECOND_SERVICE, EACH_WORKLOAD = 0.15, 0.1


def growing_evidence(signals: DataFrame) -> DataFrame:
    """(incident_id, category, component, weight, pieces): the evidence of rules that count: the more lookups fail, the likelier it is the name service; a second client that sees it adds to it; other kinds beside speak for the cause.

    signals: incident_id, cluster, component, kind.
    """
    parts = []
    for category, kinds, least, each, most in GROWING:
        mine = signals.filter(F.col("kind").isin(kinds)).groupBy("incident_id", "cluster", "component").agg(F.count("*").alias("n"))
        whole = mine.groupBy("incident_id", "cluster").agg(F.sum("n").alias("all"), F.count("*").alias("clients"))
        weight = F.least(F.lit(most), F.lit(least) + F.lit(each) * (F.col("all") - 1))
        parts.append(mine.join(whole, ["incident_id", "cluster"]).select("incident_id", F.lit(category).alias("category"), "component", (weight + F.when(F.col("clients") > 1, SECOND_SERVICE).otherwise(0.0)).alias("weight"), F.col("n").alias("pieces")))
    for category, kinds, weight, most in BESIDE:
        beside = signals.filter(F.col("kind").isin(kinds)).groupBy("incident_id", "component").agg(F.count("*").alias("n"))
        parts.append(beside.select("incident_id", F.lit(category).alias("category"), "component", (F.least("n", F.lit(most)) * weight).alias("weight"), F.col("n").alias("pieces")))
    return reduce(lambda a, b: a.unionByName(b), parts)


# What speaks against a cause when it is missing: category, change categories of which one would be expected.
EXPECTED = {"image-pull": ["image"], "config-error": ["configmap", "env", "secret"], "resource-limits": ["resources"], "probe-misconfig": ["probe"], "connection-exhaustion": ["hpa", "replicas", "env"], "dns": ["configmap"]}


def counter_evidence(hypotheses: DataFrame, changes: DataFrame, siblings: DataFrame) -> DataFrame:
    """(incident_id, category, component, against): no change of the kind that would explain it; the same name healthy in another cluster under no change.

    hypotheses: incident_id, category, component, name, cluster; changes: category, name; siblings: name, cluster, status. Where these
    have an incident_id too, they count for that incident only.
    """
    keys = lambda df: [k for k in ("incident_id", "name") if k in df.columns]
    table = F.create_map(*[x for k, v in EXPECTED.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    h = hypotheses.withColumn("expected", F.try_element_at(table, F.col("category")))
    had = changes.groupBy(*keys(changes)).agg(F.collect_set("category").alias("had"))  # a closed vocabulary bounds the set
    bare = h.filter("expected is not null").join(had, keys(changes), "left").filter(~F.coalesce(F.arrays_overlap("had", "expected"), F.lit(False)))
    missing = bare.select("incident_id", "category", "component", F.lit("no-such-change").alias("against"))
    # A healthy place elsewhere: the least and the greatest healthy cluster of a name tell, so no pairs of clusters arise.
    well = siblings.filter("status = 'healthy'").groupBy(*keys(siblings)).agg(F.min("cluster").alias("least"), F.max("cluster").alias("most"))
    twin = h.join(well, keys(siblings)).filter("least <> cluster or most <> cluster").select("incident_id", "category", "component", F.lit("healthy-sibling").alias("against")).distinct()
    return missing.unionByName(twin)


def covers(hypotheses: DataFrame, edges: DataFrame, failing: DataFrame) -> DataFrame:
    """(incident_id, category, component, covered): what a cause explains: its component, and failing callers within two calls.

    edges: incident_id, from, to; failing: incident_id, component.
    """
    h = hypotheses.select("incident_id", "category", "component").filter("component <> ''")
    calls = edges.select("incident_id", F.col("to").alias("near"), F.col("from").alias("covered")).distinct()
    ill = failing.select("incident_id", F.col("component").alias("covered")).distinct()
    one = h.join(calls, (h["incident_id"] == calls["incident_id"]) & (h["component"] == calls["near"])).select(h["incident_id"], "category", "component", "covered").join(ill, ["incident_id", "covered"], "left_semi")
    step = one.withColumnRenamed("covered", "near")
    two = step.join(calls, ["incident_id", "near"]).join(ill, ["incident_id", "covered"], "left_semi").select("incident_id", "category", "component", "covered")
    return h.withColumn("covered", F.col("component")).unionByName(one.select("incident_id", "category", "component", "covered")).unionByName(two).distinct()
