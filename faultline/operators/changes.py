"""Releases and changes: previous revisions, paired removals and additions, caps, classification, range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_of
from ..functions.times import quantity

RISKS = ["high", "medium", "low"]


def risk_rank(risk: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RISKS]), risk).cast("int")


def previous_revision(history: DataFrame) -> DataFrame:
    """Adds previous: the highest earlier revision that was superseded or deployed, else the one before."""
    before = Window.partitionBy("release_id").orderBy("revision").rowsBetween(Window.unboundedPreceding, -1)
    good = F.last(F.when(F.col("status").isin("superseded", "deployed"), F.col("revision")), ignorenulls=True).over(before)
    return history.withColumn("previous", F.coalesce(good, F.lag("revision").over(Window.partitionBy("release_id").orderBy("revision"))))


def latest_deploy(history: DataFrame) -> DataFrame:
    """The newest row of each release; rows without a time are last."""
    w = Window.partitionBy("release_id").orderBy(F.col("ts_ms").desc_nulls_last(), F.desc("revision"))
    return history.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def paired(marks: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, before, after): the n-th removal of a place beside its n-th addition; marks has sign, pos and value."""
    of = lambda sign: F.col("sign") == sign
    before = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    n = F.when(of("-"), F.count_if(of("-")).over(before)).otherwise(F.count_if(of("+")).over(before))
    rows = marks.filter("sign in ('-', '+')").withColumn("n", n.cast("int"))
    return rows.groupBy(*by, "n").agg(F.max(F.when(of("-"), F.col("value"))).alias("before"), F.max(F.when(of("+"), F.col("value"))).alias("after"))


def capped_changes(changes: DataFrame, by: list[str], most: int = 40) -> DataFrame:
    """(by, pos, risk, folded): the first `most` changes by risk and position, and one row for the rest with the worst risk of them."""
    w = Window.partitionBy(*by).orderBy(risk_rank(F.col("risk")), "pos")
    rows = changes.withColumn("_rn", F.row_number().over(w))
    kept = rows.filter(F.col("_rn") <= most).select(*by, "pos", "risk", F.lit(1).cast("long").alias("folded"))
    rest = rows.filter(F.col("_rn") > most).groupBy(*by).agg(F.max("pos").alias("pos"), F.min_by("risk", risk_rank(F.col("risk"))).alias("risk"), F.count("*").alias("folded"))
    return kept.unionByName(rest)


def after_rollback(errors: DataFrame, rollbacks: DataFrame, wait_ms: int = 120_000) -> DataFrame:
    """(release_id, errors, last_ms): errors of a release over wait_ms after its rollback."""
    hit = errors.join(rollbacks, "release_id").filter(F.col("ts_ms") > F.col("rolled_back_ms") + wait_ms)
    return hit.groupBy("release_id").agg(F.count("*").alias("errors"), F.max("ts_ms").alias("last_ms"))


def anchor_factor(anchor: Column, first_error: Column, kind: Column | None = None) -> Column:
    """1.15 if the first error is from a minute before to an hour after, 0.6 if earlier than that, else 1."""
    lag = first_error - anchor
    near = (lag >= -60_000) & (lag <= 3_600_000)
    early = lag < -60_000 if kind is None else (lag < -60_000) & (kind == "change")
    return F.when(near, 1.15).when(early, 0.6).otherwise(1.0)


# Change categories by path and resource kind, in order.
LABELS = r"^(spec\.template\.|spec\.jobtemplate\.spec\.template\.)?metadata\.(labels|annotations)(\.|\z)"
CHART_LABELS = r"helm\.sh/chart|app\.kubernetes\.io/version|(^|\.)labels\.chart\z"
RBAC_KINDS = "Role RoleBinding ClusterRole ClusterRoleBinding ServiceAccount".split()


def classify_change(field: Column, kind: Column, before: Column, after: Column, namespace: Column, hook: Column) -> Column:
    """Struct of category, risk and direction of a change at a path of a resource; first match wins."""
    p, removed, added = F.lower(F.coalesce(field, F.lit(""))), after.isNull(), before.isNull()
    values = kind == "values"
    has = lambda pattern: p.rlike(pattern)
    qb, qa = quantity(before), quantity(after)
    nb, na = before.try_cast("double"), after.try_cast("double")
    leaf = F.regexp_extract(p, r"([^.\[\]]+)\]?\z", 1)
    tighter = F.coalesce((leaf.rlike("timeoutseconds|failurethreshold|initialdelayseconds|periodseconds") & (na < nb)) | (leaf.rlike("successthreshold") & (na > nb)), F.lit(False))
    risky = lambda c: F.when(c, "high").otherwise("medium")
    both = qb.isNotNull() & qa.isNotNull()
    limit = has("limits")
    resources = has(r"(^|\.)resources(\.|\z)|(^|\.)(limits|requests)\.(memory|cpu|ephemeral-storage)\z")
    direction = F.when(both & (qa < qb), "down").when(both & (qa > qb), "up").when(both & limit, "same").when(both, "up")
    none = F.lit(None).cast("string")
    out = lambda category, risk, way=none: F.struct(F.lit(category).alias("category"), (F.lit(risk) if isinstance(risk, str) else risk).alias("risk"), way.alias("direction"))
    label = has(LABELS) & ~has(r"helm\.sh/hook")
    cases = [
        (label & has(CHART_LABELS), out("chart", "low")),
        (label, out("other", "low")),
        ((kind == "CustomResourceDefinition") | has(r"(^|\.)crds?(\.|\z)|installcrds"), out("crd", "high")),
        ((kind == "NetworkPolicy") | has("networkpolic"), out("networkpolicy", "high")),
        (hook | (has("migrat") & values), out("migration-hook", "high")),
        ((kind == "Secret") | (has(r"(^|\.)secrets?(\.|\[|\z)") & values), out("secret", risky(removed))),
        ((kind == "HorizontalPodAutoscaler") | has(r"maxreplicas|minreplicas|autoscaling\."), out("hpa", risky(has("maxreplicas|minreplicas|metrics|target") | added | removed))),
        (has(r"(^|\.)(replicas|replicacount)\z"), out("replicas", "high")),
        (has("(liveness|readiness|startup)probe"), out("probe", risky(tighter | added))),
        (resources & limit & both, out("resources", F.when(qa < qb, "high").otherwise("low"), direction)),
        (resources, out("resources", "medium", F.when(~limit, direction))),
        (has(r"(^|\.)image\z|\.image\.(tag|repository|digest)\z|^image\.(tag|repository|digest)\z|^image\z|(^|\.)tag\z"), out("image", "medium")),
        (has(r"\.env\[|^env\[|\.env\z|(^|\.)envfrom|^env\.|(^|\.)extraenv"), out("env", risky(removed))),
        ((kind == "ConfigMap") | has(r"(^|\.)(config|configmap|configuration)(\.|\z)"), out("configmap", risky(removed | F.coalesce(namespace == "kube-system", F.lit(False))))),
        (kind.isin("Ingress", "HTTPRoute", "Gateway") | has(r"(^|\.)ingress(\.|\z)|gateway|httproute"), out("ingress", "medium")),
        ((kind == "Service") | has(r"^service\."), out("service", risky(has(r"selector|targetport|port\z")))),
        (kind.isin(*RBAC_KINDS) | has(r"(^|\.)rbac(\.|\z)|serviceaccount"), out("rbac", "medium")),
        (has(CHART_LABELS + r"|^version\z|^appversion\z"), out("chart", "low")),
        (has(r"\.labels\.|\.annotations\.|(^|\.)labels\z|(^|\.)annotations\z"), out("other", "low")),
        (has(r"containers\[") | values, out("other", "medium")),
    ]
    return F.coalesce(first_of(cases), out("other", "low"))
