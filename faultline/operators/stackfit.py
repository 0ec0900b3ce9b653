"""Traits of an incident and what they cost or break in an observability stack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import half_up

# Label keys and values that make series without bound.
ID_KEYS = r"(?i)(^|[_-])(id|uuid|guid|user|session|request|trace|email|ip|url|path)([_-]|\z)"
ID_VALUES = r"^[0-9a-f]{8,}\z|^[0-9a-f]{8}-[0-9a-f]{4}-"


def high_cardinality(labels: DataFrame, least: int = 20) -> DataFrame:
    """(key, values, id_like): label keys with `least` and more values, or whose name or values look like ids."""
    out = labels.groupBy("key").agg(F.countDistinct("value").alias("values"), F.bool_or(F.col("value").rlike(ID_VALUES)).alias("by_value"))
    id_like = F.col("key").rlike(ID_KEYS) | F.coalesce(F.col("by_value"), F.lit(False))
    return out.select("key", "values", id_like.alias("id_like")).filter((F.col("values") >= least) | F.col("id_like"))


def tiered_cost(usage: DataFrame, tiers: list[tuple[float, float | None, float]]) -> DataFrame:
    """(id, cost): the sum over price tiers (from, to, price of a unit) of what falls into each."""
    cost = F.lit(0.0)
    for low, high, price in tiers:
        top = F.col("amount") if high is None else F.least(F.col("amount"), F.lit(high))
        cost = cost + F.greatest(top - low, F.lit(0.0)) * price
    return usage.select("id", half_up(cost, 4).alias("cost"))


def verdict(flags: DataFrame) -> DataFrame:
    """(id, verdict): Strained if anything breaks, Workable from two strains on, else Good fit."""
    out = flags.groupBy("id").agg(F.count_if(F.col("level") == "breaks").alias("b"), F.count_if(F.col("level") == "strain").alias("s"))
    return out.select("id", F.when(F.col("b") > 0, "Strained").when(F.col("s") >= 2, "Workable").otherwise("Good fit").alias("verdict"))


def per_minute(count, span_ms):
    """count over at least a minute, one place; null without a span."""
    return F.when(span_ms.isNotNull(), half_up(count / F.greatest(span_ms / 60000.0, F.lit(1.0)), 1))


# What a scale is taken to be where it isn't stated; label keys that name a part of the infrastructure; limits and prices of stacks, as published.
SCALE = {"nodes": 40.0, "logs_gb": 50.0, "series": 500_000.0, "apm_hosts": 20.0}
INFRA_LABEL = r"(?i)^(pod|pod_name|pod_ip|pod_uid|kubernetes_pod_name|exported_pod|instance|exported_instance|container|container_id|container_name|node|nodename|node_name|kubernetes_node|host|hostname|host_ip|ip|address|endpoint)$"
DAYS, MINUTES = 30, 43_200
INCLUDED_PER_NODE, NODE_USD, APM_USD, INGEST_USD = 100, 15.0, 31.0, 0.10
TENANT_SERIES, TENANT_MB_S, PLAN_USD, PLAN_SERIES, SERIES_USD, PLAN_GB, PROCESS_USD, WRITE_USD = 150_000, 4.0, 19.0, 10_000, 6.50, 50.0, 0.05, 0.40
POINT_BYTES, POINT_GB_USD = 450, 0.50
WORKSPACE_SERIES, BURST_SERIES = 1_000_000, 2_000_000
SAMPLE_TIERS = [(0.0, 50e9, 0.06), (50e9, 250e9, 0.048), (250e9, 500e9, 0.036), (500e9, None, 0.024)]


def stated_number(text, default: float):
    """A number as typed, with separators; the default for blanks, negatives and what is no number."""
    n = F.regexp_replace(text, r"[,_\s]", "").try_cast("double")
    return F.when((n >= 0) & ~F.isnan(n) & (n < float("inf")), n).otherwise(F.lit(default))


def normalised_scale(rows: DataFrame) -> DataFrame:
    """rows with the columns of SCALE as numbers; nodes, series and hosts are whole."""
    whole = lambda k: half_up(stated_number(F.col(k), SCALE[k]))
    return rows.withColumns({"nodes": whole("nodes"), "logs_gb": stated_number(F.col("logs_gb"), SCALE["logs_gb"]), "series": whole("series"), "apm_hosts": whole("apm_hosts")})


def label_traits(labels: DataFrame) -> DataFrame:
    """(id, infra, request): how many high-cardinality label keys name infrastructure, and how many others; rows (id, key)."""
    return labels.filter("key is not null and key <> ''").distinct().groupBy("id").agg(F.count_if(F.col("key").rlike(INFRA_LABEL)).alias("infra"), F.count_if(~F.col("key").rlike(INFRA_LABEL)).alias("request"))


def money(x):
    return F.when(x >= 100, half_up(x)).otherwise(half_up(x, 2))


def _when(condition, level):
    return F.when(condition, level)


def stack_flags(rows: DataFrame) -> DataFrame:
    """(id, stack, pos, flag, level): what of an incident each kind of stack breaks on, strains under or takes.

    rows: id, the columns of SCALE, infra, request (label counts), silent (error traces may be missing), multi, has_logs, has_traces, untraced (a count).
    """
    c = F.col
    labelled, series, rate = (c("infra") + c("request")) > 0, c("series"), c("logs_gb") * 1000 / 86_400
    included, share = c("nodes") * INCLUDED_PER_NODE, half_up(c("series") / WORKSPACE_SERIES * 100)
    table = {
        "hosted": [
            ("custom-metrics", F.when(labelled | (series > included), "strain").otherwise("ok")),
            ("error-sampler", _when(c("silent"), "ok")),
            ("sampling-cost", _when(c("silent"), "strain")),
            ("span-retention", _when(c("has_traces") | c("silent"), "strain")),
            ("index-quota", _when(c("has_logs"), "strain")),
            ("cluster-view", _when(c("multi"), "ok")),
        ],
        "self-hosted": [
            ("tenant-series", F.when((series > TENANT_SERIES) | labelled, "strain").otherwise("ok")),
            ("stream-labels", _when(labelled, "strain")),
            ("log-rate", F.when(rate >= TENANT_MB_S / 2, "strain").otherwise("ok")),
            ("kept-traces", _when(c("silent"), "strain")),
            ("shared-tenant", _when(c("multi"), "strain")),
            ("churn-bill", _when(labelled, "strain")),
        ],
        "collector": [
            ("head-sampling", F.when(c("silent"), "breaks").when(c("has_traces"), "ok")),
            ("label-limit", _when(labelled, "strain")),
            ("untraced-parts", _when(c("untraced") > 0, "strain")),
            ("cluster-labels", _when(c("multi"), "strain")),
            ("refused-data", F.lit("strain")),
        ],
        "managed": [
            ("workspace-series", F.when(series >= WORKSPACE_SERIES, "breaks").when((share >= 70) | labelled, "strain").otherwise("ok")),
            ("burst", F.when(series >= BURST_SERIES, "strain").when(labelled, "ok")),
            ("billed-series", _when(labelled, "strain")),
            ("metrics-only", _when(c("silent"), "strain")),
            ("shared-workspace", _when(c("multi"), "strain")),
        ],
    }
    entries = [F.struct(F.lit(s).alias("stack"), F.lit(i).alias("pos"), F.lit(f).alias("flag"), level.alias("level")) for s, fs in table.items() for i, (f, level) in enumerate(fs)]
    return rows.select("id", F.inline(F.array(*entries))).filter("level is not null")


def stack_costs(rows: DataFrame) -> DataFrame:
    """(id, stack, line, usd): monthly list-price estimates of a scale; null where no price is known."""
    c, gb = F.col, F.col("logs_gb") * DAYS
    none, samples = F.lit(None).cast("double"), F.col("series") * MINUTES
    tiers = F.lit(0.0)
    for low, high, price in SAMPLE_TIERS:
        tiers = tiers + F.greatest((samples if high is None else F.least(samples, F.lit(high))) - low, F.lit(0.0)) / 1e6 * price
    lines = [
        ("hosted", "nodes", c("nodes") * NODE_USD),
        ("hosted", "apm", c("apm_hosts") * APM_USD),
        ("hosted", "log-ingest", gb * INGEST_USD),
        ("hosted", "log-index", none),
        ("hosted", "custom-metrics", F.when(c("series") <= c("nodes") * INCLUDED_PER_NODE, 0.0)),
        ("self-hosted", "plan", F.lit(PLAN_USD)),
        ("self-hosted", "metrics", F.greatest(F.lit(0.0), c("series") - PLAN_SERIES) / 1000 * SERIES_USD),
        ("self-hosted", "logs-processed", gb * PROCESS_USD),
        ("self-hosted", "logs-written", F.greatest(F.lit(0.0), gb - PLAN_GB) * WRITE_USD),
        ("collector", "points", samples * POINT_BYTES / 1e9 * POINT_GB_USD),
        ("managed", "samples", tiers),
    ]
    return rows.select("id", F.inline(F.array(*[F.struct(F.lit(s).alias("stack"), F.lit(n).alias("line"), money(x).alias("usd")) for s, n, x in lines])))


#: The limits and prices that flags and costs rest on: stack, item, value, unit.
CATALOGUE = [
    ("hosted", "included series per node", float(INCLUDED_PER_NODE), "series"), ("hosted", "node", NODE_USD, "usd/month"), ("hosted", "traced host", APM_USD, "usd/month"), ("hosted", "log ingest", INGEST_USD, "usd/GB"), ("hosted", "log index", None, "usd/event"),
    ("self-hosted", "series per tenant", float(TENANT_SERIES), "series"), ("self-hosted", "log rate per tenant", TENANT_MB_S, "MB/s"), ("self-hosted", "plan", PLAN_USD, "usd/month"), ("self-hosted", "series", SERIES_USD, "usd/1000"), ("self-hosted", "log processed", PROCESS_USD, "usd/GB"), ("self-hosted", "log written", WRITE_USD, "usd/GB"),
    ("collector", "point", float(POINT_BYTES), "bytes"), ("collector", "points", POINT_GB_USD, "usd/GB"), ("managed", "series per workspace", float(WORKSPACE_SERIES), "series"), ("managed", "burst floor", float(BURST_SERIES), "series"), *[("managed", f"samples from {int(low)}", price, "usd/million") for low, _, price in SAMPLE_TIERS],
]


def stack_catalogue(scales: DataFrame) -> DataFrame:
    """(stack, item, value, unit, over): the catalogue, and how many of the scales have more series than a limit allows; null for what is no limit of series."""
    table = F.explode(F.array(*[F.struct(F.lit(s).alias("stack"), F.lit(i).alias("item"), F.lit(v).cast("double").alias("value"), F.lit(u).alias("unit")) for s, i, v, u in CATALOGUE]))
    rows = scales.select(F.col("series").cast("double").alias("series"), table.alias("c")).select("series", "c.*")
    return rows.groupBy("stack", "item", "value", "unit").agg(F.count_if(F.col("series") > F.col("value")).alias("over")).withColumn("over", F.when(F.col("unit") == "series", F.col("over")))


def assembled(flags: DataFrame) -> DataFrame:
    """(id, stack, verdict, why): the verdict of each stack and the first of its worst flags."""
    keyed = flags.withColumn("key", F.struct("id", "stack"))
    order = F.struct(F.when(F.col("level") == "breaks", 0).when(F.col("level") == "strain", 1).otherwise(2), "pos")
    why = flags.groupBy("id", "stack").agg(F.min_by("flag", order).alias("why"))
    v = verdict(keyed.select(F.col("key").alias("id"), "level")).select("id.id", "id.stack", "verdict")
    return v.join(why, ["id", "stack"])
