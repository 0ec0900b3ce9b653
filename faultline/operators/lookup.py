"""Read-only lookups: literal search, a component's signals, dependencies, results within a byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import rank
from .scans import running_sums


def search(lines: DataFrame, query: str, most: int = 40, source: str | None = None, redact: bool = False) -> DataFrame:
    """The first `most` lines that hold the query, without regard to case and never as a pattern; of one source if given.

    With redact the lines are redacted before they are searched, so a secret can't be found by guessing it.
    """
    rows = lines if source is None else lines.filter(F.col("source") == source)
    rows = rows.withColumn("body", text.redact(F.col("body"))) if redact else rows
    return rows.filter(F.contains(F.lower("body"), F.lit(query.lower()))).orderBy("seq").limit(most)


def component_signals(signals: DataFrame, component: str, kinds: list[str] | None = None, most: int = 25) -> DataFrame:
    """A component's most severe signals, then earliest; most is held within 1 and 60."""
    rows = signals.filter(F.col("component") == component)
    if kinds:
        rows = rows.filter(F.col("kind").isin(kinds))
    return rows.orderBy(rank(F.col("severity")).desc(), "ts_ms", "seq").limit(max(1, min(60, most)))


def dependencies(edges: DataFrame, component: str, most: int = 30) -> DataFrame:
    """(direction, other, calls, errors): callers and callees, most errors first."""
    w = Window.partitionBy("direction").orderBy(F.desc("errors"), F.desc("calls"), "other")
    side = lambda own, other, name: edges.filter(F.col(own) == component).select(F.lit(name).alias("direction"), F.col(other).alias("other"), "calls", "errors")
    rows = side("to", "from", "caller").unionByName(side("from", "to", "callee"))
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).drop("_rn")


def within_bytes(rows: DataFrame, by: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose texts fit the budget."""
    return running_sums(rows, by, order, {"used_bytes": F.octet_length(text).cast("long")}).filter(F.col("used_bytes") <= budget)


# Bytes of a lookup's result and of an evidence pack.
LOOKUP_BYTES, PACK_BYTES = 8_000, 60_000


def resolved(components: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ref, id, others): the component that each reference names, and how many more it could mean.

    An exact id wins; then a name, an id without its type, the end of one, or namespace/name; then any part of an id. Of
    several the worst off is taken. wanted: ref.

    Every way to name a component is a key, so the first two are equi-joins. For the
    last, ids are indexed by their runs of up to GRAM characters; a reference looks up
    the run of its own that the fewest ids have, and what it finds is compared.
    """
    from .orders import STATUSES, place_in

    refs = wanted.filter("ref <> ''").select("ref", F.lower("ref").alias("low")).distinct().withColumn("tail", F.regexp_replace("low", r"^[^:]*:", ""))
    rest = ["id", "status", "impact"]
    c = components.select(*rest, F.lower("id").alias("lid"), F.lower("name").alias("lname"), F.lower(F.coalesce("namespace", F.lit(""))).alias("ns"))
    exact = c.join(refs.select("ref", F.col("ref").alias("id")), "id").select("ref", F.lit(0).alias("tier"), *rest)
    way = lambda on, key: F.struct(F.lit(on).alias("on"), key.alias("key"))
    parts = F.split("lid", "/")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: way("tail", F.array_join(F.slice(parts, k, F.size(parts)), "/")))
    ways = F.concat(F.array(way("low", F.col("lname")), way("low", F.col("lid")), way("low", F.concat_ws("/", "ns", "lname")), way("tail", F.regexp_replace("lid", r"^[^:]*:", ""))), F.when(F.size(parts) > 1, ends).otherwise(F.slice(ends, 1, 0)))
    keys = c.select(*rest, F.explode(F.array_distinct(ways)).alias("w")).select(*rest, "w.*").filter("key is not null")
    asked = refs.select("ref", F.explode(F.array(way("low", F.col("low")), way("tail", F.col("tail")))).alias("w")).select("ref", "w.*")
    named = keys.join(asked, ["on", "key"]).select("ref", F.lit(1).alias("tier"), *rest).distinct()
    open_ = refs.join(exact.select("ref").union(named.select("ref")).distinct(), "ref", "left_anti")
    indexed = c.select(*rest, "lid", F.explode(grams(F.col("lid"))).alias("gram"))
    held = indexed.groupBy("gram").agg(F.count("*").alias("ids"))
    longest = F.least(F.char_length("low"), F.lit(GRAM))
    looked = open_.select("ref", "low", F.explode(F.filter(grams(F.col("low")), lambda g: F.char_length(g) == longest)).alias("gram")).join(held, "gram", "left")
    rarest = looked.groupBy("ref", "low").agg(F.min_by("gram", F.struct(F.coalesce("ids", F.lit(0)), "gram")).alias("gram"))
    part = indexed.join(rarest, "gram").filter(F.contains("lid", F.col("low"))).select("ref", F.lit(2).alias("tier"), *rest)
    hits = exact.unionByName(named.join(exact.select("ref"), "ref", "left_anti")).unionByName(part)
    best = F.struct(place_in(F.col("status"), STATUSES), -F.coalesce("impact", F.lit(0.0)), "id")
    return hits.groupBy("ref").agg(F.min_by("id", best).alias("id"), (F.count("*") - 1).alias("others"))


#: Characters of the longest runs by which ids are indexed.
GRAM = 3


def grams(text):
    """The distinct runs of 1 to GRAM characters of a text."""
    runs = lambda k: F.when(F.char_length(text) >= k, F.transform(F.sequence(F.lit(1), F.char_length(text) - (k - 1)), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[runs(k) for k in range(1, GRAM + 1)]))


def fitted(rows: DataFrame, by: list[str], order: list, budget: int = LOOKUP_BYTES) -> DataFrame:
    """(by, result, shown, total): rows of each group as JSON, in order, as many as fit the budget; a group is a result, so it is small."""
    fields = [c for c in rows.columns if c not in by]
    text = rows.withColumn("json", F.to_json(F.struct(*fields)))
    w = Window.partitionBy(*by).orderBy(*order)
    used = text.withColumns({"used": F.sum(F.octet_length("json") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(w)})
    inside = F.when(F.col("used") <= budget, F.struct("place", "json"))
    shown = F.transform(F.sort_array(F.collect_list(inside)), lambda x: x["json"])
    return used.groupBy(*by).agg(F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]")).alias("result"), F.count(inside).alias("shown"), F.count("*").alias("total"))


def component_list(components: DataFrame) -> DataFrame:
    """(cluster, result, shown, total): components of each cluster, the worst off first."""
    from .orders import STATUSES, place_in

    rows = components.select("cluster", "id", "name", "type", "role", "namespace", "status", "user_facing", "errors", "impact", "release")
    return fitted(rows, ["cluster"], [place_in(F.col("status"), STATUSES), F.desc("impact"), "id"])


def change_list(changes: DataFrame) -> DataFrame:
    """(release, result, shown, total): changes of each release, the riskiest first."""
    from .changes import risk_rank

    rows = changes.select("release", "id", "category", "risk", "field", "before", "after", "line")
    return fitted(rows, ["release"], [F.coalesce(risk_rank(F.col("risk")), F.lit(4)), "line", "id"])


def json_number(x: Column) -> Column:
    """A double as JSON text: plain digits from 0.0001 to below 1e16, where Spark writes exponents from 1e7 on and below 0.001."""
    text, size = x.cast("double").cast("string"), F.abs(x)
    plain = F.regexp_replace(F.regexp_replace(x.cast("double").cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    far = F.regexp_replace(F.regexp_replace(text, r"(?:\.0)?E(?=\d)", "e+"), r"(?:\.0)?E-", "e-")
    return F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(F.regexp_replace(far, r"(e[+-])(\d)$", "$10$2"))


def budget_view(budgets: DataFrame) -> DataFrame:
    """(id, result): the budget of each incident as JSON, or a note that nothing tells its error rate."""
    from .budget import consumed_pct

    used = F.round(consumed_pct(F.col("burn"), F.col("minutes"), F.col("window_days")), 4)
    said = {"burnRate": F.round("burn", 3), "incidentMinutes": F.col("minutes"), "windowDays": F.col("window_days"), "consumedPct": used}
    known = F.concat(F.lit("{"), F.concat_ws(",", F.lit('"hasEvidence":true'), *[F.concat(F.lit(f'"{k}":'), json_number(v)) for k, v in said.items()]), F.lit("}"))
    return budgets.select("id", F.when(F.col("burn").isNotNull(), known).otherwise(F.to_json(F.struct(F.lit(False).alias("hasEvidence"), F.lit("no error-rate evidence").alias("note")))).alias("result"))


#: Lookups by name: the relations that each reads, and its function of these and of the input.
LOOKUPS = {
    "search_evidence": (["lines"], lambda r, i: search(r["lines"], i["query"])),
    "get_component_signals": (["signals"], lambda r, i: component_signals(r["signals"], i["component"], i.get("kinds"), int(i.get("limit", 25)))),
    "list_components": (["components"], lambda r, i: component_list(r["components"])),
    "get_changes": (["changes"], lambda r, i: change_list(r["changes"])),
    "get_dependencies": (["edges"], lambda r, i: dependencies(r["edges"], i["component"])),
    "get_budget": (["budgets"], lambda r, i: budget_view(r["budgets"])),
}


def look_up(relations: dict[str, DataFrame], name: str, given: dict) -> DataFrame:
    """The result of a lookup by name; an unknown name, or an input that it lacks, gives one row with a message."""
    spark = next(iter(relations.values())).sparkSession
    say = lambda text: spark.createDataFrame([(text,)], "message string")
    if name not in LOOKUPS:
        return say(f"there is no lookup {name}; there are {', '.join(LOOKUPS)}")
    needs, run = LOOKUPS[name]
    missing = [n for n in needs if n not in relations]
    try:
        return say(f"{name} has nothing to read: {', '.join(missing)}") if missing else run(relations, given)
    except KeyError as key:
        return say(f"{name} needs {key.args[0]}")


def overview(components: DataFrame, hypotheses: DataFrame, by: str, most: int = 25, causes: int = 3) -> DataFrame:
    """(by, unhealthy, healthy, causes): names of at most `most` unhealthy components and 40 healthy ones, and the first causes, as text."""
    from .orders import STATUSES, place_in

    ill = F.col("status") != "healthy"
    w = Window.partitionBy(by, ill).orderBy(place_in(F.col("status"), STATUSES), F.desc("impact"), "id")
    rows = components.withColumns({"ill": ill, "place": F.row_number().over(w)}).filter(F.when(F.col("ill"), F.col("place") <= most).otherwise(F.col("place") <= 40))
    named = lambda c, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("place", text.alias("t"))))), lambda x: x["t"]), ", ")
    parts = rows.groupBy(by).agg(named(F.col("ill"), F.concat("name", F.lit(" "), "status")).alias("unhealthy"), named(~F.col("ill"), F.col("name")).alias("healthy"))
    h = hypotheses.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("confidence"), "category", "component"))).filter(F.col("place") <= causes)
    top = h.groupBy(by).agg(named(F.lit(True), F.concat("category", F.lit(" at "), "component")).alias("causes"))
    return parts.join(top, by, "left")


def unlikely_options(options: DataFrame, hypotheses: DataFrame, components: DataFrame) -> DataFrame:
    """(option, unlikely): an option that isn't recommended, and all of whose causes are under 0.35 or at a healthy component.

    options: option, cause, recommended, a row per cause; hypotheses: cause, confidence, component; components: id, status.
    """
    known = hypotheses.join(components.select(F.col("id").alias("component"), "status"), "component", "left")
    weak = (F.coalesce("confidence", F.lit(0.0)) < 0.35) | F.coalesce(F.col("status") == "healthy", F.lit(False))
    return options.join(known.select("cause", weak.alias("weak")), "cause").groupBy("option").agg((F.bool_and("weak") & ~F.bool_or("recommended")).alias("unlikely"))


def compared_reads(reads: DataFrame, hypotheses: DataFrame, most: int = 6) -> DataFrame:
    """(incident, agree, same_component, same_category, match_rank): another's read (incident, component, category) against the first cause, and its place among the first causes."""
    ranked = hypotheses.withColumn("rank", F.row_number().over(Window.partitionBy("incident").orderBy(F.desc("confidence"), "category", "component"))).filter(F.col("rank") <= most)
    top = ranked.filter("rank = 1").select("incident", F.col("component").alias("tc"), F.col("category").alias("tk"))
    hit = ranked.select("incident", "component", "category", F.col("rank").alias("match_rank"))
    out = reads.join(top, "incident").join(hit, ["incident", "component", "category"], "left")
    c, k = F.col("component") == F.col("tc"), F.col("category") == F.col("tk")
    return out.select("incident", (c & k).alias("agree"), c.alias("same_component"), k.alias("same_category"), "match_rank")


def clean_ids(text):
    """An id without brackets, quotes and stops around it; null for none."""
    t = F.regexp_replace(F.substring(F.trim(text), 1, 80), r"^[\[(\s\"']+|[\])\s\"'.,;:]+$", "")
    return F.when(~F.lower(t).isin("", "null", "none", "n/a", "-"), t)


def capped_parts(parts: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Rows (reply, part, pos, text) of a reply's lists, at most caps[part] of each and none that are blank; every remediation needs approval."""
    w = Window.partitionBy("reply", "part").orderBy("pos")
    most = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("part")]
    kept = parts.withColumn("_rn", F.row_number().over(w)).filter((F.col("_rn") <= most) & (F.trim("text") != ""))
    return kept.drop("_rn").withColumn("needs_approval", F.col("part") == "remediation")


def fingerprints_of(counts: DataFrame) -> DataFrame:
    """(id, fingerprint): what tells one state of an analysis from another: its counts and headline fields, joined."""
    return counts.select("id", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(counts.columns) if c != "id"]).alias("fingerprint"))
