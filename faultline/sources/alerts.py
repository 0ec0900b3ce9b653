"""Alert documents to one relation: webhook, API and rule JSON, and text lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.names import norm, pod_owner
from ..functions.text import alert_kind, alert_severity, bound, computed, first_of, logfmt
from ..functions.times import leading_stamp, window_minutes
from .lines import pane_lines, reader, split_lines
from .traces import json_segments, line_of, repaired_json

#: What read_alerts gives.
ALERTS = "incident_id string, name string, status string, kind string, alert_kind string, severity string, component string, namespace string, cluster string, starts_ms bigint, ends_ms bigint, value double, long_window_min double, source_line int, summary string, labels map<string,string>"

_ALERT = "struct<status:string,state:string,labels:map<string,string>,annotations:map<string,string>,startsAt:string,activeAt:string,endsAt:string,value:string,fingerprint:string>"
_API = "array<struct<status:struct<state:string,silencedBy:array<string>>,labels:map<string,string>,annotations:map<string,string>,startsAt:string,endsAt:string,fingerprint:string>>"
WEBHOOK = f"struct<alerts:array<{_ALERT}>,commonLabels:map<string,string>,groupLabels:map<string,string>,commonAnnotations:map<string,string>,data:struct<alerts:array<{_ALERT}>,groups:array<struct<rules:array<struct<name:string,alerts:array<{_ALERT}>>>>>>>"


def _map(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.create_map().cast("map<string,string>"))


def overlaid(*maps: Column) -> Column:
    """One map; keys of later maps replace those of earlier ones."""

    def over(low: Column, high: Column) -> Column:
        return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)

    return reduce(over, maps)


def iso_ms(stamp: Column) -> Column:
    return leading_stamp(F.concat(stamp, F.lit(" ")))["ts_ms"]


def _told(df: DataFrame, status: Column, value: Column) -> DataFrame:
    return df.select("incident_id", "labels", "annotations", "starts", "ends", "source_line", status.alias("status"), value.alias("value"))


def _rows(df: DataFrame) -> DataFrame:
    """(incident_id, labels, annotations, starts, ends, source_line, status, value) to alert rows."""
    status, value = F.col("status"), F.col("value")
    l = F.col("labels")  # noqa: E741
    name = F.coalesce(l["alertname"], F.lit("alert"))
    kind = alert_kind(name, F.coalesce(l["reason"], F.lit("")), F.coalesce(l["job_name"], l["job"], F.lit("")))
    alive = [F.when(~l[k].rlike(V.MONITORING), l[k]) for k in V.COMPONENT_LABELS]
    pods = [pod_owner(x)["workload"] if k in ("pod", "instance") else norm(x) for k, x in zip(V.COMPONENT_LABELS, alive, strict=True)]
    component = F.coalesce(*[F.when(x.isNotNull() & (p != ""), p) for x, p in zip(alive, pods, strict=True)])
    long_window = F.coalesce(window_minutes(F.coalesce(l["long_window"], l["window"], l["long"])), window_minutes(F.regexp_extract(name, r"(\d+[mhd])", 1)))
    return df.select(
        "incident_id",
        name.alias("name"),
        status.alias("status"),
        F.when(status == "resolved", "alert_resolved").otherwise(kind).alias("kind"),
        kind.alias("alert_kind"),
        alert_severity(l["severity"], status).alias("severity"),
        component.alias("component"),
        F.coalesce(*[l[k] for k in V.NAMESPACE_LABELS]).alias("namespace"),
        F.coalesce(*[l[k] for k in V.CLUSTER_LABELS]).alias("cluster"),
        iso_ms(F.col("starts")).alias("starts_ms"),
        iso_ms(F.col("ends")).alias("ends_ms"),
        value.alias("value"),
        long_window.alias("long_window_min"),
        "source_line",
        F.coalesce(_map("annotations")["summary"], _map("annotations")["description"], _map("annotations")["message"]).alias("summary"),
        "labels",
    )


def _located(labels: Column, starts: Column, fingerprint: Column) -> Column:
    """The line that names an alert of a document: by name, else by start, else by fingerprint."""
    doc, first = F.col("doc"), F.col("first_line")
    has = lambda v: F.coalesce(doc.contains(F.concat(F.lit('"'), v, F.lit('"'))), F.lit(False))
    name = F.coalesce(labels["alertname"], F.lit(""))
    return F.when(has(name), line_of(doc, first, name)).when(has(starts), line_of(doc, first, starts)).when(has(fingerprint), line_of(doc, first, fingerprint)).otherwise(first)


@reader(_rows)
def json_alerts(docs: DataFrame) -> DataFrame:
    """Of (incident_id, doc): webhook and rule documents, and bare arrays of alerts. Inactive rules are left out."""
    o = docs.filter(F.col("doc").rlike(r"^\s*\{")).select("incident_id", "first_line", "doc", F.from_json("doc", WEBHOOK).alias("o"))
    listed = F.concat(*[F.coalesce(x, F.array().cast(f"array<{_ALERT}>")) for x in (F.col("o.alerts"), F.col("o.data.alerts"), F.flatten(F.flatten(F.transform(F.col("o.data.groups"), lambda g: F.transform(g["rules"], lambda r: r["alerts"])))))])
    a = o.select("incident_id", "first_line", "doc", _map("o.groupLabels").alias("gl"), _map("o.commonLabels").alias("cl"), _map("o.commonAnnotations").alias("ca"), F.explode(listed).alias("a"))
    a = a.select("incident_id", _located(F.col("a.labels"), F.coalesce("a.startsAt", "a.activeAt"), F.col("a.fingerprint")).alias("source_line"), overlaid(F.col("gl"), F.col("cl"), _map("a.labels")).alias("labels"), overlaid(F.col("ca"), _map("a.annotations")).alias("annotations"), F.coalesce("a.startsAt", "a.activeAt").alias("starts"), F.col("a.endsAt").alias("ends"), F.lower(F.coalesce("a.status", "a.state", F.lit("firing"))).alias("state"), F.col("a.value").try_cast("double").alias("value"))
    first = _told(a.filter("state <> 'inactive'"), F.when(F.col("state") == "active", "firing").otherwise(F.col("state")), F.col("value"))
    api = docs.filter(F.col("doc").rlike(r"^\s*\[")).select("incident_id", "first_line", "doc", F.explode(F.from_json("doc", _API)).alias("a")).filter("a.labels is not null")
    api = api.select("incident_id", _located(F.col("a.labels"), F.col("a.startsAt"), F.col("a.fingerprint")).alias("source_line"), _map("a.labels").alias("labels"), _map("a.annotations").alias("annotations"), F.col("a.startsAt").alias("starts"), F.col("a.endsAt").alias("ends"), F.lower(F.coalesce("a.status.state", F.lit("firing"))).alias("state"))
    return first.unionByName(_told(api, F.when(F.col("state") == "suppressed", "silenced").when(F.col("state") == "active", "firing").otherwise(F.col("state")), F.lit(None).cast("double")))


@reader(_rows)
def text_alerts(panes: DataFrame) -> DataFrame:
    """Of (incident_id, text): "[FIRING:n] Name ...", "stamp FIRING severity Name k=v ...", 'ALERT Name{k="v"}' and alertname= lines."""
    rows = bodied_lines(panes)
    line = F.col("line")
    subject, stamped, rule = r"^\s*\[(FIRING|RESOLVED)(?::\d+)?\]\s+(\S+)", r"\b(FIRING|RESOLVED|PENDING)\s+(\w+)\s+([A-Z]\w+)", r"^\s*ALERT\s+(\w+)\s*\{([^}]*)\}"
    m = rows.withColumn("m", logfmt(F.regexp_replace(line, "[{},]", " ")))
    name = first_of([(line.rlike(subject), F.regexp_extract(line, subject, 2)), (line.rlike(rule), F.regexp_extract(line, rule, 1)), (line.rlike(stamped), F.regexp_extract(line, stamped, 3)), (F.col("m")["alertname"].isNotNull(), F.col("m")["alertname"])])
    state = F.lower(F.coalesce(first_of([(line.rlike(subject), F.regexp_extract(line, subject, 1)), (line.rlike(stamped), F.regexp_extract(line, stamped, 1))]), F.col("m")["state"], F.lit("firing")))
    severity = F.when(line.rlike(stamped), F.lower(F.regexp_extract(line, stamped, 2)))
    extra = F.map_filter(F.create_map(F.lit("alertname"), F.col("name"), F.lit("severity"), F.coalesce(severity, F.col("m")["severity"])), lambda k, v: v.isNotNull())
    m = m.withColumns({"name": name, "state": state}).filter("name is not null")
    m = m.select("incident_id", F.col("line_no").cast("int").alias("source_line"), overlaid(F.col("m"), extra).alias("labels"), _map(F.lit(None).cast("map<string,string>")).alias("annotations"), line.alias("starts"), F.lit(None).cast("string").alias("ends"), "state", "body")
    m = with_bodies(m)
    return _told(m, F.col("state"), F.lit(None).cast("double"))


_DATE = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:\s?(?:[A-Z]{2,5}|[+-]\d{2}:?\d{2}|Z))?"
TOOL_ROW = rf"(?i)^\s*([A-Za-z_:][\w:.-]*)\s+({_DATE})\s+(.*?)\s*\b(active|suppressed|unprocessed|firing|resolved|pending)\s*$"
TOOL_WIDE = rf"(?i)^(.*?)\s+({_DATE})\s+({_DATE})\s+(\S*)\s+(active|suppressed|unprocessed|firing|resolved|pending)\s*$"
TOOL_HEADER = r"^\s*(?:Alertname\s+Starts At\s+Summary\s+State|Labels\s+Annotations\s+Starts At\s+Ends At\s+Generator URL\s+State)\s*$"
ANNOTATIONS = "summary description message runbook_url runbook dashboard title".split()
LABEL = r"([A-Za-z_][\w]*)=\"((?:[^\"\\]|\\.)*)\""


@reader(_rows)
def tool_alerts(panes: DataFrame) -> DataFrame:
    """Of (incident_id, text): the simple and the extended table of the alert manager's command line tool."""
    rows = split_lines(panes, "incident_id", "text")
    line = F.col("line")
    w = Window.partitionBy("incident_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last(F.when(line.rlike(TOOL_HEADER), F.col("line_no")).when(F.trim(line) == "", F.lit(-1)), ignorenulls=True).over(w)
    rows = rows.withColumn("table", inside).filter((F.col("table") > 0) & (F.col("table") < F.col("line_no")))
    pairs = F.map_from_arrays(F.regexp_extract_all(F.regexp_extract(line, TOOL_WIDE, 1), F.lit(LABEL), F.lit(1)), F.regexp_extract_all(F.regexp_extract(line, TOOL_WIDE, 1), F.lit(LABEL), F.lit(2)))
    wide, simple = line.rlike(TOOL_WIDE) & line.contains('="'), line.rlike(TOOL_ROW)
    part = lambda i, j: F.when(wide, F.regexp_extract(line, TOOL_WIDE, j)).otherwise(F.regexp_extract(line, TOOL_ROW, i))
    is_note = lambda k: F.lower(k).isin(ANNOTATIONS)
    labels = F.when(wide, F.map_filter(pairs, lambda k, v: ~is_note(k))).otherwise(F.create_map(F.lit("alertname"), F.regexp_extract(line, TOOL_ROW, 1)))
    notes = F.when(wide, F.map_filter(pairs, lambda k, v: is_note(k))).otherwise(F.create_map(F.lit("summary"), F.regexp_extract(line, TOOL_ROW, 3)))
    stamp = lambda c: F.regexp_replace(c, r"\s(?:UTC|GMT)$", "Z")
    state = F.lower(part(4, 5))
    a = rows.filter(wide | simple).select("incident_id", F.col("line_no").cast("int").alias("source_line"), labels.alias("labels"), notes.alias("annotations"), stamp(part(2, 2)).alias("starts"), F.when(wide & (state == "resolved"), stamp(F.regexp_extract(line, TOOL_WIDE, 3))).alias("ends"), state.alias("state"))
    return _told(a.filter(F.col("labels")["alertname"].isNotNull()), F.when(F.col("state").isin("resolved", "pending"), F.col("state")).when(F.col("state") == "suppressed", "silenced").otherwise("firing"), F.lit(None).cast("double"))


SECTION = r"(?i)^\s*\*?(Labels|Annotations|Details|Alert details)\*?\s*:\s*$"
BULLET = r"^\s*(?:[-•*·]\s*)?\*?([A-Za-z_][\w.]*)\*?\s*(?:=|:)\s*(.+?)\s*$"


HEADS = [r"^\s*\[(?:FIRING|RESOLVED)(?::\d+)?\]\s+\S", r"\b(?:FIRING|RESOLVED|PENDING)\s+\w+\s+[A-Z]\w+"]


def bodied_lines(panes: DataFrame) -> DataFrame:
    """(incident_id, line_no, line, body): the lines of panes; one that begins an alert has the lines up to the next one as its body. A pane is cut in its own row."""
    numbered = F.transform(pane_lines(F.col("text")), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), (x.rlike(HEADS[0]) | x.rlike(HEADS[1])).alias("head")))
    p = panes.select("incident_id", computed(numbered).alias("all"))
    p = p.select("incident_id", "all", computed(F.transform(F.filter("all", lambda x: x["head"]), lambda x: x["line_no"])).alias("heads"))
    end = lambda i: F.coalesce(F.get("heads", i + 1), F.size("all") + 1)
    body = lambda at, i: F.transform(F.slice("all", at + 1, end(i) - at - 1), lambda x: x["line"])
    begun = F.transform("heads", lambda at, i: F.struct(at.alias("line_no"), F.get("all", at - 1)["line"].alias("line"), body(at, i).alias("body")))
    others = F.transform(F.filter("all", lambda x: ~x["head"]), lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), F.array().cast("array<string>").alias("body")))
    return p.select("incident_id", F.explode(F.concat(begun, others)).alias("x")).select("incident_id", "x.*")


def _lasts(entries: Column) -> Column:
    """Map of (key, value) entries; of a repeated key the last."""
    firsts = lambda back, keys: F.filter(back, lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    return bound(F.reverse(entries), lambda back: bound(F.transform(back, lambda x: x["key"]), lambda keys: F.map_from_entries(F.transform(firsts(back, keys), lambda x: F.struct(x["key"], x["value"])))))


def with_bodies(rows: DataFrame) -> DataFrame:
    """Text alerts (labels, annotations, body and others) with what the bullets under "Labels:", "Annotations:" and "Details:" of their bodies state in place of what the subject could only guess."""
    r = rows.withColumn("sections", computed(F.filter(F.transform("body", lambda x, i: F.when(x.rlike(SECTION), i + 1)), lambda i: i.isNotNull())))

    def bullets(at: Column, i: Column) -> Column:
        section = F.lower(F.regexp_extract(F.get("body", at - 1), SECTION, 1))
        under = F.slice("body", at + 1, F.coalesce(F.get("sections", i + 1), F.size("body") + 1) - at - 1)
        return bound(section, lambda section: F.transform(F.filter(under, lambda x: x.rlike(BULLET)), lambda x: stated(section, x)))

    def stated(section: Column, x: Column) -> Column:
        key, value = F.regexp_extract(x, BULLET, 1), F.regexp_replace(F.regexp_extract(x, BULLET, 2), "^[\"']|[\"']$", "")
        note = (section == "annotations") | ((section != "labels") & F.lower(key).isin(*ANNOTATIONS, "alert"))
        return F.struct(F.when(note, F.lower(key)).otherwise(key).alias("key"), value.alias("value"), note.alias("note"))

    r = r.withColumn("stated", computed(F.flatten(F.transform("sections", bullets))))
    of = lambda note: _lasts(F.filter("stated", lambda x: x["note"] == note))
    return r.withColumns({"labels": overlaid(_map("labels"), of(False)), "annotations": overlaid(_map("annotations"), of(True))}).drop("body", "sections", "stated")


def read_alerts(panes: DataFrame) -> DataFrame:
    """All alerts of panes."""
    docs = json_segments(panes).withColumn("doc", repaired_json("doc"))
    return _rows(json_alerts.told(docs).unionByName(text_alerts.told(panes)).unionByName(tool_alerts.told(panes)))
