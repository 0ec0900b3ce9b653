"""Log panes to signals: application lines, event, pod, node and autoscaler tables, command echoes and cluster markers.

A pane is read line by line without state in Python: what a line inherits from
earlier ones (cluster, namespace, table header, time) is carried by windows over
(incident_id, line_no) inside parts that a marker or an echoed command begins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.names import component_id, component_type, norm, pod_owner, replica_set_owner, target_in
from ..functions.text import bound, classify, computed, first_of, level_in, level_of, logfmt, redact, with_floor
from ..functions.times import MONTHS, age_ms, duration_ms, leading_stamp
from ..session import cut, spread
from .lines import reader, split_lines
from .traces import json_segments, line_of, repaired_json

#: What read_logs gives.
SIGNALS = "incident_id string, source string, source_line int, ts_ms bigint, age_ms bigint, kind string, severity string, component string, name string, namespace string, cluster string, text string, trace_id string, target string, pod string"

MARKERS = [r"^\s*#\s*cluster:\s*(\S+)", r"^\s*-{3}\s*cluster=(\S+?)\s*-{3}", r"^\s*\[context:\s*([^\]\s]+)\s*\]"]
ECHO = r"^\s*(?:[$#>]\s*)?(?:kubectl|k|oc|helm|stern|kubectx)\s+\S"
#: Header columns that tell a table.
HEADERS = {"events": r"LAST SEEN\s+TYPE\s+REASON\s+OBJECT\s+MESSAGE", "pods": r"NAME\s+READY\s+STATUS\s+RESTARTS\s+AGE", "nodes": r"NAME\s+STATUS\s+ROLES\s+AGE\s+VERSION", "hpa": r"NAME\s+REFERENCE\s+TARGETS\s+MINPODS\s+MAXPODS\s+REPLICAS\s+AGE"}
EVENT_ROW = r"^\s*(?:([a-z0-9-]+)\s+)?(\S+(?: \(x\d+ over \S+\))?)\s+(Normal|Warning)\s+(\S+)\s+([a-zA-Z.]+/\S+)\s+(.*)\z"
POD_ROW = r"^\s*(?:([a-z0-9-]+)\s+)?([a-z0-9][a-z0-9.-]*)\s+(\d+)/(\d+)\s+([A-Za-z:]+)\s+(\d+)(?: \((\S+) ago\))?\s+(\S+)"
NODE_ROW = r"^\s*(\S+)\s+((?:Not)?Ready\S*|Unknown\S*)\s+(\S+)\s+(\S+)\s+(v\S+)"
HPA_ROW = r"^\s*(?:([a-z0-9-]+)\s+)?(\S+)\s+([A-Za-z]+/\S+)\s+(.+?)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\S+)\s*\z"

# Kinds of pod statuses.
POD_KINDS = {
    "OOMKilled": "oom_killed", "CrashLoopBackOff": "crash_loop", "ImagePullBackOff": "image_pull", "ErrImagePull": "image_pull", "InvalidImageName": "image_pull",
    "CreateContainerConfigError": "config_error", "CreateContainerError": "config_error", "RunContainerError": "config_error", "Evicted": "evicted", "Error": "error_generic",
}

# Names under which structured logs state a field, in order.
FIELDS = {
    "ts": ["ts", "time", "timestamp", "@timestamp"],
    "level": ["level", "lvl", "severity", "loglevel"],
    "msg": ["msg", "message", "log"],
    "error": ["error", "err", "exception"],
    "service": ["service", "app", "component"],
    "pod": ["pod", "pod_name"],
    "namespace": ["namespace", "ns"],
    "cluster": ["cluster"],
    "trace": ["trace_id", "traceId", "traceID"],
    "status": ["status", "status_code", "code"],
    "latency": ["latency_ms", "duration_ms", "latency", "duration"],
    "upstream": ["upstream", "target", "peer"],
}


def structured(body: Column) -> Column:
    """Struct of FIELDS of a JSON or logfmt body; null fields otherwise."""
    fields = lambda value: F.struct(*[F.coalesce(*[value(k) for k in keys]).alias(name) for name, keys in FIELDS.items()])
    json = lambda b: fields(lambda k: F.get_json_object(b, f"$['{k}']"))
    return bound(body, lambda b: F.when(b.rlike(r"^\s*\{"), json(b)).otherwise(bound(logfmt(b), lambda pairs: fields(lambda k: pairs[k]))))


def contexts(panes: DataFrame) -> DataFrame:
    """Lines with cluster, namespace and table that hold for them, and whether the line is itself a marker, an echo or a header."""
    rows = spread(split_lines(panes, "incident_id", "text"), "incident_id")
    line = F.col("line")
    marker = first_of([(line.rlike(p), F.regexp_extract(line, p, 1)) for p in MARKERS])
    echo = line.rlike(ECHO)
    flag = lambda p: F.when(F.regexp_extract(line, p, 1) != "", F.regexp_extract(line, p, 1))
    header = first_of([(line.rlike(p), F.lit(k)) for k, p in HEADERS.items()])
    namespace = F.when(echo, flag(r"(?:^|\s)(?:-n|--namespace)[ =](\S+)"))
    cluster = F.coalesce(marker, F.when(echo, flag(r"(?:^|\s)(?:--context|--kube-context)[ =](\S+)")))
    rows = rows.withColumns({"is_echo": echo, "marker": marker, "header": F.coalesce(header, F.when(F.trim(line) == "", "none")), "said_ns": namespace, "said_cluster": cluster})
    order = Window.partitionBy("incident_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("part", F.sum((F.col("is_echo") | F.col("marker").isNotNull()).cast("int")).over(order))
    inside = Window.partitionBy("incident_id", "part").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    return rows.select("incident_id", "line_no", "line", (F.col("is_echo") | F.col("marker").isNotNull() | header.isNotNull()).alias("control"), last("said_cluster", order).alias("cluster"), last("said_ns", inside).alias("namespace"), last("header", inside).alias("table_kind"))


EXTRA = ["trace_id", "target", "pod"]


def _of(rows: DataFrame, kind: Column, level: Column, name: Column, ns: Column, text: Column, ts: Column, age: Column, ctype: Column | None = None, **more: Column) -> DataFrame:
    """What rows tell, for _signals. What is used more than once becomes a column first, which keeps the expressions small."""
    none = F.lit(None).cast("string")
    extra = {k: more.get(k, none) for k in EXTRA}
    told = {"_kind": kind, "_level": level, "_name": name, "_ns": F.coalesce(ns, F.col("namespace")), "_type": none if ctype is None else ctype, "_ts": ts.cast("long"), "_age": age.cast("long"), "_text": text} | {f"_{k}": c for k, c in extra.items()}
    return rows.select("incident_id", F.col("line_no").cast("int").alias("line_no"), "cluster", *[c.alias(k) for k, c in told.items()])


def _signals(r: DataFrame) -> DataFrame:
    """Signals of what rows tell."""
    r = r.withColumn("_type", F.coalesce("_type", component_type(F.col("_name"))["type"]))
    return r.select(
        "incident_id", F.lit("logs").alias("source"), F.col("line_no").alias("source_line"), F.col("_ts").alias("ts_ms"), F.col("_age").alias("age_ms"), F.col("_kind").alias("kind"), with_floor(F.col("_kind"), F.col("_level")).alias("severity"),
        component_id(F.col("_type"), F.col("cluster"), F.col("_ns"), F.col("_name")).alias("component"), F.col("_name").alias("name"), F.col("_ns").alias("namespace"), F.coalesce("cluster", F.lit("cluster-1")).alias("cluster"), F.substring(redact(F.col("_text")), 1, 400).alias("text"),
        *[F.col(f"_{k}").alias(k) for k in EXTRA],
    )


@reader(_signals)
def event_rows(rows: DataFrame) -> DataFrame:
    """Rows of an events table: the "over" age is the onset, the object names the workload."""
    pattern = EVENT_ROW
    line = F.col("line")
    part = lambda i: F.regexp_extract(line, pattern, i)
    e = rows.filter((F.col("table_kind") == "events") & ~F.col("control") & line.rlike(pattern))
    age = F.coalesce(age_ms(F.regexp_extract(part(2), r"over (\S+)\)", 1)), age_ms(part(2)))
    kind_of, name = F.lower(F.split(part(5), "/")[0]), F.split(part(5), "/")[1]
    owner = F.when(kind_of == "pod", pod_owner(name)["workload"]).when(kind_of == "replicaset", replica_set_owner(name)).otherwise(norm(name))
    kind = classify(F.concat_ws(" ", part(4), part(6)))
    level = F.when(part(3) == "Warning", "warn").otherwise("info")
    kind = F.coalesce(kind, F.when(part(3) == "Warning", "error_generic"))
    out = _of(e.withColumn("k", computed(kind)), F.col("k"), level, owner, F.when(part(1) != "", part(1)), F.concat_ws(" ", part(4), part(6)), F.lit(None).cast("long"), age, F.when(kind_of == "node", "node"), pod=F.when(kind_of == "pod", name))
    return out


@reader(_signals)
def pod_rows(rows: DataFrame) -> DataFrame:
    """Rows of a pods table: the status tells the kind; running but unready is a failed probe; restarts are restarts."""
    line = F.col("line")
    part = lambda i: F.regexp_extract(line, POD_ROW, i)
    p = rows.filter((F.col("table_kind") == "pods") & ~F.col("control") & line.rlike(POD_ROW))
    status = F.regexp_replace(part(5), "^Init:", "")
    known = first_of([(status == k, F.lit(v)) for k, v in POD_KINDS.items()])
    unready = (status == "Running") & (part(3) != part(4))
    kind = F.coalesce(known, F.when(unready, "probe_failed"), F.when(part(6).try_cast("int") > 0, "restart"))
    level = F.when(known.isNotNull(), "error").otherwise("warn")
    age = F.coalesce(age_ms(part(7)), F.when(kind != "restart", age_ms(part(8))))
    return _of(p.withColumn("k", computed(kind)), F.col("k"), level, pod_owner(part(2))["workload"], F.when(part(1) != "", part(1)), line, F.lit(None).cast("long"), age, pod=part(2))


@reader(_signals)
def node_rows(rows: DataFrame) -> DataFrame:
    line = F.col("line")
    n = rows.filter((F.col("table_kind") == "nodes") & ~F.col("control") & line.rlike(NODE_ROW) & F.regexp_extract(line, NODE_ROW, 2).rlike("NotReady|Unknown"))
    return _of(n, F.lit("node_not_ready"), F.lit("error"), F.regexp_extract(line, NODE_ROW, 1), F.lit(None).cast("string"), line, F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit("node"))


@reader(_signals)
def hpa_rows(rows: DataFrame) -> DataFrame:
    """Autoscalers at their maximum, as a signal of the workload that they scale."""
    line = F.col("line")
    part = lambda i: F.regexp_extract(line, HPA_ROW, i)
    h = rows.filter((F.col("table_kind") == "hpa") & ~F.col("control") & line.rlike(HPA_ROW) & (part(7).try_cast("int") >= part(6).try_cast("int")))
    return _of(h, F.lit("hpa_maxed"), F.lit("warn"), F.split(part(3), "/")[1], F.when(part(1) != "", part(1)), line, F.lit(None).cast("long"), F.lit(None).cast("long"))


DESCRIBE_KEY = r"^(\s*)(Name|Namespace|State|Last State|Reason|Exit Code|Finished|Started|Restart Count):\s+(\S.*?)\s*\z"
CONTAINER = r"^  ([a-z0-9][a-z0-9-]*):\s*\z"
RFC_1123 = r"^\w{3}, (\d{1,2}) (\w{3}) (\d{4}) (\d{2}:\d{2}:\d{2}) ([+-]\d{4})"


@reader(_signals)
def describe_rows(rows: DataFrame) -> DataFrame:
    """Pod descriptions: one row per container and state that tells of a failure.

    A block begins at "Name:" without indentation; its container and state are
    carried along the lines, and the keys of a state meet in one aggregate. A
    kill signal with reason Error counts as out of memory; the finishing time
    places the signal.
    """
    line = F.col("line")
    key, value = F.regexp_extract(line, DESCRIBE_KEY, 2), F.regexp_extract(line, DESCRIBE_KEY, 3)
    top = line.rlike(r"^Name:\s+\S")
    order = Window.partitionBy("incident_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # Other lines change nothing that is carried.
    told = F.col("control") | line.rlike(DESCRIBE_KEY) | line.rlike(CONTAINER) | line.rlike(r"^Name(?:space)?:")
    r = rows.filter(told).withColumn("block", F.sum(top.cast("int")).over(order)).filter("block > 0")
    inside = Window.partitionBy("incident_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(inside)
    r = r.withColumns({"pod0": last(F.when(top, value)), "ns0": last(F.when(line.rlike(r"^Namespace:"), value)), "box": last(F.when(line.rlike(CONTAINER), F.regexp_extract(line, CONTAINER, 1))), "state": last(F.when(key.isin("State", "Last State"), key))})
    keyed = lambda k: F.max(F.when(key == k, value))
    g = r.filter("box is not null and state is not null").groupBy("incident_id", "block", "pod0", "box", "state").agg(
        keyed("Reason").alias("reason"), keyed("Exit Code").alias("code"), F.coalesce(keyed("Finished"), keyed("Started")).alias("at"), F.min("line_no").alias("line_no"), F.max("ns0").alias("ns0"), F.max("cluster").alias("cluster"), F.max("namespace").alias("namespace")
    )
    killed = (F.col("code") == "137") & F.coalesce(F.col("reason") == "Error", F.lit(True))
    kind = F.when(killed, "oom_killed").otherwise(first_of([(F.col("reason") == k, F.lit(v)) for k, v in POD_KINDS.items()]))
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02}")])
    part = lambda i: F.regexp_extract("at", RFC_1123, i)
    iso = F.concat(part(3), F.lit("-"), F.try_element_at(months, part(2)), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("T"), part(4), part(5), F.lit(" "))
    g = g.withColumns({"k": kind, "ts": leading_stamp(iso)["ts_ms"]}).filter("k is not null")
    text = F.concat_ws(" ", "state", "reason", F.lit("exit code"), "code")
    return _of(g, F.col("k"), F.lit("error"), pod_owner(F.col("pod0"))["workload"], F.col("ns0"), text, F.col("ts"), F.lit(None).cast("long"), pod=F.col("pod0"))


DESCRIBED_EVENT = r"^\s+(Normal|Warning)\s+(\S+)\s+(\S+(?: \(x\d+ over \S+\))?)\s+(\S+)\s+(.*)\z"


@reader(_signals)
def described_events(rows: DataFrame) -> DataFrame:
    """The events under a pod description: type, reason, age, origin and message; the "over" age is the onset."""
    line = F.col("line")
    part = lambda i: F.regexp_extract(line, DESCRIBED_EVENT, i)
    top = line.rlike(r"^Name:\s+\S")
    order = Window.partitionBy("incident_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.filter(line.rlike(r"^(?:Name|Namespace|Events):") | line.rlike(DESCRIBED_EVENT)).withColumn("block", F.sum(top.cast("int")).over(order)).filter("block > 0")
    inside = Window.partitionBy("incident_id", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(inside)
    r = r.withColumns({"pod0": last(F.when(top, F.regexp_extract(line, r"^Name:\s+(\S+)", 1))), "ns0": last(F.when(line.rlike(r"^Namespace:"), F.regexp_extract(line, r"^Namespace:\s+(\S+)", 1))), "under": last(F.when(line.rlike(r"^Events:"), F.lit(True)))})
    e = r.filter(F.coalesce("under", F.lit(False)) & line.rlike(DESCRIBED_EVENT))
    age = F.coalesce(age_ms(F.regexp_extract(part(3), r"over (\S+)\)", 1)), age_ms(part(3)))
    warning = part(1) == "Warning"
    kind = F.coalesce(classify(F.concat(part(2), F.lit(": "), part(5))), F.when(warning, "error_generic"))
    return _of(e.withColumn("k", computed(kind)), F.col("k"), F.when(warning, "warn").otherwise("info"), pod_owner(F.col("pod0"))["workload"], F.col("ns0"), F.concat(part(2), F.lit(": "), part(5)), F.lit(None).cast("long"), age, pod=F.col("pod0"))


_OBJECT = "struct<kind:string,name:string,namespace:string>"
_EVENT = f"struct<kind:string,involvedObject:{_OBJECT},regarding:{_OBJECT},reason:string,message:string,note:string,type:string,count:bigint,firstTimestamp:string,lastTimestamp:string,eventTime:string,series:struct<count:bigint,lastObservedTime:string>>"
_EVENTS = f"struct<kind:string,items:array<{_EVENT}>>"


def documents(panes: DataFrame) -> DataFrame:
    return json_segments(panes).withColumn("doc", repaired_json("doc"))


def event_documents(panes: DataFrame) -> DataFrame:
    """Events as JSON: a list, an array or one event, of either API version; the first time is the onset."""
    return _events_in(documents(panes))


@reader(_signals)
def _events_in(docs: DataFrame) -> DataFrame:
    many, one = F.from_json("doc", _EVENTS)["items"], F.from_json("doc", _EVENT)
    array = F.from_json("doc", f"array<{_EVENT}>")
    listed = F.when(F.col("doc").rlike(r"^\s*\["), array).otherwise(F.coalesce(many, F.array(one)))
    e = docs.select("incident_id", "first_line", "doc", F.explode(listed).alias("e"))
    e = e.withColumn("o", F.coalesce("e.involvedObject", "e.regarding")).filter(F.col("o.name").isNotNull() & F.col("e.reason").isNotNull())
    said = F.trim(F.coalesce("e.message", "e.note", F.lit("")))
    warning = F.coalesce(F.col("e.type"), F.lit("Normal")) == "Warning"
    text = F.concat("e.reason", F.lit(": "), said)
    kind = F.coalesce(classify(text), F.when(warning, "error_generic"))
    at = leading_stamp(F.concat(F.coalesce("e.firstTimestamp", "e.eventTime", "e.lastTimestamp", "e.series.lastObservedTime"), F.lit(" ")))["ts_ms"]
    what = F.lower(F.coalesce("o.kind", F.lit("pod")))
    owner = F.when(what == "pod", pod_owner(F.col("o.name"))["workload"]).when(what == "replicaset", replica_set_owner(F.col("o.name"))).otherwise(norm(F.col("o.name")))
    none = F.lit(None).cast("string")
    rows = e.withColumn("k", computed(kind)).withColumns({"said": text, "at": at, "line_no": line_of(F.col("doc"), F.col("first_line"), F.coalesce("e.message", "e.note")), "cluster": none, "namespace": none})
    return _of(rows, F.col("k"), F.when(warning, "warn").otherwise("info"), owner, F.col("o.namespace"), F.col("said"), F.col("at"), F.lit(None).cast("long"), F.when(what == "node", "node"), pod=F.when(what == "pod", F.col("o.name")))


#: The stream and flag that a container runtime puts behind the stamp.
CRI = r"^(\d{4}-\d{2}-\d{2}T\S+ )(?:stdout|stderr) [FP] "
KLOG_LINE = r"^([IWEF])\d{4} \d{2}:\d{2}:\d{2}\.\d+\s+\d+ [^\]]+\]\s*"
POD_PREFIX = r"^\[pod/([^/\]]+)/([^\]]+)\]\s*"
STERN = r"^(?:([a-z0-9-]+)\s+)?([a-z0-9][a-z0-9-]*-[a-z0-9]{5}|[a-z0-9][a-z0-9-]*-\d{1,3})\s+([a-z0-9-]+)\s+(?=\[?\d{4}-|\{|[A-Z]{4,5}\b)"


@reader(_signals)
def application_rows(rows: DataFrame) -> DataFrame:
    """Application lines: prefixes name the pod, structured bodies the rest; unstamped lines take the time of the one before."""
    lines = spread(rows.filter(~F.col("control") & (F.coalesce("table_kind", F.lit("none")) == "none") & (F.trim("line") != "") & ~F.col("line").rlike(DESCRIBE_KEY)), "incident_id")
    line = F.col("line")
    prefixed, stern = line.rlike(POD_PREFIX), line.rlike(STERN)
    some = lambda c: F.when(c != "", c)
    pod = F.when(prefixed, F.regexp_extract(line, POD_PREFIX, 1)).when(stern, F.regexp_extract(line, STERN, 2))
    ns = F.when(stern & ~prefixed, some(F.regexp_extract(line, STERN, 1)))
    body = F.when(prefixed, F.regexp_replace(line, POD_PREFIX, "")).when(stern, F.regexp_replace(line, STERN, "")).otherwise(line)
    body = F.regexp_replace(body, CRI, "$1")
    r = lines.withColumns({"pod0": pod, "ns0": ns, "body": body}).withColumn("stamp", leading_stamp(F.col("body"))).withColumn("f", structured(F.col("stamp.rest")))
    said = leading_stamp(F.concat("f.ts", F.lit(" ")))["ts_ms"]
    r = r.withColumn("own_ts", F.coalesce("stamp.ts_ms", said))
    order = Window.partitionBy("incident_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("ts", F.last("own_ts", ignorenulls=True).over(order))
    text = F.coalesce(F.concat_ws(" ", "f.msg", "f.error"), F.lit(""))
    text = F.when(text != "", text).otherwise(F.col("stamp.rest"))
    bare = F.concat_ws(" ", text, F.when(F.col("f.status").isNotNull(), F.concat(F.lit("status="), "f.status")))
    r = r.withColumns({"said": bare, "k0": classify(bare), "level": F.coalesce(level_of(F.col("f.level")), first_of([(F.regexp_extract("body", KLOG_LINE, 1) == k, F.lit(v)) for k, v in (("I", "info"), ("W", "warn"), ("E", "error"), ("F", "critical"))]), level_in(F.col("stamp.rest")))})
    kind = F.coalesce(F.col("k0"), F.when(F.col("level").isin("error", "critical"), "error_generic"))
    r = r.withColumn("k", computed(kind))
    # Continuations of a stack repeat the kind of the record above: one signal is enough.
    above = Window.partitionBy("incident_id").orderBy("line_no")
    r = r.withColumn("k_above", F.lag("k").over(above))
    r = r.filter(~F.coalesce(F.col("line").rlike(r"^\s+(?:at |\.\.\.|File )") & (F.col("k_above") == F.col("k")), F.lit(False)))
    podname = F.coalesce("f.pod", "pod0")
    named = F.when(F.col("f.service").isNotNull(), norm(F.col("f.service"))).when(podname.isNotNull(), pod_owner(podname)["workload"]).otherwise(F.lit("unknown"))
    target = bound(F.coalesce(target_in(F.col("said"))["name"], norm(F.col("f.upstream"))), lambda x: F.when(x != "", x))
    r = r.withColumn("cluster", F.coalesce("f.cluster", "cluster"))
    return _of(r, F.col("k"), F.col("level"), named, F.coalesce("f.namespace", "ns0"), F.col("said"), F.col("ts"), F.lit(None).cast("long"), trace_id=F.col("f.trace"), target=target, pod=podname)


def request_counts(rows: DataFrame) -> DataFrame:
    """(incident_id, requests, failed): lines that state a status, and those with 5xx."""
    status = structured(F.col("line"))["status"]
    s = rows.filter(~F.col("control")).select("incident_id", F.when(status.rlike(r"^\d{3}\z"), status.try_cast("int")).alias("status")).filter("status is not null")
    return s.groupBy("incident_id").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("failed"))


def read_logs(panes: DataFrame) -> DataFrame:
    """All signals of log panes; ages are left as ages until the clock is known.

    The readers of tables, descriptions and documents take part where a line calls for them.
    """
    rows = cut(contexts(panes))  # seven readers share it
    docs = cut(documents(panes))
    there = rows.agg(F.collect_set("table_kind").alias("tables"), F.coalesce(F.bool_or(F.col("line").startswith("Name:")), F.lit(False)).alias("described")).first()
    tables = {"events": event_rows, "pods": pod_rows, "nodes": node_rows, "hpa": hpa_rows}
    parts = [application_rows.told(rows), *[f.told(rows) for k, f in tables.items() if k in there.tables]]
    if there.described:
        parts += [describe_rows.told(rows), described_events.told(rows)]
    if docs.count():
        parts.append(_events_in.told(docs))
    return _signals(spread(reduce(lambda a, b: a.unionByName(b), parts), "incident_id", "line_no"))


def latency_ms(body: Column) -> Column:
    return duration_ms(structured(body)["latency"])


def dependency_kinds() -> list[str]:
    # Kinds whose text names the dependency that failed.
    return [k for k in V.KINDS if k in ("conn_refused", "timeout", "dns_failure", "tls_error", "http_5xx", "conn_exhaustion", "db_error", "http_429")]
