"""Span documents to one relation: OTLP, Jaeger and Zipkin JSON, and one-span-per-line text.

Readers take panes (incident_id, text). A pane may mix documents and lines:
json_segments cuts the documents out, text_spans reads what is left.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache, reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text, computed, has_key, pairs_in, unquoted, written_in
from ..functions.times import duration_ms, leading_stamp
from ..session import cut
from .lines import pane_lines, split_lines

COLUMNS = ["incident_id", "trace_id", "span_id", "parent_id", "service", "op", "kind", "start_ms", "dur_ms", "error", "http_status", "db", "peer", "cluster", "namespace", "pod", "source_line", "format"]

#: What read_spans gives.
SPANS = "incident_id string, trace_id string, span_id string, parent_id string, service string, op string, kind string, start_ms double, dur_ms double, error boolean, http_status int, db string, peer string, cluster string, namespace string, pod string, source_line int, format string"

_VALUE = "struct<stringValue:string,intValue:string,boolValue:boolean,doubleValue:double>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_OTLP_SPAN = f"struct<traceId:string,spanId:string,`spanId@line`:int,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:string,message:string>,attributes:{_ATTRIBUTES}>"
_OTLP_RESOURCE = f"array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:array<{_OTLP_SPAN}>>>,instrumentationLibrarySpans:array<struct<spans:array<{_OTLP_SPAN}>>>>>"
OTLP = f"struct<resourceSpans:{_OTLP_RESOURCE},resource_spans:{_OTLP_RESOURCE},batches:{_OTLP_RESOURCE}>"
_TAGS = "array<struct<key:string,value:string>>"
JAEGER = f"struct<data:array<struct<traceID:string,spans:array<struct<traceID:string,spanID:string,`spanID@line`:int,operationName:string,references:array<struct<refType:string,spanID:string>>,startTime:double,duration:double,tags:{_TAGS},processID:string>>,processes:map<string,struct<serviceName:string,tags:{_TAGS}>>>>>"
ZIPKIN = "array<struct<traceId:string,id:string,`id@line`:int,parentId:string,name:string,kind:string,timestamp:double,duration:double,localEndpoint:struct<serviceName:string>,remoteEndpoint:struct<serviceName:string,ipv4:string>,tags:map<string,string>>>"


# Fixed value: a line that can begin a document; "[FIRING:2]" and "[pod/x" can't.
OPENS = re.compile(r"""\s*(?:\{\s*(?:["}]|$)|\[\s*(?:[\[{"\d\]-]|true|false|null|$))""")
#: What is no bracket: strings, which end with their line at the latest, and all else.
_NO_BRACKET = re.compile(r'"(?:[^"\\]|\\.)*"?|[^"{}\[\]]+')
_SEGMENTS = T.ArrayType(T.StructType([T.StructField("first_line", T.IntegerType()), T.StructField("doc", T.StringType())]))


def _heights(brackets: str) -> tuple[int, float]:
    heights = list(accumulate(1 if c in "{[" else -1 for c in brackets))
    return (heights[-1], min(heights)) if heights else (0, math.inf)


_short_heights = lru_cache(4096)(_heights)  # lines of a document are much alike


def _levels(line: str) -> tuple[int, float]:
    """How far a line's brackets go up or down, and the lowest that they come."""
    brackets = _NO_BRACKET.sub("", line)
    return _short_heights(brackets) if len(brackets) <= 64 else _heights(brackets)


#: OPENS for any line of a text, in Java's words; it may hold for a text without such a line, but not the other way round.
_BLANK = r"[^\p{L}\p{N}\p{P}\p{S}]*"
MAY_OPEN = rf"(?m)^{_BLANK}(?:\{{{_BLANK}(?:[\"}}]|$)|\[{_BLANK}(?:[\[{{\"\p{{Nd}}\]-]|true|false|null|$))"


def segments(lines):
    """The documents in the lines of a pane. A document ends with the line on which its brackets come back to the ground, or with the pane."""
    out, taken = [], 0
    for first in (i for i, line in enumerate(lines or []) if OPENS.match(line)):
        if first >= taken:  # else it is inside the document before
            levels = [_levels(lines[first])]
            ground = 0
            for line in map(lines.__getitem__, range(first + 1, len(lines))):
                if ground + levels[-1][1] <= 0:
                    break
                ground += levels[-1][0]
                levels.append(_levels(line))
            taken = first + len(levels)
            out.append((first + 1, "\n".join(lines[first:taken])))
    return out


_segments = F.udf(segments, _SEGMENTS, useArrow=False)  # a batch is 100 panes, whereas an Arrow batch is 10,000 of any size


def json_segments(panes: DataFrame) -> DataFrame:
    """(incident_id, first_line, doc): the JSON documents in panes; text outside a document doesn't count for it."""
    found = panes.filter(clean_text(F.col("text")).rlike(MAY_OPEN)).select("incident_id", F.explode(_segments(pane_lines(F.col("text")))).alias("d"))
    return found.select("incident_id", "d.first_line", "d.doc")


_DECLARES = re.compile(r'"(spanId|spanID|id)"\s*:\s*"([^"]+)"')


@F.udf(_SEGMENTS, useArrow=False)
def _span_documents(lines):
    """The readable documents of a pane. Behind each id stands the first line of the pane that declares it, under the id's key and "@line"."""
    found = [(first, doc) for first, text in segments(lines) if (doc := repaired(text)) is not None]
    at: dict[str, int] = {}
    for first, doc in found:
        for i, line in enumerate(doc.split("\n")):
            for _, span_id in _DECLARES.findall(line):
                at.setdefault(span_id, first + i)
    marked = lambda m: m[0] if "\\" in m[2] or m[2] not in at else f'{m[0]},"{m[1]}@line":{at[m[2]]}'
    return [(first, _DECLARES.sub(marked, doc)) for first, doc in found]


def span_documents(panes: DataFrame) -> DataFrame:
    """json_segments for the readers of spans: cut-off documents are closed, unreadable ones left out, and ids bear their lines, so that spans need no join with the lines of their pane."""
    found = panes.filter(clean_text(F.col("text")).rlike(MAY_OPEN)).select("incident_id", F.explode(_span_documents(pane_lines(F.col("text")))).alias("d"))
    return found.select("incident_id", "d.first_line", "d.doc")


def line_of(doc: Column, first_line: Column, value: Column) -> Column:
    """The pane's line on which a document first holds a quoted value; the document's first line if it doesn't."""
    before = F.call_function("substring_index", doc, F.concat(F.lit('"'), value, F.lit('"')), F.lit(1))
    lines = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.when(doc.contains(F.concat(F.lit('"'), value, F.lit('"'))), first_line + lines).otherwise(first_line).cast("int")


def repaired(text):
    """A document that is cut off, closed after its last complete value; null for what is whole and malformed, or can't be read."""
    import json

    try:
        json.loads(text)
        return text
    except (TypeError, ValueError):
        if not isinstance(text, str):
            return None
    stack, quoted, escaped, marks = [], False, False, []
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and (not stack or stack.pop() != c):
            return None  # malformed, not cut off
        if not quoted and c in "{[}],":
            marks.append((i + (c != ","), "".join(reversed(stack))))
    if not stack:
        return None
    for at, tail in reversed(marks):
        try:
            json.loads(text[:at] + tail)
            return text[:at] + tail
        except ValueError:
            continue
    return None


repaired_json = F.udf(repaired, T.StringType(), useArrow=False)


def _attributes(pairs: Column) -> Column:
    """Map of keys to text values; of a repeated key the last."""
    text = F.transform(pairs, lambda a: F.struct(a["key"].alias("k"), F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["boolValue"].cast("string"), a["value"]["doubleValue"].cast("string")).alias("v")))
    return _as_map(text)


def _as_map(pairs: Column) -> Column:
    kind = "array<struct<k:string,v:string>>"
    some = F.filter(F.coalesce(pairs.cast(kind), F.array().cast(kind)), lambda p: p["k"].isNotNull())
    lasts = F.filter(some, lambda p, i: ~F.exists(F.slice(some, i + 2, F.size(some)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(lasts)


def _tags(pairs: Column) -> Column:
    return _as_map(F.transform(pairs, lambda t: F.struct(t["key"].alias("k"), t["value"].alias("v"))))


def _first(m: Column, *keys: str) -> Column:
    return F.coalesce(*[m[k] for k in keys])


def _normalised(df: DataFrame, form: str) -> DataFrame:
    """Spans with attribute map a and resource map r to COLUMNS."""
    a, r = F.col("a"), F.col("r")
    status = _first(a, "http.status_code", "http.response.status_code", "status_code").try_cast("int")
    code = F.lower(F.coalesce(F.col("status_code"), F.lit("")))
    bad = code.isin("2", "error", "status_code_error") | (F.lower(F.coalesce(a["error"], F.lit(""))) == "true") | F.coalesce(status >= 500, F.lit(False))
    kind = F.regexp_replace(F.lower(F.coalesce("kind", a["span.kind"], F.lit(""))), "span_kind_", "")
    named = F.create_map(*[F.lit(x) for kv in {"1": "internal", "2": "server", "3": "client", "4": "producer", "5": "consumer"}.items() for x in kv])
    return df.select(
        "incident_id",
        "trace_id",
        "span_id",
        F.when(~F.coalesce("parent_id", F.lit("")).isin("", "-", "0", "none", "0000000000000000"), F.col("parent_id")).alias("parent_id"),
        F.coalesce(F.col("service"), r["service.name"], F.lit("unknown")).alias("service"),
        "op",
        F.coalesce(F.try_element_at(named, kind), F.when(kind != "", kind)).alias("kind"),
        "start_ms",
        F.greatest(F.col("dur_ms"), F.lit(0.0)).alias("dur_ms"),
        bad.alias("error"),
        status.alias("http_status"),
        _first(a, "db.system", "db.type", "db.system.name").alias("db"),
        F.coalesce(F.col("peer"), _first(a, "peer.service", "server.address", "net.peer.name", "db.name")).alias("peer"),
        F.coalesce(_first(r, "k8s.cluster.name", "cluster"), _first(a, "k8s.cluster.name", "cluster")).alias("cluster"),
        F.coalesce(_first(r, "k8s.namespace.name", "service.namespace"), _first(a, "k8s.namespace.name", "namespace")).alias("namespace"),
        F.coalesce(r["k8s.pod.name"], a["k8s.pod.name"]).alias("pod"),
        "source_line",
        F.lit(form).alias("format"),
    )


def otlp_spans(docs: DataFrame) -> DataFrame:
    """Of (incident_id, doc): resource, scope and span levels exploded; nanoseconds to milliseconds with their fraction."""
    held = ["incident_id", "first_line"]
    root = docs.select(*held, F.from_json("doc", OTLP).alias("o"))
    res = root.select(*held, F.explode(F.coalesce("o.resourceSpans", "o.resource_spans", "o.batches")).alias("res"))
    scopes = res.select(*held, _attributes(F.col("res.resource.attributes")).alias("r"), F.explode(F.coalesce("res.scopeSpans", "res.instrumentationLibrarySpans")).alias("scope"))
    s = scopes.select(*held, "r", F.explode("scope.spans").alias("s"))
    start, end = F.col("s.startTimeUnixNano").try_cast("decimal(20,0)"), F.col("s.endTimeUnixNano").try_cast("decimal(20,0)")
    none = F.lit(None).cast("string")
    rows = s.select("incident_id", F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.col("s.parentSpanId").alias("parent_id"), none.alias("service"), F.col("s.name").alias("op"), F.col("s.kind").alias("kind"),
                    (start / 1000000).cast("double").alias("start_ms"), ((end - start) / 1000000).cast("double").alias("dur_ms"), F.col("s.status.code").alias("status_code"), none.alias("peer"), _attributes(F.col("s.attributes")).alias("a"), "r", F.coalesce("s.`spanId@line`", "first_line").alias("source_line"))
    return _normalised(rows, "otlp")


def jaeger_spans(docs: DataFrame) -> DataFrame:
    """Of (incident_id, doc): services from the process table; the CHILD_OF reference is the parent, else the first; microseconds."""
    t = docs.select("incident_id", "first_line", F.explode(F.from_json("doc", JAEGER)["data"]).alias("t"))
    s = t.select("incident_id", "first_line", "t.processes", "t.traceID", F.explode("t.spans").alias("s"))
    process = F.col("processes")[F.col("s.processID")]
    refs = F.col("s.references")
    parent = F.coalesce(F.get(F.filter(refs, lambda x: x["refType"] == "CHILD_OF"), F.lit(0))["spanID"], F.get(refs, F.lit(0))["spanID"])
    a = _tags(F.col("s.tags"))
    rows = s.select("incident_id", F.coalesce("s.traceID", "traceID").alias("trace_id"), F.col("s.spanID").alias("span_id"), parent.alias("parent_id"), process["serviceName"].alias("service"), F.col("s.operationName").alias("op"), F.lit(None).cast("string").alias("kind"),
                    (F.col("s.startTime") / 1000).alias("start_ms"), (F.col("s.duration") / 1000).alias("dur_ms"), a["otel.status_code"].alias("status_code"), F.lit(None).cast("string").alias("peer"), a.alias("a"), _tags(process["tags"]).alias("r"), F.coalesce("s.`spanID@line`", "first_line").alias("source_line"))
    return _normalised(rows, "jaeger")


def zipkin_spans(docs: DataFrame) -> DataFrame:
    """Of (incident_id, doc): version 2 arrays with local and remote endpoints; microseconds."""
    s = docs.filter(F.col("doc").rlike(r"^\s*\[")).select("incident_id", "first_line", F.explode(F.from_json("doc", ZIPKIN)).alias("s")).filter("s.id is not null")
    empty = F.create_map().cast("map<string,string>")
    a = F.coalesce(F.col("s.tags"), empty)
    failed = F.when(F.coalesce(a["error"], F.lit("false")) != "false", "error")
    rows = s.select("incident_id", F.col("s.traceId").alias("trace_id"), F.col("s.id").alias("span_id"), F.col("s.parentId").alias("parent_id"), F.col("s.localEndpoint.serviceName").alias("service"), F.col("s.name").alias("op"), F.col("s.kind").alias("kind"),
                    (F.col("s.timestamp") / 1000).alias("start_ms"), (F.col("s.duration") / 1000).alias("dur_ms"), failed.alias("status_code"), F.coalesce("s.remoteEndpoint.serviceName", "s.remoteEndpoint.ipv4").alias("peer"), a.alias("a"), empty.alias("r"), F.coalesce("s.`id@line`", "first_line").alias("source_line"))
    return _normalised(rows, "zipkin")


#: Keys that a line of a span may state.
PAIRS = "trace span parent service op kind dur status code db error cluster ns namespace pod peer".split()


def text_spans(panes: DataFrame) -> DataFrame:
    """Of (incident_id, text): lines with trace, span and service pairs."""
    whole = lambda p: reduce(lambda a, k: a & has_key(p, k), ["span", "service"], has_key(p, "trace"))
    m = split_lines(panes, "incident_id", "text").select("incident_id", F.col("line_no").alias("source_line"), "line", computed(pairs_in(F.col("line")), whole).alias("m"))
    m = m.select("incident_id", "source_line", leading_stamp(F.col("line"))["ts_ms"].alias("ts_ms"), *[written_in(F.col("m"), k).alias(f"_{k}") for k in PAIRS])
    v = {k: unquoted(F.col(f"_{k}")) for k in PAIRS}
    status = F.when(F.lower(F.coalesce(v["status"], F.lit(""))).isin("error", "err", "failed", "2"), "error")
    a = F.create_map(F.lit("http.status_code"), v["code"], F.lit("db.system"), v["db"], F.lit("error"), v["error"])
    r = F.create_map(F.lit("cluster"), v["cluster"], F.lit("k8s.namespace.name"), F.coalesce(v["ns"], v["namespace"]), F.lit("k8s.pod.name"), v["pod"])
    rows = m.select("incident_id", v["trace"].alias("trace_id"), v["span"].alias("span_id"), v["parent"].alias("parent_id"), v["service"].alias("service"), v["op"].alias("op"), v["kind"].alias("kind"),
                    F.col("ts_ms").cast("double").alias("start_ms"), duration_ms(v["dur"]).alias("dur_ms"), status.alias("status_code"), v["peer"].alias("peer"), a.alias("a"), r.alias("r"), "source_line")
    return _normalised(rows, "text")


def read_spans(panes: DataFrame) -> DataFrame:
    """All spans of panes, whatever their formats; a document that fits none gives no rows."""
    out = text_spans(panes).withColumn("source_line", F.col("source_line").cast("int"))
    docs = cut(span_documents(panes))  # three readers share it
    if docs.count():
        out = otlp_spans(docs).unionByName(jaeger_spans(docs)).unionByName(zipkin_spans(docs)).unionByName(out)
    return out.filter("trace_id is not null and span_id is not null")
