"""What the fourth round changed: span documents without a join, pairs without maps, lines cut once."""

import json

from pyspark.sql import functions as F

from faultline.functions import names, text
from faultline.sources import lines, traces

PANES = "incident_id string, text string"


def test_span_lines_need_no_shuffle(spark):
    zipkin = json.dumps([{"traceId": "t", "id": x, "localEndpoint": {"serviceName": "s"}, "tags": {"id": "tagged"}} for x in ("a", "b", "a")], indent=1)
    odd = '[{"traceId": "t", "id":\n"c", "tags": {}}, {"traceId": "t", "id": "q\\"r"}, {"traceId": "t", "id": "cut"}, {"tra'
    pane = f"head\n{zipkin}\nnoise\n{odd}"
    docs = traces.span_documents(spark.createDataFrame([("i", pane), ("j", "no document"), ("k", None)], PANES))
    spans = traces.zipkin_spans(docs)
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.span_id, r.source_line) for r in spans.collect())
    at = {x: 1 + next(i for i, line in enumerate(pane.split("\n")) if f'"id": "{x}"' in line) for x in ("a", "b")}
    begin = 1 + pane.split("\n").index('[{"traceId": "t", "id":')
    # An id that is written with escapes, or apart from its key, takes its document's first line.
    assert got == sorted([("a", at["a"]), ("a", at["a"]), ("b", at["b"]), ("c", begin), ('q"r', begin), ("cut", begin + 1)])


def test_pairs_equal_the_map(spark):
    rows = ['trace=1 span=2 trace=3 x="a \\"b\\" c" empty= dur=5ms quoted=""', "no pairs", "", 'k="open', "a.b/c-d=1 @t=2 µ=3 ünï=4 d=ä=ö", 'x="1 y=2" y=3', None]
    df = spark.createDataFrame([(r,) for r in rows], "line string").withColumns({"m": text.logfmt(F.col("line")), "p": text.pairs_in(F.col("line"))})
    keys = ["trace", "span", "x", "empty", "dur", "quoted", "k", "a.b/c-d", "@t", "d", "y", "race", "none"]
    for r in df.select("line", *[F.struct(F.col("m")[k].alias("a"), text.unquoted(text.written_in(F.col("p"), k)).alias("b")) for k in keys]).collect():
        assert all(x.a == x.b for x in r[1:]), r


def test_panes_are_cleaned_and_cut_as_before(spark):
    rows = ["﻿a﻿\n\x1b[31mred\x1b[0m\r\nb c\rd\n", "", "\n", "\r\n", "a\n\n", "\x1b[", None, "x"]
    old = F.translate(F.regexp_replace(F.regexp_replace("t", "^\\x{FEFF}", ""), "\\x1b\\[[0-9;?]*[ -/]*[@-~]", ""), " ", " ")
    parts = F.split(old, "\r\n|\r|\n")
    before = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert all(r.a == r.b for r in df.select(before.alias("a"), lines.pane_lines(F.col("t")).alias("b")).collect())
    plan = df.select(lines.pane_lines(F.col("t")).alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and plan.count("replace(") <= 3  # cleaned once, not by each use; translate goes letter by letter


def test_types_of_names(spark):
    rows = ["CoreDNS", "kube-proxy", "redis-ingress", "orders-db", "db-exporter", '"web"', "", None, "api-gw"]
    got = [tuple(r.t) for r in spark.createDataFrame([(r,) for r in rows], "n string").select(names.component_type(F.col("n")).alias("t")).collect()]
    assert got == [("infra", None), ("infra", None), ("service", "ingress"), ("datastore", None), ("service", None), ("service", None), ("service", None), ("service", None), ("service", "ingress")]


def test_targets_of_a_text_are_worked_out_once(spark):
    rows = ["dial tcp payments-api:8443 refused", "lookup orders-db.shop.svc.cluster.local: no such host", "10.1.2.3:5432 (redis.data.svc)", "panic in main.go:20, host=cart-api", "http://user@db.example.com/x", "DIAL TCP Cart-Api:80", "nothing", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(names.target_in(F.col("t")).alias("h"))
    got = [r.h and (r.h.name, r.h.namespace) for r in df.collect()]
    assert got == [("payments-api", None), ("orders-db", "shop"), ("redis", "data"), ("cart-api", None), ("db.example.com", None), ("cart-api", None), None, None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") < 50  # not once for each shape and use
