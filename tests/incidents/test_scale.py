"""What only larger tables show: ties, long numbers, expressions that are computed once, memory of a batch."""

from pyspark.sql import functions as F

from faultline.functions import text
from faultline.functions import vocabulary as V
from faultline.operators import correlate, lookup, orders
from faultline.plans import catalog_readers
from faultline.plans.analyze import analyze
from faultline.sources import alerts, lines, logs, manifests, releases, traces
from faultline.sources.adapters import LOG_TEXTS


def test_equal_deploy_signals_give_the_first(spark):
    rows = [("r", 1, 7, f"chg-{i:03}") for i in range(300)]
    deploys = spark.createDataFrame([("r", 1)], "release string, revision long")
    for some in (rows, rows[::-1]):
        got = correlate.deploy_signals(deploys, spark.createDataFrame(some, "release string, revision long, seq long, id string").repartition(7)).collect()
        assert [r.signal_id for r in got] == ["chg-000"]


def test_budgets_of_any_size_are_plain_numbers(spark):
    rows = spark.createDataFrame([("a", 47760.0, 2445600.0, 30.0), ("b", 0.0, 10.0, 30.0), ("c", 3.25, 4.0, 30.0), ("d", None, 4.0, 30.0)], "id string, burn double, minutes double, window_days double")
    got = dict(lookup.budget_view(rows).collect())
    assert got["a"] == '{"hasEvidence":true,"burnRate":47760.0,"incidentMinutes":2445600.0,"windowDays":30.0,"consumedPct":270374666.6667}'
    assert got["b"] == '{"hasEvidence":true,"burnRate":0.0,"incidentMinutes":10.0,"windowDays":30.0,"consumedPct":0.0}'
    assert got["d"] == '{"hasEvidence":false,"note":"no error-rate evidence"}'
    values = [1e7, 12345678.25, 9.5e15, 1e16, 1.5e20, 0.0005, 0.00025, 0.00001, -3e8, 0.0, 250.0]
    said = spark.createDataFrame([(v,) for v in values], "x double").select(lookup.json_number(F.col("x"))).collect()
    assert [r[0] for r in said] == ["10000000.0", "12345678.25", "9500000000000000.0", "1e+16", "1.5e+20", "0.0005", "0.00025", "1e-05", "-300000000.0", "0.0", "250.0"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_line_are_searched_once(spark):
    line = spark.createDataFrame([('a=1 b="x \\" y" a=2 c= ts=5 status=502',), (None,), ("none",)], "line string")
    got = [r.m for r in line.select(text.logfmt(F.col("line")).alias("m")).collect()]
    assert got == [{"a": "1", "b": 'x " y', "c": "", "ts": "5", "status": "502"}, None, {}]
    searched = line.select(logs.structured(F.col("line")).alias("f")).select("f.ts", "f.level", "f.status")
    assert plan(searched).count("regexp_extract_all(") == 1
    assert [tuple(r) for r in searched.collect()] == [("5", None, "502"), (None, None, None), (None, None, None)]
    spans = traces.text_spans(line.select(F.lit("i").alias("incident_id"), F.col("line").alias("text")))
    assert plan(spans).count("regexp_extract_all(") == 3  # the pairs, and an age's numbers and units


def test_required_texts_lose_no_kind(spark):
    samples = [x.replace("#", "7") for x in LOG_TEXTS] + ["migrate x failed", "ERRORS in the migration", "Lookup a.b: I/O TIMEOUT", "ORA-00001", "node a is Not Ready", "secret \"a\" not found", "HTTP/1.1 503", "upstream 502 ", "back-off 5m restarting failed x", "took 500 ms", None, ""]
    df = spark.createDataFrame([(x,) for x in samples], "t string")
    other = {"http_429": text.is_rate_limit, "http_5xx": text.is_server_error}
    plain = text.first_of([(F.col("t").rlike("(?i)" + p) if p else other[k](F.col("t")), F.lit(k)) for k, p in V.LOG_PATTERNS])
    assert df.filter(~text.classify(F.col("t")).eqNullSafe(plain)).count() == 0
    assert text.required(r"a{2}|no such host|x") == [] and text.required(r"(?:fail|error)\w*.{0,60}\bmigrate") == ["migrate"]


def test_documents_are_cut_in_small_batches_and_only_where_one_may_open(spark):
    batched = 100  # PythonEvalType.SQL_BATCHED_UDF: rows by the hundred, whatever their size
    assert traces._segments.evalType == batched and traces.repaired_json.evalType == batched
    panes = ["[pod/x] a", "x\n  {\n\"a\": 1}", "[\n{}\n]", " [1]", "{", None, "[FIRING:1] y", "{ }", "[null]", "a {\"b\"}", "﻿{\"a\": 1}", "x\r[-1]"]
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(panes)], "incident_id string, text string")
    every = df.select("incident_id", F.explode(traces._segments(lines.pane_lines(F.col("text")))).alias("d")).select("incident_id", "d.*")
    assert sorted(map(tuple, traces.json_segments(df).collect())) == sorted(map(tuple, every.collect())) and every.count() == 8


def test_manifests_are_read_without_a_shuffle(spark):
    pane = "ns, a, Deployment (apps) has changed:\n  spec:\n-   replicas: 1\n+   replicas: 2\n\nns, b, ConfigMap (v1) has changed:\n  data:\n    k: v"
    df = spark.createDataFrame([("i", pane), ("j", "nothing"), ("k", None)], "incident_id string, text string")
    got = releases.diff_records(df)
    assert "Exchange" not in plan(got)
    assert [(r.block_no, r.resource, r.line_no, r.sign, r.path, r.value) for r in got.collect()] == [(1, "a", 3, "-", "spec.replicas", "1"), (1, "a", 4, "+", "spec.replicas", "2"), (2, "b", 8, " ", "data.k", "v")]
    assert [tuple(r) for r in releases.changes(df).select("resource", "field", "before", "after").collect()] == [("a", "spec.replicas", "1", "2")]


def test_facts_of_blocks_are_those_of_their_records(spark):
    pane = "ns, a, Deployment (apps) has changed:\n  kind: Deployment\n  metadata:\n-   name: old\n+   name: new\n    labels:\n      chart: c-1\n  spec:\n    containers:\n    - name: web\n      image: x:1\n    - name: api\n      image: y:1\nns, e, Secret (v1) has changed:\n# none"
    blocks = manifests.block_records(releases.block_arrays(spark.createDataFrame([("i", pane)], "incident_id string, text string")), releases.BLOCK_KEYS).withColumnRenamed("kind", "of")
    by = ["incident_id", "block_no"]
    rows = manifests.facts(blocks.select(*by, F.explode("records").alias("r")).select(*by, "r.*"), by).collect()
    assert manifests.block_facts(blocks, by).collect() == rows and rows[0].name == "new" and rows[0].containers == ["api", "web"] and len(rows) == 1


def test_evidence_without_an_id_is_spread(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 100 == 0, F.concat(F.lit("s"), "id")).alias("signal_id"), F.lit(None).cast("string").alias("change_id"), F.lit("logs").alias("source"), F.when(F.col("id") % 2 == 0, F.col("id").cast("int")).alias("line"), F.concat(F.lit("t"), "id").alias("text"), F.lit(0.1).alias("weight"))
    ids = spark.createDataFrame([("s200",)], "id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = orders.valid_evidence(rows, ids, ids.limit(0))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 2000 and max(sizes) < 1000
        some = orders.valid_evidence(rows.withColumn("line", F.lit(None).cast("int")), ids, ids.limit(0)).collect()
        assert [r.signal_id for r in some] == ["s200"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_panes_are_spread_over_the_cores(spark):
    rows = spark.range(5000).select(F.col("id").alias("seq"))
    panes = catalog_readers.pane(rows, F.col("seq").cast("string"))
    assert panes.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and panes.count() == 25


def test_an_analysis_makes_its_panes_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string", useArrow=False)
    def text_of(t):
        made.add(1)
        return t

    text_of = text_of.asNondeterministic()
    rows = [("i", "logs", "2025-10-09T08:53:20Z service=cart level=error msg=\"OOMKilled\""), ("i", "traces", "2025-10-09T08:53:20Z trace=1 span=1 parent=- service=cart kind=server op=x dur=3ms status=ok")]
    panes = spark.createDataFrame(rows, "incident_id string, source string, text string").withColumn("text", text_of("text"))
    got = analyze(panes)["hypotheses"].collect()
    assert made.value == 2 and [(r.category, r.rank) for r in got] == [("resource-limits", 1)]


def test_columns_of_absent_sources_are_those_of_their_readers(spark):
    panes = spark.createDataFrame([("i", "x")], "incident_id string, text string")
    for reader, columns in ((traces.read_spans, traces.SPANS), (alerts.read_alerts, alerts.ALERTS), (logs.read_logs, logs.SIGNALS), (releases.deploys, releases.DEPLOYS), (releases.changes, releases.CHANGES)):
        assert ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in reader(panes).schema) == columns


def test_bodies_of_alerts_are_read_without_a_shuffle(spark):
    pane = "Labels:\n - lost = x\n[FIRING:1] Hot guessed\n - early = x\nLabels:\n - service = a\n - service = \"b\"\nDetails:\n - Summary = s1\n - zone = z\n[RESOLVED] Cold guessed\nAnnotations:\n * summary: t\nALERT Bare{k=\"v\"}"
    got = alerts.text_alerts(spark.createDataFrame([("i", pane), ("j", "nothing"), ("k", None)], "incident_id string, text string"))
    assert "Exchange" not in plan(got) and "Window" not in plan(got)
    hot, cold, bare = sorted(got.collect(), key=lambda r: r.source_line)
    assert (hot.source_line, hot.name, hot.summary) == (3, "Hot", "s1") and hot.labels == {"alertname": "Hot", "service": "b", "zone": "z"}
    assert (cold.source_line, cold.status, cold.summary) == (11, "resolved", "t") and cold.labels == {"alertname": "Cold"}
    assert (bare.name, bare.summary, bare.labels) == ("Bare", None, {"alertname": "Bare", "k": "v"})
