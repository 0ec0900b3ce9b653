"""Queries of readers: panes are written from the tables, read back, and held against the rows that they were written from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions import vocabulary as V
from ..session import spread
from ..sources import alerts, context, lines, logs, releases, traces
from ..sources.adapters import pick, view
from .catalog import FLOOR_SQL, ORACLES, _classify_sql, query, read

#: Rows that one pane holds: panes grow in number with the tables, not in size.
PANE_ROWS = 200


def stamp():
    return F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def pane(rows: DataFrame, line, before=None, after=None) -> DataFrame:
    """(incident_id, text): lines of PANE_ROWS successive rows (by seq) each, between a first and a last one."""
    r = rows.select(F.concat(F.lit("inc-"), F.expr(f"cast(seq div {PANE_ROWS} as string)")).alias("incident_id"), F.struct("seq", line.alias("l")).alias("x"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["l"]), "\n")
    parts = [*([before] if before is not None else []), text, *([after] if after is not None else [])]
    return spread(r, "incident_id").groupBy("incident_id").agg(F.concat_ws("\n", *parts).alias("text"))


INC = f"'inc-' || seq // {PANE_ROWS}"
WARNING = "seq % 3 <> 0"
SEVERITY = f"(['info', 'warn', 'error', 'critical'])[greatest({FLOOR_SQL}, CASE WHEN {WARNING} THEN 1 ELSE 0 END) + 1]"
SECONDS = "ts_ms // 1000 * 1000"


def _events_sql(reason: str) -> str:
    return f"""e AS (SELECT seq, ts_ms, component, coalesce({_classify_sql(f"'{reason}: ' || body")}, CASE WHEN {WARNING} THEN 'error_generic' END) AS kind FROM log_lines), k AS (SELECT *, {SEVERITY} AS severity FROM e WHERE kind IS NOT NULL)"""


@query("log_lines", sql=_events_sql("Noted") + f" SELECT {INC} AS incident_id, component AS name, kind, severity, count(*) AS n, min({SECONDS})::BIGINT AS first_ms FROM k GROUP BY ALL")
def read_event_documents(spark, sf_dir):
    rows = view(spark, sf_dir, "log_lines")
    obj = F.struct(F.lit("Deployment").alias("kind"), F.col("component").alias("name"), F.lit("shop").alias("namespace"))
    event = F.to_json(F.struct(obj.alias("involvedObject"), F.lit("Noted").alias("reason"), F.col("body").alias("message"), F.when(F.expr("seq % 3 <> 0"), "Warning").otherwise("Normal").alias("type"), stamp().alias("firstTimestamp")))
    # Every event is a line of one list; a comma ends each but the pane's last.
    comma = F.when((F.col("seq") % PANE_ROWS == PANE_ROWS - 1) | (F.col("seq") == F.lit(rows.agg(F.max("seq")).first()[0])), "").otherwise(",")
    got = logs.event_documents(pane(rows, F.concat(event, comma), F.lit('{"items": ['), F.lit("]}")))
    return got.groupBy("incident_id", "name", "kind", "severity").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"))


@query("log_lines", sql=_events_sql("Seen") + f" SELECT {INC} AS incident_id, kind, severity, count(*) AS n, max((seq % 50 + 1) * 60000)::BIGINT AS oldest_ms FROM k GROUP BY ALL")
def read_described_events(spark, sf_dir):
    rows = view(spark, sf_dir, "log_lines")
    age = F.concat((F.col("seq") % 50 + 1).cast("string"), F.lit("m"))
    age = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("9s (x4 over "), age, F.lit(")"))).otherwise(age)
    line = F.concat(F.lit("  "), F.when(F.expr("seq % 3 <> 0"), "Warning").otherwise("Normal"), F.lit("   Seen   "), age, F.lit("   kubelet   "), "body")
    panes = pane(rows, line, F.lit("Name:  cart-api-7d9f8b6c5-x2k4j\nNamespace:  shop\nEvents:"))
    got = logs.described_events(logs.contexts(panes))
    return got.groupBy("incident_id", "kind", "severity").agg(F.count("*").alias("n"), F.max("age_ms").alias("oldest_ms"))


STATES = ["active", "suppressed", "resolved", "pending"]


@query("signals", sql=f"""a AS (SELECT seq, 'Alert_' || component[5:] AS name, CASE seq % 4 WHEN 0 THEN 'firing' WHEN 1 THEN 'silenced' WHEN 2 THEN 'resolved' ELSE 'pending' END AS status, {SECONDS} AS starts_ms FROM signals)
SELECT {INC} AS incident_id, name, status, starts_ms, (seq % {PANE_ROWS} + 2)::INT AS source_line, 'value ' || seq AS summary FROM a""")
def read_tool_alerts(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss 'UTC'")
    line = F.concat_ws("  ", F.concat(F.lit("Alert_"), F.substring("component", 5, 9)), stamp, F.concat(F.lit("value "), F.col("seq").cast("string")), F.expr(pick("seq", STATES)))
    got = alerts.tool_alerts(pane(s, line, F.lit("Alertname  Starts At  Summary  State")))
    return got.select("incident_id", "name", "status", "starts_ms", "source_line", "summary")


@query("signals", sql=f"SELECT {INC} AS incident_id, 'Burn' AS name, component AS service, cluster, CASE seq % 4 WHEN 0 THEN 'firing' WHEN 1 THEN 'silenced' WHEN 2 THEN 'resolved' ELSE 'pending' END AS status, {SECONDS} AS starts_ms, CASE WHEN seq % 4 = 2 THEN {SECONDS} + 60000 END AS ends_ms, 'v' || seq AS summary FROM signals")
def read_tool_alerts_extended(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    at = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss 'UTC'")
    labels = F.concat(F.lit('alertname="Burn" cluster="'), "cluster", F.lit('" service="'), "component", F.lit('"'))
    line = F.concat_ws("  ", labels, F.concat(F.lit('summary="v'), F.col("seq").cast("string"), F.lit('"')), at(F.col("ts_ms")), at(F.col("ts_ms") + 60_000), F.lit("http://am.example.com/g"), F.expr(pick("seq", STATES)))
    got = alerts.tool_alerts(pane(s, line, F.lit("Labels  Annotations  Starts At  Ends At  Generator URL  State")))
    return got.select("incident_id", "name", F.col("labels")["service"].alias("service"), F.col("labels")["cluster"].alias("cluster"), "status", "starts_ms", "ends_ms", "summary")


@query("signals", sql=f"SELECT {INC} AS incident_id, 'Hot' || seq % 5 AS name, component AS service, 'ns' || seq % 3 AS namespace, 'note ' || seq AS summary FROM signals")
def read_alert_bodies(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    n = F.col("seq").cast("string")
    head = F.concat(F.lit("[FIRING:1] Hot"), (F.col("seq") % 5).cast("string"), F.lit(" guessed"))
    text = F.concat_ws("\n", head, F.lit("Labels:"), F.concat(F.lit(" - service = "), "component"), F.concat(F.lit(' - namespace = "ns'), (F.col("seq") % 3).cast("string"), F.lit('"')), F.lit("Annotations:"), F.concat(F.lit(" - summary = note "), n))
    got = alerts.text_alerts(pane(s, text))
    return got.select("incident_id", "name", F.col("labels")["service"].alias("service"), "namespace", "summary")


@query("releases", sql="SELECT 'inc-' || change_id // 200 AS incident_id, 'rel-' || release_id AS release_id, 'ns' || revision % 3 AS namespace, revision, status, ts_ms // 1000 * 1000 AS ts_ms, 'app-1.' || revision AS chart FROM releases")
def read_release_lists(spark, sf_dir):
    r = view(spark, sf_dir, "releases").withColumn("seq", F.col("change_id"))
    stamp = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss.SSSSSSSSS '+0000 UTC'")
    item = F.to_json(F.struct(F.concat(F.lit("rel-"), F.col("release_id").cast("string")).alias("name"), F.concat(F.lit("ns"), (F.col("revision") % 3).cast("string")).alias("namespace"), F.col("revision").cast("string").alias("revision"), stamp.alias("updated"), "status", F.concat(F.lit("app-1."), F.col("revision").cast("string")).alias("chart"), F.lit("1").alias("app_version")))
    got = releases.listed(pane(r, F.concat(F.lit("["), item, F.lit("]"))))
    return got.select("incident_id", "release_id", "namespace", "revision", "status", (F.expr("ts_ms div 1000 * 1000")).alias("ts_ms"), "chart")


@query("spans", sql="""s AS (SELECT trace_id, span_id, service, error, trace_id // 200 AS p, row_number() OVER (PARTITION BY trace_id // 200 ORDER BY trace_id, span_id) AS n FROM spans) SELECT 'inc-' || p AS incident_id, 't' || trace_id AS trace_id, 's' || trace_id || '-' || span_id AS span_id, service, error, (n + 1)::INT AS source_line FROM s""")
def read_span_lines(spark, sf_dir):
    s = view(spark, sf_dir, "spans").select(F.concat(F.lit("inc-"), F.expr("cast(trace_id div 200 as string)")).alias("incident_id"), "trace_id", "span_id", "service", "error")
    span = F.to_json(F.struct(F.concat(F.lit("t"), F.col("trace_id").cast("string")).alias("traceId"), F.concat(F.lit("s"), F.col("trace_id").cast("string"), F.lit("-"), F.col("span_id").cast("string")).alias("id"), F.struct(F.col("service").alias("serviceName")).alias("localEndpoint"), F.lit("op").alias("name"), F.lit(1000.0).alias("timestamp"), F.lit(5.0).alias("duration"), F.create_map(F.lit("error"), F.col("error").cast("string")).alias("tags")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("trace_id", "span_id", span.alias("l")))), lambda x: x["l"]), ",\n")
    panes = spread(s, "incident_id").groupBy("incident_id").agg(F.concat(F.lit("[\n"), text, F.lit("\n]")).alias("text"))
    return traces.zipkin_spans(traces.span_documents(panes)).select("incident_id", "trace_id", "span_id", "service", "error", "source_line")


@query("signals", sql=f"SELECT {INC} AS incident_id, 'A' || seq AS name, ({SECONDS})::BIGINT AS starts_ms, (2 * (seq % {PANE_ROWS}) + 2)::INT AS source_line FROM signals")
def read_alert_lines(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    last = s.agg(F.max("seq")).first()[0]
    doc = F.concat(F.lit('{"labels": {\n "alertname": "A'), F.col("seq").cast("string"), F.lit('"}, "startsAt": "'), stamp(), F.lit('"}'), F.when((F.col("seq") % PANE_ROWS == PANE_ROWS - 1) | (F.col("seq") == last), "]").otherwise(","))
    first = F.when(F.col("seq") % PANE_ROWS == 0, "[").otherwise("")
    docs = traces.json_segments(pane(s, F.concat(first, doc)))
    return alerts.json_alerts(docs).select("incident_id", "name", "starts_ms", "source_line")


FORMS = ["EEE, dd MMM yyyy HH:mm:ss '+0200'", "EEE MMM d HH:mm:ss yyyy", "MMM d HH:mm:ss", "MMdd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss.SSS '+0200 CEST'", "EEE MMM d HH:mm:ss 'CEST' yyyy"]


@query("signals", sql=f"""s AS (SELECT seq, ts_ms, CASE WHEN seq % 6 IN (0, 4, 5) THEN 7200000 ELSE 0 END AS ahead, CASE WHEN seq % 6 IN (3, 4) THEN ts_ms ELSE {SECONDS} END AS t, make_timestamp((ts_ms + CASE WHEN seq % 2 = 0 THEN 0 ELSE -40 * 86400000::BIGINT END) * 1000) AS now FROM signals),
y AS (SELECT *, CASE WHEN seq % 6 NOT IN (2, 3) THEN t ELSE CASE WHEN year(now) = year(make_timestamp(t * 1000)) THEN CASE WHEN t > epoch_ms(now) + 86400000 THEN epoch_ms(make_timestamp(t * 1000) - INTERVAL 1 YEAR) ELSE t END ELSE CASE WHEN year(now) < year(make_timestamp(t * 1000)) THEN epoch_ms(make_timestamp(t * 1000) - INTERVAL 1 YEAR) END END END AS r FROM s)
SELECT seq, CASE WHEN seq % 6 IN (2, 3) AND strftime(make_timestamp(t * 1000), '%m%d') = '0229' THEN NULL ELSE r END::BIGINT AS ts_ms, seq % 6 IN (1, 2, 3) AS zone_assumed, seq % 6 IN (2, 3) AS year_assumed FROM y""")
def read_stamps(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    ahead = F.when((F.col("seq") % 6).isin(0, 4, 5), 7_200_000).otherwise(0)
    at = F.timestamp_millis(F.col("ts_ms") + ahead)
    text = F.lit("")
    for i, form in enumerate(FORMS):
        text = F.when(F.col("seq") % 6 == i, F.date_format(at, form)).otherwise(text)
    now = F.col("ts_ms") + F.when(F.col("seq") % 2 == 0, 0).otherwise(-40 * 86_400_000)
    x = s.select("seq", times.parsed_stamp(text, now).alias("x"), F.date_format(at, "MMdd").alias("day"))
    # A leap day has no twin in the year before.
    leap = (F.col("seq") % 6).isin(2, 3) & (F.col("day") == "0229")
    return x.select("seq", F.when(~leap, F.col("x.ts_ms")).alias("ts_ms"), "x.zone_assumed", "x.year_assumed")


@query("faults", sql="SELECT seq, name, kind, coalesce(pod, '') AS pod, severity FROM faults")
def read_fixed_width(spark, sf_dir):
    f = view(spark, sf_dir, "faults")
    header = F.lit("NAME            KIND             POD               SEVERITY")
    line = F.concat(F.rpad("name", 16, " "), F.rpad("kind", 17, " "), F.rpad(F.coalesce("pod", F.lit("")), 18, " "), "severity")
    return f.select("seq", F.inline(F.array(context.sliced(line, header, ["NAME", "KIND", "POD", "SEVERITY"]))))


@query(sql="SELECT doc_id, (length(t) - length(replace(t, chr(10), '')) + 1)::INT AS line FROM (SELECT doc_id, left(coalesce(text, ''), length(coalesce(text, '')) // 2) AS t FROM documents)")
def offset_lines(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return read(spark, sf_dir, "documents").select("doc_id", lines.line_at(t, F.expr("length(coalesce(text, '')) div 2")).alias("line"))


@query("signals", sql=f"SELECT {INC} AS incident_id, (seq % {PANE_ROWS} + 1)::INT AS first_line, 'a document could not be read' AS error FROM signals WHERE seq % 4 = 0")
def unreadable_documents(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    line = F.when(F.col("seq") % 4 == 0, '{"a" 1}').when(F.col("seq") % 4 == 1, '{"a": 1}').when(F.col("seq") % 4 == 2, "plain {text").otherwise("[1, 2]")
    return context.unreadable(pane(s, line))


ZONES, NOWS, YEARS = ["Z", "+02:00", "", "Mars"], ["2026-10-05T21:00:00Z", "soon", "", "1790000000"], ["2026", "1960", "", "x"]


@query("signals", sql="""c AS (SELECT seq, ts_ms, cluster, seq % 4 AS z, seq // 4 % 4 AS n, seq // 16 % 4 AS y, CASE WHEN seq % 5 = 0 THEN 'never' WHEN seq % 5 = 1 THEN '2026-10-05 20:00:00Z' END AS d FROM signals),
p AS (SELECT *, CASE n WHEN 0 THEN 1791234000000 WHEN 3 THEN 1790000000000 END AS now FROM c)
SELECT 'i' || seq AS incident_id, CASE z WHEN 1 THEN 120 ELSE 0 END::INT AS zone_min, coalesce(now, ts_ms)::BIGINT AS now_ms, CASE WHEN y = 0 THEN 2026 ELSE year(make_timestamp(now * 1000)) END::INT AS year, CASE WHEN seq % 5 = 1 THEN 1791230400000 END::BIGINT AS deployed_ms, nullif(CASE WHEN seq % 6 = 0 THEN ' ' ELSE cluster END, ' ') AS cluster,
concat_ws('; ', CASE WHEN z = 3 THEN 'time zone not recognised' END, CASE WHEN n = 1 THEN 'current time could not be read' END, CASE WHEN seq % 5 = 0 THEN 'deploy time could not be read' END) AS warnings FROM p""")
def stated_contexts(spark, sf_dir):
    s = view(spark, sf_dir, "signals")
    rows = s.select(F.concat(F.lit("i"), F.col("seq").cast("string")).alias("incident_id"), F.expr(pick("seq", ZONES)).alias("zone"), F.expr(pick("(seq div 4)", NOWS)).alias("now"), F.expr(pick("(seq div 16)", YEARS)).alias("year"), F.when(F.col("seq") % 5 == 0, "never").when(F.col("seq") % 5 == 1, "2026-10-05 20:00:00Z").alias("deployed_at"), F.when(F.col("seq") % 6 == 0, " ").otherwise(F.col("cluster")).alias("cluster"), F.col("ts_ms").alias("latest_ms"))
    return context.normalised_context(rows)


# Severities that a line of application text states by itself, by the texts of log_lines.
@query("log_lines", sql=f"""h AS (SELECT seq, ts_ms, body, nullif(regexp_extract(left(body, 90), '{V.LEVEL_UPPER.replace("'", "''")}', 1), '') AS u, nullif(regexp_extract(left(body, 90), '{V.LEVEL_LEADING.replace("'", "''")}', 1) || regexp_extract(left(body, 90), '{V.LEVEL_LEADING.replace("'", "''")}', 2), '') AS l, {_classify_sql("body")} AS k FROM log_lines),
w AS (SELECT *, CASE lower(coalesce(u, l)) """ + " ".join(f"WHEN '{x}' THEN {V.SEVERITIES.index(s)}" for s, words in V.LEVEL_WORDS.items() for x in words) + f""" ELSE 0 END AS lv FROM h), e AS (SELECT *, coalesce(k, CASE WHEN lv >= 2 THEN 'error_generic' END) AS kind FROM w)
SELECT {INC} AS incident_id, kind, (['info', 'warn', 'error', 'critical'])[greatest({FLOOR_SQL}, lv) + 1] AS severity, count(*) AS n, min({SECONDS})::BIGINT AS first_ms FROM e WHERE kind IS NOT NULL GROUP BY ALL""")
def read_application_lines(spark, sf_dir):
    rows = view(spark, sf_dir, "log_lines")
    panes = pane(rows, F.concat(F.lit("[pod/"), "component", F.lit("-7d9f8b6c5-x2k4j/app] "), stamp(), F.when(F.col("seq") % 2 == 0, " stdout F ").otherwise(" "), "body"))
    return logs.read_logs(panes).groupBy("incident_id", "kind", "severity").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"))


#: The whole reader over the same lines gives the same signals.
ORACLES["analysis_log_signals"] = ORACLES["read_application_lines"]
