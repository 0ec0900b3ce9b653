"""Certificate facts in panes: expiry dates, failed attempts, issuer errors; and panes that hold another pane's text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import leading_stamp
from .lines import split_lines

NAME = r"^Name:\s+(\S+)"
NOT_AFTER = r"(?i)(?:^\s*Not After\s*[:=]\s*|notAfter=)(.+?)\s*\z"
FAILED = r"(?i)^\s*Failed Issuance Attempts:\s*(\d+)"
ISSUER = r"(?i)\b(?:issuer|acme|order)\b.*\b(?:fail|error|denied|rate limit)"
# openssl prints "Oct  9 08:53:20 2025 GMT".
OPENSSL = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\d{4})\s*(?:GMT|UTC)?"


def certificates(panes: DataFrame) -> DataFrame:
    """(incident_id, name, not_after_ms, failed_attempts, issuer_line): one row per named block of a pane."""
    rows = split_lines(panes, "incident_id", "text")
    line = F.col("line")
    get = lambda p: F.when(line.rlike(p), F.regexp_extract(line, p, 1))
    w = Window.partitionBy("incident_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("name", F.last(get(NAME), ignorenulls=True).over(w))
    stamp = get(NOT_AFTER)
    months = F.create_map(*[F.lit(x) for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1) for x in (m, f"{i:02}")])
    part = lambda i: F.regexp_extract(stamp, OPENSSL, i)
    iso = F.when(stamp.rlike(OPENSSL), F.concat(part(4), F.lit("-"), F.try_element_at(months, part(1)), F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("T"), part(3), F.lit("Z"))).otherwise(stamp)
    rows = rows.select("incident_id", "name", "line_no", leading_stamp(F.concat(iso, F.lit(" ")))["ts_ms"].alias("t"), get(FAILED).cast("int").alias("f"), F.when(line.rlike(ISSUER), F.col("line_no")).alias("i"))
    out = rows.groupBy("incident_id", "name").agg(F.min("t").alias("not_after_ms"), F.max("f").alias("failed_attempts"), F.min("i").alias("issuer_line"))
    return out.filter("not_after_ms is not null or failed_attempts is not null or issuer_line is not null")


#: What tells a pane's text, by source.
TELLS = {
    "logs": r"^\s*LAST SEEN\s+TYPE|^NAME\s+READY\s+STATUS|\blevel=(?:info|warn|error)\b",
    "traces": r'"resourceSpans"|"traceID"|"localEndpoint"|\btrace=\S+ span=',
    "alerts": r'"alertname"|^\s*\[FIRING|^\s*ALERT \w+',
    "helm": r"^REVISION\s+UPDATED\s+STATUS|\) has changed:\s*$|^diff --git ",
}


def misplaced(panes: DataFrame) -> DataFrame:
    """(incident_id, source, looks_like): panes without a tell of their own source and with one of another."""
    rows = panes.select("incident_id", "source", F.explode(F.split("text", "\n")).alias("line"))
    seen = rows.groupBy("incident_id", "source").agg(*[F.bool_or(F.col("line").rlike(p)).alias(f"is_{k}") for k, p in TELLS.items()])
    own = F.coalesce(*[F.when(F.col("source") == k, F.col(f"is_{k}")) for k in TELLS])
    other = F.coalesce(*[F.when((F.col("source") != k) & F.col(f"is_{k}"), F.lit(k)) for k in TELLS])
    return seen.filter(~own).select("incident_id", "source", other.alias("looks_like")).filter("looks_like is not null")
