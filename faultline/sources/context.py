"""What is stated beside the panes, fixed-width tables, and documents that nothing can read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import offset_minutes, parsed_stamp
from .traces import json_segments, repaired_json


def normalised_context(rows: DataFrame) -> DataFrame:
    """rows (incident_id, zone, now, year, deployed_at, cluster, latest_ms; all but the last as typed) as zone_min, now_ms, year, deployed_ms, cluster and warnings.

    A zone, time or year that can't be read is left out with a warning; without a year, now's is taken.
    """
    zone = F.trim(F.coalesce("zone", F.lit("")))
    minutes = offset_minutes(F.when(zone != "", zone))
    stated = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    rows = rows.withColumns({"_now": parsed_stamp(F.col("now"), F.col("latest_ms"))["ts_ms"], "_at": parsed_stamp(F.col("deployed_at"), F.col("latest_ms"))["ts_ms"], "_y": F.col("year").try_cast("int")})
    year = F.when((F.col("_y") > 1970) & (F.col("_y") < 3000), F.col("_y"))
    warnings = F.array_compact(F.array(
        F.when((zone != "") & minutes.isNull(), "time zone not recognised"), F.when(stated(F.col("now")) & F.col("_now").isNull(), "current time could not be read"), F.when(stated(F.col("deployed_at")) & F.col("_at").isNull(), "deploy time could not be read"),
    ))
    return rows.select(
        "incident_id", F.coalesce(minutes, F.lit(0)).cast("int").alias("zone_min"), F.coalesce("_now", "latest_ms").alias("now_ms"), F.coalesce(year, F.year(F.timestamp_millis("_now"))).alias("year"), F.col("_at").alias("deployed_ms"),
        F.nullif(F.trim("cluster"), F.lit("")).alias("cluster"), F.array_join(warnings, "; ").alias("warnings"),
    )


def sliced(line: Column, header: Column, names: list[str]) -> Column:
    """Struct of a table line's cells, cut where the header has the names: a cell ends where the next one begins."""
    starts = [F.locate(n, header) if isinstance(header, str) else F.instr(header, n) for n in names]
    cells = []
    for i, n in enumerate(names):
        length = (starts[i + 1] - starts[i]) if i + 1 < len(names) else F.length(line)
        cells.append(F.trim(F.substring(line, starts[i], length)).alias(n.lower().replace(" ", "_")))
    return F.struct(*cells)


def unreadable(panes: DataFrame) -> DataFrame:
    """(incident_id, first_line, error): JSON documents that stay unreadable when they are closed. Other text of the pane is read all the same."""
    docs = json_segments(panes).withColumn("fixed", repaired_json("doc"))
    return docs.filter("fixed is null").select("incident_id", "first_line", F.lit("a document could not be read").alias("error"))
