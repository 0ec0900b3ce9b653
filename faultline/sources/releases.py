"""Release panes: history tables and JSON, and before/after changes from marked or unified diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import chart_release, fnv_id
from ..functions.text import computed, looks_secret
from ..functions.times import leading_stamp
from ..operators.changes import classify_change
from .lines import pane_lines, split_lines
from .manifests import block_records
from .traces import json_segments, repaired_json

#: What deploys and changes give.
DEPLOYS = "incident_id string, release_id string, revision bigint, previous bigint, deployed_ms bigint, rolled_back_ms bigint, chart string, app_version string, assumed boolean"
CHANGES = "id string, incident_id string, namespace string, resource string, kind string, field string, before string, after string, category string, risk string, direction string"

HISTORY_ROW = r"^\s*(\d+)\s+(\d{4}-\S+(?: [\d:.]+(?: \S+)*?)?|\S.*?\d{4})\s+(superseded|deployed|failed|pending-\w+|uninstalled|uninstalling|unknown)\s+(\S+)\s+(\S+)\s+(.*)\z"
HISTORY = "array<struct<revision:bigint,updated:string,status:string,chart:string,app_version:string,description:string>>"
LISTED = "array<struct<name:string,namespace:string,revision:string,updated:string,status:string,chart:string,app_version:string>>"
LIST_ROW = r"^\s*(\S+)\s+(\S+)\s+(\d+)\s+(\d{4}-\d{2}-\d{2}\s.*?)\s+(superseded|deployed|failed|pending-\w+|uninstalled|unknown)\s+(\S+)\s+(\S+)\s*\z"
UNIFIED = r"^\+\+\+ (?:b/)?(?:\S*/)?([^/\s]+)/([^/\s]+\.ya?ml)"
BLOCK = r"^(\S+), (\S+), (\w+) \(([^)]*)\) has (changed|been added|been removed)"
_UPDATED = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?\s*(?:Z|[+-]\d{2}:?\d{2})?)"


def history(panes: DataFrame) -> DataFrame:
    """(incident_id, release_id, revision, status, ts_ms, chart, app_version, rolled_back_to) of history tables and JSON."""
    rows = split_lines(panes, "incident_id", "text").filter(F.col("line").rlike(HISTORY_ROW))
    part = lambda i: F.regexp_extract("line", HISTORY_ROW, i)
    table = rows.select("incident_id", part(1).cast("long").alias("revision"), part(2).alias("updated"), part(3).alias("status"), part(4).alias("chart"), part(5).alias("app_version"), part(6).alias("description"))
    docs = json_segments(panes).withColumn("doc", repaired_json("doc")).filter(F.col("doc").rlike(r"^\s*\["))
    j = docs.select("incident_id", F.explode(F.from_json("doc", HISTORY)).alias("h")).filter("h.revision is not null").select("incident_id", "h.*")
    both = table.unionByName(j)
    stamp = F.regexp_replace(F.regexp_extract("updated", _UPDATED, 1), r"\s+([+-]\d{2}:?\d{2})\z", "$1")
    back = F.regexp_extract("description", r"(?i)rollback to (\d+)", 1)
    return both.select(
        "incident_id", chart_release(F.col("chart")).alias("release_id"), "revision", "status", leading_stamp(F.concat(stamp, F.lit(" ")))["ts_ms"].alias("ts_ms"), "chart", "app_version", F.when(back != "", back).cast("long").alias("rolled_back_to")
    )


def listed(panes: DataFrame) -> DataFrame:
    """(incident_id, release_id, namespace, revision, status, ts_ms, chart, app_version) of release lists, tables and JSON."""
    rows = split_lines(panes, "incident_id", "text").filter(F.col("line").rlike(LIST_ROW))
    part = lambda i: F.regexp_extract("line", LIST_ROW, i)
    docs = json_segments(panes).withColumn("doc", repaired_json("doc"))
    items = F.when(F.col("doc").rlike(r"^\s*\["), F.from_json("doc", LISTED)).otherwise(F.from_json("doc", f"struct<releases:{LISTED}>")["releases"])
    j = docs.select("incident_id", F.explode(items).alias("x")).filter("x.name is not null and x.revision rlike '^[0-9]+$'")
    at = F.regexp_replace(F.regexp_extract("x.updated", _UPDATED, 1), r"\s+([+-]\d{2}:?\d{2})\z", "$1")
    j = j.select("incident_id", F.col("x.name").alias("release_id"), "x.namespace", F.col("x.revision").cast("long").alias("revision"), F.lower("x.status").alias("status"), leading_stamp(F.concat(at, F.lit(" ")))["ts_ms"].alias("ts_ms"), "x.chart", "x.app_version").filter("ts_ms is not null")
    stamp = F.regexp_replace(F.regexp_extract(part(4), _UPDATED, 1), r"\s+([+-]\d{2}:?\d{2})\z", "$1")
    table = rows.select("incident_id", part(1).alias("release_id"), part(2).alias("namespace"), part(3).cast("long").alias("revision"), part(5).alias("status"), leading_stamp(F.concat(stamp, F.lit(" ")))["ts_ms"].alias("ts_ms"), part(6).alias("chart"), part(7).alias("app_version"))
    return table.unionByName(j)


def deploys(panes: DataFrame) -> DataFrame:
    """suspects of histories, and of lists where a release has no history: the revision before is then assumed."""
    known = suspects(history(panes)).withColumn("assumed", F.lit(False))
    extra = listed(panes).join(known.select("incident_id", "release_id").distinct(), ["incident_id", "release_id"], "left_anti")
    extra = extra.select("incident_id", "release_id", "revision", F.when(F.col("revision") > 1, F.col("revision") - 1).alias("previous"), F.col("ts_ms").alias("deployed_ms"), F.lit(None).cast("long").alias("rolled_back_ms"), "chart", "app_version", F.lit(True).alias("assumed"))
    return known.unionByName(extra)


def suspects(rows: DataFrame) -> DataFrame:
    """Of history: per release the revision under suspicion, the one before it, and whether it is rolled back already.

    The latest is the suspect, unless it is a rollback past its predecessor, which is then the suspect that was undone.
    """
    latest = rows.groupBy("incident_id", "release_id").agg(F.max_by(F.struct("revision", "ts_ms", "rolled_back_to"), "revision").alias("l"))
    undone = F.col("l.rolled_back_to").isNotNull() & (F.col("l.rolled_back_to") != F.col("l.revision") - 1)
    s = latest.select("incident_id", "release_id", (F.col("l.revision") - undone.cast("int")).alias("revision"), F.when(undone, F.col("l.rolled_back_to")).alias("target"), F.when(undone, F.col("l.ts_ms")).alias("rolled_back_ms"))
    good = rows.filter("status in ('superseded', 'deployed')").select("incident_id", "release_id", F.col("revision").alias("older"))
    before = s.join(good, ["incident_id", "release_id"]).filter("older < revision").groupBy("incident_id", "release_id").agg(F.max("older").alias("older"))
    times = rows.select("incident_id", "release_id", "revision", "ts_ms", "chart", "app_version")
    out = s.join(before, ["incident_id", "release_id"], "left").join(times, ["incident_id", "release_id", "revision"], "left")
    return out.select("incident_id", "release_id", "revision", F.coalesce("target", "older").alias("previous"), F.col("ts_ms").alias("deployed_ms"), "rolled_back_ms", "chart", "app_version")


#: What a block is of.
BLOCK_KEYS = ["incident_id", "block_no", "namespace", "resource", "kind"]


def block_arrays(panes: DataFrame) -> DataFrame:
    """(incident_id, block_no, namespace, resource, kind, lines): "ns, name, Kind (group) has changed:" blocks and unified diffs of values files with their lines (line_no, line). A pane is cut in its own row."""
    header = r"^(?:diff --git |index [0-9a-f]+|--- |@@ )"
    numbered = F.transform(pane_lines(F.col("text")), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), (x.rlike(BLOCK) | x.rlike(UNIFIED)).alias("head")))
    p = panes.select("incident_id", computed(F.filter(numbered, lambda x: ~x["line"].rlike(header))).alias("all"))
    heads = F.filter(F.transform("all", lambda x, i: F.when(x["head"], i + 1)), lambda i: i.isNotNull())
    p = p.select("incident_id", "all", computed(heads, lambda x: F.size(x) > 0).alias("heads"))
    end = lambda i: F.coalesce(F.get("heads", i + 1), F.size("all") + 1)
    held = lambda at, i: F.transform(F.slice("all", at + 1, end(i) - at - 1), lambda x: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line")))
    b = p.select("incident_id", F.explode(F.transform("heads", lambda at, i: F.struct((i + 1).alias("block_no"), F.get("all", at - 1)["line"].alias("head"), held(at, i).alias("lines")))).alias("b")).select("incident_id", "b.*")
    file, part = F.col("head").rlike(UNIFIED), lambda i: F.regexp_extract("head", BLOCK, i)
    return b.select("incident_id", "block_no", F.when(file, "").otherwise(part(1)).alias("namespace"), F.when(file, F.regexp_extract("head", UNIFIED, 1)).otherwise(part(2)).alias("resource"), F.when(file, "values").otherwise(part(3)).alias("kind"), "lines")


def diff_blocks(panes: DataFrame) -> DataFrame:
    """(incident_id, block_no, namespace, resource, kind, line_no, line): the lines of block_arrays."""
    return block_arrays(panes).select(*BLOCK_KEYS, F.explode("lines").alias("x")).select(*BLOCK_KEYS, "x.*")


def diff_records(panes: DataFrame) -> DataFrame:
    """(incident_id, block_no, namespace, resource, kind, line_no, sign, path, value): every value of the blocks with its path."""
    return block_records(block_arrays(panes), BLOCK_KEYS).select(*BLOCK_KEYS, F.explode("records").alias("r")).select(*BLOCK_KEYS, "r.*")


def diff_marks(panes: DataFrame) -> DataFrame:
    """Removed and added values of blocks, one row per marked line with its path and pos."""
    return diff_records(panes).filter("sign <> ' '").withColumnRenamed("line_no", "pos")


def changes(panes: DataFrame) -> DataFrame:
    """(id, incident_id, namespace, resource, kind, field, before, after, category, risk, direction): paired marks, classified; secrets are not shown."""
    from ..operators.changes import paired

    by = ["incident_id", "block_no", "namespace", "resource", "kind", "path"]
    pairs = paired(diff_marks(panes), by).withColumnRenamed("path", "field").filter(F.coalesce(F.col("before") != F.col("after"), F.lit(True)))
    hook = F.col("resource").rlike("(?i)migrat") & (F.col("kind") == "Job")
    c = classify_change(F.col("field"), F.col("kind"), F.col("before"), F.col("after"), F.col("namespace"), hook)
    secret = (F.col("kind") == "Secret") | looks_secret(F.regexp_extract("field", r"([A-Za-z0-9_-]+)\]?(?:\.value)?\z", 1), F.coalesce("after", "before"))
    shown = lambda k: F.when(secret & F.col(k).isNotNull(), "(redacted)").otherwise(F.col(k)).alias(k)
    return pairs.select(
        F.concat(F.lit("chg-"), fnv_id(F.concat_ws("|", "namespace", "resource", "kind", "field", F.col("n").cast("string")))).alias("id"),
        "incident_id", "namespace", "resource", "kind", "field", shown("before"), shown("after"), c["category"].alias("category"), c["risk"].alias("risk"), c["direction"].alias("direction"),
    )
