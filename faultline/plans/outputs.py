"""Sinks of an analysis: a folder of tables, one JSON document and one Markdown brief per incident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scoring import band

#: How many rows of each relation a document holds for one incident, best first.
DOCUMENT = {
    "hypotheses": ("rank", 6), "evidence": ("place", 60), "against": ("category", 30), "options": ("eta_min", 12), "components": ("component", 200), "edges": ("errors", 40), "deploys": ("release_id", 20), "changes": ("place", 40),
    "timeline": ("ts_ms", 60), "clusters": ("cluster", 50), "certificates": ("name", 20), "warnings": ("place", 20), "alert_rows": ("long_h", 3), "projections": ("ahead_min", 3),
}


def write_tables(analysis: dict[str, DataFrame], path: str) -> None:
    """Each relation as Parquet under path."""
    for name, df in analysis.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def documents(analysis: dict[str, DataFrame]) -> DataFrame:
    """(incident_id, document): the parts of DOCUMENT as one JSON text; each part is cut per incident before it is gathered."""
    out = analysis["budget"].select("incident_id", F.struct("burn", "minutes", "window_days", "ratio_source").alias("budget"))
    for name, (order, most) in DOCUMENT.items():
        df = analysis[name]
        if "incident_id" not in df.columns:
            df = df.withColumnRenamed("id", "incident_id")
        key = F.desc(order) if order == "errors" else F.asc_nulls_last(order)
        fields = sorted(c for c in df.columns if c != "incident_id")
        rows = df.withColumn("_rn", F.row_number().over(Window.partitionBy("incident_id").orderBy(key, *[c for c in fields if c != order and dict(df.dtypes)[c] in ("string", "bigint", "int")])))
        part = rows.filter(F.col("_rn") <= most).groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("_rn", F.struct(*fields).alias("row")))).alias(name))
        out = out.join(part.select("incident_id", F.transform(name, lambda x: x["row"]).alias(name)), "incident_id", "left")
    return out.select("incident_id", F.to_json(F.struct(*[c for c in out.columns if c != "incident_id"])).alias("document"))


def _listed(df: DataFrame, order: list, text: Column, most: int, name: str) -> DataFrame:
    """(incident_id, name): the first `most` texts of each incident as lines; cut before they are gathered."""
    w = Window.partitionBy("incident_id").orderBy(*order)
    rows = df.select("incident_id", text.alias("t"), F.row_number().over(w).alias("n")).filter(F.col("n") <= most)
    return rows.groupBy("incident_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n").alias(name))


def briefs(analysis: dict[str, DataFrame]) -> DataFrame:
    """(incident_id, brief): likely causes with what speaks for the first, the recommended action, who is affected, the budget, the timeline and warnings, as Markdown."""
    h = analysis["hypotheses"].filter("rank <= 3")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), "category", F.when(F.col("component") != "", F.concat(F.lit(" at "), "component")).otherwise(""), F.lit(" ("), band(F.col("confidence")), F.lit(", "), F.format_number("confidence", 2), F.lit(")"))
    causes = _listed(h, ["rank"], line, 3, "causes")
    first = analysis["evidence"].join(h.filter("rank = 1").select("incident_id", "category", "component"), ["incident_id", "category", "component"], "left_semi")
    why = _listed(first, ["place"], F.concat(F.lit("- "), "clue", F.lit(" ("), F.coalesce("signal_id", "change_id", F.lit("text")), F.lit(")")), 3, "why")
    pick = analysis["options"].filter("recommended").select("incident_id", F.concat("kind", F.lit(", about "), F.col("eta_min").cast("int").cast("string"), F.lit(" min, risk "), "risk").alias("action"))
    ill = F.col("status").isin("root", "failing", "degraded")
    affected = _listed(analysis["components"].filter(ill), [F.col("status") == "degraded", "component"], F.concat(F.lit("- "), "component", F.lit(": "), "status"), 10, "affected")
    spent = analysis["budget"].select("incident_id", F.concat(F.lit("burn rate "), F.format_number(F.coalesce("burn", F.lit(0.0)), 1), F.lit(" for "), F.format_number("minutes", 0), F.lit(" min, by "), "ratio_source").alias("spent"))
    stamp = F.coalesce(F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss"), F.lit("at an unknown time"))
    began = _listed(analysis["timeline"], [F.col("ts_ms").asc_nulls_last(), "id"], F.concat(F.lit("- "), stamp, F.lit(" "), "component", F.lit(" "), "kind"), 5, "began")
    said = _listed(analysis["warnings"], ["place", "pane"], F.concat(F.lit("- "), "pane", F.lit(": "), "warning"), 5, "said")
    both = causes
    for part in (why, pick, affected, spent, began, said):
        both = both.join(part, "incident_id", "left")
    section = lambda title, name, none="none": F.concat(F.lit(f"## {title}\n"), F.coalesce(name, F.lit(none)))
    parts = [section("Likely causes", "causes"), section("Evidence", "why"), section("Recommended action", "action"), section("Affected", "affected"), section("Error budget", "spent"), section("Timeline", "began"), section("Warnings", "said")]
    return both.select("incident_id", F.concat_ws("\n\n", *parts).alias("brief"))
