"""Extensions for live signals: windowed counts, burn rates and incident sessions with watermarks.

The same functions work on batch and streaming frames with an instant column ts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_anomaly, rank

LATE = "15 minutes"


def with_instant(signals: DataFrame) -> DataFrame:
    """Adds ts, the instant of ts_ms."""
    return signals.withColumn("ts", F.timestamp_millis("ts_ms"))


def _bounded(df: DataFrame, late: str) -> DataFrame:
    return df.withWatermark("ts", late) if df.isStreaming else df


def counts(signals: DataFrame, width: str = "5 minutes", late: str = LATE) -> DataFrame:
    """(component, start_ms, errors, total) of tumbling windows."""
    out = _bounded(signals, late).groupBy(F.window("ts", width), "component").agg(F.count_if(rank(F.col("severity")) >= 2).alias("errors"), F.count("*").alias("total"))
    return out.select("component", F.unix_millis("window.start").alias("start_ms"), "errors", "total")


def burn_rates(signals: DataFrame, slo: float = 0.999, width: str = "1 hour", step: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(component, start_ms, burn) of sliding windows: the error share in units of what the objective allows."""
    out = _bounded(signals, late).groupBy(F.window("ts", width, step), "component").agg((F.count_if(rank(F.col("severity")) >= 2) / F.count("*") / (1 - slo)).alias("burn"))
    return out.select("component", F.unix_millis("window.start").alias("start_ms"), F.round("burn", 6).alias("burn"))


def sessions(signals: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(component, start_ms, end_ms, n): runs of anomalies of a component with less than gap between them."""
    odd = _bounded(signals.filter(is_anomaly(F.col("kind"), F.col("severity")) & (rank(F.col("severity")) >= 1)), late)
    out = odd.groupBy(F.session_window("ts", gap), "component").agg(F.count("*").alias("n"))
    return out.select("component", F.unix_millis("session_window.start").alias("start_ms"), F.unix_millis("session_window.end").alias("end_ms"), "n")


def distinct_signals(signals: DataFrame, late: str = LATE) -> DataFrame:
    """Signals without those that were sent again within the watermark."""
    return signals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["component", "kind", "seq"]) if signals.isStreaming else signals.dropDuplicates(["component", "kind", "seq"])
