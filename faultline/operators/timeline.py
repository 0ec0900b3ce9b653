"""Order-dependent operators over signals: clocks, onsets, timelines, carried state, hand-offs, caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_anomaly, rank
from .scans import first_rows, last_known, neighbours, row_numbers, running_sums

HOUR_MS = 3_600_000
#: Stamps of one scope are ordered by source in this order.
SOURCES = ["helm", "alerts", "logs", "traces"]


def source_rank():
    return F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")).cast("int")


def onset(errors: DataFrame, by: list[str], gap_ms: int = HOUR_MS, least: int = 3) -> DataFrame:
    """(by, onset_ms): the earliest error, without leading ones over gap_ms before the next while `least` remain."""
    marked = neighbours(errors.select(*by, "ts_ms", "seq"), by, ["ts_ms", "seq"], "ts_ms", "next", "left")
    stays = F.coalesce(F.col("next") - F.col("ts_ms") <= gap_ms, F.lit(True)) | (F.col("left") < least)
    return marked.filter(stays).groupBy(*by).agg(F.min("ts_ms").alias("onset_ms"))


def latest_clock(points: DataFrame, by: list[str], gap_ms: int = 6 * HOUR_MS, share: float = 0.05, least: int = 3) -> DataFrame:
    """(by, now_ms): the newest stamp, without runs of equal stamps far after the next one.

    Runs are dropped from the newest while the next distinct stamp is over gap_ms
    earlier, at most max(1, share of all) points in all, and `least` stay.
    Distinct stamps are counted before the window, so repeated ones cost nothing.
    """
    runs = points.groupBy(*by, "ts_ms").agg(F.count("*").alias("n"))
    newest = Window.partitionBy(*by).orderBy(F.desc("ts_ms"))
    w = Window.partitionBy(*by)
    upto = newest.rowsBetween(Window.unboundedPreceding, 0)
    marked = runs.withColumns({"all": F.sum("n").over(w), "gone": F.sum("n").over(upto), "next": F.lead("ts_ms").over(newest)})
    limit = F.greatest(F.lit(1), F.floor(F.col("all") * share))
    drops = F.col("next").isNotNull() & (F.col("ts_ms") - F.col("next") > gap_ms) & (F.col("gone") <= limit) & (F.col("all") - (F.col("gone") - F.col("n")) >= least)
    marked = marked.withColumn("drops", F.min(F.coalesce(drops, F.lit(False)).cast("int")).over(upto))
    return marked.filter("drops = 0").groupBy(*by).agg(F.max("ts_ms").alias("now_ms"))


def in_window(signals: DataFrame, onsets: DataFrame, by: list[str], lead_ms: int = HOUR_MS // 4) -> DataFrame:
    """Signals without a time, or from lead_ms before the onset of their group on."""
    return signals.join(onsets, by, "left").filter(F.col("ts_ms").isNull() | F.col("onset_ms").isNull() | (F.col("ts_ms") >= F.col("onset_ms") - lead_ms)).drop("onset_ms")


def first_per_kind(signals: DataFrame) -> DataFrame:
    """The timeline: the first signal of each component and kind by time, source and line."""
    w = Window.partitionBy("component", "kind").orderBy(F.col("ts_ms").asc_nulls_last(), source_rank(), "source_line", "seq")
    return signals.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def numbered_ids(signals: DataFrame, by: list[str]) -> DataFrame:
    """Adds id: source-line for the first signal of a line, source-line.n for the n-th after it."""
    rows = row_numbers(signals, [*by, "source", "source_line"], ["seq"], "_n")
    stem, n = F.concat_ws("-", "source", F.col("source_line").cast("string")), F.col("_n") - 1
    return rows.withColumn("id", F.when(n == 0, stem).otherwise(F.concat(stem, F.lit("."), n.cast("string")))).drop("_n")


def carried(rows: DataFrame, by: list[str], order: list[str], columns: list[str], reset: str | None = None) -> DataFrame:
    """Adds carried_<column>: the last non-null value so far in each group, forgotten at rows where reset holds."""
    return last_known(rows, by, order, columns, reset)


def first_last_error(signals: DataFrame) -> DataFrame:
    """(component, first_error_ms, last_error_ms): over anomalies of rank error and more; known times before unknown ones."""
    errors = signals.filter(is_anomaly(F.col("kind"), F.col("severity")) & (rank(F.col("severity")) >= 2))
    return errors.groupBy("component").agg(F.min("ts_ms").alias("first_error_ms"), F.max("ts_ms").alias("last_error_ms"))


def level_counts(signals: DataFrame, by: list[str]) -> DataFrame:
    """(by, errors, warns, infos, total)."""
    r = rank(F.col("severity"))
    return signals.groupBy(*by).agg(F.count_if(r >= 2).alias("errors"), F.count_if(r == 1).alias("warns"), F.count_if(r == 0).alias("infos"), F.count("*").alias("total"))


def kinds_ranked(signals: DataFrame) -> DataFrame:
    """(component, kinds): kinds joined by commas, failures before context, frequent first, then by name. A closed vocabulary bounds the list."""
    counts = signals.groupBy("component", "kind").agg(F.count("*").alias("n"))
    context = F.col("kind").isin("change", "rollout", "alert_resolved", "restart").cast("int")
    items = F.sort_array(F.collect_list(F.struct(context.alias("c"), (-F.col("n")).alias("n"), F.col("kind").alias("k"))))
    return counts.groupBy("component").agg(F.concat_ws(",", F.transform(items, lambda x: x["k"])).alias("kinds"))


def capped(signals: DataFrame, by: list[str], most: int, cited: DataFrame | None = None) -> DataFrame:
    """What a group must keep, and other signals by severity and newest first until it has `most` rows.

    Errors, changes that are more than information, and signals that cited (by, seq)
    names must be kept. Of the others the first `most` of each part of a group are
    found before the group's, so none is sorted whole.
    """
    must = (rank(F.col("severity")) >= 2) | ((F.col("kind") == "change") & (rank(F.col("severity")) >= 1))
    if cited is not None:
        signals = signals.join(cited.select(*by, "seq").distinct().withColumn("_cited", F.lit(True)), [*by, "seq"], "left")
        must = must | F.col("_cited").isNotNull()
    signals = signals.withColumn("_must", must)
    counts = signals.groupBy(*by).agg(F.count_if("_must").alias("_kept"))
    order = [rank(F.col("severity")).desc(), F.desc("ts_ms"), F.col("seq")]
    rest = first_rows(signals.filter("not _must"), by, order, most, spread=F.xxhash64("seq"), place="_rn")
    rest = rest.join(counts, by).filter(F.col("_rn") <= most - F.col("_kept")).drop("_rn", "_kept")
    return signals.filter("_must").unionByName(rest).drop("_must", "_cited")


def handoffs(scalings: DataFrame) -> DataFrame:
    """(component, old, new, ts_ms): a set scaled up and never down while another was scaled down; the earliest."""
    sets = scalings.groupBy("component", "set").agg(F.bool_or(F.col("direction") == "up").alias("up"), F.bool_or(F.col("direction") == "down").alias("down"), F.min("ts_ms").alias("ts_ms"))
    new = sets.filter("up and not down").groupBy("component").agg(F.min_by("set", F.struct("ts_ms", "set")).alias("new"), F.min("ts_ms").alias("ts_ms"))
    old = sets.filter("down").groupBy("component").agg(F.min_by("set", F.struct("ts_ms", "set")).alias("old"))
    return new.join(old, "component").select("component", "old", "new", "ts_ms")


def visible_at(reveals: DataFrame, times: DataFrame) -> DataFrame:
    """(t_ms, visible): how many components have changed by each time: running sums over distinct reveal times, no pairs."""
    steps = reveals.filter("reveal_ms is not null").groupBy(F.col("reveal_ms").alias("t_ms")).agg(F.count("*").alias("n"))
    both = steps.withColumn("asked", F.lit(False)).unionByName(times.select("t_ms", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")))
    points = both.groupBy("t_ms").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))
    return running_sums(points, [], ["t_ms"], {"visible": F.col("n")}).filter("asked").select("t_ms", "visible")


def since(direct: DataFrame, onward: DataFrame) -> DataFrame:
    """(component, since_ms): a component's own first error, else the earliest of those that reached it."""
    other = onward.groupBy("component").agg(F.min("ts_ms").alias("other_ms"))
    own = direct.groupBy("component").agg(F.min("ts_ms").alias("own_ms"))
    return own.join(other, "component", "full_outer").select("component", F.coalesce("own_ms", "other_ms").alias("since_ms"))
