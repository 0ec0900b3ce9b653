"""Error-budget arithmetic: burn rates, alert rows, projections, series, severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import half_up

# Alert rows: share of the budget, long and short window in hours, what it does.
ROWS = [(0.02, 1.0, 5 / 60, "page"), (0.05, 6.0, 0.5, "page"), (0.10, 72.0, 6.0, "ticket")]
# Minutes ahead that are projected, points of the series, minutes after now that it covers.
AHEAD, POINTS, COVERED = [0, 30, 120], 25, 120


def normalised_slo(target: Column, window_days: Column, rpm: Column, spent: Column) -> Column:
    """Struct of slo, window_days, rpm and spent; targets over 1 are percentages, what makes no sense is the default."""
    t = F.when(target > 1, target / 100).otherwise(target)
    return F.struct(
        F.when((t > 0) & (t < 1), t).otherwise(0.999).alias("slo"),
        F.when((window_days > 0) & (window_days <= 366), window_days.cast("double")).otherwise(30.0).alias("window_days"),
        F.when(rpm > 0, rpm.cast("double")).otherwise(1000.0).alias("rpm"),
        F.least(F.greatest(F.coalesce(spent, F.lit(0.0)), F.lit(0.0)), F.lit(100.0)).alias("spent"),
    )


def error_ratio(override: Column, alert: Column, traces: Column, log_errors: Column, log_requests: Column) -> Column:
    """Struct of ratio and source: stated, from a burn alert, from entry traces, from 20 and more logged requests, else 1 %."""
    logs = F.when(log_requests >= 20, log_errors / log_requests)
    chosen = [("override", override), ("alert", alert), ("traces", traces), ("logs", logs)]
    ratio = F.coalesce(*[c for _, c in chosen], F.lit(0.01))
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in chosen], F.lit("default"))
    return F.struct(ratio.cast("double").alias("ratio"), source.alias("source"))


def burn(ratio: Column, slo: Column) -> Column:
    return ratio / (1 - slo)


def consumed_pct(burn_rate: Column, minutes: Column, window_days: Column) -> Column:
    return burn_rate * minutes / (window_days * 1440) * 100


def exhaustion_hours(burn_rate: Column, remaining_pct: Column, window_days: Column) -> Column:
    """Hours until nothing is left at this rate; null without burn."""
    return F.when(burn_rate > 0, remaining_pct / 100 * window_days * 24 / burn_rate)


def alert_rows(budgets: DataFrame) -> DataFrame:
    """Of (id, burn, window_days): the three alert rows with threshold, would_fire and fires_after_min."""
    row = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.lit(h).alias("long_h"), F.lit(a).alias("action")) for s, h, _, a in ROWS])).alias("row")
    rows = budgets.select("id", "burn", "window_days", row).select("id", "burn", "row.share", "row.long_h", "row.action", (F.col("row.share") * F.col("window_days") * 24 / F.col("row.long_h")).alias("threshold"))
    fire = F.col("burn") >= F.col("threshold") - 1e-9
    after = half_up(F.col("long_h") * 60 * F.col("threshold") / F.col("burn"), 2)
    return rows.select("id", "share", "long_h", "action", half_up(F.col("threshold"), 4).alias("threshold"), fire.alias("would_fire"), F.when(fire, after).alias("fires_after_min"))


def projections(budgets: DataFrame) -> DataFrame:
    """Of (id, burn, minutes, window_days, spent): consumed and remaining percent now and later."""
    rows = budgets.select("*", F.explode(F.array(*[F.lit(float(a)) for a in AHEAD])).alias("ahead_min"))
    used = consumed_pct(F.col("burn"), F.col("minutes") + F.col("ahead_min"), F.col("window_days"))
    return rows.select("id", "ahead_min", half_up(used, 3).alias("consumed_pct"), half_up(F.greatest(F.lit(0.0), 100 - F.col("spent") - used), 3).alias("remaining_pct"))


def series(budgets: DataFrame) -> DataFrame:
    """25 evenly spaced points from the start to two hours after now."""
    rows = budgets.select("*", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("point"))
    minute = (F.col("minutes") + COVERED) * F.col("point") / (POINTS - 1)
    left = F.greatest(F.lit(0.0), 100 - F.col("spent") - consumed_pct(F.col("burn"), minute, F.col("window_days")))
    return rows.select("id", "point", half_up(minute, 2).alias("minute"), half_up(left, 3).alias("remaining_pct"))


def severity_level(burn_rate: Column, window_days: Column, user_facing_failing: Column, any_failing: Column, assumed: Column) -> Column:
    """SEV1 to SEV4 by the rescaled thresholds of the first two rows; an assumed ratio never raises it."""
    t1, t2 = (F.lit(s * 24 / h) * window_days for s, h, _, _ in ROWS[:2])
    known = ~assumed
    return F.when(known & user_facing_failing & (burn_rate >= t1), "SEV1").when(known & (burn_rate >= t2), "SEV2").when(any_failing, "SEV3").otherwise("SEV4")


def saved_pct(burn_rate: Column, eta_min: Column, window_days: Column, effect: Column) -> Column:
    """Budget that a mitigation saves over the next two hours."""
    return consumed_pct(burn_rate, F.greatest(F.lit(0.0), F.lit(120.0) - eta_min), window_days) * effect


def requests(ratio: Column, slo: Column, rpm: Column, minutes: Column, window_days: Column) -> Column:
    """Struct of bad and budget: requests that failed so far, and that may fail in the window."""
    return F.struct(half_up(ratio * rpm * minutes).cast("long").alias("bad"), half_up((1 - slo) * rpm * window_days * 1440).cast("long").alias("budget"))


def alert_states(budgets: DataFrame) -> DataFrame:
    """Of (id, burn, minutes, window_days, observed_min, observed_burn and others): the three alert rows with threshold, above, observed, modelled, state and fires_in_min.

    observed_min and observed_burn are the long window and rate of a burn alert that fires, null if unknown.
    """
    row = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("share"), F.lit(h).alias("long_h")) for i, (s, h, _, _) in enumerate(ROWS)])).alias("row")
    rows = budgets.select("*", row).select("*", "row.place", "row.long_h", (F.col("row.share") * F.col("window_days") * 24 / F.col("row.long_h")).alias("threshold")).drop("row")
    above = (F.col("burn") > 0) & (F.col("burn") >= F.col("threshold") - 1e-9)
    observed = F.coalesce((F.abs(F.col("observed_min") - F.col("long_h") * 60) < 1) & (F.col("observed_burn") >= F.col("threshold") - 1e-9), F.lit(False))
    rows = rows.withColumns({"above": above, "observed": observed, "fires_after_min": F.when(above, half_up(F.col("long_h") * 60 * F.col("threshold") / F.col("burn"), 2))})
    rows = rows.withColumn("modelled", F.col("above") & F.coalesce(F.col("minutes") >= F.col("fires_after_min") - 1e-9, F.lit(False)))
    state = F.when(F.col("observed"), "firing-observed").when(F.col("modelled"), "firing-estimate").when(F.col("above"), "pending").otherwise("not-at-this-burn")
    return rows.withColumns({"state": state, "fires_in_min": F.when(F.col("above"), half_up(F.greatest(F.lit(0.0), F.col("fires_after_min") - F.col("minutes")), 2))})


def notes(budgets: DataFrame) -> DataFrame:
    """(id, note): what a firing burn alert says against the model: the change is too recent for it, or errors began earlier; or the page is still to come.

    budgets: as for alert_states, with since_change_min (null if unknown).
    """
    rows = alert_states(budgets)
    seen = F.col("observed") | (F.col("observed_min").isNull() & F.coalesce(F.col("observed_burn") >= F.col("threshold") - 1e-9, F.lit(False)))
    first = F.min(F.when(seen, F.struct("place", "modelled", F.coalesce("fires_after_min", F.lit(0.0)).alias("after")))).alias("early")
    page = F.bool_or((F.col("place") == 0) & F.col("above") & ~F.col("modelled") & ~F.col("observed")).alias("waits")
    g = rows.groupBy("id").agg(first, page, F.min("since_change_min").alias("since"))
    early = F.col("early").isNotNull() & ~F.coalesce(F.col("early.modelled"), F.lit(True))
    recent = F.coalesce(F.col("since") < F.col("early.after"), F.lit(False))
    return g.select("id", F.when(early & recent, "change-too-recent").when(early, "started-earlier").when(F.col("waits"), "page-pending").alias("note"))
