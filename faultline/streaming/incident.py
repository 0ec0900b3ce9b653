"""The state of each component over a stream: what it was last seen with, when its trouble set in, since when it is ill.

State is kept by key with event-time timers. Signals wait in state until the
watermark has passed them and are then taken in the order of time and seq, so what
comes out doesn't depend on the order of arrival within the watermark. A component's
state is a few numbers, and the signals of one watermark delay at most.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import is_anomaly, rank
from ..operators import timeline
from .live import LATE

STATE = "component string, cluster string, onset_ms long, since_ms long, errors long, signals long, last_ms long"
_WAITING = "ts_ms long, seq long, bad boolean, cluster string"
_KNOWN = "cluster string, onset_ms long, settled boolean, error_ms long, since_ms long, errors long, signals long, last_ms long"


def _marked(signals: DataFrame) -> DataFrame:
    bad = is_anomaly(F.col("kind"), F.col("severity")) & (rank(F.col("severity")) >= 2)
    return signals.select("component", "ts", F.col("ts_ms").cast("long").alias("ts_ms"), F.col("seq").cast("long").alias("seq"), F.coalesce(bad, F.lit(False)).alias("bad"), "cluster")


def taken(known: tuple | None, waiting: list[tuple], gap_ms: int = timeline.HOUR_MS) -> tuple:
    """The state after further signals (ts_ms, seq, bad, cluster) in order.

    The onset is the first error that another follows within gap_ms. Until there
    is one, it is the last error but one, as leading errors are dropped only
    while three are left.
    """
    cluster, onset, settled, error, since, errors, signals, last = known or (None, None, False, None, None, 0, 0, None)
    for ts, _, bad, seen in waiting:
        cluster, signals, last = seen if seen is not None else cluster, signals + 1, ts
        if bad:
            since, errors = ts if since is None else since, errors + 1
            if not settled:
                onset = ts if error is None else error
                settled = error is not None and ts - error <= gap_ms
            error = ts
    return cluster, onset, settled, error, since, errors, signals, last


class ComponentState(StatefulProcessor):
    """Signals of one component wait until the watermark passes them; a timer at the earliest takes them in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", _WAITING)
        self._known = handle.getValueState("known", _KNOWN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [Row(ts_ms=r.ts_ms, seq=r.seq, bad=r.bad, cluster=r.cluster) for r in rows]
        if new:
            self._waiting.appendList([tuple(r) for r in new])
            self._handle.registerTimer(min(r.ts_ms for r in new) + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(r) for r in self._waiting.get()), key=lambda r: r[:2]) if self._waiting.exists() else []
        ready, later = [r for r in waiting if r[0] < mark], [r for r in waiting if r[0] >= mark]
        if not ready:
            return
        if later:
            self._waiting.put(later)
            self._handle.registerTimer(later[0][0] + 1)
        else:
            self._waiting.clear()
        known = taken(tuple(self._known.get()) if self._known.exists() else None, ready)
        self._known.update(known)
        cluster, onset, _, _, since, errors, signals, last = known
        yield Row(component=key[0], cluster=cluster, onset_ms=onset, since_ms=since, errors=errors, signals=signals, last_ms=last)

    def close(self) -> None:
        pass


def component_states(signals: DataFrame, late: str = LATE) -> DataFrame:
    """A row per component each time that the watermark passes signals of it; signals: component, ts, ts_ms, seq, kind, severity, cluster.

    The state store must be RocksDB: spark.sql.streaming.stateStore.providerClass. Signals later than the watermark are left out.
    """
    return _marked(signals).withWatermark("ts", late).groupBy("component").transformWithState(ComponentState(), STATE, "Update", "EventTime")


def batch_states(signals: DataFrame) -> DataFrame:
    """The same rows of a whole table: what a stream of it ends with."""
    rows = _marked(signals).filter("component is not null")
    order = F.struct("ts_ms", "seq")
    one = rows.groupBy("component").agg(
        F.max_by("cluster", F.when(F.col("cluster").isNotNull(), order)).alias("cluster"), F.min(F.when(F.col("bad"), F.col("ts_ms"))).alias("since_ms"),
        F.count_if("bad").alias("errors"), F.count("*").alias("signals"), F.max("ts_ms").alias("last_ms"),
    )
    onsets = timeline.onset(rows.filter("bad"), ["component"])
    return one.join(onsets, "component", "left").select("component", "cluster", "onset_ms", "since_ms", "errors", "signals", "last_ms")
