"""Streams against batches: component states with timers, and signals that were sent again."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.sources.adapters import view
from faultline.streaming import incident, live

HOUR = 3_600_000


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def run(df, sink, **more):
    q = df.writeStream.outputMode(more.get("mode", "update")).format("memory").queryName(sink).start()
    q.processAllAvailable()
    q.stop()


def test_states_of_a_stream_equal_the_batch(rocks, sf_dir, tmp_path):
    rnd = random.Random(3)
    real = live.with_instant(view(rocks, sf_dir, "signals").select("component", "ts_ms", "seq", "kind", "severity", "cluster"))
    planted = [("late", t, i, "http_5xx", "error", rnd.choice([None, "east", "west"])) for i, t in enumerate([0, 5 * HOUR, 9 * HOUR, 13 * HOUR, 13 * HOUR + 60_000, 20 * HOUR])]
    planted += [("far", t * 10 * HOUR, i, "http_5xx", "error", None) for i, t in enumerate([1, 2, 3])] + [("one", 7, 1, "oom_killed", "critical", "c")] + [("well", 8, 1, "rollout", "info", "c")]
    base = real.agg(F.min("ts_ms")).first()[0]
    planted = live.with_instant(rocks.createDataFrame(planted, "component string, ts_ms long, seq long, kind string, severity string, cluster string").withColumn("ts_ms", F.col("ts_ms") + base))
    rows = real.unionByName(planted)
    stops = [r.s for r in rows.select(F.expr("percentile_approx(ts_ms, array(0.25, 0.5, 0.75))").alias("s")).collect()][0]
    jitter = F.col("ts_ms") + F.pmod(F.xxhash64("seq", "component"), F.lit(600_000))  # arrival: up to ten minutes out of order
    part = sum(((jitter > s).cast("int") for s in stops), F.lit(0))
    for k in range(4):
        rows.filter(part == k).orderBy(F.rand(k)).coalesce(2).write.parquet(str(tmp_path / f"in/{k}"))
    end = live.with_instant(rocks.createDataFrame([("end", 10**13, 0, "rollout", "info", None)], "component string, ts_ms long, seq long, kind string, severity string, cluster string"))
    end.write.parquet(str(tmp_path / "in/9"))
    where, into = tmp_path / "in", tmp_path / "stream"
    into.mkdir()
    stream = rocks.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(into))
    q = incident.component_states(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    for k in (0, 1, 2, 3, 9):
        for f in sorted((where / str(k)).glob("*.parquet")):
            f.rename(into / f"{k}-{f.name}")
        q.processAllAvailable()
    q.stop()
    got = {}
    for r in rocks.table("states").collect():
        if r.component not in got or r.signals > got[r.component].signals:
            got[r.component] = r
    want = {r.component: r for r in incident.batch_states(rows).collect()}
    got.pop("end", None)
    assert len(want) > 10 and {k: tuple(r) for k, r in got.items()} == {k: tuple(r) for k, r in want.items()}
    assert want["late"].onset_ms - base == 13 * HOUR and want["far"].onset_ms - base == 20 * HOUR and want["well"].onset_ms is None


def test_onset_of_any_prefix_is_that_of_the_batch_rule():
    rnd = random.Random(5)
    for _ in range(200):
        times = sorted(rnd.randrange(0, 30 * HOUR) for _ in range(rnd.randrange(0, 9)))
        left = [t for i, t in enumerate(times) if i + 1 == len(times) or times[i + 1] - t <= HOUR or len(times) - i < 3]
        state = None
        for t in times:
            state = incident.taken(state, [(t, 0, True, None)])
        assert (state or (None, None))[1] == (left[0] if left else None)


def test_signals_sent_again_are_dropped(spark, tmp_path):
    rows = [("a", "x", i % 5, 1_000 * i) for i in range(20)] + [("b", "x", 1, 500)]
    df = live.with_instant(spark.createDataFrame(rows, "component string, kind string, seq long, ts_ms long"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(live.distinct_signals(stream), "once", mode="append")
    assert sorted((r.component, r.seq) for r in spark.table("once").collect()) == sorted((r.component, r.seq) for r in live.distinct_signals(df).collect()) == [*(("a", k) for k in range(5)), ("b", 1)]
