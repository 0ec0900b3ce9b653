"""Every query beside its DuckDB oracle, at the smallest size; streams against batches; the library without llm."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from faultline.operators import budget, graph, timeline
from faultline.plans import catalog, catalog_causes, catalog_display, catalog_forms, catalog_joins, catalog_lookups, catalog_manifests, catalog_orders, catalog_readers, catalog_scalars  # noqa: F401  each registers its queries
from faultline.sources import certificates
from faultline.sources.adapters import view
from faultline.streaming import live
from tools import oracle

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    assert oracle.compare(catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(catalog.ORACLES[name]).df()) == ""


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    s = live.with_instant(view(spark, sf_dir, "signals").select("seq", "ts_ms", "component", "severity", "kind")).orderBy("ts_ms")
    s.repartition(1).sortWithinPartitions("ts_ms").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in"))
    q = live.counts(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("live_counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("live_counts").collect()) == sorted(live.counts(s).collect())


def test_budget_closed_forms(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first().r
    thirty = F.lit(30.0)
    assert abs(one(budget.consumed_pct(F.lit(14.4), F.lit(60.0), thirty)) - 2) < 1e-9
    assert abs(one(budget.consumed_pct(F.lit(6.0), F.lit(360.0), thirty)) - 5) < 1e-9
    assert abs(one(budget.consumed_pct(F.lit(1.0), F.lit(4320.0), thirty)) - 10) < 1e-9
    assert abs(one(budget.exhaustion_hours(F.lit(1000.0), F.lit(100.0), thirty)) * 60 - 43.2) < 1e-9
    assert tuple(one(budget.normalised_slo(F.lit(99.9), F.lit(900), F.lit(-1), F.lit(200.0)))) == pytest.approx((0.999, 30.0, 1000.0, 100.0))


def test_late_outlier_is_dropped_once(spark):
    hour = 3_600_000
    rows = [("a", i * 1000) for i in range(40)] + [("a", 100 * hour), ("a", 100 * hour), ("b", 0), ("b", 100 * hour)]
    got = dict(timeline.latest_clock(spark.createDataFrame(rows, "k string, ts_ms long"), ["k"]).collect())
    assert got == {"a": 39_000, "b": 100 * hour}
    many = rows[:40] + [("a", 100 * hour)] * 3
    assert dict(timeline.latest_clock(spark.createDataFrame(many, "k string, ts_ms long"), ["k"]).collect()) == {"a": 100 * hour}


def test_aliases_with_a_cycle_end(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")]
    got = dict(graph.alias_closure(spark.createDataFrame(rows, "alias string, id string")).collect())
    assert (got["a"], got["b"], got["c"]) == ("d", "d", "d")
    edges = [("in", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "out"), ("s", "s"), ("in", "out")]
    got = dict(graph.layers(spark.createDataFrame(edges, "from string, to string")).collect())
    assert got == {"in": 0, "x": 1, "y": 2, "z": 3, "out": 4, "s": 0}


def test_certificates_and_misplaced_panes(spark):
    text = "Name:         web-tls\nStatus:\n  Not After:  2025-10-09T08:53:20Z\n  Failed Issuance Attempts: 3\nACME order failed: rate limit\nnotAfter=Oct  9 08:53:20 2025 GMT"
    row = certificates.certificates(spark.createDataFrame([("i", text), ("j", "x"), ("k", None)], "incident_id string, text string")).collect()
    assert [(r.name, r.not_after_ms, r.failed_attempts, r.issuer_line) for r in row] == [("web-tls", 1760000000000, 3, 5)]
    panes = spark.createDataFrame([("i", "logs", '{"resourceSpans": []}'), ("i", "alerts", "[FIRING:1] X"), ("i", "helm", "")], "incident_id string, source string, text string")
    assert [tuple(r) for r in certificates.misplaced(panes).collect()] == [("i", "logs", "traces")]


def test_library_stands_without_llm(tmp_path):
    subprocess.run(["cp", "-r", str(ROOT / "faultline"), str(ROOT / "__spark_entry__.py"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "faultline" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'edge_health' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"}, check=True)
