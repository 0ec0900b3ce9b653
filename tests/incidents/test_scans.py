"""Two-level scans, distributed selection, strong components and references against brute force."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators import graph, lookup, scans, selection, spans, timeline
from faultline.operators.orders import STATUSES


@pytest.fixture
def hot(spark, monkeypatch):
    """Rows of which one group has most, cut into chunks of a few rows: component, seq, ts_ms with ties and nulls, seen, kind."""
    monkeypatch.setattr(scans, "CHUNK", 20)
    monkeypatch.setattr(scans, "CHUNKS", 7)
    rnd = random.Random(4)
    rows = [("hot" if i % 3 else rnd.choice(["a", "b", None]), i, rnd.choice([None, *[j * 1_800_000 for j in range(40)], 10**12]), rnd.choice([None, None, None, f"c{i}"]), rnd.choice(["change", *["x"] * 15])) for i in range(900)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "component string, seq long, ts_ms long, seen string, kind string").withColumns({"severity": F.element_at(F.array(*[F.lit(x) for x in ("info", "warn", "error")]), (F.col("seq") % 3 + 1).cast("int")), "source": F.lit("logs"), "source_line": F.col("seq") % 2, "body": F.repeat(F.lit("x"), (F.col("seq") % 9).cast("int"))})


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_a_hot_group_is_scanned_in_chunks(spark, hot):
    chunks = scans.chunked(hot, ["component"], "seq").groupBy("component", "_chunk").count().collect()
    sizes = [r["count"] for r in chunks if r.component == "hot"]
    assert len(sizes) == 7 and max(sizes) < 120 and sum(sizes) == 600
    w = Window.partitionBy("component").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    numbers = scans.row_numbers(hot, ["component"], ["seq"], "n")
    assert rows_of(numbers, "component", "seq", "n") == rows_of(hot.withColumn("n", F.row_number().over(Window.partitionBy("component").orderBy("seq"))), "component", "seq", "n")
    part = hot.withColumn("p", F.sum((F.col("kind") == "change").cast("int")).over(w))
    plain = part.withColumn("carried_seen", F.last("seen", ignorenulls=True).over(Window.partitionBy("component", "p").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    assert rows_of(timeline.carried(hot, ["component"], ["seq"], ["seen"], "kind = 'change'"), "seq", "carried_seen") == rows_of(plain, "seq", "carried_seen")
    ever = hot.withColumns({f"carried_{c}": F.last(c, ignorenulls=True).over(w) for c in ("seen", "ts_ms")})
    assert rows_of(timeline.carried(hot, ["component"], ["seq"], ["seen", "ts_ms"]), "seq", "carried_seen", "carried_ts_ms") == rows_of(ever, "seq", "carried_seen", "carried_ts_ms")
    kept = lookup.within_bytes(hot, ["component"], ["seq"], "body", 500)
    assert rows_of(kept, "seq", "used_bytes") == rows_of(hot.withColumn("used_bytes", F.sum(F.octet_length("body")).over(w)).filter("used_bytes <= 500"), "seq", "used_bytes")


def test_onset_ids_caps_and_replay_of_a_hot_group(spark, hot):
    errors = hot.filter("ts_ms is not null")
    w = Window.partitionBy("component").orderBy("ts_ms", "seq")
    plain = errors.withColumns({"next": F.lead("ts_ms").over(w), "left": F.count("*").over(w.rowsBetween(0, Window.unboundedFollowing))})
    plain = plain.filter("next is null or next - ts_ms <= 3600000 or left < 3").groupBy("component").agg(F.min("ts_ms").alias("onset_ms"))
    assert rows_of(timeline.onset(errors, ["component"]), "component", "onset_ms") == rows_of(plain, "component", "onset_ms")
    ids = rows_of(timeline.numbered_ids(hot, ["component"]), "component", "seq", "id")
    assert len({(c, i) for c, _, i in ids}) == len(ids) and ("hot", 1, "logs-1") in ids and ("hot", 5, "logs-1.1") in ids
    cited = spark.createDataFrame([("hot", 0 + k * 3) for k in range(1, 150)], "component string, seq long").join(hot.filter("severity = 'info'").select("component", "seq"), ["component", "seq"])
    got = timeline.capped(hot.filter("component is not null"), ["component"], 350, cited).select("component", "seq", "severity", "kind", "ts_ms").collect()
    here = {r.seq: r for r in got if r.component == "hot"}
    every = {r.seq: r for r in hot.filter("component = 'hot'").collect()}
    must = {s for s, r in every.items() if r.severity == "error" or (r.kind == "change" and r.severity == "warn")} | {r.seq for r in cited.collect()}
    assert must <= set(here) and len(here) == max(350, len(must))
    rest = sorted((r for s, r in every.items() if s not in must), key=lambda r: (-["info", "warn"].index(r.severity), -(r.ts_ms if r.ts_ms is not None else -1), r.seq))
    assert set(here) == must | {r.seq for r in rest[: 350 - len(must)]}
    reveals = hot.select(F.col("ts_ms").alias("reveal_ms"))
    times = spark.range(0, 60).select((F.col("id") * 1_500_000).alias("t_ms"))
    known = [r.reveal_ms for r in reveals.collect() if r.reveal_ms is not None]
    assert rows_of(timeline.visible_at(reveals, times), "t_ms", "visible") == sorted(((t, sum(x <= t for x in known)) for t in range(0, 90_000_000, 1_500_000)), key=repr)


def test_ranks_by_selection(spark, monkeypatch):
    monkeypatch.setattr(selection, "BUCKETS", 4)
    rnd = random.Random(1)
    values = {"one": [5.0], "same": [2.5] * 40, "ties": [1.0] * 30 + [2.0] * 30 + [9.0], "wide": [10.0**k for k in range(-9, 12)], "many": [rnd.lognormvariate(0, 6) for _ in range(501)], "minus": [-x for x in range(8)]}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("many", None), (None, 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    n = F.col("n")
    got = {r.k: r for r in selection.ranked_values(df, ["k"], "v", {"low": F.floor((n + 1) / 2), "high": F.floor(n / 2) + 1, "p95": F.floor((n * 95 + 99) / 100), "top": n}).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        s = sorted(map(float, vs))
        assert (got[k].low, got[k].high, got[k].p95, got[k].top, got[k].n) == (s[(len(s) + 1) // 2 - 1], s[len(s) // 2], s[math.ceil(len(s) * 0.95) - 1], s[-1], len(s))


def test_no_window_over_values(spark, sf_dir):
    from faultline.sources.adapters import view

    s = view(spark, sf_dir, "spans")
    for df in (spans.edge_health(spans.derived_edges(s)), spans.slow_spans(s)):
        assert "windowspecdefinition(" not in df._jdf.queryExecution().optimizedPlan().toString().replace("windowspecdefinition(l_orderkey", "")  # the adapter numbers the spans of a trace


def test_strong_components_and_layers(spark):
    linked = [("x", "y"), ("y", "x"), ("a", "b"), ("b", "a"), ("y", "a")]
    assert dict(graph.layers(spark.createDataFrame(linked, "from string, to string")).collect()) == {"x": 0, "y": 1, "a": 2, "b": 3}
    rnd = random.Random(2)
    for n, m in ((6, 8), (14, 20), (14, 40), (9, 0), (0, 0)):
        edges = sorted({(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(m)}) if n else [*linked, ("y", "m"), ("m", "a"), ("z", "z"), ("a", "z")]
        reach = {a: {a} for e in edges for a in e}
        while True:
            new = {a: r | {t for f, t in edges if f in r} for a, r in reach.items()}
            if new == reach:
                break
            reach = new
        df = spark.createDataFrame(edges, "from string, to string")
        want = {a: max(b for b in reach[a] if a in reach[b]) for a in reach if any(b != a and a in reach[b] for b in reach[a])}
        assert dict(graph.strong_components(df).collect()) == want
        dropped = {(f, t) for f, t in edges if t <= f and f in reach[t]}
        assert {tuple(r) for r in graph.acyclic(df).collect()} == set(edges) - dropped


def test_references(spark):
    rnd = random.Random(3)
    rows = [(f"{t}:c{c}/{ns}/{name}", name, ns or None, rnd.choice(STATUSES), rnd.random()) for t in ("service", "node") for c in (1, 2) for ns in ("shop", "") for name in ("cart-api", "Cart", "orders", "a")]
    rows += [("odd", "odd", None, "healthy", 0.1), ("service:x/y/z/w", "w", "z", "failing", 0.5)]
    refs = ["service:c1/shop/cart-api", "CART", "shop/orders", "cart-api", "z/w", "c2/shop/Cart", "art", "a", "o", "/w", "ode:", "nothing", "c1//a", "", "dd", ":c", "service:c1/shop/orders"]
    components = spark.createDataFrame(rows, "id string, name string, namespace string, status string, impact double")
    got = {r.ref: (r.id, r.others) for r in lookup.resolved(components, spark.createDataFrame([(r,) for r in refs], "ref string")).collect()}

    def want(ref):
        low, tiers = ref.lower(), [[], [], []]
        tail = low.split(":", 1)[1] if ":" in low else low
        for r in rows:
            lid, name = r[0].lower(), r[1].lower()
            bare = lid.split(":", 1)[1] if ":" in lid else lid
            if r[0] == ref:
                tiers[0].append(r)
            elif low in (name, lid, f"{(r[2] or '').lower()}/{name}") or bare == tail or lid.endswith("/" + tail):
                tiers[1].append(r)
            elif low in lid:
                tiers[2].append(r)
        hits = next((t for t in tiers if t), None) if ref else None
        return hits and (min(hits, key=lambda r: (STATUSES.index(r[3]), -r[4], r[0]))[0], len(hits) - 1)

    assert got == {r: want(r) for r in refs if want(r)}
    plan = lookup.resolved(components, components.select(F.col("name").alias("ref")))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
