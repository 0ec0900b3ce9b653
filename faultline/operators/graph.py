"""The dependency graph as an edge table: failing sets, reachability, deepest failures, impact, layers, alias closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .spans import DEGRADED, FAILING

# Impact of a status.
IMPACT = {"root": 0.9, "failing": 0.75, "degraded": 0.45, "at-risk": 0.2, "healthy": 0.0}


def failing_set(edges: DataFrame, own_errors: DataFrame) -> DataFrame:
    """Components with errors of their own, or with an inbound traced edge that fails often."""
    return own_errors.select("component").union(edges.filter(F.col("error_rate") >= FAILING).select(F.col("to").alias("component"))).distinct()


def at_risk(edges: DataFrame, failing: DataFrame) -> DataFrame:
    """(component, hops): components outside the failing set that reach it in one or two calls."""
    f = failing.select(F.col("component").alias("to"))
    links = edges.select("from", "to").distinct()
    one = links.join(f, "to", "left_semi").select(F.col("from").alias("component"), F.lit(1).alias("hops"))
    two = links.join(one.select(F.col("component").alias("to")).distinct(), "to", "left_semi").select(F.col("from").alias("component"), F.lit(2).alias("hops"))
    return one.union(two).join(failing, "component", "left_anti").groupBy("component").agg(F.min("hops").alias("hops"))


def deepest_failing(edges: DataFrame, failing: DataFrame) -> DataFrame:
    """Failing components that a failing edge leads to and that call no other failing one."""
    into = edges.filter(F.col("error_rate") >= FAILING).select(F.col("to").alias("component"))
    out = edges.select(F.col("from").alias("component"), F.col("to").alias("callee")).join(failing.select(F.col("component").alias("callee")), "callee", "left_semi")
    return failing.join(into, "component", "left_semi").join(out.select("component"), "component", "left_anti").select("component")


def statuses(components: DataFrame, edges: DataFrame, failing: DataFrame, warned: DataFrame) -> DataFrame:
    """(component, status): failing over degraded (warnings, or calls into failing ones that fail) over at-risk over healthy."""
    calls_bad = edges.filter(F.col("error_rate") >= DEGRADED).join(failing.select(F.col("component").alias("to")), "to", "left_semi").select(F.col("from").alias("component"))
    flag = lambda df, name: df.select("component").distinct().withColumn(name, F.lit(True))
    out = components.select("component").distinct()
    for df, name in ((failing, "failing"), (warned.select("component").union(calls_bad), "degraded"), (at_risk(edges, failing), "risk")):
        out = out.join(flag(df, name), "component", "left")
    status = F.when(F.col("failing"), "failing").when(F.col("degraded"), "degraded").when(F.col("risk"), "at-risk").otherwise("healthy")
    return out.select("component", status.alias("status"))


def impact(components: DataFrame) -> DataFrame:
    """Adds impact: base of the status, 0.05 if user facing, up to 0.05 by share of the most errors; two places."""
    most = components.agg(F.max("errors").alias("most"))
    base = F.create_map(*[F.lit(x) for kv in IMPACT.items() for x in kv])[F.col("status")]
    share = F.coalesce(F.try_divide(F.col("errors"), F.col("most")), F.lit(0.0))
    score = base + F.when(F.col("user_facing"), 0.05).otherwise(0.0) + 0.05 * share
    return components.crossJoin(F.broadcast(most)).withColumn("impact", F.floor(score * 100 + 0.5) / 100).drop("most")


def healthy_siblings(components: DataFrame) -> DataFrame:
    """(component, cluster, sibling_cluster): unhealthy components whose name is healthy in another cluster."""
    ill = components.filter("status <> 'healthy'").select("name", "cluster")
    well = components.filter("status = 'healthy'").select("name", F.col("cluster").alias("sibling_cluster"))
    return ill.join(well, "name").filter("cluster <> sibling_cluster")


def alias_closure(aliases: DataFrame) -> DataFrame:
    """(alias, id): the end of each alias chain, by pointer doubling; members of a cycle stop at the least name in it."""
    now = cut(aliases.groupBy("alias").agg(F.min("id").alias("id")))
    hops = 1
    while True:
        step = now.select(F.col("alias").alias("id"), F.col("id").alias("next"))
        new = cut(now.join(step, "id", "left").select("alias", F.coalesce("next", "id").alias("id"), (F.col("next").isNotNull() & (F.col("next") != F.col("id"))).alias("moved")))
        hops *= 2
        if new.filter("moved").isEmpty():
            return new.select("alias", "id")
        if hops > 2 * now.count():  # longer than any chain: what still moves is a cycle
            end = new.join(new.select(F.col("alias").alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.min("alias").alias("least"))
            return new.join(end, "id", "left").select("alias", F.coalesce("least", "id").alias("id"))
        now = new.select("alias", "id")


def _trimmed(links: DataFrame) -> DataFrame:
    """links (from, to) without those that no cycle can hold, as nothing leads to their start or on from their end; round by round."""
    n = links.count()
    while n:
        entered, left = links.select(F.col("to").alias("from")).distinct(), links.select(F.col("from").alias("to")).distinct()
        links = cut(links.join(entered, "from", "left_semi").join(left, "to", "left_semi").select("from", "to"))
        if (now := links.count()) == n:
            break
        n = now
    return links


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, root): the nodes that lie on cycles, and the greatest node of those that they reach and are reached by.

    Every node takes the greatest name among those that reach it; within one name,
    what reaches the bearer of the name is its component. Components found are taken
    out and the rest goes round again, without what lies on no cycle.
    """
    rest = _trimmed(cut(edges.select("from", "to").filter("from <> to").distinct()))
    out = rest.select(F.col("from").alias("node"), F.col("from").alias("root")).limit(0)
    while not rest.isEmpty():
        named = cut(rest.select(F.col("from").alias("node")).union(rest.select("to")).distinct().withColumn("root", F.col("node")))
        while True:
            came = rest.join(named.select(F.col("node").alias("from"), "root"), "from").groupBy(F.col("to").alias("node")).agg(F.max("root").alias("came"))
            new = cut(named.join(came, "node", "left").select("node", F.greatest("root", "came").alias("root"), (F.col("came") > F.col("root")).alias("moved")))
            named = new.select("node", "root")
            if new.filter("moved").isEmpty():
                break
        end = lambda k: named.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
        inside = cut(rest.join(end("from"), "from").join(end("to"), "to").filter("root_from = root_to").select("from", "to", F.col("root_to").alias("root")))
        found = front = cut(named.filter("node = root"))
        while not front.isEmpty():
            back = inside.join(front.select(F.col("node").alias("to")), "to", "left_semi").select(F.col("from").alias("node"), "root").distinct()
            front = cut(back.join(found, "node", "left_anti"))
            found = cut(found.union(front))
        out = out.union(found)
        gone = lambda k: found.select(F.col("node").alias(k))
        rest = _trimmed(cut(rest.join(gone("from"), "from", "left_anti").join(gone("to"), "to", "left_anti").select("from", "to")))
    many = out.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    return out.join(many, "root", "left_semi").select("node", "root")  # what lies between two cycles bears its own name alone


def acyclic(edges: DataFrame) -> DataFrame:
    """(from, to): the edges without those that close a cycle: of the edges inside a strong component those that don't go up in the order of names. All others stay."""
    links = cut(edges.select("from", "to").distinct())
    parts = cut(strong_components(links))
    end = lambda k: parts.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    inside = links.join(end("from"), "from").join(end("to"), "to").filter("root_from = root_to")
    closing = inside.filter(F.col("from") >= F.col("to")).select("from", "to").union(links.filter(F.col("from") == F.col("to")))
    return links.join(closing, ["from", "to"], "left_anti")


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer): the longest path that leads to each node, once cycles are broken; a round passes on what the round before raised."""
    links = cut(acyclic(edges))
    state = cut(edges.select(F.col("from").alias("node")).union(edges.select("to")).distinct().select("node", F.lit(0).alias("layer")))
    front = state
    while True:
        raised = links.join(front.withColumnRenamed("node", "from"), "from").groupBy(F.col("to").alias("node")).agg((F.max("layer") + 1).alias("up"))
        new = cut(state.join(raised, "node", "left").select("node", F.greatest("layer", "up").alias("layer"), (F.col("up") > F.col("layer")).alias("moved")))
        state, front = new.select("node", "layer"), new.filter("moved").select("node", "layer")
        if front.isEmpty():
            return state


def edge_dns_only(edges: DataFrame, dns_spans: DataFrame) -> DataFrame:
    """Edges with dns_only: every error on the edge is a failed name lookup."""
    n = dns_spans.groupBy("from", "to").agg(F.count("*").alias("dns"))
    return edges.join(n, ["from", "to"], "left").withColumn("dns_only", (F.col("errors") > 0) & (F.coalesce("dns", F.lit(0)) >= F.col("errors"))).drop("dns")


def reveal_times(status_since: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, reveal_ms): the earliest time at which a component or one within two calls of it changed."""
    own = status_since.select("component", "since_ms")
    links = edges.select("from", "to").distinct()
    one = links.join(own.withColumnRenamed("component", "to"), "to").select(F.col("from").alias("component"), "since_ms")
    two = links.join(one.groupBy("component").agg(F.min("since_ms").alias("since_ms")).withColumnRenamed("component", "to"), "to").select(F.col("from").alias("component"), "since_ms")
    return own.union(one).union(two).groupBy("component").agg(F.min("since_ms").alias("reveal_ms"))


def worst_first(df: DataFrame, partition: list[str], most: int, *order) -> DataFrame:
    """The first `most` rows of each partition in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("_rn") <= most).drop("_rn")
