"""Names of pods, workloads, hosts and components: Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import required
from .times import bound

# Shapes of generated names: deployment, daemon set, stateful set, replica set; letters of generated suffixes, where a digit anywhere also tells.
_DEPLOYMENT = r"^(.+)-([a-z0-9]{8,10})-([a-z0-9]{5})\z"
_DAEMON = r"^(.+)-([a-z0-9]{5})\z"
_STATEFUL = r"^(.+)-(\d{1,4})\z"
_REPLICA_SET = r"^(.+)-([a-z0-9]{8,10})\z"
_GENERATED = r"^[bcdfghjklmnpqrstvwxz2456789]+\z|\d"


def norm(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "^[\"']|[\"']\\z", ""))


def pod_owner(pod: Column) -> Column:
    """Struct of workload, controller and replica_set of a pod's name."""
    p = norm(pod)
    part = lambda pattern, i: F.regexp_extract(p, pattern, i)
    deployed = p.rlike(_DEPLOYMENT) & part(_DEPLOYMENT, 2).rlike(_GENERATED)
    daemon = p.rlike(_DAEMON) & part(_DAEMON, 2).rlike(_GENERATED)
    stateful = p.rlike(_STATEFUL)
    return F.struct(
        F.when(deployed, part(_DEPLOYMENT, 1)).when(daemon, part(_DAEMON, 1)).when(stateful, part(_STATEFUL, 1)).otherwise(p).alias("workload"),
        F.when(deployed, "Deployment").when(daemon, "DaemonSet").when(stateful, "StatefulSet").alias("controller"),
        F.when(deployed, F.concat_ws("-", part(_DEPLOYMENT, 1), part(_DEPLOYMENT, 2))).alias("replica_set"),
    )


def replica_set_owner(name: Column) -> Column:
    p = norm(name)
    return F.when(p.rlike(_REPLICA_SET) & F.regexp_extract(p, _REPLICA_SET, 2).rlike(_GENERATED), F.regexp_extract(p, _REPLICA_SET, 1)).otherwise(p)


def component_type(name: Column) -> Column:
    """Struct of type and role by name: infra, ingress service, datastore, else service."""
    return type_of(norm(name))


def type_of(n: Column) -> Column:
    """component_type of a name that norm has been over."""
    infra, ingress, store = n.rlike(V.CORE_DNS) | n.rlike(V.INFRA), n.rlike(V.INGRESS), n.rlike(V.DATASTORE) & ~n.rlike(V.NOT_DATASTORE)
    type_ = F.when(infra, "infra").when(ingress, "service").when(store, "datastore").otherwise("service")
    return F.struct(type_.alias("type"), F.when(~infra & ingress, "ingress").alias("role"))


def component_id(kind: Column, cluster: Column, namespace: Column, name: Column) -> Column:
    """type:cluster/namespace/name; the cluster's DNS has one home, nodes have no namespace."""
    n, c = norm(name), F.coalesce(cluster, F.lit("cluster-1"))
    ns = F.when(kind == "node", "").otherwise(F.coalesce(namespace, F.lit("default")))
    plain = F.concat(F.coalesce(kind, F.lit("service")), F.lit(":"), c, F.lit("/"), ns, F.lit("/"), n)
    return F.when((kind == "infra") & n.rlike(V.CORE_DNS), F.concat(F.lit("infra:"), c, F.lit("/kube-system/coredns"))).otherwise(plain)


def parse_id(component: Column) -> Column:
    pattern = r"^([a-z]+):([^/]*)/([^/]*)/(.*)\z"
    fields = [F.regexp_extract(component, pattern, i + 1).alias(k) for i, k in enumerate(("type", "cluster", "namespace", "name"))]
    return F.when(component.rlike(pattern), F.struct(*fields))


def host_parts(host: Column) -> Column:
    """Struct of name, namespace and external of a host or address; null for IP addresses and localhost."""
    h = F.regexp_replace(F.regexp_replace(norm(host), r"^[a-z][a-z0-9+.-]*://", ""), r"[:/].*\z", "")
    service = r"^([a-z0-9][a-z0-9-]*)\.([a-z0-9][a-z0-9-]*)\.svc(\.[a-z0-9.-]+)?\z"
    none = (h == "") | (h == "localhost") | h.rlike(r"^\d{1,3}(\.\d{1,3}){3}\z")
    inside = h.rlike(service)
    out = F.struct(
        F.when(inside, F.regexp_extract(h, service, 1)).otherwise(h).alias("name"),
        F.when(inside, F.regexp_extract(h, service, 2)).alias("namespace"),
        (~inside & h.contains(".")).alias("external"),
    )
    return F.when(~none, out)


# Shapes in which a text names the dependency that it waits for, in order, and words that are no names.
TARGETS = [
    r"(?i)\b\d{1,3}(?:\.\d{1,3}){3}:\d{2,5} \(([a-z0-9][a-z0-9.-]*[a-z0-9])\)",
    r"(?i)\b([a-z0-9][a-z0-9-]*\.[a-z0-9][a-z0-9-]*\.svc(?:\.cluster\.local)?)\b",
    r"(?i)\blookup ([a-z0-9][a-z0-9.-]*[a-z0-9])",
    r"(?i)\bdial (?:tcp|udp)\d? ([a-z][a-z0-9.-]*[a-z0-9]):\d+",
    r"(?i)\b(?:https?|grpcs?|postgres(?:ql)?|mysql|redis|amqps?|mongodb(?:\+srv)?|nats|kafka)://(?:[^@\s/]+@)?([a-z0-9][a-z0-9.-]*[a-z0-9])",
    r"(?i)\b(?:upstream|host|server|peer|target|backend|calling|call to|connect(?:ing)? to|request to|requests to)[=: \"']+([a-z][a-z0-9-]*(?:\.[a-z0-9-]+)*)",
    r"(?i)\b([a-z][a-z0-9]*-[a-z0-9-]+|[a-z]+(?:sql|gres|redis|mongo|kafka|rabbitmq|db))(?:\.[a-z0-9-]+)*:\d{2,5}\b",
]
NO_TARGETS = "localhost tcp udp http https the a an error errors err fatal failed failure closed returned responded unavailable timeout not is was with for from to".split()
CODE_FILES = r"(?i)\.(go|py|js|ts|java|kt|rb|rs|c|cc|cpp|h|php|scala|cs|swift)\z"


def target_in(text: Column) -> Column:
    """host_parts of the first name in text that can be a dependency. A shape is looked for where one of its required texts is found; a name's parts are computed once."""

    def named(t: Column) -> Column:
        possible = [reduce(lambda a, x: a | x, [t["low"].contains(x) for x in required(p)], F.lit(not required(p))) for p in TARGETS]
        found = F.array(*[F.when(c, F.regexp_extract(t["text"], p, 1)) for c, p in zip(possible, TARGETS, strict=True)])
        hosts = F.transform(F.filter(found, lambda x: (x != "") & ~x.rlike(CODE_FILES)), host_parts)
        return F.get(F.filter(hosts, lambda h: h.isNotNull() & (F.length(h["name"]) > 1) & ~h["name"].isin(NO_TARGETS)), F.lit(0))

    return bound(F.struct(text.alias("text"), F.lower(text).alias("low")), named)


def fnv_id(text: Column) -> Column:
    """FNV-1a of a text's characters in base 36."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.when(c == 0, h).otherwise((h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295).cast("long"))))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def image_tag(image: Column) -> Column:
    """The tag of an image reference, null if it has none."""
    tag = F.regexp_extract(F.regexp_replace(image, r"@.*\z", ""), r":([^:/]+)\z", 1)
    return F.when(tag != "", tag)


def chart_release(chart: Column) -> Column:
    """A chart's name without its version."""
    return F.regexp_replace(chart, r"-v?\d+(?:\.\d+)*(?:[-+][\w.+-]*)?\z", "")


def entity_hint(name: Column, namespace: Column, cluster: Column, pod: Column | None = None, node: Column | None = None, kind: Column | None = None) -> Column:
    """Struct of id, type, role, name, cluster, cluster_known, namespace, ns_known and controller of what a line names; null without a name.

    A pod stands for its workload, a node for itself; where a name tells of infrastructure or a store, that outweighs a stated service.
    """
    none = F.lit(None).cast("string")
    pod, node, kind = (none if x is None else x for x in (pod, node, kind))
    some = lambda c: F.nullif(norm(c), F.lit(""))
    given = F.struct(some(name).alias("name"), some(pod).alias("pod"), some(node).alias("node"), some(namespace).alias("namespace"), F.nullif(cluster, F.lit("")).alias("cluster"), kind.alias("kind"))

    def owned(g: Column) -> Column:
        owner = F.when(g["pod"].isNotNull() & g["name"].isNull(), pod_owner(g["pod"]))
        return bound(owner, lambda o: bound(F.coalesce(g["name"], o["workload"], g["node"]), lambda own: bound(component_type(own), lambda told: placed(g, o, own, told))))

    def placed(g: Column, o: Column, own: Column, told: Column) -> Column:
        is_node = g["node"].isNotNull() | F.coalesce(g["kind"] == "node", F.lit(False))
        type_ = F.when(is_node, "node").when(g["kind"].isNull() | ((g["kind"] == "service") & told["type"].isin("infra", "datastore")), told["type"]).otherwise(g["kind"])
        dns = ~is_node & (told["type"] == "infra") & own.rlike(V.CORE_DNS)
        place = F.when(is_node, "").when(dns, "kube-system").otherwise(g["namespace"])
        named = F.when(dns, "coredns").otherwise(own)
        fields = [
            component_id(type_, g["cluster"], place, named).alias("id"), type_.alias("type"), F.when(~is_node, told["role"]).alias("role"), named.alias("name"), F.coalesce(g["cluster"], F.lit("cluster-1")).alias("cluster"), g["cluster"].isNotNull().alias("cluster_known"),
            F.coalesce(place, F.lit("default")).alias("namespace"), place.isNotNull().alias("ns_known"), o["controller"].alias("controller"),
        ]
        return F.when(own.isNotNull(), F.struct(*fields))

    return bound(given, owned)


# How events tell of replica sets and their pods.
SCALED, CREATED = r"(?i)replica set (\S+) (?:to|from \d+ to) (\d+)", r"Created pod: (\S+)"


def rollout_attributes(text: Column) -> Column:
    """Struct of replica_set, replicas, direction and pod that an event's text names; nulls where it names none."""
    found = F.struct(F.regexp_extract(text, SCALED, 1).alias("set"), F.regexp_extract(text, SCALED, 2).alias("n"), F.lower(F.regexp_extract(text, CREATED, 1)).alias("pod"), text.rlike("(?i)Scaled down").alias("down"))

    def fields(x: Column) -> Column:
        scaled = x["set"] != ""
        owner = F.when(x["pod"] != "", pod_owner(x["pod"])["replica_set"])
        return F.struct(
            F.when(scaled, F.lower(x["set"])).otherwise(owner).alias("replica_set"), F.when(scaled, x["n"].try_cast("int")).alias("replicas"), F.when(scaled, F.when(x["down"], "down").otherwise("up")).alias("direction"), F.nullif(x["pod"], F.lit("")).alias("pod"),
        )

    return bound(found, fields)
