"""Queries of release diffs: manifests are written from the tables as diffs, read back, and held against what they were written from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import spread
from ..sources import manifests, releases
from .catalog import query, read

#: The lines of a customer's diff: {k} its key, {app} its workload, {ns} a namespace, and numbers that follow from the key.
LINES = """{ns}, {app}, Deployment (apps) has changed:
  metadata:
    name: {app}
    labels:
      helm.sh/chart: shop-{n}.1.0
  # a comment: of no value
  spec:
    template:
      spec:
        containers:
        - name: web
          image: shop/web:{k7}
          resources:
            limits:
-             memory: {mem_a}Mi
+             memory: {mem_b}Mi
          env:
          - name: MODE
-           value: m{k4}
+           value: "m{k5}"
{ns}, {app}-config, ConfigMap (v1) has changed:
  data:
    app.conf: |
      keep: me
-     level={k3}
+     level={k2}
        tail: {k}
    mode: fast
{ns}, {app}-hpa, HorizontalPodAutoscaler (autoscaling) has changed:
  spec:
    scaleTargetRef:
      name: {app}
-   maxReplicas: {k6}
+   maxReplicas: {k8}
{ns}, shared-token, Secret (v1) has changed:
  data:
-   token: a{k3}
+   token: b{k3}""".split("\n")
VALUES = {"k": "c_custkey", "app": "concat('app-', cast(c_custkey % 90 as varchar(9)))", "ns": "concat('ns', cast(c_nationkey % 3 as varchar(9)))", "n": "c_nationkey", "mem_a": "128 + c_custkey % 7 * 64", "mem_b": "128 + c_custkey * 3 % 5 * 64", "k8": "c_custkey % 6 + 2", **{f"k{i}": f"c_custkey % {i}" for i in range(2, 8)}}
_WEB = "spec.template.spec.containers[web]"
#: What the lines hold: resource, number in the diff, sign, path, value.
HELD = [
    ("{app}", 3, " ", "metadata.name", "{app}"), ("{app}", 5, " ", "metadata.labels.helm.sh/chart", "shop-{n}.1.0"), ("{app}", 11, " ", f"{_WEB}.name", "web"), ("{app}", 12, " ", f"{_WEB}.image", "shop/web:{k7}"), ("{app}", 15, "-", f"{_WEB}.resources.limits.memory", "{mem_a}Mi"),
    ("{app}", 16, "+", f"{_WEB}.resources.limits.memory", "{mem_b}Mi"), ("{app}", 18, " ", f"{_WEB}.env[MODE].name", "MODE"), ("{app}", 19, "-", f"{_WEB}.env[MODE].value", "m{k4}"), ("{app}", 20, "+", f"{_WEB}.env[MODE].value", "m{k5}"), ("{app}-config", 24, " ", "data.app.conf", "keep: me"),
    ("{app}-config", 25, "-", "data.app.conf", "level={k3}"), ("{app}-config", 26, "+", "data.app.conf", "level={k2}"), ("{app}-config", 27, " ", "data.app.conf", "tail: {k}"), ("{app}-config", 28, " ", "data.mode", "fast"), ("{app}-hpa", 32, " ", "spec.scaleTargetRef.name", "{app}"),
    ("{app}-hpa", 33, "-", "spec.maxReplicas", "{k6}"), ("{app}-hpa", 34, "+", "spec.maxReplicas", "{k8}"), ("shared-token", 37, "-", "data.token", "a{k3}"), ("shared-token", 38, "+", "data.token", "b{k3}"),
]


def filled(text: str) -> str:
    """SQL of a line with its numbers filled in."""
    out, rest = [], text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [f"'{before}'"] * bool(before) + [f"cast({VALUES[name]} as varchar(20))"]
    return "concat(" + ", ".join([*out, f"'{rest}'"]) + ")"


def _panes(spark, sf_dir):
    """A pane per customer, so that panes grow in number with the table."""
    c = spread(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return c.select(F.expr("concat('inc-', cast(c_custkey as string))").alias("incident_id"), F.concat_ws("\n", *[F.expr(filled(x)) for x in LINES]).alias("text"))


_HELD = " UNION ALL ".join(f"SELECT 'inc-' || c_custkey AS incident_id, c_custkey AS k, {filled(r)} AS resource, {n} AS line_no, '{s}' AS sign, '{p}' AS path, {filled(v)} AS value FROM customer" for r, n, s, p, v in HELD)


@query(sql=f"SELECT incident_id, resource, line_no, sign, path, value FROM ({_HELD}) h")
def read_diff_records(spark, sf_dir):
    return releases.diff_records(_panes(spark, sf_dir)).select("incident_id", "resource", "line_no", "sign", "path", "value")


@query(sql=f"""SELECT 'inc-' || c_custkey AS incident_id, r AS resource, CASE WHEN r = app THEN app END AS name, CASE WHEN r = app THEN 'shop-' || c_nationkey || '.1.0' END AS chart, CASE WHEN r LIKE '%-hpa' THEN app END AS scale_target,
  CASE WHEN r = app THEN 'web' ELSE '' END AS containers, CASE WHEN r = app THEN 'shop/web:' || (c_custkey % 7) ELSE '' END AS images FROM (SELECT *, {VALUES['app']} AS app, unnest([{VALUES['app']}, {VALUES['app']} || '-config', {VALUES['app']} || '-hpa', 'shared-token']) AS r FROM customer) x""")
def manifest_facts(spark, sf_dir):
    f = manifests.block_facts(manifests.block_records(releases.block_arrays(_panes(spark, sf_dir)), releases.BLOCK_KEYS), ["incident_id", "block_no", "resource"])
    return f.select("incident_id", "resource", "name", "chart", "scale_target", F.array_join("containers", ",").alias("containers"), F.array_join("images", ",").alias("images"))


@query(sql=f"SELECT 'inc-' || c_custkey AS incident_id, unnest([{VALUES['app']}, {VALUES['app']} || '-config', {VALUES['app']} || '-hpa', 'shared-token']) AS resource, {VALUES['app']} AS owner FROM customer")
def resource_owners(spark, sf_dir):
    rows = manifests.block_records(releases.block_arrays(_panes(spark, sf_dir)), releases.BLOCK_KEYS)
    by = ["incident_id", "block_no", "resource", "kind"]
    f = manifests.block_facts(rows.withColumnRenamed("kind", "of_kind"), ["incident_id", "block_no", "resource", "of_kind"]).drop("kind").withColumnRenamed("of_kind", "kind")
    return manifests.owners(f.select(*by, "scale_target", "app_label")).select("incident_id", "resource", "owner")


@query(sql=f"""WITH h AS ({_HELD}), p AS (SELECT a.incident_id, a.resource, a.path AS field, a.value AS before, b.value AS after FROM h a JOIN h b ON a.k = b.k AND a.resource = b.resource AND a.path = b.path AND a.sign = '-' AND b.sign = '+' WHERE a.value <> b.value)
SELECT incident_id, resource, field, CASE WHEN resource = 'shared-token' THEN '(redacted)' ELSE before END AS before, CASE WHEN resource = 'shared-token' THEN '(redacted)' ELSE after END AS after,
  CASE WHEN field LIKE '%memory' THEN 'resources' WHEN field LIKE '%MODE%' THEN 'env' WHEN field = 'spec.maxReplicas' THEN 'hpa' WHEN field = 'data.token' THEN 'secret' ELSE 'configmap' END AS category,
  CASE WHEN field LIKE '%memory' THEN CASE WHEN replace(after, 'Mi', '')::INT < replace(before, 'Mi', '')::INT THEN 'down' ELSE 'up' END END AS direction FROM p""")
def read_diff_changes(spark, sf_dir):
    return releases.changes(_panes(spark, sf_dir)).select("incident_id", "resource", "field", "before", "after", "category", "direction")
