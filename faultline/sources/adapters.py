"""Incident relations derived from the driver's tables, as one text for Spark and DuckDB.

Each adapter is a SELECT over the tables; dialect differences are the few words in DIALECTS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Milliseconds of a timestamp column, whole division, and lines of a text.
DIALECTS = {
    "spark": {"ms": "(unix_micros(cast({} as timestamp)) div 1000)", "div": "{} div {}"},
    "duckdb": {"ms": "(epoch_us({}) // 1000)", "div": "{} // {}"},
}

# Fixed texts of our own, one per shape that readers know, filled with a number.
LOG_TEXTS = [
    "Last State: Terminated Reason: OOMKilled Exit Code: 137 after #",
    "Back-off restarting failed container worker-#",
    "Failed to pull image registry.example.com/shop:v#",
    "Readiness probe failed: HTTP/1.1 503 from 10.0.0.#",
    "dial tcp: lookup orders-db.shop.svc.cluster.local: no such host #",
    "x509: certificate has expired or is not yet valid #",
    "FATAL: remaining connection slots are reserved #",
    "migration step # failed: relation exists",
    "dial tcp payments-api:8443 connection refused attempt #",
    "ERROR context deadline exceeded calling cart-api after # ms",
    "[warn] level=warn msg=\"rate limit reached\" status=429 n=#",
    "processed 500 rows in batch #",
    "GET /cart/# HTTP/1.1 status=502 upstream cart-api",
    "CPU throttling high on core #",
    "Scaled up replica set cart-api-7d9f8b6c5 to #",
    "INFO Started container web #",
    "0/# nodes are available: Insufficient cpu",
    "panic: runtime error at step #",
    "HPA reached max replicas #",
    "user ann.lee#@example.com token=abcd#efgh signed in",
]
NAMES = ["cart-api-7d9f8b6c5-x2k4j", "orders-db-0", "fluentd-x8k2p", "coredns-5d78c9869d-abcde", "payments-gateway", "Redis-Cache", "web-worker-abcde", "kube-proxy-9xk4z", "mongo-exporter", "\"ledger\""]
HOSTS = ["http://cart-api.shop.svc.cluster.local:8080/x", "10.1.2.3:5432", "localhost", "payments-api:443", "db.example.com", "https://Orders.internal.example.com/path", "", "redis.data.svc"]
AGES = ["3m12s", "5d4h", "1.5s", "45s", "<unknown>", "2m (x5 over 10m)", "300ms", "2y3w", "soon", "12us"]
ZONES = ["Z", "UTC", "+02:00", "-0530", "UTC+2", "CEST", "IST", "+15:00", "", "pst"]
QUANTITIES = ["512Mi", "500m", "2", "1Gi", "\"250m\"", "1.5k", "lots", "3T", "64Ki", "0"]
LEVELS = ["ERROR", "warn", "30", "50", "3", "notice", "Emerg", "6", "verbose", "odd"]


KINDS = ["oom_killed", "span_error", "conn_refused", "timeout", "dns_failure", "image_pull", "node_not_ready", "conn_exhaustion", "change", "rollout", "crash_loop"]
KILLED_TEXTS = ["Memory cgroup out of memory: Killed process 12 (App-#)", "kernel: app-# invoked oom-killer: gfp", "oom-kill:constraint=NONE,task=app-#,pid=7", "certificate has expired on app-#", "handshake with app-# failed"]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(number: str, values: list[str]) -> str:
    """A CASE that picks values[number % len(values)]."""
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def adapters(dialect: str) -> dict[str, str]:
    d = DIALECTS[dialect]
    ms, div = (lambda c: d["ms"].format(c)), (lambda a, b: d["div"].format(a, b))
    return {
        "signals": f"""SELECT event_id AS seq, {ms("ts")} AS ts_ms, concat('svc-', cast(user_id % 25 AS varchar(9))) AS component,
  concat('c', cast(user_id % 3 AS varchar(9))) AS cluster, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'click' AND value > 50 THEN 'warn' ELSE 'info' END AS severity,
  CASE event_type WHEN 'error' THEN 'http_5xx' WHEN 'click' THEN 'timeout' WHEN 'view' THEN 'restart' WHEN 'purchase' THEN 'change' ELSE 'rollout' END AS kind,
  CASE event_id % 4 WHEN 0 THEN 'helm' WHEN 1 THEN 'alerts' WHEN 2 THEN 'logs' ELSE 'traces' END AS source,
  cast(event_id % 7 AS int) AS source_line, user_id, value, event_type FROM events""",
        "log_lines": f"""SELECT event_id AS seq, {ms("ts")} AS ts_ms, replace({pick("event_id", LOG_TEXTS)}, '#', cast(user_id AS varchar(9))) AS body,
  concat('svc-', cast(user_id % 25 AS varchar(9))) AS component FROM events""",
        "name_samples": f"""SELECT event_id AS seq, {pick("event_id", NAMES)} AS pod, {pick("event_id", HOSTS)} AS host, {pick("event_id", AGES)} AS age,
  {pick("event_id", ZONES)} AS zone, {pick("event_id", QUANTITIES)} AS quantity, {pick("event_id", LEVELS)} AS level FROM events""",
        "spans": f"""SELECT o_orderkey AS trace_id, cast(0 AS bigint) AS span_id, cast(NULL AS bigint) AS parent_id, concat('edge-', cast(o_custkey % 5 AS varchar(9))) AS service,
  'root' AS op, 'server' AS kind, cast(o_totalprice / 100 AS double) AS dur_ms, o_orderstatus = 'F' AND o_totalprice > 200000 AS error, {ms("o_orderdate")} AS start_ms,
  cast(NULL AS varchar(20)) AS db, cast(NULL AS varchar(20)) AS peer FROM orders
UNION ALL SELECT l_orderkey, n, CASE WHEN n % 3 = 0 THEN n - 1 WHEN n % 11 = 0 THEN 999 ELSE 0 END, concat('supp-', cast(l_suppkey % 20 AS varchar(9))),
  concat(l_returnflag, l_linestatus), CASE WHEN n % 2 = 0 THEN 'client' ELSE 'server' END, cast(l_quantity * 40 AS double), l_returnflag = 'R' AND l_discount > 0.05, {ms("l_shipdate")},
  CASE WHEN n % 4 = 0 THEN 'postgres' END, CASE WHEN n % 2 = 0 THEN CASE WHEN l_partkey % 2 = 0 THEN concat('Supp-', cast(l_partkey % 20 AS varchar(9))) ELSE concat('ext-', cast(l_partkey % 7 AS varchar(9))) END END
  FROM (SELECT *, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag, l_linestatus, l_discount) AS bigint) AS n FROM lineitem) l""",
        "releases": f"""SELECT o_custkey AS release_id, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS bigint) AS revision, o_orderkey AS change_id,
  CASE o_orderstatus WHEN 'F' THEN 'superseded' WHEN 'O' THEN 'deployed' ELSE 'failed' END AS status, {ms("o_orderdate")} AS ts_ms, o_totalprice AS amount, o_orderpriority AS priority,
  CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 120000 THEN 'medium' ELSE 'low' END AS risk FROM orders""",
        "entities": """SELECT concat('customer-', cast(c_custkey % 400 AS varchar(9))) AS name, lower(r_name) AS cluster, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower(n_name) END AS namespace,
  c_custkey AS seq, c_custkey % 4 <> 0 AS cluster_known FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
        "components": """SELECT concat(type, ':', cluster, '/', namespace, '/', name) AS id, name, type, cluster, namespace, CASE WHEN k % 7 = 0 THEN 'ingress' END AS role,
  CASE k % 6 WHEN 0 THEN 'root' WHEN 1 THEN 'failing' WHEN 2 THEN 'degraded' WHEN 3 THEN 'at-risk' ELSE 'healthy' END AS status, cast(k % 97 AS double) / 100 AS impact, n AS errors, k % 5 = 0 AS user_facing, k % 3 <> 0 AS traced,
  concat('rel-', cast(k % 30 AS varchar(9))) AS release FROM (SELECT concat('app-', cast(c_custkey % 60 AS varchar(9))) AS name,
  CASE c_custkey % 10 WHEN 0 THEN 'datastore' WHEN 1 THEN 'infra' WHEN 2 THEN 'node' WHEN 3 THEN 'external' ELSE 'service' END AS type, concat('c', cast(c_nationkey % 3 AS varchar(9))) AS cluster,
  concat('ns', cast(c_nationkey % 4 AS varchar(9))) AS namespace, min(c_custkey) AS k, count(*) AS n FROM customer GROUP BY c_custkey % 60, c_custkey % 10, c_nationkey % 3, c_nationkey % 4) g""",
        "changes": f"""SELECT concat('chg-', cast(o_orderkey AS varchar(12))) AS id, concat('app-', cast(o_custkey % 60 AS varchar(9))) AS name, concat('rel-', cast(o_custkey % 30 AS varchar(9))) AS release,
  {pick("o_orderkey", ["image", "resources", "configmap", "env", "networkpolicy", "probe", "secret", "replicas"])} AS category, CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 120000 THEN 'medium' ELSE 'low' END AS risk,
  cast(o_orderkey % 500 AS int) AS line, concat('shop/app:v', cast(o_custkey % 5 AS varchar(9)), '.0') AS before, concat('shop/app:', CASE WHEN o_orderkey % 16 = 0 THEN 'v' ELSE '' END, cast(o_custkey % 6 AS varchar(9)), '.1') AS after,
  CASE WHEN o_orderkey % 3 = 0 THEN 'containers[web].image' ELSE 'image.tag' END AS field, concat('ns', cast(o_custkey % 4 AS varchar(9))) AS namespace, {ms("o_orderdate")} AS ts_ms FROM orders""",
        "deploys": f"""SELECT concat('rel-', cast(o_custkey % 40 AS varchar(9))) AS release, o_orderkey % 50 AS revision, concat('app-', cast(o_custkey % 60 AS varchar(9))) AS name, concat('c', cast(o_custkey % 3 AS varchar(9))) AS cluster,
  o_orderkey AS seq, CASE WHEN o_orderkey % 3 <> 0 THEN {ms("o_orderdate")} END AS deployed_ms, CASE WHEN o_orderkey % 4 <> 0 THEN concat(cast(o_custkey % 6 AS varchar(9)), '.1') END AS app_to FROM orders""",
        "faults": f"""SELECT seq, CASE WHEN seq % 11 <> 0 THEN t END AS ts_ms, seq % 7 = 0 AS ts_unknown, {pick("seq", KINDS)} AS kind, {pick("user_id", ["info", "warn", "error", "critical"])} AS severity,
  {pick("seq", ["helm", "alerts", "logs", "traces"])} AS source, cast(seq % 13 AS int) AS source_line, {pick("user_id", ["dns_failure", "tls_error", "other"])} AS cause, name, type, cluster, namespace,
  concat(type, ':', cluster, '/', namespace, '/', name) AS component, CASE WHEN seq % 6 <> 0 THEN concat('ns', cast(user_id % 4 AS varchar(9))) END AS target_namespace, CASE WHEN seq % 5 <> 0 THEN concat(name, '-', cast(seq % 3 AS varchar(9))) END AS pod,
  replace({pick("user_id", KILLED_TEXTS)}, '#', cast(seq % 60 AS varchar(9))) AS text FROM (SELECT event_id AS seq, {ms("ts")} AS t, user_id, concat('app-', cast(user_id % 60 AS varchar(9))) AS name,
  CASE user_id % 10 WHEN 0 THEN 'datastore' WHEN 1 THEN 'infra' WHEN 2 THEN 'node' WHEN 3 THEN 'external' ELSE 'service' END AS type, concat('c', cast(event_id % 3 AS varchar(9))) AS cluster, concat('ns', cast(event_id % 4 AS varchar(9))) AS namespace FROM events) e""",
        "evidence": f"""SELECT concat('h', cast(o_custkey % 40 AS varchar(9))) AS hypothesis, concat('svc-', cast(o_custkey % 8 AS varchar(9))) AS component, o_orderkey AS pos,
  o_orderkey % 500 AS ref, cast({div("o_orderkey * 7 % 100", "1")} AS double) / 100 AS weight FROM orders""",
    }


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter as a DataFrame over the tables in sf_dir."""
    text = adapters("spark")[name]
    used = [t for t in ("events", "orders", "lineitem", "customer", "nation", "region", "documents", "pages") if f" {t}" in text]
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(body: str, *names: str) -> str:
    """DuckDB text: the adapters as WITH parts before body, which begins with SELECT or further parts after a comma."""
    parts = ",\n".join(f"{n} AS ({adapters('duckdb')[n]})" for n in names)
    return f"WITH {parts}{',' if not body.lstrip().upper().startswith('SELECT') else ''}\n{body}"
