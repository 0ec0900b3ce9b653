"""Closed vocabularies: fixed values that results depend on, stated plainly."""

from __future__ import annotations

# Severities in rising order.
SEVERITIES = ["info", "warn", "error", "critical"]

# Kinds of signals.
KINDS = """oom_killed crash_loop image_pull config_error probe_failed evicted node_not_ready node_pressure scheduling_failed
pvc_pending dns_failure conn_refused timeout tls_error http_5xx http_429 throttled hpa_maxed rollout restart panic db_error
conn_exhaustion migration error_generic span_error span_slow alert_firing alert_resolved slo_burn change""".split()

# The least severity of a kind; error where not listed.
FLOOR = dict.fromkeys("probe_failed node_pressure scheduling_failed pvc_pending timeout http_429 throttled hpa_maxed".split(), "warn") | dict.fromkeys(["rollout", "restart"], "info")

# Kinds that are context, not anomalies.
CONTEXT_KINDS = ["change", "rollout", "alert_resolved"]

# Text patterns of log kinds, in order; the first kind with a match wins. Two kinds need more than one pattern: see classify.
LOG_PATTERNS = [
    ("oom_killed", r"OOMKill|Exit Code:\s*137|exit code 137|exit status 137|out of memory|Killed process|OutOfMemoryError|memory cgroup out of memory|oom-kill|oom_kill"),
    ("crash_loop", r"CrashLoopBackOff|Back-off restarting|back-off \S+ restarting failed"),
    ("image_pull", r"ImagePullBackOff|ErrImagePull|ErrImageNeverPull|InvalidImageName|manifest unknown|pull access denied|Back-off pulling image|Failed to pull image|repository does not exist"),
    ("config_error", r"CreateContainerConfigError|CreateContainerError|secrets? \"[^\"]*\" not found|configmaps? \"[^\"]*\" not found|invalid configuration|couldn't find key \S+ in (?:Secret|ConfigMap)|failed to (?:load|parse) config|missing required (?:env|environment|config)"),
    ("probe_failed", r"(?:Readiness|Liveness|Startup) probe failed|failed (?:liveness|readiness|startup) probe|probe failed|probe errored"),
    ("evicted", r"\bEvicted\b|The node was low on resource|evicting pod|\bEvicting\b"),
    ("node_not_ready", r"NodeNotReady|\bnode\b.{0,60}\bnot ready\b|Kubelet stopped posting node status|NodeStatusUnknown"),
    ("node_pressure", r"MemoryPressure|DiskPressure|PIDPressure|NodeHasInsufficientMemory|NodeHasDiskPressure|EvictionThresholdMet"),
    ("scheduling_failed", r"FailedScheduling|Insufficient (?:cpu|memory|nvidia|ephemeral-storage|pods)|0/\d+ nodes are available|didn't match Pod's node affinity|untolerated taint|exceeded quota"),
    ("pvc_pending", r"unbound immediate PersistentVolumeClaims|ProvisioningFailed|FailedAttachVolume|persistentvolumeclaim \"[^\"]*\" not found|waiting for a volume to be created|FailedMount"),
    ("dns_failure", r"no such host|lookup \S+.*(?:i/o timeout|server misbehaving)|SERVFAIL|NXDOMAIN|Temporary failure in name resolution|getaddrinfo (?:ENOTFOUND|EAI_AGAIN)|EAI_AGAIN|Name or service not known|could not resolve host|UnknownHostException|dns (?:lookup|resolution|query) (?:failed|timed? ?out)"),
    ("tls_error", r"x509|certificate has expired|certificate is not yet valid|tls: handshake|tls: bad certificate|remote error: tls|certificate signed by unknown authority|SSL routines|certificate verify failed|SSLHandshakeException|CERT_HAS_EXPIRED|ERR_TLS|handshake failure"),
    ("conn_exhaustion", r"too many (?:connections|clients)|remaining connection slots are reserved|connection slots|pool exhausted|connection pool (?:timeout|exhausted|is full)|pool timeout|max_connections|could not obtain (?:a )?connection|Connection is not available, request timed out|HikariPool.*(?:timed out|Connection is not available)|ER_CON_COUNT_ERROR|maxclients"),
    ("migration", r"(?:migration|migrate|alembic|flyway|liquibase)\b.{0,120}(?:fail|error|abort|dirty|panic|could not)|(?:fail|error)\w*.{0,60}\b(?:migration|migrate)"),
    ("db_error", r"deadlock|SQLSTATE|\bpq: |ERROR:\s+(?:relation|column|duplicate key|could not|permission denied)|could not serialize access|lock wait timeout|database \"[^\"]*\" does not exist|ORA-\d{5}"),
    ("conn_refused", r"connection refused|ECONNREFUSED|no healthy upstream|upstream connect error"),
    ("timeout", r"context deadline exceeded|i/o timeout|timed out|ETIMEDOUT|upstream request timeout|deadline exceeded|timeout exceeded|Read timed out|504 Gateway Time-?out|request timeout"),
    ("hpa_maxed", r"ScalingLimited|reached max(?:imum)? replicas|desired replica count .*max|TooManyReplicas|maxReplicas reached|at max replicas"),
    ("http_429", None),
    ("throttled", r"throttl"),
    ("http_5xx", None),
    ("panic", r"panic:|Traceback \(most recent call last\)|\w*Exception\b|NullPointer|segfault|segmentation fault|SIGSEGV|fatal error:|unhandled (?:exception|rejection|error)|uncaught"),
    ("rollout", r"ScalingReplicaSet|Scaled (?:up|down) replica set|deployment \"?\S+\"? successfully rolled out|Created pod:|SuccessfulCreate|Waiting for deployment .* rollout"),
    ("restart", r"Started container|Restarting|Killing container|container restart"),
]

# Shapes of a server-error or rate-limit status in text.
STATUS_FIELD = r"""status(?:_?code|Code)?["']?\s*[=:]\s*["']?"""
HTTP_WORDS = r"\b(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|HTTP|status|upstream|request|response)\b"
HTTP_WORDS_429 = r"\b(GET|POST|PUT|PATCH|DELETE|HTTP|status|request)\b"
COUNTED_UNITS = r" 5\d\d (?:ms|s|bytes|B|KB|MB|rows|records|items|requests|times|connections|events|messages)\b"
REASON_5XX = r"\b5\d\d\s+(?:Internal Server Error|Not Implemented|Bad Gateway|Service Unavailable|Gateway Time-?out)"
ANSWERED_5XX = r"\b(?:code|response|returned|responded|upstream_status|statusCode|got)[=: ]+5\d\d\b"
RATE_WORDS = r"Too Many Requests|rate[ _-]?limit|ratelimit|quota exceeded"

# Level words.
LEVEL_WORDS = {
    "critical": "fatal panic crit critical emerg emergency alert f dpanic".split(),
    "error": "error err e severe failure fail".split(),
    "warn": "warn warning w".split(),
    "info": "info information informational notice i debug trace verbose d t log default fine finer finest config".split(),
}
LEVEL_UPPER = r"(?:^|[\s\[(|:])(FATAL|PANIC|CRITICAL|CRIT|ERROR|ERR|SEVERE|WARNING|WARN|NOTICE|INFO|DEBUG|TRACE|LOG)(?:[\s\]):|,]|\z)"
LEVEL_LEADING = r"(?i)^\s*(?:\[(fatal|panic|error|err|warn|warning|info|debug|notice|crit)\]|(fatal|panic|error|err|warn|warning|info|debug)(?::\s|\s*\|))"

# Alert names, in order: (kind, pattern, case matters).
ALERT_PATTERNS = [
    ("crash_loop", r"CrashLoop", False),
    ("oom_killed", r"OOM", True),
    ("oom_killed", r"oomkill|OutOfMemory", False),
    ("image_pull", r"ImagePull", False),
    ("node_not_ready", r"NodeNotReady|NodeUnreachable", False),
    ("node_pressure", r"Pressure", False),
    ("slo_burn", r"ErrorBudget|Burn|(^|[_-])slo([_-]|\z)", False),
    ("slo_burn", r"SLO", True),
    ("dns_failure", r"DNS", False),
    ("tls_error", r"Cert(?:ificate)?\w*Expir|Expir\w*Cert|TLS|SSLCert|Cert(?:ificate)?\w*(?:NotReady|RenewalFail|RenewFail|NotRenewed)", False),
    ("http_5xx", r"5xx|HighErrorRate|ErrorRateHigh|ErrorsHigh|HighErrors|HTTPErrors|ServerErrors", False),
    ("span_slow", r"Latency", False),
    ("hpa_maxed", r"Hpa\w*Max|MaxedOut|Hpa\w*Replicas\w*Mismatch", False),
    ("waiting", r"ContainerWaiting", False),
    ("throttled", r"Throttl", False),
    ("conn_exhaustion", r"TooManyConnections|ConnectionsHigh|TooManyClients|MaxConnections|ConnectionPool", False),
    ("evicted", r"Evict", False),
    ("http_429", r"RateLimit|TooManyRequests|429", False),
    ("job", r"JobFailed", False),
    ("scheduling_failed", r"Unschedulable|NotScheduled", False),
]
WAITING_REASONS = [("image_pull", r"ImagePull|ErrImage|InvalidImageName"), ("config_error", r"CreateContainerConfigError|CreateContainerError|RunContainerError"), ("crash_loop", r"CrashLoop")]

# Severity label words of alerts.
ALERT_SEVERITY = {
    "critical": "critical crit page p1 sev1 emergency fatal disaster".split(),
    "error": "error high major p2 sev2".split(),
    "warn": "warning warn medium minor p3 sev3 average".split(),
    "info": "info informational low none ticket p4 p5 sev4".split(),
}

# Alert labels that name the workload, the namespace and the cluster, most telling first.
COMPONENT_LABELS = "service app app_kubernetes_io_name k8s_app deployment statefulset daemonset workload destination_workload horizontalpodautoscaler job_name job pod container instance".split()
NAMESPACE_LABELS = "namespace exported_namespace kubernetes_namespace k8s_namespace_name destination_service_namespace".split()
CLUSTER_LABELS = "cluster k8s_cluster cluster_name kubernetes_cluster k8s_cluster_name".split()
MONITORING = r"(?i)^(?:.*kube-state-metrics.*|node-exporter|.*-node-exporter|prometheus(?:-.*)?|.*-prometheus(?:-.*)?|alertmanager.*|kubelet|cadvisor|apiserver|kube-apiserver|blackbox.*|grafana-agent|alloy|otel-collector.*|opentelemetry-collector.*|kubernetes-.*|integrations/.*|servicemonitor/.*|podmonitor/.*|monitoring|federate)\z"

# Names of components by type.
CORE_DNS = r"^(coredns|kube-dns|core-dns)\z"
INFRA = r"^(kube-proxy|cilium|cilium-operator|calico-node|calico-kube-controllers|flannel|kube-flannel|aws-node|metrics-server|cluster-autoscaler|karpenter|kube-apiserver|kube-scheduler|kube-controller-manager|konnectivity-agent|node-local-dns|nodelocaldns)\z"
DATASTORE = r"(^|[-_.])(postgres|postgresql|pg|mysql|mariadb|redis|valkey|mongo|mongodb|cassandra|scylla|kafka|rabbitmq|elasticsearch|opensearch|etcd|memcache|memcached|clickhouse|cockroach|cockroachdb|zookeeper|nats|minio|dynamodb|cosmosdb|spanner|aurora|rds|db)($|[-_.\d])"
NOT_DATASTORE = r"migrat|exporter|operator|proxy|bouncer|backup|client"
INGRESS = r"ingress|gateway|(^|-)gw($|-)|envoy|traefik|(^|-)kong($|-)|haproxy|contour|edge-proxy|api-gw"

# Milliseconds of duration units, longest names first.
UNIT_MS = {"ms": 1.0, "us": 1e-3, "µs": 1e-3, "μs": 1e-3, "ns": 1e-6, "y": 31536e6, "w": 6048e5, "d": 864e5, "h": 36e5, "m": 6e4, "s": 1e3}

# Factors of Kubernetes quantities.
QUANTITY = {"": 1.0, "m": 1e-3, "k": 1e3, "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "Ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40}

# Minutes east of Greenwich of zone names that mean one offset only.
ZONES = {
    "utc": 0, "gmt": 0, "z": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480,
    "hst": -600, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}
