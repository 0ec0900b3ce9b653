"""Text for people: clocks, durations, shares, commands, sentences: Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_of
from .times import half_up

DASH = "—"

# What a component with such signals does, the most telling first.
STATES = [
    ("crash_loop", "crash-looping"),
    ("oom_killed", "being killed for running out of memory"),
    ("image_pull", "unable to pull its image"),
    ("config_error", "failing to start"),
    ("conn_exhaustion", "out of database connections"),
    ("tls_error", "failing certificate checks"),
    ("dns_failure", "failing name lookups"),
    ("probe_failed", "failing its health checks"),
    ("evicted", "losing pods to eviction"),
    ("node_not_ready", "not ready"),
    ("http_429", "being rate limited"),
    ("conn_refused", "refusing connections"),
    ("timeout", "timing out"),
    ("http_5xx", "returning server errors"),
]
# Other names of cause categories.
CATEGORY_NAMES = {
    "tls": "tls-cert", "certificate": "tls-cert", "cert": "tls-cert", "deploy": "bad-deploy", "bad-release": "bad-deploy", "oom": "resource-limits", "memory": "resource-limits", "dependency": "dependency-failure",
    "connection-pool": "connection-exhaustion", "db-connections": "connection-exhaustion", "config": "config-error", "configuration": "config-error", "probe": "probe-misconfig",
}


def whole(x: Column) -> Column:
    return half_up(x).cast("long").cast("string")


def tidy(x: Column, digits: int) -> Column:
    """A number with so many places, without noughts at its end."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", x.cast("double")), r"\.?0+$" if digits else r"\.$", "")


def truncated(text: Column, n: int) -> Column:
    """At most n characters, the last of which says that more was there."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, max(0, n - 1)), F.lit("…"))).otherwise(t)


def duration(ms: Column) -> Column:
    """850 ms, 4.5 s, 3 min 12 s, 42 min, 2 h 5 min, 3 d 4 h; minus sign and dash as needed."""
    a = F.abs(ms).cast("double")
    unit = lambda big, small, of: (F.floor(a / big), half_up((a - F.floor(a / big) * big) / small), of)

    def two(big: float, small: float, of: int, names: tuple[str, str]) -> Column:
        n, rest, most = unit(big, small, of)
        n, rest = F.when(rest == most, n + 1).otherwise(n), F.when(rest == most, 0.0).otherwise(rest)
        return F.concat(whole(n), F.lit(f" {names[0]}"), F.when(rest > 0, F.concat(F.lit(" "), whole(rest), F.lit(f" {names[1]}"))).otherwise(""))

    minutes, seconds, _ = unit(60_000.0, 1000.0, 60)
    few = (F.when(seconds == 60, minutes + 1).otherwise(minutes) < 10) & (seconds > 0) & (seconds < 60)
    out = first_of(
        [
            (a < 1000, F.concat(whole(a), F.lit(" ms"))),
            (a < 10_000, F.concat(F.regexp_replace(F.format_string("%.1f", half_up(a / 100) / 10), r"\.0$", ""), F.lit(" s"))),
            (a < 60_000, F.concat(whole(a / 1000), F.lit(" s"))),
            (a < 3_600_000, F.when(few, two(60_000.0, 1000.0, 60, ("min", "s"))).otherwise(F.concat(whole(a / 60_000), F.lit(" min")))),
            (a < 48 * 3_600_000, two(3_600_000.0, 60_000.0, 60, ("h", "min"))),
            (a >= 48 * 3_600_000, two(86_400_000.0, 3_600_000.0, 24, ("d", "h"))),
        ]
    )
    return F.when(ms.isNull(), DASH).when(ms < 0, F.concat(F.lit("−"), out)).otherwise(out)


def percent(pct: Column) -> Column:
    """A value in percent with as many places as its size needs."""
    a = F.abs(pct)
    plain = first_of([(a == 0, tidy(pct, 0)), (a >= 100, tidy(pct, 0)), (a >= 1, tidy(pct, 1)), (a >= 0.1, tidy(pct, 2)), (a >= 0.0005, tidy(pct, 3)), (pct > 0, F.lit("<0.001")), (pct < 0, F.lit(">−0.001"))])
    return F.when(pct.isNull(), DASH).otherwise(F.concat(F.when((a >= 100) | (a == 0), F.format_string("%.0f", pct.cast("double"))).otherwise(plain), F.lit("%")))


def ratio(share: Column) -> Column:
    return percent(share * 100)


def offset_name(minutes: Column) -> Column:
    """+05:30 of minutes ahead of UTC."""
    a = F.abs(minutes)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(a / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((a % 60).cast("string"), 2, "0"))


def _shifted(ms: Column, minutes: Column) -> Column:
    return F.timestamp_millis((ms + F.coalesce(minutes, F.lit(0)) * 60_000).cast("long"))


def clock(ms: Column, minutes: Column) -> Column:
    """HH:MM:SS at an offset from UTC."""
    return F.when(ms.isNull(), "--:--:--").otherwise(F.date_format(_shifted(ms, minutes), "HH:mm:ss"))


def dated(ms: Column, minutes: Column) -> Column:
    """2026-10-05 21:49:30Z, or with the offset in place of Z."""
    zone = F.when(F.coalesce(minutes, F.lit(0)) == 0, "Z").otherwise(offset_name(minutes))
    return F.when(ms.isNull(), DASH).otherwise(F.concat(F.date_format(_shifted(ms, minutes), "yyyy-MM-dd HH:mm:ss"), zone))


def iso(ms: Column) -> Column:
    """ISO 8601 in UTC with milliseconds."""
    return F.date_format(F.timestamp_millis(ms.cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def html(text: Column) -> Column:
    """Text with the five characters that markup reads replaced."""
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    """x held within low and high; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def quoted(text: Column, n: int = 110) -> Column:
    """One line of text in quotation marks, shortened."""
    return F.concat(F.lit('"'), truncated(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), n), F.lit('"'))


def counted(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def times(n: Column) -> Column:
    return F.when(n == 1, "once").otherwise(F.concat(n.cast("string"), F.lit(" times")))


def state_words(kinds: Column) -> Column:
    """What a component with these kinds (an array) does."""
    return F.coalesce(first_of([(F.array_contains(kinds, k), F.lit(v)) for k, v in STATES]), F.lit("failing"))


def check_command(cluster: Column, known: Column, namespace: Column, kind: Column) -> Column:
    """The kubectl prefix of a read-only check: the cluster only if it was stated, no namespace for nodes."""
    return F.concat(F.lit("kubectl"), F.when(known & cluster.isNotNull(), F.concat(F.lit(" --context "), cluster)).otherwise(""), F.when(namespace.isNotNull() & (kind != "node"), F.concat(F.lit(" -n "), namespace)).otherwise(""))


def change_command(cluster: Column, known: Column, namespace: Column) -> Column:
    """The kubectl prefix of a command that changes something: a placeholder for a cluster that was not stated."""
    name = F.when(known & cluster.isNotNull(), cluster).otherwise("<kube-context>")
    return F.concat(F.lit("kubectl --context "), name, F.when(namespace.isNotNull(), F.concat(F.lit(" -n "), namespace)).otherwise(""))


def release_flags(cluster: Column, known: Column, namespace: Column) -> Column:
    return F.concat(F.when(namespace.isNotNull(), F.concat(F.lit(" -n "), namespace)).otherwise(""), F.when(known & cluster.isNotNull(), F.concat(F.lit(" --kube-context "), cluster)).otherwise(""))


def workload_ref(controller: Column, name: Column) -> Column:
    """statefulset/x, daemonset/x or deployment/x."""
    c = F.lower(F.coalesce(controller, F.lit("")))
    return F.concat(F.when(c.contains("statefulset"), "statefulset/").when(c.contains("daemonset"), "daemonset/").otherwise("deployment/"), name)


def gitops_caveat(release: Column, namespace: Column) -> Column:
    """What to pause before a change by hand."""
    return F.concat(F.lit("Pause auto-sync of a GitOps controller first: argocd app set <app> --sync-policy none, or flux suspend helmrelease "), F.coalesce(release, F.lit("<name>")), F.lit(" -n "), F.coalesce(namespace, F.lit("<namespace>")))


def issuer_error(line: Column) -> Column:
    """The part of a certificate issuer's error that says what failed."""
    t = F.trim(F.regexp_replace(F.regexp_replace(line, r"^\s*Message:\s*", ""), r"\s+", " "))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"(?i)Error making API request\.?\s*", ""), r"(?i)URL: \S+ \S+\s*", ""), r"\*\s*", "")
    tail = F.regexp_extract(t, r"(?i)((?:Vault|issuer|ACME|failed to (?:sign|issue|renew)).*)$", 1)
    return F.when(tail != "", tail).otherwise(t)


def confidence_of(text: Column) -> Column:
    """A stated confidence, as words, a share or a percentage, between 0 and 1; null if it is none of these."""
    s = F.lower(F.trim(text))
    number = F.regexp_extract(s, r"^(\d+(?:\.\d+)?)\s*%?$", 1)
    n = F.when(number != "", number).cast("double")
    n = F.when(s.contains("%"), n / 100).otherwise(n)
    n = F.when((n > 1) & (n <= 100), n / 100).otherwise(n)
    return F.when(s.rlike(r"^(very )?high$"), 0.8).when(s.rlike(r"^(medium|moderate)$"), 0.55).when(s.rlike(r"^(very )?low$"), 0.3).otherwise(clamp(n, 0.0, 1.0))


def category_of(text: Column) -> Column:
    """A stated cause category under its usual name."""
    s = F.regexp_replace(F.lower(F.trim(text)), r"[\s_]+", "-")
    return F.coalesce(first_of([(s == k, F.lit(v)) for k, v in CATEGORY_NAMES.items()]), s)


def risk_of(text: Column) -> Column:
    s = F.lower(F.trim(text))
    return F.when(s.isin("high", "medium", "low"), s).otherwise("")


def _arrow(before: Column, after: Column) -> Column:
    return F.concat(truncated(before, 60), F.lit(" → "), truncated(after, 60))


def change_summary(category: Column, field: Column, kind: Column, name: Column, before: Column, after: Column) -> Column:
    """One line on a change: container and limit, image tag, variable, replicas, probe; values of secrets are left out."""
    part = lambda p: F.nullif(F.regexp_extract(field, p, 1), F.lit(""))
    box, leaf = part(r"containers\[([^\]]+)\]"), F.regexp_extract(field, r"([^.\[\]]+)\]?$", 1)
    inside, what = F.coalesce(F.concat(box, F.lit(" ")), F.lit("")), F.concat(kind, F.lit(" "), name)
    moved = F.when(before.isNull(), F.concat(F.lit("set to "), after)).when(after.isNull(), "removed").otherwise(_arrow(before, after))
    limit = F.coalesce(F.concat(part(r"(?:limits|requests)\.([\w-]+)$"), F.when(field.rlike(r"limits\."), " limit").otherwise(" request")), leaf)
    variable = F.coalesce(part(r"env\[([^\]]+)\]"), leaf)
    probe = F.coalesce(F.concat(F.lower(part(r"(?i)(liveness|readiness|startup)Probe")), F.lit(" probe")), F.lit("probe"))
    cases = [
        (category == "resources", F.concat(inside, limit, F.lit(" "), F.when(after.isNull(), F.concat(before, F.lit(" removed"))).otherwise(moved))),
        (category == "image", F.concat(inside, F.lit("image "), moved)),
        (category == "env", F.when(before.isNull(), F.concat(F.lit("env "), variable, F.lit(" added"))).when(after.isNull(), F.concat(F.lit("env "), variable, F.lit(" removed"))).otherwise(F.concat(F.lit("env "), variable, F.lit(": "), moved))),
        (category == "replicas", F.concat(what, F.lit(" replicas "), moved)),
        (category == "probe", F.concat(inside, probe, F.lit(" "), leaf, F.lit(" "), moved)),
        (category == "secret", F.concat(what, F.lit(" "), leaf, F.when(before.isNull(), " added").when(after.isNull(), " removed").otherwise(" changed"), F.lit(" (value redacted)"))),
        (category == "configmap", F.concat(what, F.lit(" "), leaf, F.lit(": "), F.when(before.isNull(), "added").otherwise(moved))),
    ]
    return F.coalesce(first_of(cases), F.concat(what, F.lit(" "), F.coalesce(field, F.lit("")), F.lit(" "), F.when(before.isNull(), "added").otherwise(moved)))
