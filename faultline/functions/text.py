"""Text to kinds, levels, key-value pairs and redacted text: Column expressions."""

from __future__ import annotations

from functools import reduce
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V


def first_of(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case whose condition holds, else null."""
    return reduce(lambda c, x: c.when(*x), cases, F)


def bound(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def computed(value: Column, test=None) -> Column:
    """A generator of value where it passes the test (is not null): what uses or filters the column later doesn't compute it again."""
    return F.explode(F.filter(F.array(value), test or (lambda x: x.isNotNull())))


def is_server_error(text: Column) -> Column:
    """A 5xx status in one of five shapes; a bare number only beside HTTP words and without a unit."""
    bare = text.rlike(r" 5\d\d(?: |\z)") & text.rlike("(?i)" + V.HTTP_WORDS) & ~text.rlike("(?i)" + V.COUNTED_UNITS)
    shapes = ["(?i)" + V.STATUS_FIELD + r"5\d\d\b", r"\bHTTP/\d(?:\.\d)?\"?\s+5\d\d\b", "(?i)" + V.REASON_5XX, "(?i)" + V.ANSWERED_5XX]
    return text.rlike(r"5\d\d") & reduce(lambda a, p: a | text.rlike(p), shapes, bare)


def is_rate_limit(text: Column) -> Column:
    bare = text.rlike(r"(?:^|\s)429(?:\s|\z)") & text.rlike("(?i)" + V.HTTP_WORDS_429)
    shapes = ["(?i)" + V.RATE_WORDS, "(?i)" + V.STATUS_FIELD + r"429\b", r"\bHTTP/\d(?:\.\d)?\"?\s+429\b", r"(?i)\b(?:code|response|returned)[=: ]+429\b"]
    return reduce(lambda a, p: a | text.rlike(p), shapes, bare)


def required(pattern: str) -> list[str]:
    """Lower-case texts of which a match of the pattern holds one at least; none if there is no such list of texts of three and more letters."""

    def of(items) -> list[str]:
        found, run = [], ""
        for op, value in [*items, (None, None)]:
            if op is parser.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            found, run = found + [[run]] * bool(run), ""
            if op is parser.BRANCH:
                found.append([x for branch in value[1] for x in of(branch) or [""]])
            elif op is parser.SUBPATTERN:
                found.append(of(value[3]))
            elif op is parser.MAX_REPEAT and value[0] > 0:
                found.append(of(value[2]))
        return max((x for x in found if x), key=lambda x: min(map(len, x)), default=[])

    texts = sorted(set(of(parser.parse(pattern))))
    return texts if texts and min(map(len, texts)) >= 3 else []


def classify(text: Column) -> Column:
    """The kind of a log text: first match in the ordered table, else null. A pattern is tried where one of its required texts is found, which is cheap to look for."""
    other = {"http_429": is_rate_limit, "http_5xx": is_server_error}

    def possible(low: Column, pattern: str) -> list[Column]:
        return [reduce(lambda a, x: a | x, [low.contains(x) for x in texts]) for texts in [required(pattern)] if texts]

    def kind_of(t: Column) -> Column:
        cases = [reduce(lambda a, x: a & x, [*possible(t["low"], p), t["text"].rlike("(?i)" + p)]) if p else other[kind](t["text"]) for kind, p in V.LOG_PATTERNS]
        return first_of([(c, F.lit(kind)) for c, (kind, _) in zip(cases, V.LOG_PATTERNS, strict=True)])

    return bound(F.struct(text.alias("text"), F.lower(text).alias("low")), kind_of)


def level_of(word: Column) -> Column:
    """The severity that a level word or number stands for; numbers from 10 are application levels, smaller ones syslog's."""
    w = F.lower(F.trim(word))
    n = F.when(w.rlike(r"^\d{1,9}\z"), w).cast("int")
    cases = [(n >= 60, "critical"), (n >= 50, "error"), (n >= 40, "warn"), (n >= 10, "info"), (n <= 2, "critical"), (n == 3, "error"), (n == 4, "warn"), (n >= 5, "info")]
    return first_of([(c, F.lit(s)) for c, s in cases] + [(w.isin(words), F.lit(s)) for s, words in V.LEVEL_WORDS.items()])


def level_in(text: Column) -> Column:
    """The severity that the first 90 characters state: an upper-case level word, else a leading one of any case."""
    head = F.substring(text, 1, 90)
    upper, leading = F.regexp_extract(head, V.LEVEL_UPPER, 1), F.concat(F.regexp_extract(head, V.LEVEL_LEADING, 1), F.regexp_extract(head, V.LEVEL_LEADING, 2))
    return F.when(upper != "", level_of(upper)).when(leading != "", level_of(leading))


def rank(severity: Column) -> Column:
    """0 to 3; unknown severities rank as info."""
    return F.coalesce(first_of([(severity == s, F.lit(i)) for i, s in enumerate(V.SEVERITIES)]), F.lit(0))


def severity_at(r: Column) -> Column:
    return first_of([(r == i, F.lit(s)) for i, s in enumerate(V.SEVERITIES)])


def with_floor(kind: Column, level: Column) -> Column:
    """The higher of a level and the least severity of its kind."""
    floor = F.when(kind.isNull(), F.lit("info")).otherwise(F.coalesce(first_of([(kind == k, F.lit(s)) for k, s in V.FLOOR.items()]), F.lit("error")))
    return severity_at(F.greatest(rank(level), rank(floor)))


def is_anomaly(kind: Column, severity: Column) -> Column:
    return ~kind.isin(V.CONTEXT_KINDS) & ~((kind == "restart") & (severity == "info"))


PAIR = r"([A-Za-z_@][\w.@/-]*)=(\"(?:[^\"\\]|\\.)*\"|[^\s\"]*)"


def logfmt(text: Column) -> Column:
    """Map of k=v pairs; of a repeated key the first, quotes taken off and escapes undone."""
    bare = lambda v: F.when(v.startswith('"'), F.regexp_replace(v.substr(F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(v)
    key = lambda p: F.substring_index(p, "=", 1)
    firsts = lambda found, keys: F.filter(found, lambda p, i: F.array_position(keys, key(p)) == i + 1)
    entry = lambda p: F.struct(key(p).alias("k"), bare(p.substr(F.length(key(p)) + 2, F.length(p))).alias("v"))
    # Found once and bound: named twice, the search would be made anew for every pair.
    return bound(F.regexp_extract_all(text, F.lit(PAIR), F.lit(0)), lambda found: bound(F.transform(found, key), lambda keys: F.map_from_entries(F.transform(firsts(found, keys), entry))))


def pairs_in(line: Column) -> Column:
    """The k=v pairs of a line, each behind a line break, for written_in: a line holds no breaks of its own."""
    return F.concat(F.lit("\n"), F.array_join(F.regexp_extract_all(line, F.lit(PAIR), F.lit(0)), "\n"))


def has_key(pairs: Column, key: str) -> Column:
    return pairs.contains(f"\n{key}=")


def written_in(pairs: Column, key: str) -> Column:
    """What stands behind the first pair of the key, from pairs_in; null without it."""
    mark = f"\n{key}="
    begin = F.length(F.substring_index(pairs, mark, 1)) + len(mark) + 1
    return F.when(has_key(pairs, key), F.substring_index(pairs.substr(begin, F.length(pairs)), "\n", 1))


def unquoted(value: Column) -> Column:
    """A written value as logfmt's map has it: quotes taken off and escapes undone."""
    bare = F.regexp_replace(F.substring(value, F.lit(2), F.length(value) - 2), r"\\(.)", "$1")
    return F.when(value.startswith('"'), bare).otherwise(value)


def clean_text(text: Column) -> Column:
    """Without byte-order mark and terminal colours, no-break spaces as spaces. Patterns are tried where their first character is found."""
    mark, escape = "\ufeff", "\x1b"
    bare = F.when(text.startswith(mark), F.regexp_replace(text, "^\\x{FEFF}", "")).otherwise(text)
    plain = lambda t: F.when(t.contains(escape), F.regexp_replace(t, "\\x1b\\[[0-9;?]*[ -/]*[@-~]", "")).otherwise(t)
    return F.replace(bound(bare, plain), F.lit("\xa0"), F.lit(" "))


# Parts of keys whose values are secrets, and values that are not secrets.
SECRET_KEY = r"[A-Za-z0-9_.-]*(?:password|passwd|pwd|secret|token|api[_-]?key|apikey|client[_-]?secret|private[_-]?key|access[_-]?key|auth[_-]?key|credentials?)[A-Za-z0-9_.-]*"
HARMLESS = r"(?:true|false|null|none|nil|yes|no|on|off|~|\*+|x+|<[^>]*>|\{\{.*\}\}|\$\{[^}]*\}|\$\(.*\)|\$[A-Z_][A-Z0-9_]*|changeme|redacted|\(redacted\)|\d{1,5}|secretKeyRef|valueFrom|configMapKeyRef|\|-?|>-?)"
REFERENCE_KEY = r"(?:name|refs?|path|file|type|kind|id)"


def redaction_passes() -> list[tuple[str, str, str]]:
    """(kind, pattern, replacement), in order; later passes leave marked values alone. All of it is fixed values."""
    mark = lambda kind: f"[REDACTED:{kind}]"
    marked = r"(?!\[REDACTED:)"
    harmless = rf"(?!{HARMLESS}(?:[\s\"',;&}}]|\z))"
    return [
        ("private-key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[\s\S]*?(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|\z)", mark("private-key")),
        ("jwt", r"\beyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]*", mark("jwt")),
        ("bearer", rf"\b(Bearer)(\s+){marked}([A-Za-z0-9._~+/=-]{{8,}})", "$1$2" + mark("bearer")),
        ("bearer", rf"\b(Basic)(\s+){marked}([A-Za-z0-9._~+/=-]{{8,}})", "$1$2" + mark("basic-auth")),
        ("aws-key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", mark("aws-key")),
        ("url-credential", rf"(?i)\b([a-z][a-z0-9+.-]*://)([^:/@\s]+):{marked}([^@\s/]+)@", "$1$2:" + mark("url-credential") + "@"),
        ("secret-value", rf"(?i)(name:[ \t]*[\"']?{SECRET_KEY}[\"']?[ \t]*\r?\n[ \t+\-]*value:[ \t]*)([\"']?){marked}{harmless}([^\s\"']+)\2", "$1$2" + mark("secret-value") + "$2"),
        ("secret-value", rf"(?i)([\"']?\b{SECRET_KEY}(?<!{REFERENCE_KEY})[\"']?[ \t]*[:=][ \t]*)([\"']?){marked}{harmless}([^\s\"',;&}}]+)\2", "$1$2" + mark("secret-value") + "$2"),
        ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b", mark("email")),
        (
            "base64",
            r"(^|[^A-Za-z0-9+/=_-])(?![0-9a-fA-F]+={0,2}(?![A-Za-z0-9+/=_-]))(?!/)(?![A-Za-z0-9+/]*//)(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[0-9])([A-Za-z0-9+/]{40,}={0,2})(?![A-Za-z0-9+/=_-])",
            "$1" + mark("base64"),
        ),
    ]


#: Without one of these, a pass finds nothing: cheap to look for, unlike its pattern.
NEEDED = {"private-key": ["PRIVATE KEY"], "jwt": ["eyJ"], "bearer": ["Bearer", "Basic"], "aws-key": ["AKIA", "ASIA"], "url-credential": ["://"], "email": ["@"]}
#: The same, of any case: parts of SECRET_KEY.
NEEDED_WORDS = {"secret-value": ["passw", "pwd", "secret", "token", "key", "credential"]}


def _possible(kind: str, t: Column) -> Column:
    if kind in NEEDED:
        return reduce(lambda a, x: a | x, [t.contains(x) for x in NEEDED[kind]])
    if kind in NEEDED_WORDS:
        return bound(F.lower(t), lambda low: reduce(lambda a, x: a | x, [low.contains(x) for x in NEEDED_WORDS[kind]]))
    return F.length(t) >= 40 if kind == "base64" else F.lit(True)


def redacted(df: DataFrame, column: str) -> DataFrame:
    """df with the column redacted and `counts`, a map of kinds to how many were replaced.

    A pass's text is a column of its own, computed once for the next pass and its
    count; a pass whose literals are absent is skipped.
    """
    passes, names = redaction_passes(), [f"_n{i}" for i in range(len(redaction_passes()))]
    df = df.withColumn(column, F.coalesce(column, F.lit("")))
    for name, (kind, pattern, new) in zip(names, passes, strict=True):
        t = F.col(column)
        df = df.withColumn(name, F.when(_possible(kind, t), F.regexp_count(t, F.lit(pattern))).otherwise(0))
        df = df.withColumn(column, F.when(F.col(name) > 0, F.regexp_replace(t, pattern, new)).otherwise(t))
    kinds: dict[str, Column] = {}
    for name, (kind, _, _) in zip(names, passes, strict=True):
        kinds[kind] = kinds[kind] + F.col(name) if kind in kinds else F.col(name)
    return df.withColumn("counts", F.create_map(*[x for k, c in kinds.items() for x in (F.lit(k), c)])).drop(*names)


def redacted_pane(df: DataFrame, column: str) -> DataFrame:
    """redacted, with as many lines as before: the mark of a private key is followed by the breaks that the key had, so lines keep their numbers."""
    kind, pattern, mark = redaction_passes()[0]
    t = F.coalesce(column, F.lit(""))
    breaks = lambda key: F.regexp_count(key, F.lit(r"\r\n|\r|\n"))

    def padded(parts: Column) -> Column:
        keys = F.transform(F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)), lambda key: F.concat(F.lit(mark), F.repeat(F.lit("\n"), breaks(key))))
        after = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.concat(parts[0], F.array_join(F.zip_with(keys, after, lambda key, rest: F.concat(key, rest)), ""))

    has = t.contains(NEEDED[kind][0])
    df = df.withColumns({"_keys": F.when(has, F.regexp_count(t, F.lit(pattern))).otherwise(0), column: F.when(has, F.transform(F.array(F.split(t, pattern)), padded)[0]).otherwise(t)})
    out = redacted(df, column)
    return out.withColumn("counts", F.transform_values("counts", lambda k, n: n + F.when(k == kind, F.col("_keys")).otherwise(0))).drop("_keys")


# Columns that hold ids and closed vocabularies, which are never redacted.
KEPT = set("id ids signal_id change_id component_id related_ids from to source kind kinds severity status category risk type role cluster clusters namespace state tool incident_id component".split())


def scrubbed(df: DataFrame) -> DataFrame:
    """df with every text column redacted but those that hold ids and closed vocabularies."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), redact(F.col(c))) for c, kind in df.dtypes if kind == "string" and c.lower() not in KEPT})


def redact(text: Column) -> Column:
    """Text with secrets, credentials, addresses and blobs replaced by marks that name their kind."""
    once = lambda t, p: bound(t, lambda x: F.when(_possible(p[0], x), F.regexp_replace(x, p[1], p[2])).otherwise(x))
    return reduce(once, redaction_passes(), F.coalesce(text, F.lit("")))


def looks_secret(key: Column, value: Column) -> Column:
    """Whether a key names a secret or a value would be redacted."""
    hit = lambda v: reduce(lambda a, x: a | x, [_possible(k, v) & v.rlike(p) for k, p, _ in redaction_passes()])
    return F.coalesce(key.rlike(f"(?i)^{SECRET_KEY}\\z"), F.lit(False)) | bound(F.coalesce(value, F.lit("")), hit)


def alert_kind(name: Column, reason: Column | None = None, job: Column | None = None) -> Column:
    """The kind that an alert's name stands for; waiting containers go by their reason, failed jobs by their name."""
    cases = []
    for kind, pattern, exact in V.ALERT_PATTERNS:
        hit = name.rlike(pattern if exact else f"(?i){pattern}")
        if kind == "waiting":
            cases += [(hit & reason.rlike(f"(?i){p}"), F.lit(k)) for k, p in V.WAITING_REASONS] if reason is not None else []
        elif kind == "job":
            cases += [(hit & job.rlike("(?i)migrat"), F.lit("migration"))] if job is not None else []
        else:
            cases.append((hit, F.lit(kind)))
    return F.coalesce(first_of(cases), F.lit("alert_firing"))


def alert_severity(label: Column, status: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    known = first_of([(low.isin(words), F.lit(s)) for s, words in V.ALERT_SEVERITY.items()])
    return F.when(status == "resolved", "info").otherwise(F.coalesce(known, F.when(status == "pending", "info").otherwise("warn")))
