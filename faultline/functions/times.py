"""Instants in epoch milliseconds, ages and durations: Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import bound, first_of

_UNITS = "ms|us|µs|μs|ns|y|w|d|h|m|s"


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded half towards plus infinity."""
    p = float(10**digits)
    return F.floor(x * p + 0.5) / p


def age_ms(text: Column) -> Column:
    """Milliseconds of an age such as 3m12s or 5d4h: the leading token only; null if it isn't one."""
    token = F.split(F.trim(text), r"\s+")[0]
    unit = lambda u: first_of([(u == k, F.lit(v)) for k, v in V.UNIT_MS.items()])
    pair = rf"(\d+(?:\.\d+)?)({_UNITS})"
    terms = F.zip_with(F.regexp_extract_all(token, F.lit(pair), F.lit(1)), F.regexp_extract_all(token, F.lit(pair), F.lit(2)), lambda n, u: n.cast("double") * unit(u))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(token.rlike(rf"^(?:\d+(?:\.\d+)?(?:{_UNITS}))+\z"), half_up(total).cast("long"))


def duration_ms(text: Column, unit: str = "ms") -> Column:
    """Milliseconds of a number with or without a unit, else of an age."""
    pattern = r"^(\d+(?:\.\d+)?)\s*(ms|us|µs|μs|ns|s|m|h)?\z"
    t = F.trim(text)
    u = F.regexp_extract(t, pattern, 2)
    factor = first_of([(u == "", F.lit(V.UNIT_MS[unit]))] + [(u == k, F.lit(v)) for k, v in V.UNIT_MS.items()])
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1).cast("double") * factor).otherwise(age_ms(t).cast("double"))


def epoch_ms(n: Column) -> Column:
    """Milliseconds of an epoch number whose size tells its unit: seconds, milli-, micro- or nanoseconds."""
    a, x = F.abs(n), n.cast("double")
    return half_up(F.when(a < 1e11, x * 1000).when(a < 1e14, x).when(a < 1e17, x / 1000).otherwise(x / 1e6)).cast("long")


def offset_minutes(zone: Column) -> Column:
    """Minutes east of Greenwich; null for zones that are unknown or ambiguous."""
    z = F.trim(zone)
    pattern = r"(?i)^(?:utc|gmt)?\s*([+\-\x{2212}])\s*(\d{1,2})(?::?(\d{2}))?\z"
    h, m = F.regexp_extract(z, pattern, 2).try_cast("int"), F.coalesce(F.regexp_extract(z, pattern, 3).try_cast("int"), F.lit(0))
    sign = F.when(F.regexp_extract(z, pattern, 1) == "+", 1).otherwise(-1)
    named = F.try_element_at(F.create_map(*[F.lit(x) for zone in V.ZONES.items() for x in zone]), F.lower(z))  # one look at the name, not one for each zone
    return F.when(z == "", 0).when(z.rlike(pattern), F.when((h <= 14) & (m <= 59), sign * (h * 60 + m))).otherwise(named)


def _utc_ms(stamp: Column) -> Column:
    """Milliseconds of 'yyyy-MM-dd HH:mm:ss' read as UTC, whatever the session's zone."""
    days = F.datediff(F.to_date(F.substring(stamp, 1, 10)), F.lit("1970-01-01").cast("date"))
    clock = [F.substring(stamp, a, 2).cast("long") for a in (12, 15, 18)]
    return (((days.cast("long") * 24 + clock[0]) * 60 + clock[1]) * 60 + clock[2]) * 1000


#: Shapes of a leading stamp: ISO, syslog, epoch.
LEAD_ISO = r"^\[?(\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:?\d{2}|\s?UTC|\s?GMT)?\]?(?:\s+|\z)"
LEAD_SYSLOG = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})(?:\.(\d+))?\s+"
LEAD_EPOCH = r"^(\d{10}(?:\.\d{1,9})?|\d{13})\s+"
# Month names.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def leading_stamp(line: Column, year: int = 1970, default_offset: int = 0) -> Column:
    """Struct of ts_ms, inferred (a zone or year was supplied by us), format and rest; null fields without a stamp."""
    iso, syslog, epoch = (line.rlike(p) for p in (LEAD_ISO, LEAD_SYSLOG, LEAD_EPOCH))
    millis = lambda digits: F.coalesce(F.rpad(F.substring(digits, 1, 3), 3, "0").try_cast("long"), F.lit(0).cast("long"))
    #: The groups of a shape, from the stamp alone: the line behind it is not gone through.
    groups = lambda p, n: F.split(F.regexp_replace(F.regexp_extract(line, p, 0), p, "\x00".join(f"${i + 1}" for i in range(n))), "\x00")
    zone = F.trim(F.regexp_extract(line, LEAD_ISO, 3))
    east = lambda z: F.when(z == "", default_offset).when(z == "Z", 0).otherwise(offset_minutes(z)) * 60000
    at_iso = bound(groups(LEAD_ISO, 3), lambda g: _utc_ms(F.replace(g[0], F.lit("/"), F.lit("-"))) + millis(g[1]) - bound(F.trim(g[2]), east))

    def of_syslog(g: Column) -> Column:
        month = reduce(lambda c, m: c.when(g[0] == m[1], f"{m[0]:02}"), enumerate(MONTHS, 1), F)
        return bound(F.concat(F.lit(f"{year:04}-"), month, F.lit("-"), F.lpad(g[1], 2, "0"), F.lit(" "), g[2]), _utc_ms) + millis(g[3]) - default_offset * 60000

    at_syslog = bound(groups(LEAD_SYSLOG, 4), of_syslog)
    at_epoch = bound(F.regexp_extract(line, LEAD_EPOCH, 1).try_cast("double"), epoch_ms)
    chosen = lambda *v: F.when(iso, v[0]).when(syslog, v[1]).when(epoch, v[2])
    rest = [F.regexp_replace(line, p, "") for p in (LEAD_ISO, LEAD_SYSLOG, LEAD_EPOCH)]
    return F.struct(
        chosen(at_iso, at_syslog, at_epoch).alias("ts_ms"),
        F.coalesce(chosen(zone == "", F.lit(True), F.lit(False)), F.lit(False)).alias("inferred"),
        chosen(F.lit("iso"), F.lit("syslog"), F.lit("epoch")).alias("format"),
        F.coalesce(chosen(*rest), line).alias("rest"),
    )


# Whole stamps: day and month names first, C's form, syslog's and klog's without a year.
ISO = r"(?i)^(\d{4})[-/](\d{2})[-/](\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?\s*(Z|[+-]\d{2}(?::?\d{2})?|UTC|GMT)?(?:\s+\(?([A-Za-z]{2,5})\)?)?(?:\s+m=[+-][\d.]+)?$"
RFC_1123 = r"^(?:[A-Za-z]{3},?\s+)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+(\d{2}:\d{2})(?::(\d{2})(?:\.(\d+))?)?\s*(Z|[+-]\d{2}:?\d{2}|[A-Za-z]{1,5})?$"
ANSIC = r"^(?:[A-Za-z]{3}\s+)?([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})(?:\.(\d+))?\s+(?:([A-Za-z]{2,5}|[+-]\d{4})\s+)?(\d{4})$"
SYSLOG = r"^([A-Za-z]{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})(?:\.(\d+))?$"
KLOG = r"^(\d{2})(\d{2})\s+(\d{2}:\d{2}:\d{2})(?:\.(\d+))?$"
EPOCH = r"^-?\d{9,19}(?:\.\d+)?$"
DAY = 86_400_000


def parsed_stamp(text: Column, now_ms: Column, year: Column | None = None, default_offset: int = 0) -> Column:
    """Struct of ts_ms, zone_assumed and year_assumed of a whole stamp in one of six forms; nulls if it is none.

    A form without a year takes the year given, else now's; without one given, a stamp over a day after now is last year's.
    """
    t = F.trim(text)
    part = lambda p, i: F.regexp_extract(t, p, i)
    some = lambda c, other: F.when(c != "", c).otherwise(other)
    iso, rfc, c, sys_, klog, epoch = (t.rlike(p) for p in (ISO, RFC_1123, ANSIC, SYSLOG, KLOG, EPOCH))
    months = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m.lower(), f"{i:02}")])
    named = F.try_element_at(months, F.lower(first_of([(rfc, part(RFC_1123, 2)), (c, part(ANSIC, 1)), (sys_, part(SYSLOG, 1))])))
    month = first_of([(iso, part(ISO, 2)), (klog, part(KLOG, 1)), (rfc | c | sys_, named)])
    day = F.lpad(first_of([(iso, part(ISO, 3)), (rfc, part(RFC_1123, 1)), (c, part(ANSIC, 2)), (sys_, part(SYSLOG, 2)), (klog, part(KLOG, 2))]), 2, "0")
    short = lambda clock, seconds: F.concat(some(clock, "00:00"), F.lit(":"), some(seconds, "00"))
    clock = first_of([(iso, short(part(ISO, 4), part(ISO, 5))), (rfc, short(part(RFC_1123, 4), part(RFC_1123, 5))), (c, part(ANSIC, 3)), (sys_, part(SYSLOG, 3)), (klog, part(KLOG, 3))])
    digits = first_of([(iso, part(ISO, 6)), (rfc, part(RFC_1123, 6)), (c, part(ANSIC, 4)), (sys_, part(SYSLOG, 4)), (klog, part(KLOG, 4))])
    zone = first_of([(iso, some(part(ISO, 7), part(ISO, 8))), (rfc, part(RFC_1123, 7)), (c, part(ANSIC, 5))])
    stated = first_of([(iso, part(ISO, 1)), (rfc, part(RFC_1123, 3)), (c, part(ANSIC, 6))])
    now_year = F.year(F.timestamp_millis(now_ms))
    assumed = now_year if year is None else F.coalesce(year.cast("int"), now_year)
    given = F.lit(False) if year is None else year.isNotNull()
    fields = F.struct(
        epoch.alias("epoch"), (iso | rfc | c).alias("dated"), (sys_ | klog).alias("yearless"), F.when(epoch, epoch_ms(t.try_cast("double"))).alias("at"), stated.alias("y"), month.alias("mo"), day.alias("d"), clock.alias("clock"), digits.alias("digits"),
        F.when(zone != "", zone).alias("zone"), assumed.alias("assumed"), now_ms.alias("now"), given.alias("given"),
    )

    def placed(p: Column, offset: Column) -> Column:
        rest = F.coalesce(F.rpad(F.substring(p["digits"], 1, 3), 3, "0").try_cast("long"), F.lit(0).cast("long")) - F.coalesce(offset, F.lit(default_offset)) * 60_000
        at = lambda back: _utc_ms(F.concat_ws(" ", F.concat_ws("-", F.coalesce(p["y"], F.lpad((p["assumed"] - back).cast("string"), 4, "0")), p["mo"], p["d"]), p["clock"])) + rest

        def chosen(this: Column) -> Column:
            ts = F.when(p["epoch"], p["at"]).when(p["yearless"] & ~p["given"] & (this > p["now"] + DAY), at(1)).when(p["dated"] | p["yearless"], this).cast("long")
            return F.struct(ts.alias("ts_ms"), F.when(ts.isNotNull(), ~p["epoch"] & offset.isNull()).alias("zone_assumed"), F.when(ts.isNotNull(), p["yearless"]).alias("year_assumed"))

        return bound(F.when(p["dated"] | p["yearless"], at(0)), chosen)

    return bound(fields, lambda p: bound(offset_minutes(p["zone"]), lambda offset: placed(p, offset)))


def window_minutes(text: Column) -> Column:
    """Minutes of a plain window length such as 1h or 3 days."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)\s*(m|min|mins|minutes?|h|hr|hours?|d|days?)\s*\z"
    unit = F.lower(F.substring(F.regexp_extract(text, pattern, 2), 1, 1))
    factor = F.when(unit == "m", 1.0).when(unit == "h", 60.0).when(unit == "d", 1440.0)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1).try_cast("double") * factor)


def quantity(text: Column) -> Column:
    """The number that a Kubernetes quantity stands for."""
    pattern = r"^\s*\"?(\d+(?:\.\d+)?)\s*(Ki|Mi|Gi|Ti|k|K|M|G|T|m)?\"?\s*\z"
    unit = F.regexp_extract(text, pattern, 2)
    factor = first_of([(unit == k, F.lit(v)) for k, v in V.QUANTITY.items()])
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1).try_cast("double") * factor)
