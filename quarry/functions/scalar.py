"""Scalar Column functions (N1-N10, M11-M13): all built-in expressions, codegen friendly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def abbrev_number(x: Column) -> Column:
    """>= 1000 -> 'x.xK' (one decimal), else the number as text."""
    return F.when(x >= 1000, F.concat(F.format_string("%.1f", x / 1000.0), F.lit("K"))).otherwise(
        x.cast("string"))


def capitalize(s: Column) -> Column:
    """Upper-case the first character only (not initcap)."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def format_date(ts: Column, long: bool = False) -> Column:
    """N3: 'Mon D, YYYY' or 'Month D, YYYY at HH:MM AM'; NULL -> 'N/A'."""
    fmt = "MMMM d, yyyy 'at' hh:mm a" if long else "MMM d, yyyy"
    return F.coalesce(F.date_format(ts, fmt), F.lit("N/A"))


def parse_tags(s: Column) -> Column:
    """Split on comma, trim, drop empty."""
    return F.filter(F.transform(F.split(s, ","), lambda t: F.trim(t)), lambda t: t != "")


def first_other_tag(tags: Column, task: Column) -> Column:
    """First tag different from the task, else 'Unknown'."""
    return F.coalesce(F.try_element_at(F.filter(tags, lambda t: t != task), F.lit(1)), F.lit("Unknown"))


def json_field(js: Column, path: str, default=None) -> Column:
    """Lift a JSON field with a default."""
    v = F.get_json_object(js, path)
    return F.coalesce(v, F.lit(default)) if default is not None else v


def to_percent(x: Column) -> Column:
    """A ratio in [0, 1] becomes a percent; larger values are taken as percent already."""
    return F.when(x <= 1, x * 100.0).otherwise(x)


def to_ratio(x: Column) -> Column:
    """A percent (> 1) becomes a ratio."""
    return F.when(x > 1, x / 100.0).otherwise(x)


def mask_secret(s: Column) -> Column:
    """<= 8 characters -> '***', else first 8 + '...' + last 4."""
    return F.when(F.char_length(s) <= 8, F.lit("***")).otherwise(
        F.concat(F.substring(s, 1, 8), F.lit("..."), F.substring(s, -4, 4)))


def mask_url_password(url: Column) -> Column:
    """N10: 'scheme://user:password@host' -> 'scheme://user:***@host'."""
    return F.regexp_replace(url, r"^([^:/]+://[^:@/]+):[^@]*@", "$1:***@")


def format_duration(seconds: Column, style: str = "long") -> Column:
    """M11: 'long' = 'Hh Mm Ss' / 'Mm Ss' / 'Ss'; 'short' = 'Hh Mm' from one hour, else 'Mm Ss' / 'Ss'."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long"), F.pmod(s, F.lit(60))
    if style == "short":
        return (F.when(s.isNull(), F.lit(None)).when(s < 60, F.format_string("%ds", s))
                .when(s < 3600, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%dh %dm", h, m)))
    return (F.when(s.isNull(), F.lit(None)).when(h > 0, F.format_string("%dh %dm %ds", h, m, r))
            .when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r)))


def format_duration_ui(seconds: Column) -> Column:
    """M11 (UI): NULL or 0 -> 'N/A', else the long style."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, F.lit("N/A")).otherwise(format_duration(seconds, "long"))


def parse_duration(txt: Column) -> Column:
    """M12: '(\\d+)h', '(\\d+)m', '(\\d+)s' -> seconds (missing parts count 0)."""
    def part(unit: str, mult: int) -> Column:
        v = F.regexp_extract(txt, rf"(\d+){unit}", 1)
        return F.coalesce(F.when(v != "", v.cast("long")), F.lit(0)) * mult
    return part("h", 3600) + part("m", 60) + part("s", 1)


def avg_time_per_iteration(duration: Column, iterations: Column) -> Column:
    """Duration / iterations as 'x.xs' / 'x.xm' / 'x.xh'; 'N/A' when missing."""
    a = F.try_divide(duration.cast("double"), iterations.cast("double"))
    ok = (F.coalesce(duration, F.lit(0)) != 0) & (F.coalesce(iterations, F.lit(0)) > 0)
    txt = (F.when(a < 60, F.format_string("%.1fs", a)).when(a < 3600, F.format_string("%.1fm", a / 60))
           .otherwise(F.format_string("%.1fh", a / 3600)))
    return F.when(ok, txt).otherwise(F.lit("N/A"))


def epoch_micros(ts: Column, ntz: bool = True) -> Column:
    """Microseconds since 1970-01-01 00:00:00.

    TIMESTAMP_NTZ is a wall-clock value: its fields are re-read as a UTC
    timestamp, so no session time zone (and no DST gap or overlap) shifts it.
    """
    if not ntz:
        return F.unix_micros(ts)
    utc = F.make_timestamp(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts),
                           F.date_part(F.lit("SECOND"), ts), F.lit("UTC"))
    return F.unix_micros(utc)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end of two TIMESTAMP_NTZ values, zone-free."""
    return F.floor((epoch_micros(end) - epoch_micros(start)) / 1_000_000).cast("long")
