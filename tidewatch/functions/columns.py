"""Column expressions shared by the operators, all of built-in functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schemas import (
    DISPLAY_TZ,
    INSTANCE_STATES_ANALYZED,
    LB_STATES_ANALYZED,
    LOAD_BALANCER,
    RESOURCE_TYPE_LABELS,
    RUN_STATUS_LABELS,
    SCALING_GROUP,
    SEVERITY_RANKS,
    STATUS_KINDS,
    THRESHOLD_OPERATORS,
)


def lookup(col: Column, mapping: dict, default=None) -> Column:
    """``mapping[col]`` as a ``CASE``; ``default`` may be a column or a literal."""
    expr = None
    for key, value in mapping.items():
        hit = col == F.lit(key)
        expr = F.when(hit, F.lit(value)) if expr is None else expr.when(hit, F.lit(value))
    return expr if default is None else expr.otherwise(default)


def or_else(col: Column, default) -> Column:
    """Null or empty text falls back to ``default``."""
    return F.coalesce(F.nullif(col, F.lit("")), default if isinstance(default, Column) else F.lit(default))


# --- time -------------------------------------------------------------------------


def instant(at: dt.datetime, kind: T.DataType = T.TimestampType()) -> Column:
    """A literal time, of a zone-less column's type if so asked. A time without a zone is UTC on any driver."""
    plain = at.astimezone(dt.timezone.utc).replace(tzinfo=None) if at.tzinfo else at
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(plain.isoformat(sep=" ")).cast(kind)
    return F.lit(plain.isoformat(sep=" ") + "+00:00").cast("timestamp")


def to_display(ts: Column) -> Column:
    """The wall clock shown to people, as a timestamp to be formatted only."""
    return F.from_utc_timestamp(ts, DISPLAY_TZ)


def clock_label(ts: Column) -> Column:
    return F.date_format(to_display(ts), "HH:mm")


def trend_label(ts: Column) -> Column:
    return F.date_format(to_display(ts), "dd MMM, HH:mm")


def iso_display(ts: Column) -> Column:
    """ISO-8601 text with the display offset, which never changes over the year there; a fraction only if there is one."""
    whole = F.unix_micros(ts) % 1_000_000 == 0
    local = to_display(ts)
    text = F.when(whole, F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return F.concat(text, F.lit("+05:30"))


def run_id_of(ts: Column) -> Column:
    return F.date_format(to_display(ts), "dd-MM-yyyy_HH-mm-ss")


def clock_text_of(ts: Column) -> Column:
    return F.concat(F.date_format(to_display(ts), "dd-MM-yyyy HH:mm:ss"), F.lit(" IST"))


def _display_parse(text: Column, fmt: str) -> Column:
    return F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(fmt)), DISPLAY_TZ)


def parse_clock_text(text: Column) -> Column:
    """``dd-MM-yyyy HH:mm:ss IST``; null when it does not parse."""
    return _display_parse(F.trim(F.replace(text, F.lit("IST"), F.lit(""))), "d-M-yyyy H:m:s")


def parse_run_id(text: Column) -> Column:
    """Both run-id layouts: ``dd-MM-yyyy_HH-mm-ss`` and ``yyyyMMdd_HHmmss``."""
    return F.coalesce(_display_parse(text, "d-M-yyyy_H-m-s"), _display_parse(text, "yyyyMMdd_HHmmss"))


def is_run_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{2}-\d{2}-\d{4}_\d{2}-\d{2}-\d{2}$"), F.lit(False))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000.0)


# --- numbers ----------------------------------------------------------------------


def round2(col: Column) -> Column:
    return F.round(col, 2)


def round_whole(value: Column) -> Column:
    """Nearest whole number, halves to even; null for anything that is not a number."""
    return F.bround(value.try_cast("double"), 0).try_cast("bigint")


def unit_confidence(raw: Column) -> Column:
    """Confidence given as a fraction or as a percentage, as a fraction in [0, 1]."""
    value = raw.try_cast("double")
    return (
        F.when(value.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(value), F.lit(1.0))
        .when(value < 0, F.lit(0.0))
        .when(value <= 1, value)
        .when(value <= 100, value / 100)
        .otherwise(F.lit(1.0))
    )


def clamp_percent(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(round_whole(value), F.lit(0)))).cast("int")


# --- vocabularies -----------------------------------------------------------------


def type_label(raw: Column) -> Column:
    return F.nullif(lookup(raw, RESOURCE_TYPE_LABELS, raw), F.lit(""))


def severity_rank(severity: Column) -> Column:
    return lookup(severity, SEVERITY_RANKS, F.lit(0))


def run_status_label(status: Column) -> Column:
    return lookup(F.upper(status), RUN_STATUS_LABELS, status)


def status_check_label(latest: Column) -> Column:
    return F.when(latest.isNull(), "UNKNOWN").when(latest == 0, "PASS").otherwise("FAILED")


def operator_code(raw: Column) -> Column:
    """GT/GTE/LT/LTE; null for band operators, whose threshold is not one number."""
    return lookup(raw, THRESHOLD_OPERATORS)


def breaches(value: Column, op: Column, threshold: Column) -> Column:
    return F.coalesce(
        F.when(op == "GT", value > threshold)
        .when(op == "GTE", value >= threshold)
        .when(op == "LT", value < threshold)
        .when(op == "LTE", value <= threshold)
        .when(op == "EQ", value == threshold),
        F.lit(False),
    )


def is_healthy(status: Column) -> Column:
    return F.coalesce(F.lower(F.trim(status)) == "healthy", F.lit(False))


def dims_key(dims: Column) -> Column:
    """Dimensions as a set: order and repeats do not matter."""
    return F.array_sort(F.array_distinct(F.coalesce(dims, F.array().cast("array<struct<name:string,value:string>>"))))


def state_text(resource_type: Column, instance_state: Column, lb_state: Column) -> Column:
    raw = F.when(resource_type == LOAD_BALANCER, lb_state).otherwise(instance_state)
    return F.when(resource_type == SCALING_GROUP, F.lit("active")).otherwise(or_else(F.lower(F.trim(raw)), "unknown"))


def is_analyzed_state(resource_type: Column, state: Column) -> Column:
    return (
        F.when(resource_type == LOAD_BALANCER, state.isin(LB_STATES_ANALYZED))
        .when(resource_type == SCALING_GROUP, F.lit(True))
        .otherwise(state.isin(INSTANCE_STATES_ANALYZED))
    )


def run_status(analyzed: Column, successful: Column, failed: Column) -> Column:
    return (
        F.when((failed > 0) & (successful > 0), "PARTIAL_SUCCESS")
        .when((analyzed > 0) & (failed == analyzed), "FAILED")
        .otherwise("SUCCESS")
    )


# --- ARN suffixes -----------------------------------------------------------------


def lb_dimension(arn: Column) -> Column:
    """Text behind ``loadbalancer/``; null when the marker is missing."""
    return F.when(arn.contains("loadbalancer/"), F.split(arn, "loadbalancer/")[1])


def target_group_dimension(arn: Column) -> Column:
    return F.when(arn.contains("targetgroup/"), F.concat(F.lit("targetgroup/"), F.split(arn, "targetgroup/")[1]))


# --- display ----------------------------------------------------------------------

DASH = "—"


def duration_text(seconds: Column) -> Column:
    s = seconds.try_cast("bigint")
    minutes = F.floor(s / 60)
    return (
        F.when(s.isNull(), DASH)
        .when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(minutes.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))
    )


def number_text(value: Column) -> Column:
    v = value.try_cast("double")
    return (
        F.when(v.isNull(), DASH)
        .when(v == F.floor(v), F.format_number(v, 0))
        .otherwise(F.format_number(v, 1))
    )


def datetime_text(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "MMM dd, yyyy hh:mm a"), F.lit(DASH))


def age_text(ts: Column, as_of: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / 1_000_000))
    return (
        F.when(ts.isNull(), DASH)
        .when(s < 60, "just now")
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" hr ago")))
        .when(s < 30 * 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(ts, "MMM dd, yyyy"))
    )


def short_text(text: Column, length: int = 160, empty: str = "No summary available.") -> Column:
    full = or_else(text, empty)
    return F.when(F.length(full) <= length, full).otherwise(
        F.concat(F.rtrim(F.substring(full, 1, length - 1)), F.lit("…"))
    )


def severity_kind(severity: Column) -> Column:
    low = F.lower(severity)
    return F.when(low.isin("critical", "high", "medium", "low"), low).otherwise("neutral")


def status_kind(status: Column) -> Column:
    return lookup(F.lower(status), STATUS_KINDS, F.lit("neutral"))
