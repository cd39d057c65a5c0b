"""Event time parsing, UTC stamps and display helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_ts(text: Column) -> Column:
    """Instant of an ISO-8601 text, NULL when it does not start with a date."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def as_instant(as_of: str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def prune_days(entries: DataFrame, since: Column, slack_days: int = 0) -> DataFrame:
    """Leave out day partitions of the stored log that end before ``since``; other tables are unchanged.

    Rows whose time could not be parsed or ran ahead of their arrival stand in the day ``unknown``, which is always read.
    """
    if "event_date" not in entries.columns:
        return entries
    first = F.date_format(since - F.expr(f"interval {int(slack_days)} days"), "yyyy-MM-dd")
    return entries.where((F.col("event_date") >= first) | (F.col("event_date") == "unknown"))


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_stamp(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in UTC, the form control tables store."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def utc_hours_ago(as_of: str | Column, hours: int) -> Column:
    return utc_stamp(as_instant(as_of) - F.expr(f"interval {int(hours)} hours"))


def clock(text: Column) -> Column:
    sliced = F.nullif(F.substring(text, 12, 8), F.lit(""))
    return F.coalesce(F.date_format(event_ts(text), "HH:mm:ss"), sliced, F.lit("--:--:--"))


def day(text: Column) -> Column:
    return F.coalesce(F.date_format(event_ts(text), "MM-dd"), F.lit(""))


def relative(then: Column, as_of: str | Column) -> Column:
    """``just now`` / ``Nm ago`` / ``Nh ago`` / ``Nd ago``, floored, never negative."""
    seconds = F.greatest(F.lit(0).cast("bigint"), F.unix_seconds(as_instant(as_of)) - F.unix_seconds(then))
    mins = F.floor(seconds / 60)
    hours = F.floor(seconds / 3600)
    days = F.floor(seconds / 86400)
    return (F.when(mins < 1, F.lit("just now"))
            .when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
            .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
            .otherwise(F.concat(days.cast("string"), F.lit("d ago"))))


# Least and greatest digits in the shape of a time text; signs stand for themselves.
_LEAST, _GREATEST = "0000-00-00T00:00:00.000Z", "9999-99-99T99:99:99.999Z"


def order_key(timestamp: Column) -> Column:
    """A number that orders as the time text does: of two texts the smaller never has the greater number.

    Texts of the shape ``yyyy-MM-ddTHH:mm:ss.SSSZ`` give their 17 digits, each its own number. Any other text gives the number of the nearest text of that shape
    on the far side of where it leaves the shape: it keeps the part that fits and goes on with the least digits, if its next sign is
    too small, or with the greatest. So other texts may share a number; who needs their order compares the texts. NULL gives -1.
    """
    shape = ""
    for sign in reversed(_LEAST):
        shape = f"(?:{'[0-9]' if sign == '0' else re.escape(sign)}{shape})?"
    head = F.regexp_extract(timestamp, f"^{shape}", 0)
    at = F.length(head) + 1
    rest = F.when(F.substring(timestamp, at, F.lit(1)) < F.substring(F.lit(_LEAST), at, F.lit(1)), F.substring(F.lit(_LEAST), at, F.lit(24)))
    fitted = F.concat(head, rest.otherwise(F.substring(F.lit(_GREATEST), at, F.lit(24))))
    usual = F.regexp_replace(timestamp, "[-T:.Z]", "").cast("bigint")
    return F.coalesce(F.when(timestamp.rlike(f"^{re.sub('0', '[0-9]', _LEAST.replace('.', '[.]'))}$"), usual).otherwise(F.regexp_replace(fitted, "[-T:.Z]", "").cast("bigint")), F.lit(-1).cast("bigint"))


def key_text(key: Column) -> Column:
    """The time text of the usual shape whose ``order_key`` is ``key``."""
    digits, at, parts = F.lpad(key.cast("string"), 17, "0"), 1, []
    for run in re.split("([0-9]+)", _LEAST):
        if run.isdigit():
            parts.append(F.substring(digits, at, len(run)))
            at += len(run)
        elif run:
            parts.append(F.lit(run))
    return F.concat(*parts)
