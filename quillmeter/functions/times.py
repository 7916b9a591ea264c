"""Days and instants from texts that collectors write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3339 with any fraction; groups: date, time to the second, fraction, zone.
_RFC3339 = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}:[0-9]{2})(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def instant(text: Column) -> Column:
    """The instant of an RFC 3339 text, to the microsecond; null for any other text."""
    zone = F.upper(F.regexp_extract(text, _RFC3339, 4))
    fraction = F.rpad(F.substr(F.regexp_extract(text, _RFC3339, 3), F.lit(2), F.lit(6)), 6, "0")
    plain = F.concat(F.regexp_extract(text, _RFC3339, 1), F.lit(" "), F.regexp_extract(text, _RFC3339, 2), F.lit("."), fraction, zone)
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSXXX")))


def line_instant(timestamp: Column, ts: Column) -> Column:
    """The instant of a line: its ``timestamp`` text, or ``ts`` where it has none; a text that can't be read has no other."""
    return instant(F.coalesce(timestamp, ts))


def line_day(timestamp: Column, ts: Column, file_day: Column) -> Column:
    """The UTC day that a line counts for: the file's day where the line has no readable time."""
    return F.coalesce(F.to_date(line_instant(timestamp, ts)), file_day)


def provider_day(text: Column) -> Column:
    """``YYYY-MM-DD`` from a day or the beginning of a time; null for what isn't a day of the calendar."""
    head = F.regexp_extract(F.trim(text), "^([0-9]{4}-[0-9]{2}-[0-9]{2})([T ].*)?$", 1)
    return F.date_format(F.try_to_date(F.nullif(head, F.lit("")), "yyyy-MM-dd"), "yyyy-MM-dd")


def day_span(first: Column, last: Column) -> Column:
    """Days from first to last, both counted."""
    return F.date_diff(last, first) + 1


def collection_window(now: Column, days: int = 120) -> tuple[Column, Column]:
    """First and last of the ``days`` whole UTC days before the one of ``now``."""
    last = F.date_sub(F.to_date(now), 1)
    return F.date_sub(last, days - 1), last


def nanos_text(nanos: Column) -> Column:
    """RFC 3339 in UTC of nanoseconds since 1970, no digit lost; trailing zeros of the fraction are left out."""
    rest = F.pmod(nanos.cast("long"), F.lit(1_000_000_000).cast("long"))
    seconds = F.call_function("div", nanos.cast("long") - rest, F.lit(1_000_000_000).cast("long"))
    rest = F.regexp_replace(F.lpad(rest.cast("string"), 9, "0"), "0+$", "")
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("Z"))


def is_utc_second(text: Column) -> Column:
    """Whether a text has the exact shape ``YYYY-MM-DDTHH:MM:SSZ``."""
    return text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$")


def retry_after(value: Column, now: Column, most_seconds: int = 1800) -> Column:
    """Seconds to wait by a Retry-After header: a number or an HTTP date, at most ``most_seconds``; null if neither."""
    text = F.trim(value)
    until = F.try_to_timestamp(F.regexp_extract(text, "^[A-Za-z]{3}, (.*) (GMT|[+]0000)$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.when(text.rlike("^[+]?[0-9]+$"), text.try_cast("decimal(38,0)")).otherwise(F.unix_seconds(until) - F.unix_seconds(now))
    return F.when(wait.isNotNull(), F.least(F.greatest(wait, F.lit(0)), F.lit(most_seconds)).cast("long"))
