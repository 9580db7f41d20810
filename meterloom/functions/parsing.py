"""Tolerant readings of JSON values, names and times, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


#: Fixed value: what the telemetry format may put before an event's name.
EVENT_PREFIX = "claude_code."


def first_attribute(attributes: Column, key: str) -> Column:
    """The value struct of the first attribute with that key, or null."""
    return F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))["value"]


def whole_number(text: Column) -> Column:
    """A 64-bit integer written without padding or fraction, else null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def int_value(value: Column) -> Column:
    """An integer given as number, as string or as a double, which is cut, from an attribute's value."""
    return F.coalesce(
        whole_number(value["intValue"]), whole_number(value["stringValue"]), value["doubleValue"].try_cast("double").try_cast("bigint")
    )


def double_value(value: Column) -> Column:
    return F.coalesce(value["doubleValue"].try_cast("double"), value["stringValue"].try_cast("double"), whole_number(value["intValue"]).cast("double"))


def event_name(name: Column, body_text: Column) -> Column:
    """The event's name, else the body's text, without one leading ``EVENT_PREFIX``."""
    name = F.coalesce(name, body_text)
    return F.when(name.startswith(EVENT_PREFIX), F.substring(name, len(EVENT_PREFIX) + 1, 1 << 20)).otherwise(name)


def event_time_ms(record: Column) -> Column:
    """Milliseconds of the record's own time, else of the time it was observed."""
    nanos = lambda text: F.when(whole_number(text) > 0, whole_number(text))
    return F.call_function("div", F.coalesce(nanos(record["timeUnixNano"]), nanos(record["observedTimeUnixNano"])), F.lit(1_000_000))


def rfc3339_ms(text: Column) -> Column:
    """Milliseconds of an RFC 3339 time in UTC with ``Z``; a longer fraction is cut; else null.

    A second of 60 gives null.
    """
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?Z$"
    number = lambda at: F.substring(text, at, 2).try_cast("bigint")
    seconds = ((F.unix_date(F.substring(text, 1, 10).try_cast("date")) * 24 + number(12)) * 60 + number(15)) * 60 + number(18)
    # What follows the point, up to three digits; the pattern lets one end of line follow.
    fraction = F.translate(F.substring(text, 21, 3), "Z\n\r\u0085\u2028\u2029", "")
    return F.when(text.rlike(shape), seconds * 1000 + F.rpad(fraction, 3, "0").try_cast("bigint"))


def iso_ms(ms: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSZ`` in UTC."""
    time = F.timestamp_add("MILLISECOND", ms, F.expr("timestamp_ntz'1970-01-01 00:00:00'"))
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def reset_time_ms(value: Column) -> Column:
    """A reset time: a number is epoch seconds, a string RFC 3339 or a UTC time without zone."""
    seconds = value.try_cast("double")
    plain = F.concat(F.regexp_replace(F.regexp_replace(value, " ", "T"), r"(\+00:00|Z)$", ""), F.lit("Z"))
    return F.coalesce((seconds * 1000).try_cast("bigint"), rfc3339_ms(plain))


def project_name(path: Column) -> Column:
    """The last segment of a path."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.coalesce(F.when(F.size(parts) > 0, F.element_at(parts, -1)), path, F.lit("(unknown project)"))


def below_home(path: Column, home: str) -> Column:
    """The path with a leading home folder as ``~``, where a segment ends there."""
    return F.when(path == home, "~").when(path.startswith(home + "/"), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 20))).otherwise(path)


def model_key(name: Column) -> Column:
    """A model's name without space and provider prefix; null if nothing is left."""
    return F.nullif(F.element_at(F.split(F.trim(name), "/"), -1), F.lit(""))


def undated(name: Column) -> Column:
    """The name without a trailing date of eight digits."""
    return F.regexp_replace(name, r"^(.+)-[0-9]{8}$", "$1")
