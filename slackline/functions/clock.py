"""Timetable clocks: HH:MM:SS strings whose hours may pass 24, and seconds since midnight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _part(text: Column, k: int) -> Column:
    return F.try_to_number(F.get(F.split(F.trim(text), ":"), F.lit(k)), F.lit("999999")).cast("int")


def clock_seconds(text: Column) -> Column:
    """Seconds of HH:MM or HH:MM:SS; hours of 24 and more go on counting. Anything else is null."""
    sound = F.trim(text).rlike("^[0-9]{1,3}:[0-5][0-9](:[0-5][0-9])?$")
    return F.when(sound, _part(text, 0) * 3600 + _part(text, 1) * 60 + F.coalesce(_part(text, 2), F.lit(0)))


def _two(n: Column) -> Column:
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def clock_text(seconds: Column, wrap: bool = False) -> Column:
    """HH:MM:SS of seconds since midnight; ``wrap`` starts anew at 24 hours."""
    s = F.floor(seconds).cast("int")
    hours = F.floor(s / 3600).cast("int")
    hours = F.pmod(hours, F.lit(24)) if wrap else hours
    return F.concat_ws(":", _two(hours), _two(F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int")), _two(F.pmod(s, F.lit(60))))


def weekday_name(day: Column) -> Column:
    """The weekday of a date, or of text that is a weekday's name or an ISO date, in lower case."""
    text = F.lower(F.trim(day.cast("string")))
    return F.when(text.isin(*WEEKDAYS), text).otherwise(F.lower(F.date_format(F.try_to_timestamp(text), "EEEE")))


def deadline_seconds(deadline: Column, day: Column) -> Column:
    """Seconds from the day's midnight to a deadline, given as a clock or as an ISO timestamp."""
    stamp = F.try_to_timestamp(deadline)
    return F.coalesce(clock_seconds(deadline), (F.unix_timestamp(stamp) - F.unix_timestamp(day.cast("timestamp"))).cast("int"))


def service_runs(day: Column, *flags: Column) -> Column:
    """The flag (Monday's first) of the weekday of a date."""
    return F.get(F.array(*flags), F.weekday(day))
