"""Calendar expressions: local schedule times, weekdays and run dates. Timestamps are UTC throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names, the local hour of each delivery channel, the hour that ends the early morning.
DAYS_OF_WEEK = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]
EMAIL_HOUR = 5
FEED_HOUR = 2
EARLY_MORNING_HOUR = 5


def day_of_week(date: Column) -> Column:
    return F.lower(F.date_format(date, "EEE"))


def date_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def channel_hour(channel: Column) -> Column:
    return F.when(channel == "email", EMAIL_HOUR).when(channel.isin("single_feed", "multiple_feeds"), FEED_HOUR)


def local_now(now: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(now, zone)


def is_early_morning(local: Column) -> Column:
    return F.hour(local) < EARLY_MORNING_HOUR


def local_to_utc(local: Column, zone: Column) -> Column:
    """UTC instant of a wall-clock time: the first of two when it occurs twice; a skipped time moves on by whole hours
    until it exists."""

    def exists(wall: Column) -> Column:
        return F.from_utc_timestamp(F.to_utc_timestamp(wall, zone), zone) == wall

    later = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda h: F.timestamp_add("HOUR", h, local))
    first = F.element_at(F.filter(later, exists), 1)
    return F.when(exists(local), F.to_utc_timestamp(local, zone)).otherwise(F.to_utc_timestamp(first, zone))


def run_at(date: Column, hour: Column, zone: Column) -> Column:
    """UTC instant of the daily run on a local date."""
    return local_to_utc(F.timestamp_add("HOUR", hour, date.cast("timestamp")), zone)


def first_run_date(start: Column, now: Column, hour: Column, zone: Column) -> Column:
    """First local date from ``start`` on whose run is not before ``now``.

    Runs before yesterday (local) are always past, so four candidate days decide for any gap.
    """
    begin = F.greatest(start, F.date_sub(F.to_date(F.from_utc_timestamp(now, zone)), 1))
    days = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.date_add(begin, i.cast("int")))
    return F.element_at(F.filter(days, lambda d: run_at(d, hour, zone) >= now), 1)
