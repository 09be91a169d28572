"""Scores and labels of points in time, against a given now."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60, 3600, 86400


def seconds_between(since: Column, now: Column) -> Column:
    """Whole seconds of both points, one less the other."""
    whole = lambda t: F.unix_seconds(F.date_trunc("second", t.cast("timestamp")))
    return whole(now) - whole(since)


def micros_between(since: Column, now: Column) -> Column:
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))


def recency_score(since: Column, now: Column) -> Column:
    """100 in the last five minutes, then 80, 60, 40, 20 within an hour, a day, a week and 30 days, else 10; null without a time."""
    gone = micros_between(since, now)
    # Fixed values
    steps = [(5 * MINUTE, 100.0), (HOUR, 80.0), (DAY, 60.0), (7 * DAY, 40.0), (30 * DAY, 20.0)]
    out = F.when(gone.isNull(), None)
    for most, score in steps:
        out = out.when(gone < most * 1_000_000, score)
    return out.otherwise(10.0)


def relative_time(since: Column, now: Column) -> Column:
    """just now, minutes, hours or days ago; the point itself from a week on."""
    s = seconds_between(since, now)
    ago = lambda size, word: F.concat(F.floor(s / size).cast("string"), F.lit(f" {word} ago"))
    return F.when(s < MINUTE, "just now").when(s < HOUR, ago(MINUTE, "min")).when(s < DAY, ago(HOUR, "hours")).when(s < 7 * DAY, ago(DAY, "days")).otherwise(F.date_format(since, "yyyy-MM-dd HH:mm"))


def history_relevance(frequency: Column, searched: Column, executed: Column, now: Column) -> Column:
    """Ten a use, what recency adds, and a bonus for what was executed."""
    hours, done = seconds_between(searched, now) / 3600.0, seconds_between(executed, now) / 3600.0
    recent = F.when(hours < 1, 100.0).when(hours < 24, 50.0 / hours).when(hours < 168, 20.0 / (hours / 24.0)).otherwise(5.0 / (hours / 168.0))
    bonus = F.when(executed.isNull(), 0.0).when(done < 24, 50.0).when(done < 168, 20.0 / (done / 24.0)).otherwise(5.0)
    return frequency * 10.0 + recent + bonus


def time_band(hour: Column) -> Column:
    """struct(result_id, score) of what the hour suggests; null at other hours."""
    band = lambda name, score: F.struct(F.lit(name).alias("result_id"), F.lit(score).alias("score"))
    # Fixed values
    return F.when(hour.between(6, 9), band("morning_routine", 80.0)).when(hour.between(12, 14), band("lunch_break", 70.0)).when(hour.between(18, 23), band("evening_routine", 75.0))
