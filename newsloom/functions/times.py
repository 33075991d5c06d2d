"""Time functions.  Instants are seconds since 1970 (long), so results don't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86400
BEIJING = 8 * HOUR


def epoch(wall_clock: Column | str) -> Column:
    """Seconds of a zone-less UTC time stamp."""
    name = wall_clock if isinstance(wall_clock, str) else None
    if name:
        return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")
    return F.unix_timestamp(wall_clock)


def parse_instant(text: Column) -> Column:
    """Seconds of mixed time values: seconds or milliseconds as digits, ISO 8601 or RFC 2822; null for None, null and the rest."""
    t = F.trim(text)
    number = F.when(t.rlike(r"^[0-9]{1,18}$"), t.try_cast("long"))
    digits = F.when(number > 1_000_000_000_000, F.floor(number / 1000)).otherwise(number)
    shapes = ["yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z"]
    dated = F.regexp_replace(t, "^[A-Za-z]{3}, *", "")  # patterns to read by know no names of weekdays
    stamps = [F.unix_timestamp(F.try_to_timestamp(dated, F.lit(s))) for s in shapes]
    return F.coalesce(digits, *[F.when(~t.isin("None", "null", ""), s) for s in stamps])


def beijing_date(seconds: Column) -> Column:
    return F.date_from_unix_date(F.floor((seconds + BEIJING) / DAY).cast("int"))


def beijing_hour(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds + BEIJING, F.lit(DAY)) / HOUR).cast("int")


def week_start(seconds: Column) -> Column:
    """Monday of the Beijing week."""
    return F.date_trunc("week", beijing_date(seconds)).cast("date")


def slot_hour(hour: Column) -> Column:
    """The edition an hour belongs to: from 15 and before 5 the evening's, from 8 the noon's, else the morning's."""
    return F.when((hour >= 15) | (hour < 5), 18).when(hour >= 8, 11).otherwise(5)


def batch_slot(hour: Column) -> Column:
    """Last edition at or before an hour, of 5, 11 and 18; 18 of the day before earlier than 5."""
    return F.when(hour >= 18, 18).when(hour >= 11, 11).when(hour >= 5, 5).otherwise(18)


def slot_start(seconds: Column) -> Column:
    """Seconds at which the edition window that holds an instant began: windows of unequal width."""
    local = seconds + BEIJING
    day = F.floor(local / DAY) * DAY
    hour = F.floor(F.pmod(local, F.lit(DAY)) / HOUR)
    begin = F.when(hour >= 18, 18 * HOUR).when(hour >= 11, 11 * HOUR).when(hour >= 5, 5 * HOUR).otherwise(-6 * HOUR)
    return (day + begin - BEIJING).cast("long")


def is_quiet(seconds: Column) -> Column:
    return beijing_hour(seconds).between(1, 4)


def mode_of_hour(hour: Column) -> Column:
    return F.when(hour == 5, "morning").when(hour == 11, "noon").otherwise("summary")


def _local(seconds: Column, pattern: str) -> Column:
    """A Beijing time of day or date, by pattern."""
    return F.date_format(F.timestamp_add("SECOND", seconds + BEIJING, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), pattern)


def clock(seconds: Column) -> Column:
    """Beijing time of day."""
    return _local(seconds, "HH:mm")


def relative_label(seconds: Column, as_of: Column) -> Column:
    """Just now, minutes, hours or days ago, from three days on the date; empty for null."""
    age = as_of - seconds
    ago = lambda unit, name: F.concat(F.floor(age / unit).cast("string"), F.lit(name))
    label = F.when(age < 60, "刚刚").when(age < HOUR, ago(60, "分钟前")).when(age < DAY, ago(HOUR, "小时前")).when(age < 3 * DAY, ago(DAY, "天前")).otherwise(_local(seconds, "M月d日"))
    return F.when(seconds.isNull(), "").otherwise(label)


def absolute_label(seconds: Column) -> Column:
    return F.coalesce(_local(seconds, "M/d HH:mm"), F.lit(""))


def browse_label(seconds: Column, as_of: Column) -> Column:
    """Time of day for today, then yesterday and days ago up to seven, else empty."""
    days = F.datediff(beijing_date(as_of), beijing_date(seconds))
    return F.when(seconds.isNull(), "").when(days <= 0, _local(seconds, "HH:mm")).when(days == 1, "昨天").when(days <= 7, F.concat(days.cast("string"), F.lit("天前"))).otherwise("")


def day_label(seconds: Column, as_of: Column) -> Column:
    """Time of day for today, else with the date; empty for null."""
    same = beijing_date(seconds) == beijing_date(as_of)
    return F.coalesce(F.when(same, F.concat(F.lit("今天 "), _local(seconds, "HH:mm"))).otherwise(_local(seconds, "MM-dd HH:mm")), F.lit(""))


def duration_seconds(text: str) -> int:
    """Seconds of a literal such as 24h, 3d or 1w."""
    return int(text[:-1]) * {"h": HOUR, "d": DAY, "w": 7 * DAY}[text[-1]]
