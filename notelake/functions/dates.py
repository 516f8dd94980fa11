"""Date and schedule functions over columns. Weeks start on Sunday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_ws

_DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")


def day_of_week(d: Column) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(d) - 1


def week_start(d: Column) -> Column:
    return F.date_sub(d, F.dayofweek(d) - 1)


def plan_label(d: Column) -> Column:
    return F.date_format(d, "M-d-yyyy")


def is_weekend(d: Column) -> Column:
    return F.dayofweek(d).isin(1, 7)


def weekly_plan_name(d: Column) -> Column:
    start = week_start(d)
    return F.concat(F.lit("Weekly Planning "), plan_label(start), F.lit(" to "), plan_label(F.date_add(start, 6)))


def weekly_plan_start(name: Column) -> Column:
    """The first day in a weekly plan's file name; null if the name isn't one or its week is not a whole Sunday-to-Saturday one."""
    form = r"^Weekly Planning (\d{1,2}-\d{1,2}-\d{4}) to (\d{1,2}-\d{1,2}-\d{4})(\.md)?$"
    start, end = (F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(name, form, k), F.lit("")), F.lit("M-d-yyyy"))) for k in (1, 2))
    return F.when((day_of_week(start) == 0) & (F.date_add(start, 6) == end), start)


def daily_note_day(name: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")))


def business_days_back(d: Column, n: int) -> Column:
    """The last n weekdays up to d, newest first."""
    span = F.sequence(d, F.date_sub(d, 2 * n + 3), F.expr("interval -1 day"))
    return F.slice(F.filter(span, lambda x: ~is_weekend(x)), 1, n)


def weeks_back(d: Column, n: int) -> Column:
    """Labels of the weeks 0 to n - 1 before d's."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: plan_label(F.date_sub(week_start(d), k * 7)))


def cron_of(c: Column, strict_reference: bool = False) -> Column:
    """Five cron fields of an English frequency; 06:00 unless a time with am or pm is named. Five fields stand as they are.

    ``strict_reference`` reads Tuesday to Thursday as daily, as the specification does.
    """
    text = F.lower(c)
    fields = r"^[-0-9*/,]+( [-0-9*/,]+){4}$"
    clock = r"(\d{1,2})(?::(\d{2}))?\s*(am|pm)"
    hour, minute, half = F.regexp_extract(text, clock, 1), F.regexp_extract(text, clock, 2), F.regexp_extract(text, clock, 3)
    n = hour.try_cast("int")
    h = F.when(half == "", "6").when((half == "pm") & (n < 12), (n + 12).cast("string")).when((half == "am") & (n == 12), "0").otherwise(hour)
    m = F.when(minute == "", "0").otherwise(F.coalesce(minute.try_cast("int").cast("string"), F.lit("0")))
    day = F.when(text.contains("weekday") | text.contains("mon-fri"), "1-5").when(text.contains("sun"), "0").when(text.contains("monday"), "1")
    if not strict_reference:
        day = day.when(text.contains("tuesday"), "2").when(text.contains("wednesday"), "3").when(text.contains("thursday"), "4")
    day = day.when(text.contains("fri"), "5").when(text.contains("saturday"), "6").when(text.contains("day") | text.contains("daily"), "*").when(text.contains("weekly"), "0").otherwise("*")
    return F.when(text.rlike(fields), text).otherwise(F.concat_ws(" ", m, h, F.lit("*"), F.lit("*"), day))


def cron_human(c: Column) -> Column:
    """Five cron fields in words, as ``Sundays at 5:00 PM``; days other than those told apart are ``daily``."""
    p = F.split(trim_ws(c), r"\s+")
    lead = lambda k: F.coalesce(F.regexp_extract(F.get(p, F.lit(k)), r"^(\d+)", 1).try_cast("int"), F.lit(0))
    minute, hour, day = lead(0), lead(1), F.get(p, F.lit(4))
    named = F.when(day == "1-5", "weekdays").when(day == "0", "Sundays").when(day == "1", "Mondays").when(day == "5", "Fridays").when(day == "6", "Saturdays").otherwise("daily")
    return F.concat(named, F.lit(" at "), F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), F.when(hour < 12, " AM").otherwise(" PM"))


def due_day(text: Column, today: Column) -> Column:
    """The day an item names: a date in full, ``EOD`` or ``today``, or ``by <weekday>`` (the next one); null otherwise."""
    low = F.lower(text)
    literal = F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(low, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")))
    out = F.when(literal.isNotNull(), literal).when(low.rlike(r"\b(eod|today)\b"), today)
    for d in _DAYS:
        out = out.when(low.rlike(rf"\bby {d}"), F.next_day(today, d))
    return out


def news_floor(now: Column, last_run: Column) -> Column:
    """News older than this is left out: the gap since the last run, at least 24 and at most 72 hours."""
    gap = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(last_run), F.lit(0))
    return F.timestamp_seconds(F.unix_timestamp(now) - F.least(F.greatest(gap, F.lit(24 * 3600)), F.lit(72 * 3600)))


def memory_floor(updated: Column, today: Column, most_days: int = 30) -> Column:
    """The first day a memory run reads: that after the last update, at most ``most_days`` days with today."""
    oldest = F.date_sub(today, most_days - 1)
    return F.greatest(F.coalesce(F.date_add(updated, 1), oldest), oldest)


def lookback_floor(today: Column, days: int = 2) -> Column:
    """The catch-up window's first day: some days back, but not before the week began."""
    return F.greatest(F.date_sub(today, days), week_start(today))


def in_prior_week(d: Column, today: Column) -> Column:
    """Whether a day lies in the Sunday-to-Saturday week before today's."""
    start = week_start(today)
    return (d >= F.date_sub(start, 7)) & (d < start)


def in_past_two_days(d: Column, today: Column) -> Column:
    """Yesterday or today."""
    return d.between(F.date_sub(today, 1), today)


def within(d: Column, lo: Column, hi: Column) -> Column:
    """Inside a horizon, both ends included."""
    return d.between(lo, hi)


def time_slot(n: Column, slots: int = 7, first: int = 9) -> Column:
    """The n-th of a day's half-hour slots in turn, as ``HH:mm``."""
    return F.concat(F.lpad((n % slots + first).cast("string"), 2, "0"), F.when(n % 2 == 0, ":00").otherwise(":30"))
