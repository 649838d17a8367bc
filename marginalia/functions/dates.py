"""Dates of items as built-in expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

#: Fixed value: milliseconds of the Unix clock at which time-ordered post ids begin.
POST_EPOCH_MS = 1288834974657
RECENT_DAYS = 7


def instant(text: Column) -> Column:
    """A lenient ISO time, else its first ten characters as a date, else null; a time without a zone is UTC's."""
    trimmed = F.trim(text)
    return F.coalesce(F.try_to_timestamp(trimmed), F.try_to_timestamp(F.substring(trimmed, 1, 10)))


def feed_instant(text: Column) -> Column:
    """A post's 'Wed Oct 10 20:19:24 +0000 2018' as an instant, null if it is none; the name of the day isn't read."""
    return F.try_to_timestamp(F.substring(text, 5, 64), F.lit("MMM dd HH:mm:ss Z yyyy"))


#: What a date of each length lacks, for its first and for its last day.
_MISSING = {4: ("-01-01", "-12-31"), 7: ("-01", None), 10: ("", "")}


def bound(value: str | None, end: bool) -> str | None:
    """YYYY, YYYY-MM or YYYY-MM-DD (months and days of one digit too) widened to its first or last day; None for none, ValueError for anything else."""
    text = "-".join(part.zfill(2) for part in (value or "").strip().split("-"))
    if text == "00":
        return None
    try:
        missing = _MISSING[len(text)][end]
        if missing is None:  # the last day of a month is the day before the next one's first
            after = dt.date.fromisoformat(f"{text}-28") + dt.timedelta(days=4)
            return (after.replace(day=1) - dt.timedelta(days=1)).isoformat()
        return dt.date.fromisoformat(text + missing).isoformat()
    except (KeyError, ValueError):
        raise ValueError(f"{value!r} is no date: give YYYY, YYYY-MM or YYYY-MM-DD") from None


def range_end(day: Column, precision: Column) -> Column:
    """The last day that a date of some precision may mean: a year runs to its 31 December, all else is one day."""
    return F.when(precision == "year", F.concat(F.substring(day, 1, 4), F.lit("-12-31"))).otherwise(day)


def within(day: Column, precision: Column, first: str | None, last: str | None) -> Column | None:
    """Whether a dated item's range meets [first, last]; undated items (null or empty) don't. No bounds: no filter."""
    low, high = bound(first, False), bound(last, True)
    if low is None and high is None:
        return None
    cond = day.isNotNull() & (day != "")
    if low is not None:
        cond = cond & (range_end(day, precision) >= low)
    return cond & (day <= high) if high is not None else cond


def is_new(published: Column, arrived: Column) -> Column:
    """Published within a week before it arrived; without either date an item is new."""
    return F.coalesce(published >= F.date_sub(arrived, RECENT_DAYS), F.lit(True))


def first_post_id(at: Column) -> Column:
    """The least time-ordered post id of an instant."""
    return F.shiftleft(F.unix_millis(at) - F.lit(POST_EPOCH_MS), 22)


def post_instant(post_id: Column) -> Column:
    return F.timestamp_millis(F.shiftright(post_id, 22) + F.lit(POST_EPOCH_MS))


def spread(key: Column, digits: int, steps: int, band: float) -> Column:
    """A multiplier around 1 that depends on a key alone: of its SHA-256's first hex digits the remainder by ``steps``, laid evenly over 1 - band to 1 + band."""
    number = F.conv(F.substring(F.sha2(key, 256), 1, digits), 16, 10).cast("long")
    return 1 + band * (2 * (number % steps) / (steps - 1) - 1)


def post_date(stated: Column, fed: Column, modified: Column) -> Column:
    """(day, precision) of a post: what its page states, else what a feed says, else when its site map says it changed; unknown without any."""
    day = F.coalesce(*(F.nullif(F.substring(c, 1, 10), F.lit("")) for c in (stated, fed, modified)))
    return F.struct(F.coalesce(day, F.lit("")).alias("day"), F.when(day.isNotNull(), "day").otherwise("unknown").alias("precision"))


#: Hours between pulls of a pair, by what share these spread, and minutes that a failed try waits.
TTL_HOURS, SPREAD, RETRY_MINUTES = 24, 0.1, 60


def due_at(pulled: Column, tried: Column, query: Column, source: Column) -> Column:
    """When a pair is pulled again: of its events the latest counts, a pull for a day (spread by the pair), a try after it for an hour. Null: now."""
    day = F.make_dt_interval(secs=F.round(TTL_HOURS * 3600 * spread(F.concat_ws(":", query, source), 8, 2001, SPREAD), 3).cast("decimal(18,6)"))
    events = F.array(F.struct(pulled.alias("at"), (pulled + day).alias("due")), F.struct(tried.alias("at"), (tried + F.make_dt_interval(mins=F.lit(RETRY_MINUTES))).alias("due")))
    known = F.filter(events, lambda e: e["at"].isNotNull())
    latest = F.array_max(F.transform(known, lambda e: e["at"]))
    return F.element_at(F.filter(known, lambda e: e["at"] == latest), 1)["due"]
