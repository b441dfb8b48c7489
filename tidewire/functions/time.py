"""Time columns. The clock is always an argument: as_of is a timestamp column or literal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_time(published: Column, collected: Column) -> Column:
    """The published value unless it is null, empty or 'unknown'."""
    known = published.isNotNull() & ~published.cast("string").isin("", "unknown")
    return F.when(known, published).otherwise(collected)


def precision(raw: Column) -> Column:
    """How exact a raw time text is: second, minute, hour, day or unknown."""
    return (
        F.when(raw.isNull() | (raw == "") | (raw == "unknown"), "unknown").when(raw.rlike(r"T\d{2}:\d{2}:\d{2}"), "second").when(raw.rlike(r"T\d{2}:\d{2}"), "minute")
        .when(raw.rlike(r"T\d{2}"), "hour").when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), "day").otherwise("unknown")
    )


def iso_week(ts: Column) -> Column:
    """YYYY-Www by the ISO rule; null for a null time."""
    day = ts.cast("date")
    return F.when(day.isNotNull(), F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0")))


def seventh_day_week(ts: Column) -> Column:
    """YYYY-Www where week n is the n-th seven days of the year; 'unknown' for a null time."""
    return F.when(ts.isNull(), "unknown").otherwise(F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(F.ceil(F.dayofyear(ts) / 7).cast("string"), 2, "0")))


def parse_date(raw: Column) -> Column:
    """A feed's date text as a timestamp, null where none of its usual forms fits."""
    bare = F.regexp_replace(F.trim(raw), r"^[A-Za-z]{3,9},\s*", "")
    forms = ["d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm z", "d MMM yyyy", "yyyy-MM-dd'T'HH:mmX", "yyyy-MM-dd'T'HH:mm"]
    return F.coalesce(raw.try_cast("timestamp"), *[F.try_to_timestamp(bare, F.lit(f)) for f in forms])


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9


def cooldown_minutes(failures: Column, base: float = 10, most: float = 120, trip: int = 3) -> Column:
    """Doubling wait after the trip-th failure, bounded."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), failures - trip), F.lit(most))
