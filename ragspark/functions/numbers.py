"""Numbers, ages and scores. Whatever depends on the time takes it as an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"\d[\d,]*(?:\.\d+)?\s*[kK]?"


def decay(age_days: Column, days: float) -> Column:
    return F.exp(-age_days / days)


def log_points(value: Column) -> Column:
    return F.log1p(F.greatest(value, F.lit(0)).cast("double"))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Between 0 and 1 of the range; 0 where the range is empty."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def age_days(text: Column, as_of: str) -> Column:
    """Days of "3 days ago" (weeks, hours too) or since an ISO date; else null."""
    words = r"(?i)^(\d+(?:\.\d+)?)\s+(days?|weeks?|hours?)\s+ago$"
    plain = F.trim(text)
    value = F.expr("1.0") * F.regexp_extract(plain, words, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(plain, words, 2))
    since = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.try_to_timestamp(plain))) / 86_400_000_000
    return F.when(unit.startswith("day"), value).when(unit.startswith("week"), value * 7).when(unit.startswith("hour"), value / 24).otherwise(since)


def posted_score(text: Column, as_of: str) -> Column:
    """1 up to 7 days, 0.7 to 30, 0.3 to 90, else 0; "N days ago" goes before today and yesterday, these before a date."""
    low = F.lower(F.trim(text))
    days = F.regexp_extract(low, r"(\d+)\s+days?\s+ago", 1).try_cast("double")
    since = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.try_to_timestamp(F.trim(text)))) / 86_400_000_000
    tier = lambda d: F.when(d <= 7, 1.0).when(d <= 30, 0.7).when(d <= 90, 0.3).otherwise(0.0)
    return F.when(text.isNull(), 0.0).when(days.isNotNull(), tier(days)).when(low.contains("today") | low.contains("yesterday"), 1.0).when(since.isNotNull(), tier(since)).otherwise(0.0)


def salary_max(text: Column) -> Column:
    """The largest number of the text, k as thousands; null without one."""
    value = lambda m: F.regexp_replace(m, r"[,\skK]", "").try_cast("double") * F.when(F.lower(m).endswith("k"), 1000).otherwise(1)
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), value))


def with_suffix(text: Column) -> Column:
    """1.2K as 1200, 3M as 3000000, 1,234 as 1234; 0 if it is no number."""
    plain = F.upper(F.replace(F.trim(text), F.lit(","), F.lit("")))
    value = F.regexp_extract(plain, r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    factor = F.when(plain.endswith("K"), 1000).when(plain.endswith("M"), 1_000_000).otherwise(1)
    return F.coalesce(F.round(value * factor), F.lit(0)).cast("long")


def digits(text: Column) -> Column:
    """The digits of the text as one number; 0 without any."""
    return F.coalesce(F.regexp_replace(text, r"\D", "").try_cast("long"), F.lit(0))


def compact_timestamp(text: Column) -> Column:
    """20240131T235900Z as a timestamp."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})Z?$", "$1-$2-$3 $4:$5:$6"))


def year_of(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\d{4})", 1).try_cast("int")
