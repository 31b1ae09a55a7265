"""Days and months in a named zone; event times are stored as UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HOME_ZONE = "Europe/Amsterdam"
HARVEST_MONTHS = (9, 10, 11)


def local_day(ts: Column, zone: str = HOME_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def local_month(ts: Column, zone: str = HOME_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM")


def in_harvest(ts: Column, zone: str = HOME_ZONE) -> Column:
    return F.month(F.from_utc_timestamp(ts, zone)).isin(*HARVEST_MONTHS)


def within_days(ts: Column, as_of: Column, days: int) -> Column:
    return ts > as_of - F.expr(f"INTERVAL {days} DAYS")


def in_month_of(ts: Column, as_of: Column) -> Column:
    return ts >= F.date_trunc("month", as_of)
