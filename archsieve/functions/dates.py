"""Expiry of accepted violations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """The date of ``YYYY-MM-DD``; null for any other shape and for days that no calendar has."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def is_expired(expires: Column, today: Column) -> Column:
    """Past its day; missing and invalid dates never expire."""
    return F.coalesce(iso_date(expires) < today, F.lit(False))


def expiry(expires: Column, today: Column, soon: int = 30) -> Column:
    day = iso_date(expires)
    return F.when(day.isNull(), "no_expiry").when(day < today, "expired").when(day <= F.date_add(today, soon), "expiring").otherwise("active")
