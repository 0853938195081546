"""Business days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.config import DEFAULT_FEES, FeeModel


def is_business_day(day: Column, fees: FeeModel = DEFAULT_FEES) -> Column:
    return (F.weekday(day) < 5) & ~day.isin(*fees.holidays) if fees.holidays else F.weekday(day) < 5


def business_days_after(day: Column, n: int, fees: FeeModel = DEFAULT_FEES) -> Column:
    """The n-th business day after day; day itself for 0."""
    if n < 0:
        raise ValueError("n must not be negative")
    if n == 0:
        return day
    ahead = 7 * (n // 5 + 1) + 2 + len(fees.holidays)
    days = F.sequence(F.date_add(day, 1), F.date_add(day, ahead))
    return F.element_at(F.filter(days, lambda d: is_business_day(d, fees)), n)


def window_days(settled: Column, slack: int, fees: FeeModel = DEFAULT_FEES) -> Column:
    """array<date> of the days on which a credit of this settlement may land."""
    return F.sequence(settled, business_days_after(settled, slack, fees))
