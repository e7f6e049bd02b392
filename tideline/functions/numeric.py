"""Number rules. ``half_up`` rounds halves towards plus infinity, which Spark's ``round`` does not."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def tenth(x: Column) -> Column:
    """Round to 0.1, halves up."""
    return F.floor(x * 10 + F.lit(0.5)) / 10


def hundredth(x: Column) -> Column:
    return F.floor(x * 100 + F.lit(0.5)) / 100


def clamp(x: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(x, low), high)


def nz(x: Column, default) -> Column:
    return F.coalesce(x, default if isinstance(default, Column) else F.lit(default))
