"""Mapping a numeric time axis onto bins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tier:
    """Values below `upper` go to the nearest multiple of `step` (after adding `shift`)."""

    upper: float | None
    step: float
    shift: float = 0


# The resolution of the time axis by age, coarse in the far past and yearly today.
YEAR_TIERS = (
    Tier(-800_000, 50_000),
    Tier(-20_000, 2_000),
    Tier(0, 250),
    Tier(1_850, 50),
    Tier(2_025, 1),
    Tier(None, 1_000, shift=1_000),
)


def tiered_bin(value: Column, tiers: Sequence[Tier] = YEAR_TIERS) -> Column:
    """Bin with a resolution that depends on where the value lies; ties go to the even multiple."""
    number = value.cast("double")
    result = None
    for tier in tiers:
        nearest = F.bround((number + F.lit(float(tier.shift))) / F.lit(float(tier.step))) * F.lit(float(tier.step))
        if tier.upper is None:
            return (nearest if result is None else result.otherwise(nearest)).cast("bigint")
        below = number < F.lit(float(tier.upper))
        result = F.when(below, nearest) if result is None else result.when(below, nearest)
    return result.cast("bigint")


def floor_bin(value: Column, width: float) -> Column:
    """The lower edge of the fixed-width bin that holds the value."""
    return (F.floor(value / F.lit(width)) * F.lit(width)).cast("bigint")


def year_before(age: Column, epoch: float = 1950, unit: float = 1) -> Column:
    """Age counted back from `epoch`, in units of `unit` years, as a calendar year."""
    return F.lit(epoch) - age * F.lit(unit)


def year_of_mega_offset(t: Column) -> Column:
    """Thousands of years relative to the year 3000, as a whole calendar year."""
    return F.bround(t * 1000 + 3000).cast("bigint")
