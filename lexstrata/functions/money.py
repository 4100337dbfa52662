"""Usage cost and budget arithmetic, in decimals from end to end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIX = "decimal(12,6)"


def rate_or_one(rate: Column) -> Column:
    return F.when(rate > 0, rate).otherwise(F.lit(1).cast("decimal(10,4)"))


def usage_cost(inputs: Column, outputs: Column, cached: Column, price_in: Column, price_out: Column, price_cached: Column, rate: Column) -> Column:
    """Cost of a call with prices per million tokens; a missing price is free, and cached
    tokens cost as much as fresh ones where they have no price of their own."""
    wide = lambda c: c.cast("decimal(18,0)")
    zero = F.lit(0).cast("decimal(10,4)")
    p_in, p_out = F.coalesce(price_in, zero), F.coalesce(price_out, zero)
    fresh = F.greatest(inputs - cached, F.lit(0))
    total = wide(fresh) * p_in + wide(cached) * F.coalesce(price_cached, p_in) + wide(outputs) * p_out
    return (total.cast("decimal(28,4)") * rate_or_one(rate) / F.lit(1000000)).cast(SIX)


def is_free(price_in: Column, price_out: Column) -> Column:
    return (F.coalesce(price_in, F.lit(0)) == 0) & (F.coalesce(price_out, F.lit(0)) == 0)


def budget_state(spent: Column, limit: Column, warn_at: float = 0.8) -> Column:
    """ok, warning or exceeded; a limit of zero or less switches the budget off."""
    ratio = spent / limit
    return F.when(limit <= 0, "ok").when(ratio >= 1, "exceeded").when(ratio >= warn_at, "warning").otherwise("ok")


def half_up(value: Column, digits: int = 0) -> Column:
    """Rounding half away from zero."""
    return F.round(value, digits)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))
