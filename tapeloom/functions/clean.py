"""Column expressions that bring raw feed fields to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 100_000_000
DAY_MS = 86_400_000


def floor_div(c: Column, by: int) -> Column:
    """Integer division rounded down, exact over the whole BIGINT range."""
    n = F.lit(by).cast("bigint")
    return F.call_function("div", c - F.pmod(c, n), n)


def restore_ms(c: Column) -> Column:
    """Epoch stamps in s, ms, us or ns, told apart by magnitude, as whole ms rounded down; null stays null."""
    size = F.abs(c)
    return (
        F.when(size < 100_000_000_000, c * 1000)
        .when(size < 100_000_000_000_000, c)
        .when(size < 100_000_000_000_000_000, floor_div(c, 1000))
        .otherwise(floor_div(c, 1_000_000))
    )


def e8(c: Column) -> Column:
    """A DOUBLE as BIGINT units of 1e-8, half away from zero; null, NaN and what does not fit give null."""
    scaled = c * float(SCALE)
    return F.when(F.abs(scaled) < 9.2e18, F.round(scaled).cast("bigint"))


def known(c: Column, zero_missing: bool = False) -> Column:
    """True for a reading: neither null nor NaN, nor 0.0 where zero stands for missing."""
    ok = c.isNotNull() & ~F.isnan(c)
    return ok & (c != 0.0) if zero_missing else ok


def side_name(c: Column) -> Column:
    """bid/buy/b and ask/sell/a in any case and with blanks as 'bid' and 'ask'; anything else null."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("bid", "buy", "b"), "bid").when(s.isin("ask", "sell", "a"), "ask")


def day_start(ms: Column) -> Column:
    return ms - F.pmod(ms, F.lit(DAY_MS))
