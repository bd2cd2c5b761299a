"""Scalar functions of market data as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 100_000_000
# Abramowitz and Stegun 7.1.26, 26.2.17 and Acklam's inverse normal.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
TAIL_P, TAIL_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    y = 1.0 - _horner(t, (*reversed(ERF_A), 0.0)) * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1.0 + erf(x / math.sqrt(2)))


def normal_inverse(p: Column) -> Column:
    """Quantile of the normal distribution, p held within [1e-15, 1 - 1e-15]."""
    p = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    q = F.sqrt(-2.0 * F.ln(p))
    r = F.sqrt(-2.0 * F.ln(1.0 - p))
    m = p - 0.5
    tail = lambda q: _horner(q, ACKLAM_C) / _horner(q, (*ACKLAM_D, 1.0))
    mid = _horner(m * m, ACKLAM_A) * m / _horner(m * m, (*ACKLAM_B, 1.0))
    return F.when(p < ACKLAM_LOW, tail(q)).when(p > 1 - ACKLAM_LOW, -tail(r)).otherwise(mid)


def two_sided_p(z: Column) -> Column:
    t = 1.0 / (1.0 + TAIL_P * F.abs(z))
    density = F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi)
    return F.least(F.lit(1.0), 2.0 * density * _horner(t, (*reversed(TAIL_B), 0.0)))


def ratio(num: Column, den: Column, other: float = 0.0) -> Column:
    """num / den, or other where den is 0 or null."""
    return F.when(den != 0, num / den).otherwise(F.lit(other))


def microprice(bid: Column, ask: Column, bid_qty: Column, ask_qty: Column) -> Column:
    """The mid weighted by the other side's depth; the plain mid without depth."""
    return F.when(bid_qty + ask_qty > 0, (bid * ask_qty + ask * bid_qty) / (bid_qty + ask_qty)).otherwise((bid + ask) / 2)


def imbalance(bid_qty: Column, ask_qty: Column) -> Column:
    return F.when(bid_qty + ask_qty > 0, (bid_qty - ask_qty) / (bid_qty + ask_qty)).otherwise(F.lit(0.0))


def spread_bps(bid: Column, ask: Column) -> Column:
    return F.when(bid + ask > 0, (ask - bid) / ((bid + ask) / 2) * 1e4).otherwise(F.lit(0.0))


def relative_drop(before: Column, now: Column) -> Column:
    """By how much of itself a quantity fell, within [0, 1]; 0 without a quantity before."""
    return F.when(before > 0, F.least(F.greatest((before - now) / before, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def relative_rise(before: Column, now: Column) -> Column:
    """By how much of itself a quantity rose, within [0, 1]; a rise from nothing is 1."""
    return F.when(before > 0, F.least(F.greatest((now - before) / before, F.lit(0.0)), F.lit(1.0))).when(now > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def notional8(p8: Column, q8: Column) -> Column:
    """price x quantity in units of 1e-8, truncated towards zero, exact in DECIMAL."""
    raw = p8.cast("decimal(20,0)") * q8.cast("decimal(18,0)")
    return truncated(raw, SCALE)


def truncated(raw: Column, by: int) -> Column:
    """An integral DECIMAL divided by an integer towards zero."""
    size = F.abs(raw)
    whole = (size - F.pmod(size, F.lit(by))) / F.lit(by).cast("decimal(10,0)")
    return (F.when(raw < 0, -1).otherwise(1) * whole).cast("decimal(38,0)")


def fee8(notional: Column, rate8: int) -> Column:
    """Fee of a notional at a rate in units of 1e-8; a negative rate pays."""
    return truncated(notional.cast("decimal(28,0)") * F.lit(rate8).cast("decimal(10,0)"), SCALE)


def bps_to_rate8(bps: float) -> int:
    return int(math.floor(abs(bps) / 1e4 * SCALE + 0.5)) * (1 if bps >= 0 else -1)


UNITS_NS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


def duration_ns(text: Column) -> Column:
    """'250ms', '2h', '7' (ns) as nanoseconds; null for anything else."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^(\d+)(ns|us|ms|s|m|h)?$", 1).try_cast("bigint")
    unit = F.regexp_extract(t, r"^(\d+)(ns|us|ms|s|m|h)?$", 2)
    factor = F.lit(1)
    for k, v in UNITS_NS.items():
        factor = F.when(unit == k, F.lit(v)).otherwise(factor)
    return n * factor


def duration_text(ns: int) -> str:
    """Nanoseconds in the largest unit that divides them."""
    for unit in ("h", "m", "s", "ms"):
        if ns and ns % UNITS_NS[unit] == 0:
            return f"{ns // UNITS_NS[unit]}{unit}"
    return f"{ns}ns"


def close_mechanism(traded: Column, moved: Column, share: float = 0.5) -> Column:
    """'trade' if at least the share of what closed a gap was traded, else 're-quote'."""
    part = F.when(moved > 0, F.least(F.greatest(traded / moved, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.when((part >= share) & (moved > 0), "trade").otherwise("re-quote")


def wall_outcome(peak: Column, current: Column, traded: Column, share: float = 0.5) -> Column:
    """'absorbed' if trades explain at least the share of what a wall lost, else 'pulled'."""
    lost = F.greatest(peak - current, F.lit(0.0))
    return F.when((lost > 0) & (traded >= share * lost), "absorbed").otherwise("pulled")


def regime_allows(regime: Column, only: str) -> Column:
    """Whether a filter ('any', 'trending', 'sideways', 'neutral') lets the regime in."""
    return F.lit(True) if only == "any" else regime == only


def passes_magnitude(spike_bps: Column, drop_pct: Column, min_spike_bps: float, min_drop_pct: float) -> Column:
    """Both legs reach their minimum; a minimum of 0 or less is none."""
    return (F.lit(min_spike_bps <= 0) | (spike_bps >= min_spike_bps)) & (F.lit(min_drop_pct <= 0) | (drop_pct >= min_drop_pct))


def confirms_revert(start: Column, end: Column, fell: Column, least: float) -> Column:
    """Depth returned to the side that was hit: the imbalance moved towards it by at least so much."""
    return F.when(fell, end - start).otherwise(start - end) >= least


def confirms_trend(start: Column, end: Column, fell: Column, most: float) -> Column:
    """Depth stayed away from the side that was hit: the imbalance moved towards it by no more than that."""
    return F.when(fell, end - start).otherwise(start - end) <= most


def size_multiplier(dev: Column, threshold: float, cap: float) -> Column:
    """|dev| against the threshold, from 1 to cap."""
    return F.when(dev.isNotNull(), F.least(F.greatest(F.abs(dev) / threshold, F.lit(1.0)), F.lit(float(cap))))


def defending_depth(imbalance_: Column, push: Column) -> Column:
    """The share of depth on the side that the pressure (push: 1 buying, -1 selling) runs into."""
    return F.when(push > 0, (1 - imbalance_) / 2).when(push < 0, (1 + imbalance_) / 2).otherwise(0.0)


def pattern_confidence(count: Column, least: int) -> Column:
    """The confidence of a repeated pattern: 0.65 of its count against the least one, and 0.2, at most 0.85."""
    return F.least(count / least * 0.65 + 0.2, F.lit(0.85))


def parse_flags(text: str) -> list[bool]:
    """'limit,market' and the like: true, 1, limit, fade; false, 0, market, follow."""
    known = {"true": True, "1": True, "limit": True, "fade": True, "false": False, "0": False, "market": False, "follow": False}
    try:
        return [known[x.strip()] for x in text.split(",")]
    except KeyError as e:
        raise ValueError(f"bad flag {e}") from None


def parse_regimes(text: str) -> list[str]:
    """A list of regime filters in any of their spellings."""
    known = {"any": "any", "trend": "trending", "trending": "trending", "side": "sideways", "sideways": "sideways", "chop": "sideways", "neutral": "neutral", "neut": "neutral"}
    try:
        return [known[x.strip().lower()] for x in text.split(",")]
    except KeyError as e:
        raise ValueError(f"bad regime {e}") from None
