"""Volume profiles: bins, point of control, value area, low-volume nodes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def profile_bins(trades: DataFrame, key: list[str], width8: int) -> DataFrame:
    """Volume by price bin of width8 from the group's lowest price: bin, buy8, sell8, vol8 and the bin's left edge."""
    low = trades.groupBy(*key).agg(F.min("p8").alias("low8"))
    b = F.call_function("div", F.col("p8") - F.col("low8"), F.lit(width8).cast("bigint"))
    buy = F.col("sgn") > 0
    out = trades.join(low, key).groupBy(*key, "low8", b.alias("bin")).agg(F.coalesce(F.sum(F.when(buy, F.col("q8"))), F.lit(0)).alias("buy8"), F.coalesce(F.sum(F.when(~buy, F.col("q8"))), F.lit(0)).alias("sell8"), F.sum("q8").alias("vol8"))
    return out.withColumn("edge8", F.col("low8") + F.col("bin") * width8)


def even_bins(trades: DataFrame, key: list[str], n: int) -> DataFrame:
    """A fixed number of bins between the group's lowest and highest price; the highest price is in the last bin."""
    span = trades.groupBy(*key).agg(F.min("p8").alias("low8"), F.max("p8").alias("high8"))
    b = F.when(F.col("high8") > F.col("low8"), F.least(F.lit(n - 1), F.floor((F.col("p8") - F.col("low8")) * n / (F.col("high8") - F.col("low8"))))).otherwise(0)
    return trades.join(span, key).groupBy(*key, "low8", "high8", b.cast("bigint").alias("bin")).agg(F.sum("q8").alias("vol8"))


def grow_area(volumes: dict[int, int], poc: int, lo: int, hi: int, need: float, tie_low: bool) -> tuple[int, int]:
    """The bins around poc that hold `need`: the fuller neighbour joins first, equal ones low or high; a side's end joins nothing.

    Stretches of empty bins are crossed at once.
    """
    full = sorted(volumes)
    a = b = poc
    held = volumes[poc]
    while held < need and (a > lo or b < hi):
        low = volumes.get(a - 1, 0) if a > lo else -1
        high = volumes.get(b + 1, 0) if b < hi else -1
        if low >= high if tie_low else low > high:
            a = a - 1 if low else full[bisect_left(full, a) - 1] + 1
            held += low
        else:
            b = b + 1 if high else full[bisect_right(full, b)] - 1
            held += high
    return a, b


def value_area(bins: DataFrame, key: list[str], share: float = 0.7, tie_low: bool = True, first_max: bool = False) -> DataFrame:
    """Per group: poc (the fullest bin, of equal ones the last, or the first), va_lo and va_hi, total volume, number of bins.

    The area grows from the poc by the fuller neighbour until it holds the share of the volume; equal
    neighbours go low, or high. A group is its non-empty bins, bounded by its price range over the width; the
    growth, step by step by nature, runs over Arrow batches of such groups.
    """
    best = F.max_by("bin", F.struct("vol8", -F.col("bin"))) if first_max else F.max_by("bin", F.struct("vol8", "bin"))
    g = bins.groupBy(*key).agg(best.alias("poc"), F.max("vol8").alias("poc8"), F.sum("vol8").alias("total8"), (F.max("bin") + 1).alias("n_bins"), F.min("bin").alias("lo"), F.collect_list(F.struct("bin", "vol8")).alias("m"))

    @F.pandas_udf("struct<va_lo:bigint,va_hi:bigint>")
    def area(m: pd.Series, poc: pd.Series, lo: pd.Series, n: pd.Series, total: pd.Series) -> pd.DataFrame:
        rows = [grow_area({x["bin"]: x["vol8"] for x in xs}, p, a, k - 1, t * share, tie_low) for xs, p, a, k, t in zip(m, poc, lo, n, total, strict=True)]
        return pd.DataFrame(rows, columns=["va_lo", "va_hi"])

    return g.withColumn("a", area("m", "poc", "lo", "n_bins", "total8")).select(*key, "poc", "poc8", "total8", "n_bins", "a.va_lo", "a.va_hi")


def low_volume_nodes(bins: DataFrame, key: list[str], share: float) -> DataFrame:
    """Bins with some volume but less than the share of the fullest bin's."""
    top = F.max("vol8").over(Window.partitionBy(*key))
    return bins.withColumn("top8", top).where((F.col("vol8") > 0) & (F.col("vol8") < F.col("top8") * share)).drop("top8")


def concentration(bins: DataFrame, key: list[str]) -> DataFrame:
    """1 - entropy / log2(number of bins, empty ones included); 0 for one bin."""
    total = F.sum("vol8").over(Window.partitionBy(*key))
    p = F.col("vol8") / F.col("total8")
    g = bins.withColumn("total8", total).where("vol8 > 0").groupBy(*key).agg((-F.sum(p * F.log2(p))).alias("h"), (F.max("bin") + 1).alias("n_bins"))
    return g.withColumn("concentration", F.when(F.col("n_bins") > 1, 1 - F.col("h") / F.log2("n_bins")).otherwise(0.0)).drop("h")
