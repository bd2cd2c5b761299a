"""Bars over tapes and what is derived from bar to bar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.clean import DAY_MS
from tapeloom.functions.market import ratio, relative_drop, relative_rise, two_sided_p
from tapeloom.operators.flow import session


def _ohlc(key: list[str]) -> list[Column]:
    buy = F.when(F.col("sgn") > 0, F.col("q8")).otherwise(0)
    return [
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("trades"), F.sum("q8").alias("vol8"), F.sum(buy).alias("buy8"),
        F.min_by("p8", F.struct("ts", "seq")).alias("open8"), F.max("p8").alias("high8"), F.min("p8").alias("low8"), F.max_by("p8", F.struct("ts", "seq")).alias("close8"),
    ]


def time_bars(trades: DataFrame, key: str, period_ms: int) -> DataFrame:
    """Tumbling bars by time; empty periods have none. Combined before the shuffle."""
    start = F.col("ts") - F.pmod("ts", F.lit(period_ms))
    return trades.groupBy(key, start.alias("ts")).agg(*_ohlc([key]))


def volume_bars(trades: DataFrame, key: str, volume8: int) -> DataFrame:
    """Bars that end where the day's cumulative volume crosses the next multiple of volume8; bar_no counts from 0 per day.

    The running volume is taken in two levels: minutes first, so that the pass per key and day sees at most 1,440
    sums, then within a minute. A trade belongs to the bar in which its last unit falls.
    """
    day = (F.col("ts") - F.pmod("ts", F.lit(DAY_MS))).alias("day")
    minute = (F.col("ts") - F.pmod("ts", F.lit(60_000))).alias("minute")
    t = trades.select("*", day, minute)
    sums = t.groupBy(key, "day", "minute").agg(F.sum("q8").alias("m8"))
    before = sums.withColumn("base8", F.coalesce(F.sum("m8").over(Window.partitionBy(key, "day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m8")
    w = Window.partitionBy(key, "day", "minute").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("q8").over(w)
    cum = t.withColumn("in8", run).join(before, [key, "day", "minute"])
    no = F.call_function("div", F.col("base8") + F.col("in8") - 1, F.lit(volume8).cast("bigint"))
    return cum.withColumn("bar_no", no).groupBy(key, "day", "bar_no").agg(*_ohlc([key])).withColumnRenamed("last_ts", "ts")


def bar_changes(bars: DataFrame, key: str) -> DataFrame:
    """Cumulative delta of the day and its first and second differences, 0 for the first bars."""
    s = session(key, "ts")
    x = bars.withColumn("cvd8", F.sum(2 * F.col("buy8") - F.col("vol8")).over(s.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("momentum8", F.coalesce(F.col("cvd8") - F.lag("cvd8").over(s), F.lit(0)))
    return x.withColumn("acceleration8", F.when(F.lag("cvd8", 2).over(s).isNotNull(), F.col("momentum8") - F.lag("momentum8").over(s)).otherwise(0))


def rolling_enrichment(bars: DataFrame, key: str, windows: tuple[int, ...], sums: list[str], means: list[str], changes: list[str]) -> DataFrame:
    """For each window of w bars: sums, means (nulls skipped, from the first bar on) and changes in per cent against w bars before."""
    s = session(key, "ts")
    out = []
    for n in windows:
        w = s.rowsBetween(1 - n, 0)
        out += [F.sum(c).over(w).alias(f"{c}_sum_{n}") for c in sums] + [F.avg(c).over(w).alias(f"{c}_avg_{n}") for c in means]
        out += [F.when(F.lag(c, n).over(s) != 0, (F.col(c) / F.lag(c, n).over(s) - 1) * 100).alias(f"{c}_change_{n}") for c in changes]
    return bars.select(key, "ts", *out)


def bar_features(bars: DataFrame, key: str) -> DataFrame:
    """Features of a bar against the one before, from b8, bq8, a8, aq8 (touch), bid8, ask8 (depth), vol8, buy8, close8, spread and gap in bps.

    ofi8 (queue changes on the depth), absorption per side (pressure on a held touch), vacuum per side (depth drop, gap
    rise, spread rise) and divergence (price and flow of opposite sign). The first bar of a day has none.
    """
    s = session(key, "ts")
    cols = ["b8", "a8", "bid8", "ask8", "close8", "spread_bps", "bid_gap_bps", "ask_gap_bps"]
    x = bars.withColumns({f"l_{c}": F.lag(c).over(s) for c in cols}).where("l_b8 is not null")
    c = F.col
    ofi = F.when(c("b8") >= c("l_b8"), c("bid8")).otherwise(0) - F.when(c("b8") <= c("l_b8"), c("l_bid8")).otherwise(0) - F.when(c("a8") <= c("l_a8"), c("ask8")).otherwise(0) + F.when(c("a8") >= c("l_a8"), c("l_ask8")).otherwise(0)
    ret = (c("close8") / c("l_close8") - 1) * 1e4
    boost = F.least(1 + F.abs(ret) / 100, F.lit(3.0))
    sell8 = c("vol8") - c("buy8")
    vacuum = lambda d, g: 0.5 * relative_drop(c(f"l_{d}"), c(d)) + 0.3 * relative_rise(c(f"l_{g}"), c(g)) + 0.2 * relative_rise(c("l_spread_bps"), c("spread_bps"))
    delta = 2 * c("buy8") - c("vol8")
    sign = lambda v: F.when(v >= 0, 1).otherwise(-1)
    return x.select(
        key, "ts", ofi.alias("ofi8"), ret.alias("ret_bps"),
        F.when(c("b8") >= c("l_b8"), ratio(sell8, c("vol8")) * boost).otherwise(0.0).alias("bid_absorption"),
        F.when(c("a8") <= c("l_a8"), ratio(c("buy8"), c("vol8")) * boost).otherwise(0.0).alias("ask_absorption"),
        vacuum("bid8", "bid_gap_bps").alias("bid_vacuum"), vacuum("ask8", "ask_gap_bps").alias("ask_vacuum"),
        F.when(sign(ret) != sign(delta), F.abs(ratio(delta, c("vol8")))).otherwise(0.0).alias("divergence"),
    )


def zscores(rows: DataFrame, key: str, columns: list[str], n: int) -> DataFrame:
    """(x - mean) / std_pop against the n rows before; 0 where the deviation is at most 1e-12 or the window is not full."""
    w = session(key, "ts").rowsBetween(-n, -1)
    full = F.count("*").over(w) >= n
    z = lambda c: F.when(full & (F.stddev_pop(c).over(w) > 1e-12), (F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w)).otherwise(0.0)
    return rows.select(key, "ts", *[z(c).alias(f"z_{c}") for c in columns])


def false_discovery(zs: DataFrame, key: str, columns: list[str], alpha: float) -> DataFrame:
    """Benjamini-Hochberg per row over its z-scores: kind, z, p and whether it is discovered. No shuffle: a row's few tests are an array."""
    m = len(columns)
    tests = F.array_sort(F.array(*[F.struct(two_sided_p(F.col(c)).alias("p"), F.lit(c).alias("kind"), F.col(c).alias("z")) for c in columns]))
    passing = F.filter(F.transform("tests", lambda t, i: F.when(t["p"] <= (i + 1) / m * alpha, i + 1).otherwise(0)), lambda r: r > 0)
    x = zs.select(key, "ts", tests.alias("tests")).withColumn("cut", F.coalesce(F.array_max(passing), F.lit(0)))
    return x.select(key, "ts", "cut", F.posexplode("tests").alias("i", "t")).select(key, "ts", "t.kind", "t.z", "t.p", (F.col("i") < F.col("cut")).alias("discovered"))


def z_anomalies(zs: DataFrame, key: str, columns: list[str], threshold: float, lower: dict[str, float] | None = None) -> DataFrame:
    """The z-scores beyond their thresholds, one row each."""
    each = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("z"), F.lit((lower or {}).get(c, threshold)).alias("limit")) for c in columns])
    return zs.select(key, "ts", F.inline(each)).where(F.abs("z") >= F.col("limit"))


def _distances(cov: np.ndarray, diff: np.ndarray) -> np.ndarray:
    """The distance of each difference under its covariance, 0 where that is singular; other rows do not mind."""
    try:
        solved = np.linalg.solve(cov, diff[..., None])[..., 0]
    except np.linalg.LinAlgError:
        if len(cov) == 1:
            return np.zeros(1)
        half = len(cov) // 2
        return np.concatenate([_distances(cov[:half], diff[:half]), _distances(cov[half:], diff[half:])])
    return np.sqrt(np.maximum(np.einsum("ni,ni->n", diff, solved), 0))


def mahalanobis(rows: DataFrame, key: str, columns: list[str], n: int, ridge: float = 1e-3, cap: float = 40.0) -> DataFrame:
    """Distance of each row to the n rows before it, with a ridge on the covariance; null until the window is full, at most cap.

    The moments come from window sums over the columns and their products; only the small solves run in Python,
    batched over Arrow. Groups are (key, day), frames n rows. A row whose covariance is singular is at 0.
    """
    d = len(columns)
    w = session(key, "ts").rowsBetween(-n, -1)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.avg(c).over(w) for c in columns]
    prods = [F.covar_samp(columns[i], columns[j]).over(w) for i, j in pairs]
    x = rows.select(key, "ts", F.array(*[F.col(c).cast("double") for c in columns]).alias("v__"), F.array(*sums).alias("m__"), F.array(*prods).alias("s__"), F.count("*").over(w).alias("k__"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.full(len(b), np.nan)
            ok = np.nonzero((b["k__"] >= n).to_numpy())[0]
            if len(ok):
                diff = np.stack(b["v__"].iloc[ok]) - np.stack(b["m__"].iloc[ok])
                flat = np.stack(b["s__"].iloc[ok])
                cov = np.zeros((len(ok), d, d))
                for p, (i, j) in enumerate(pairs):
                    cov[:, i, j] = cov[:, j, i] = flat[:, p]
                var = np.einsum("nii->ni", cov)
                cov[:, np.arange(d), np.arange(d)] += ridge * np.maximum(var, var.mean(1, keepdims=True)) + 1e-12
                out[ok] = np.minimum(_distances(cov, diff), cap)
            yield pd.DataFrame({key: b[key], "ts": b["ts"], "distance": pd.array(np.where(np.isnan(out), None, out), dtype="Float64")})

    kind = rows.schema[key].dataType.simpleString()
    return x.mapInPandas(solve, f"{key} {kind}, ts bigint, distance double")


def rolling_mad(rows: DataFrame, key: str, column: str, n: int) -> DataFrame:
    """Median and median absolute deviation of the last n rows."""
    w = session(key, "ts").rowsBetween(1 - n, 0)
    x = rows.select(key, "ts", F.array_sort(F.collect_list(F.col(column).cast("double")).over(w)).alias("a"))
    mid = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.floor(F.size(a) / 2).cast("int") + 1)) / 2
    x = x.where(F.size("a") > 0).withColumn("median", mid(F.col("a")))
    return x.select(key, "ts", "median", mid(F.array_sort(F.transform("a", lambda v: F.abs(v - F.col("median"))))).alias("mad"))
