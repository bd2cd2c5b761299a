"""Irregular readings onto a regular grid by interval representation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.clean import DAY_MS, known


def regular_grid(
    readings: DataFrame,
    source: list[str],
    ts: str,
    value: str,
    ordinal: str,
    period_ms: int = 300_000,
    validity_ms: int = 900_000,
    span_ms: int = DAY_MS,
    zero_missing: bool = True,
) -> DataFrame:
    """One row per source and period between the first and last reading of each span (a UTC day).

    A reading is a validity interval [ts, next reading), at most validity_ms long: a step
    function. Each interval is intersected with the grid cells; a cell gets its time-weighted
    average, the covered fraction, the last value carried forward and the state 'observed' or 'gap'.

    Of several readings of one source and instant the one with the largest ordinal holds. Rows
    with a null source or ts and missing values (null, NaN, 0.0 if zero_missing) are no readings.
    Other columns are ignored. No readings give no rows.

    Result: the source columns, period_ms, state, n_readings, twa, coverage, fill.

    Plan: repeated deliveries vanish in a map-side combine; the interval pass is keyed by
    (source, cell), so a source with a third of the rows spreads over all tasks; only one row
    per cell reaches the pass per (source, span), whose groups have span/period rows at most.
    """
    key = [F.col(c).alias(f"k{i}") for i, c in enumerate(source)]
    k = [f"k{i}" for i in range(len(source))]
    v = F.col(value).cast("double")
    r = (
        readings.where(known(v, zero_missing))
        .select(*key, F.col(ts).cast("bigint").alias("t"), v.alias("v"), F.col(ordinal).alias("o"))
        .dropna(subset=[*k, "t"])
        .groupBy(*k, "t")
        .agg(F.max_by("v", "o").alias("v"))
        .withColumn("cell", F.col("t") - F.pmod("t", F.lit(period_ms)))
    )
    w = Window.partitionBy(*k, "cell").orderBy("t")
    step = F.lead("t").over(w) - F.col("t")
    held = F.when(step.isNotNull(), F.least(step, F.lit(validity_ms)))  # least skips nulls
    cells = (
        r.withColumn("held", held)
        .groupBy(*k, "cell")
        .agg(
            F.min("t").alias("t0"),
            F.max("t").alias("t1"),
            F.count("*").alias("n"),
            F.max_by("v", "t").alias("v1"),
            F.coalesce(F.sum(F.col("v") * F.col("held")), F.lit(0.0)).alias("area"),
            F.coalesce(F.sum("held"), F.lit(0)).alias("cov"),
        )
    )
    s = Window.partitionBy(*k, F.col("cell") - F.pmod("cell", F.lit(span_ms))).orderBy("cell")
    period, valid = F.lit(period_ms), F.lit(validity_ms)
    p, zero = F.col("p"), F.lit(0).cast("bigint")
    head = F.greatest(zero, F.least(F.col("t0"), F.col("pt") + valid) - F.col("cell"))
    tail = F.greatest(zero, F.least(p + period, F.col("t1") + valid) - F.greatest(p, F.col("t1")))
    own = p == F.col("cell")
    head = F.when(own & F.col("pt").isNotNull(), head).otherwise(zero)
    cov = tail + head + F.when(own, F.col("cov")).otherwise(zero)
    area = tail * F.col("v1") + F.coalesce(head * F.col("pv"), F.lit(0.0)) + F.when(own, F.col("area")).otherwise(0.0)
    return (
        cells.withColumns({"nc": F.lead("cell").over(s), "pt": F.lag("t1").over(s), "pv": F.lag("v1").over(s)})
        .withColumn("p", F.explode(F.sequence("cell", F.coalesce(F.col("nc") - period, F.col("cell")), period.cast("bigint"))))
        .select(
            *[F.col(f"k{i}").alias(c) for i, c in enumerate(source)],
            p.alias("period_ms"),
            F.when(own, "observed").otherwise("gap").alias("state"),
            F.when(own, F.col("n")).otherwise(zero).alias("n_readings"),
            F.when(cov > 0, area / cov).alias("twa"),
            (cov / period).alias("coverage"),
            F.col("v1").alias("fill"),
        )
    )
