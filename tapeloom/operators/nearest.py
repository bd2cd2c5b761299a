"""Pairs of records nearest in time within a tolerance, by time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, entity: list[str], ts: str, ordinal: str, tolerance_ms: int) -> DataFrame:
    """For each left row the right row of the same entity nearest in time, at most tolerance_ms away.

    Both sides have the entity columns, ts (BIGINT ms) and a unique ordinal; other columns are
    ignored. Equal distance goes to the earlier ts, then to the smaller right ordinal. A null
    entity or ts matches nothing; left rows without a partner give no row. The bound is included.

    Result: the entity columns, left_ordinal, right_ordinal, dt_ms (right minus left).

    Method: buckets as wide as the tolerance, so a partner stands in the same bucket or in one of
    the two beside it. From a bucket beside, only its last (or first) right row can be nearest;
    these edges, at most two rows a bucket, join the adjacent buckets. Inside a bucket the rows
    are merged in time order in place of pairing each with each. The filter by difference and the
    deterministic minimum follow. Groups are (entity, bucket), so a hot entity spreads over all
    tasks, and the work is linear in the rows however dense a bucket is.
    """
    keys = [f"k{i}" for i in range(len(entity))]
    names = [F.col(c).alias(f"k{i}") for i, c in enumerate(entity)]
    bucket = (F.col("t") - F.pmod("t", F.lit(tolerance_ms))).alias("b")
    lf = left.select(*names, F.col(ts).alias("t"), F.col(ordinal).alias("o")).dropna()
    rt = right.select(*names, F.col(ts).alias("t"), F.col(ordinal).alias("o")).dropna().select("*", bucket)
    # one row per entity and instant: at equal ts the smaller ordinal wins in any case
    rt = rt.groupBy(*keys, "b", "t").agg(F.min("o").alias("o"))
    first, last = F.min(F.struct("t", "o")).alias("f"), F.max(F.struct("t", "o")).alias("l")
    step = F.lit(tolerance_ms)
    edges = (
        rt.groupBy(*keys, "b").agg(first, last)
        .select(*keys, F.inline(F.array(F.struct((F.col("b") - step).alias("b"), F.col("f.t").alias("t"), F.col("f.o").alias("o")), F.struct((F.col("b") + step).alias("b"), F.col("l.t").alias("t"), F.col("l.o").alias("o")))))
    )
    r = rt.select(*keys, "b", "t", "o").union(edges.select(*keys, "b", "t", "o")).withColumn("is_left", F.lit(False))
    rows = lf.select("*", bucket).select(*keys, "b", "t", "o").withColumn("is_left", F.lit(True)).union(r)
    part = Window.partitionBy(*keys, "b")
    hit = F.when(~F.col("is_left"), F.struct("t", "o"))
    before = F.last(hit, ignorenulls=True).over(part.orderBy(F.asc("t"), F.asc("is_left")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(hit, ignorenulls=True).over(part.orderBy(F.desc("t"), F.asc("is_left")).rowsBetween(Window.unboundedPreceding, 0))
    gap = lambda c: F.abs(F.col(f"{c}.t") - F.col("t"))
    pick = F.when(F.col("n").isNull() | (gap("p") <= gap("n")), F.col("p")).otherwise(F.col("n"))
    return (
        rows.withColumns({"p": before, "n": after}).where("is_left")
        .select(*keys, "t", "o", pick.alias("m")).where(gap("m") <= tolerance_ms)
        .select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(entity)], F.col("o").alias("left_ordinal"), F.col("m.o").alias("right_ordinal"), (F.col("m.t") - F.col("t")).alias("dt_ms"))
    )
