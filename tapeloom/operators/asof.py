"""As-of, interval and range joins as unions with windows per key and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.clean import DAY_MS


def _bucket(c: str, width: int) -> Column:
    return F.col(c) - F.pmod(F.col(c), F.lit(width))


def _merged(left: DataFrame, right: DataFrame, key: list[str], ts: str, tie: str, payload: list[str], width: int, back: bool) -> DataFrame:
    """Left and right rows by (key, bucket of ts), each bucket with the right row that its neighbours carry into it.

    Only the last (first) right row of a bucket can matter beyond it; these, one per bucket, are carried on
    over the key's buckets, so that no task sees more of a key than one bucket and the list of its buckets.
    """
    own = [c for c in left.columns if c not in key]
    a = left.select(*key, F.col(ts).alias("t__"), F.col(tie).alias("tie__"), F.lit(True).alias("left__"), F.struct(*own).alias("l__")).withColumn("b__", _bucket("t__", width))
    r = right.select(*key, F.col(ts).alias("t__"), F.col(tie).alias("tie__"), F.lit(False).alias("left__"), F.struct(*payload).alias("r__")).withColumn("b__", _bucket("t__", width))
    edge = F.struct("t__", "tie__", "r__")
    edges = r.groupBy(*key, "b__").agg((F.max if back else F.min)(edge).alias("e__"))
    slots = edges.unionByName(a.select(*key, "b__").distinct(), allowMissingColumns=True).groupBy(*key, "b__").agg(F.max("e__").alias("e__"))
    w = Window.partitionBy(*key).orderBy(F.asc("b__") if back else F.desc("b__")).rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("e__", F.last("e__", ignorenulls=True).over(w)).where("e__ is not null").select(*key, "b__", "e__.*").withColumn("left__", F.lit(False))
    return a.unionByName(r, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)


def _opened(df: DataFrame, left: DataFrame, key: list[str], extra: list[Column]) -> DataFrame:
    return df.where("left__").select(*key, *[F.col("l__")[c].alias(c) for c in left.columns if c not in key], *extra)


def asof_backward(left: DataFrame, right: DataFrame, key: list[str], ts: str, tie: str, take: list[str], strict: bool = False, clip: bool = False, keep_right_ts: str | None = None, width: int = DAY_MS) -> DataFrame:
    """left with the take columns of the last right row at or before it (before it, if strict).

    Rows of equal ts go by tie on the right side; clip gives left rows before the first right row that
    row's values instead of null. A union and a window per key and bucket of `width`; no nested loop.
    """
    payload = [*take, F.col(ts).alias("t__")]
    m = _merged(left, right, key, ts, tie, payload, width, True)
    rank = F.when(F.col("left__"), 0 if strict else 1).otherwise(1 if strict else 0)
    w = Window.partitionBy(*key, "b__").orderBy("t__", rank, "tie__")
    m = m.withColumn("g__", F.last("r__", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("left__")
    if clip:
        firsts = right.groupBy(*key).agg(F.min(F.struct(F.col(ts).alias("t__"), F.col(tie).alias("tie__"), F.struct(*payload).alias("r__"))).alias("f__"))
        m = m.join(firsts, key, "left").withColumn("g__", F.coalesce("g__", "f__.r__"))
    extra = [F.col("g__")[c].alias(c) for c in take] + ([F.col("g__.t__").alias(keep_right_ts)] if keep_right_ts else [])
    return _opened(m, left, key, extra)


def asof_forward(left: DataFrame, right: DataFrame, key: list[str], ts: str, tie: str, take: list[str], strict: bool = False, width: int = DAY_MS) -> DataFrame:
    """left with the take columns of the first right row at or after it (after it, if strict)."""
    m = _merged(left, right, key, ts, tie, take, width, False)
    rank = F.when(F.col("left__"), 0 if strict else 1).otherwise(1 if strict else 0)
    w = Window.partitionBy(*key, "b__").orderBy(F.desc("t__"), rank, F.desc("tie__"))
    got = F.last("r__", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return _opened(m.withColumn("g__", got), left, key, [F.col("g__")[c].alias(c) for c in take])


def interval_bins(bars: DataFrame, ticks: DataFrame, key: list[str], ts: str, tie: str, bar_id: str, closed: str = "right") -> DataFrame:
    """ticks with the bar whose interval they fall in.

    closed='right': the bar with ts in (previous bar, bar]; closed='left': [previous bar, bar), so that ticks at or
    after the last bar have none. Ticks without a bar are left out.
    """
    edges = bars.select(*key, ts, bar_id, *([tie] if tie in bars.columns and tie != bar_id else []))
    if tie not in edges.columns:
        edges = edges.withColumn(tie, F.lit(0).cast("bigint"))
    found = asof_forward(ticks, edges, key, ts, tie, [bar_id], strict=closed == "left")
    return found.where(F.col(bar_id).isNotNull())


def nearest_horizon(rows: DataFrame, key: list[str], ts: str, order: str, value: str, horizon: int, out: str, later_on_tie: bool = False) -> DataFrame:
    """rows with `out`: the value of the later row of the key nearest in time to ts + horizon.

    Equal distance goes to the earlier row, or the later one if later_on_tie; past the end the last row
    counts; the last row itself has none. Two as-of lookups and a comparison of distances.
    """
    probe = rows.select(*key, (F.col(ts) + horizon).alias(ts), order)
    target = lambda name: rows.select(*key, ts, order, F.struct(F.col(ts).alias("at"), F.col(order).alias("no"), F.col(value).alias("v")).alias(name))
    before = asof_backward(probe, target("b"), key, ts, order, ["b"])
    both = asof_forward(before, target("a"), key, ts, order, ["a"], strict=True)
    later = F.when(F.col("b.no") > F.col(order), F.col("b"))
    near = F.col(ts) - F.col("later.at")
    far = F.col("a.at") - F.col(ts)
    first = (near < far) if later_on_tie else (near <= far)
    pick = F.when(F.col("a").isNull(), F.col("later")).when(F.col("later").isNull(), F.col("a")).when(first, F.col("later")).otherwise(F.col("a"))
    got = both.withColumn("later", later).select(*key, order, pick["v"].alias(out))
    return rows.join(got, [*key, order], "left")


def range_join(points: DataFrame, path: DataFrame, key: list[str], ts: str, width: int) -> DataFrame:
    """points x path rows of the key with path ts in [point ts, point ts + width], by buckets as wide as the range.

    The path's ts comes as path_ts. A point meets the path rows of two buckets only; the residual decides.
    """
    b = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(width))
    p = points.withColumn("b__", F.explode(F.array(b(ts), b(ts) + width)))
    q = path.withColumn("b__", b(ts)).withColumnRenamed(ts, "path_ts")
    return p.join(q, [*key, "b__"]).where((F.col("path_ts") >= F.col(ts)) & (F.col("path_ts") <= F.col(ts) + width)).drop("b__")
