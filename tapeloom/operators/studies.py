"""Event studies: episodes, the paths after them, and what a trade on them would have met.

Episodes: id, key, ts, side (+1 up, -1 down), p8. Paths: an episode's columns with path_ts and v8 for each sample in
[ts, ts + width], from a bucketed range join; every measure is an aggregation over an episode's path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.clean import DAY_MS
from tapeloom.functions.market import ratio
from tapeloom.operators.asof import asof_backward, range_join
from tapeloom.operators.flow import session
from tapeloom.operators.sim import non_overlapping

EPISODE = ["id", "key", "ts", "side", "p8"]


def paths(episodes: DataFrame, samples: DataFrame, width_ms: int) -> DataFrame:
    """samples: key, ts, v8."""
    return range_join(episodes.select(*EPISODE), samples.select("key", "ts", "v8"), ["key"], "ts", width_ms)


def bps(v: Column, base: Column) -> Column:
    return (v / base - 1) * 1e4


def dislocations(samples: DataFrame, threshold: float, close: float) -> DataFrame:
    """Stretches in which |dev| stays above `close` after having reached the threshold: from_ts, fired_ts, end_ts (null: open at the day's end), peak, side.

    samples: key, ts, dev. Gaps and islands over the sign of |dev| > close per key and day.
    """
    s = session("key", "ts")
    x = samples.where("dev is not null").withColumn("out", F.abs("dev") > close)
    x = x.withColumns({"isle": F.sum((~F.col("out")).cast("int")).over(s.rowsBetween(Window.unboundedPreceding, 0)), "day": F.col("ts") - F.pmod("ts", F.lit(DAY_MS)), "nxt": F.lead("ts").over(s)})
    e = x.where("out").groupBy("key", "day", "isle").agg(
        F.min("ts").alias("from_ts"), F.min(F.when(F.abs("dev") >= threshold, F.col("ts"))).alias("fired_ts"), F.max_by("nxt", "ts").alias("end_ts"), F.max(F.abs("dev")).alias("peak"), F.min_by("dev", "ts").alias("dev0"), F.count("*").alias("samples"),
    )
    return e.where("fired_ts is not null").select("key", "from_ts", "fired_ts", "end_ts", "peak", F.when(F.col("dev0") > 0, 1).otherwise(-1).alias("side"), "samples")


def cascades(oi: DataFrame, price: DataFrame, window_ms: int, drop: float, move_bps: float, cooldown_ms: int) -> DataFrame:
    """Where open interest fell by the share `drop` and the price moved by move_bps within the window; after one, none for the cool-down.

    oi: key, ts, seq, oi8; price: key, ts, seq, v8.
    """
    w = session("key", "ts").rangeBetween(-window_ms, 0)
    o = asof_backward(oi, price, ["key"], "ts", "seq", ["v8"]).where("v8 is not null")
    o = o.withColumns({"oi0": F.first("oi8").over(w), "v0": F.first("v8").over(w), "t0": F.min("ts").over(w)})
    fell = (F.col("oi0") - F.col("oi8")) / F.col("oi0")
    moved = bps(F.col("v8"), F.col("v0"))
    hit = o.where((F.col("ts") - F.col("t0") >= window_ms / 2) & (fell >= drop) & (F.abs(moved) >= move_bps))
    hit = hit.select("key", "ts", "seq", fell.alias("oi_drop"), moved.alias("move_bps"), F.when(moved > 0, 1).otherwise(-1).alias("side"), F.col("v8").alias("p8"), (F.col("ts") + cooldown_ms).alias("until"))
    return non_overlapping(hit, "key", "ts", "until").withColumnRenamed("seq", "id")


def reversion(path: DataFrame) -> DataFrame:
    """How far the price ran on in the episode's direction and what it gave back: spike_bps, peak_ts, revert share, half and full recovery times."""
    run = bps(F.col("v8"), F.col("p8")) * F.col("side")
    x = path.withColumn("run", run)
    top = x.groupBy(*EPISODE).agg(F.max(F.struct("run", -F.col("path_ts"))).alias("m"))
    top = top.select(*EPISODE, F.greatest(F.col("m.run"), F.lit(0.0)).alias("spike_bps"), (-F.col("m.col2")).alias("peak_ts"))
    y = x.join(top, EPISODE).where(F.col("path_ts") >= F.col("peak_ts"))
    back = F.col("spike_bps") - F.col("run")
    g = y.groupBy(*EPISODE, "spike_bps", "peak_ts").agg(F.max(back).alias("back"), F.min(F.when(back >= F.col("spike_bps") / 2, F.col("path_ts"))).alias("half_ts"), F.min(F.when(F.col("run") <= 0, F.col("path_ts"))).alias("full_ts"))
    return g.select("id", "key", "spike_bps", "peak_ts", F.least(ratio(F.col("back"), F.col("spike_bps")), F.lit(1.0)).alias("reverted"), (F.col("half_ts") - F.col("peak_ts")).alias("half_ms"), (F.col("full_ts") - F.col("peak_ts")).alias("full_ms"))


def first_touch(path: DataFrame, delay_ms: int, hold_ms: int, target_bps: float, stop_bps: float, fade: bool = True) -> DataFrame:
    """A trade entered at the first sample delay_ms after the episode, against its direction (or with it): signed bps at the first of target, stop, hold.

    A missing touch pays the last sample within the hold; no entry, no row.
    """
    late = path.where(F.col("path_ts") >= F.col("ts") + delay_ms)
    entry = late.groupBy(*EPISODE).agg(F.min(F.struct("path_ts", "v8")).alias("e"))
    x = late.join(entry, EPISODE).where(F.col("path_ts") <= F.col("e.path_ts") + hold_ms)
    gain = bps(F.col("v8"), F.col("e.v8")) * F.col("side") * (-1 if fade else 1)
    x = x.withColumn("gain", gain)
    touch = (F.col("gain") >= target_bps) | (F.col("gain") <= -stop_bps)
    g = x.groupBy(*EPISODE).agg(F.min_by("gain", F.when(touch, F.col("path_ts"))).alias("at_touch"), F.min(F.when(touch, F.col("path_ts"))).alias("touch_ts"), F.max_by("gain", "path_ts").alias("at_end"), F.max("path_ts").alias("end_ts"))
    return g.select("id", "key", F.coalesce("at_touch", "at_end").alias("bps"), F.coalesce("touch_ts", "end_ts").alias("exit_ts"), F.col("touch_ts").isNotNull().alias("touched"))


def through_trades(orders: DataFrame, trades: DataFrame, width_ms: int) -> DataFrame:
    """Resting orders and the first trade that goes through them: orders (id, key, ts, is_bid, p8) with fill_ts, null without one.

    A bid is filled by an aggressive sell at or below its price within width_ms, an ask by an aggressive buy at or above it.
    """
    x = range_join(orders, trades.select("key", "ts", "sgn", F.col("p8").alias("t8")), ["key"], "ts", width_ms)
    through = F.when(F.col("is_bid"), (F.col("sgn") < 0) & (F.col("t8") <= F.col("p8"))).otherwise((F.col("sgn") > 0) & (F.col("t8") >= F.col("p8")))
    hit = x.where(through).groupBy("id").agg(F.min("path_ts").alias("fill_ts"))
    return orders.join(hit, "id", "left")


def outcome_class(path: DataFrame, edge: str, run_bps: float) -> DataFrame:
    """+1 if the price ran on by run_bps beyond the break before it came back through the edge, -1 if it came back first, 0 if neither."""
    on = bps(F.col("v8"), F.col("p8")) * F.col("side") >= run_bps
    back = (F.col("v8") - F.col(edge)) * F.col("side") < 0
    g = path.groupBy("id", "key").agg(F.min(F.when(on, F.col("path_ts"))).alias("on_ts"), F.min(F.when(back, F.col("path_ts"))).alias("back_ts"))
    out = F.when(F.col("on_ts").isNull() & F.col("back_ts").isNull(), 0).when(F.col("back_ts").isNull() | (F.col("on_ts") < F.col("back_ts")), 1).otherwise(-1)
    return g.select("id", "key", out.alias("outcome"), "on_ts", "back_ts")


def flow_metrics(episodes: DataFrame, trades: DataFrame, width_ms: int) -> DataFrame:
    """Volume forced in the episode's direction, in the early and late half of the width, the displacement, their ratios and the state they say."""
    x = range_join(episodes.select(*EPISODE), trades.select("key", "ts", "seq", "sgn", "q8", F.col("p8").alias("v8")), ["key"], "ts", width_ms)
    forced = F.when(F.col("sgn") == F.col("side"), F.col("q8")).otherwise(0)
    early = F.col("path_ts") < F.col("ts") + width_ms / 2
    g = x.groupBy(*EPISODE).agg(F.sum(forced).alias("forced8"), F.sum(F.when(early, forced).otherwise(0)).alias("early8"), F.sum(F.when(~early, forced).otherwise(0)).alias("late8"), F.max_by("v8", F.struct("path_ts", "seq")).alias("last8"))
    push = bps(F.col("last8"), F.col("p8")) * F.col("side")
    g = g.withColumns({"push_bps": push, "late_share": ratio(F.col("late8"), F.col("forced8"))})
    state = F.when((F.col("push_bps") >= 5) & (F.col("late_share") >= 0.5), "continuation").when((F.col("forced8") > 0) & (F.col("push_bps") < 1), "absorbed").when(F.col("late_share") < 0.3, "exhausted").otherwise("unclassified")
    return g.select("id", "key", "forced8", "early8", "late8", "push_bps", "late_share", state.alias("state"))


def structural_stop(path: DataFrame, entry_ms: int, buffer_bps: float, multiple: float) -> DataFrame:
    """A reversal entered entry_ms after the break with its stop behind the wick so far and a target at a multiple of that risk: R at the first touch."""
    wick = path.where(F.col("path_ts") <= F.col("ts") + entry_ms).groupBy(*EPISODE).agg(F.max(F.struct(F.col("v8") * F.col("side"), "v8")).alias("w"), F.max_by("v8", "path_ts").alias("entry8"))
    risk = (bps(F.col("w.v8"), F.col("entry8")) * F.col("side")) + buffer_bps
    x = path.where(F.col("path_ts") > F.col("ts") + entry_ms).join(wick.withColumn("risk", risk), EPISODE)
    x = x.withColumn("r", -bps(F.col("v8"), F.col("entry8")) * F.col("side") / F.col("risk"))
    touch = (F.col("r") >= multiple) | (F.col("r") <= -1)
    g = x.groupBy("id", "key", "risk").agg(F.min_by("r", F.when(touch, F.col("path_ts"))).alias("hit"), F.max_by("r", "path_ts").alias("last"))
    return g.select("id", "key", F.col("risk").alias("risk_bps"), F.coalesce("hit", "last").alias("r"))


def ladder(path: DataFrame, rungs: int, span_bps: float, hold_ms: int) -> DataFrame:
    """Entries against the episode on `rungs` levels up to span_bps beyond the break: how many filled, the average and the result in bps at the hold's end."""
    run = bps(F.col("v8"), F.col("p8")) * F.col("side")
    g = path.where(F.col("path_ts") <= F.col("ts") + hold_ms).groupBy(*EPISODE).agg(F.max(run).alias("far"), F.max_by("v8", "path_ts").alias("last8"))
    n = F.least(F.lit(rungs), F.greatest(F.floor(F.col("far") / (span_bps / rungs)), F.lit(0))).cast("int")
    avg = span_bps / rungs * (F.col("n") + 1) / 2
    return g.withColumn("n", n).select("id", "key", F.col("n").alias("filled"), F.when(F.col("n") > 0, avg - bps(F.col("last8"), F.col("p8")) * F.col("side")).alias("bps"))


def twap(episodes: DataFrame, samples: DataFrame, slices: int, step_ms: int) -> DataFrame:
    """Mean of the prices as of `slices` points at step_ms from the episode on; points before the first sample are left out."""
    points = episodes.select("id", "key", "side", F.explode(F.sequence(F.col("ts"), F.col("ts") + (slices - 1) * step_ms, F.lit(step_ms).cast("bigint"))).alias("ts"), F.lit(0).cast("bigint").alias("seq"))
    got = asof_backward(points, samples.withColumn("seq", F.lit(0).cast("bigint")), ["key"], "ts", "seq", ["v8"])
    return got.groupBy("id", "key").agg(F.count("v8").alias("points"), F.avg("v8").alias("twap8"))


def exhaustion(samples: DataFrame, episodes: DataFrame, width_ms: int, still_bps: float) -> DataFrame:
    """The first sample after the episode at which open interest bleeds less than in the step before and the price stands still: id, ts.

    samples: key, ts, oi8, v8.
    """
    s = session("key", "ts")
    x = samples.withColumns({"bleed": F.lag("oi8").over(s) - F.col("oi8"), "stall": F.abs(bps(F.col("v8"), F.lag("v8").over(s)))})
    x = x.withColumn("slower", (F.col("bleed") < F.lag("bleed").over(s)) & (F.col("stall") <= still_bps)).where("slower").select("key", "ts", "slower")
    return range_join(episodes.select(*EPISODE), x, ["key"], "ts", width_ms).where(F.col("path_ts") > F.col("ts")).groupBy("id", "key").agg(F.min("path_ts").alias("exhausted_ts"))


def reclaims(path: DataFrame, edge: str) -> DataFrame:
    """The first sample back inside the broken range: id, reclaim_ts, v8."""
    inside = (F.col("v8") - F.col(edge)) * F.col("side") < 0
    return path.where(inside).groupBy("id", "key").agg(F.min(F.struct("path_ts", "v8")).alias("r")).select("id", "key", F.col("r.path_ts").alias("reclaim_ts"), F.col("r.v8").alias("v8"))


def flow_exit(episodes: DataFrame, trades: DataFrame, hold_ms: int, trail_ms: int, times: float, base_ms: int, target_bps: float = 0.0) -> DataFrame:
    """Where a reversal of each episode ends: id, key, exit_ts, exit ('target', 'flow', 'hold' or 'end'), bps.

    trades: key, ts, seq, p8, sgn, q8. Entered at the first trade from the episode on, against its side. 'target': the gain reaches
    target_bps (0: none); 'flow': later than the entry the forced volume (of the episode's side) of trail_ms reaches `times` the rate
    of the base_ms up to the episode, known by then; 'hold': hold_ms after the entry; 'end': the last trade seen. Looked at in this order.
    """
    reach = max(base_ms, trail_ms)
    moved = episodes.select("id", "key", (F.col("ts") - reach).alias("ts"), "side", "p8")
    x = range_join(moved, trades.select("key", "ts", "seq", "p8", "sgn", "q8").withColumnRenamed("p8", "px8"), ["key"], "ts", reach + 2 * hold_ms).withColumn("ts", F.col("ts") + reach)
    forced = F.when(F.col("sgn") == F.col("side"), F.col("q8")).otherwise(0)
    one = Window.partitionBy("id")
    x = x.withColumn("trail", F.sum(forced).over(one.orderBy("path_ts").rangeBetween(-trail_ms, 0)))
    x = x.withColumn("base", F.sum(F.when((F.col("path_ts") >= F.col("ts") - base_ms) & (F.col("path_ts") < F.col("ts")), forced)).over(one))
    y = x.where("path_ts >= ts").withColumn("entry", F.min(F.struct("path_ts", "seq", "px8")).over(one)).where(F.col("path_ts") <= F.col("entry.path_ts") + hold_ms * 2)
    bps = (F.col("px8") / F.col("entry.px8") - 1) * 1e4 * -F.col("side")
    flow = (F.col("base") > 0) & (F.col("path_ts") > F.col("entry.path_ts")) & (F.col("trail") / trail_ms >= times * F.col("base") / base_ms)
    kind = F.when(F.lit(target_bps > 0) & (bps >= target_bps), "target").when(flow, "flow").when(F.col("path_ts") - F.col("entry.path_ts") >= hold_ms, "hold")
    y = y.select("id", "key", "path_ts", "seq", bps.alias("bps"), kind.alias("exit"))
    first = F.min(F.when(F.col("exit").isNotNull(), F.struct("path_ts", "seq", "exit", "bps")))
    last = F.max(F.struct("path_ts", "seq", F.lit("end").alias("exit"), "bps"))
    return y.groupBy("id", "key").agg(F.coalesce(first, last).alias("m")).select("id", "key", F.col("m.path_ts").alias("exit_ts"), F.col("m.exit").alias("exit"), F.col("m.bps").alias("bps"))
