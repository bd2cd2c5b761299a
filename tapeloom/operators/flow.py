"""Order-flow measures over trades, quotes and books, per key and UTC day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom.functions.clean import DAY_MS
from tapeloom.functions.market import imbalance, ratio


def session(key: str, *order: str) -> WindowSpec:
    """A window per key and UTC day of ts: days are sessions, so that no key is one task."""
    return Window.partitionBy(key, F.col("ts") - F.pmod("ts", F.lit(DAY_MS))).orderBy(*(order or ("ts", "seq")))


def cvd(trades: DataFrame, key: str, period_ms: int) -> DataFrame:
    """Volume by aggressor per period: buy, sell, delta, ratio (0.5 without volume), count imbalance."""
    buy, sell = F.col("sgn") > 0, F.col("sgn") < 0
    agg = trades.groupBy(key, (F.col("ts") - F.pmod("ts", F.lit(period_ms))).alias("period_ms")).agg(
        F.coalesce(F.sum(F.when(buy, F.col("q8"))), F.lit(0)).alias("buy8"), F.coalesce(F.sum(F.when(sell, F.col("q8"))), F.lit(0)).alias("sell8"),
        F.count_if(buy).alias("n_buy"), F.count_if(sell).alias("n_sell"),
    )
    b, s, nb, ns = F.col("buy8"), F.col("sell8"), F.col("n_buy"), F.col("n_sell")
    return agg.withColumns({"delta8": b - s, "cvd_ratio": ratio(b, b + s, 0.5), "count_imbalance": ratio(nb - ns, nb + ns)})


def trade_stats(trades: DataFrame, key: str, period_ms: int, large8: int) -> DataFrame:
    """Per period: trades, large trades by side, aggressor ratios, largest trade, intensity (at most 20)."""
    big = F.col("q8") >= large8
    buy = F.col("sgn") > 0
    n = trades.groupBy(key, (F.col("ts") - F.pmod("ts", F.lit(period_ms))).alias("period_ms")).agg(
        F.count("*").alias("trades"), F.count_if(buy).alias("buys"), F.count_if(big & buy).alias("large_buys"), F.count_if(big & ~buy).alias("large_sells"),
        F.coalesce(F.sum(F.when(big & buy, F.col("q8"))), F.lit(0)).alias("large_buy8"), F.coalesce(F.sum(F.when(big & ~buy, F.col("q8"))), F.lit(0)).alias("large_sell8"),
        F.max("q8").alias("max8"), F.sum("q8").alias("vol8"),
    )
    large = F.col("large_buy8") + F.col("large_sell8")
    return n.withColumns({"aggressor_ratio": ratio(F.col("buys"), F.col("trades"), 0.5), "large_ratio": ratio(F.col("large_buy8"), large, 0.5), "intensity": F.least(F.lit(20.0), ratio(F.col("trades") * 1e8, F.col("vol8")))})


def rolling_cvd(trades: DataFrame, key: str, n: int) -> DataFrame:
    """Signed and total volume of the last n trades and their ratio."""
    w = session(key).rowsBetween(1 - n, 0)
    net, all_ = F.sum(F.col("sgn") * F.col("q8")).over(w), F.sum("q8").over(w)
    return trades.select(key, "seq", "ts", net.alias("net8"), all_.alias("gross8"), ratio(net, all_).alias("cvd_ratio"))


def top_of_book(levels: DataFrame, key: str) -> DataFrame:
    """Best prices and their quantities per key and ts, from level rows (side, p8, q8)."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    best = levels.groupBy(key, "ts").agg(F.max(F.when(bid, F.struct("p8", "q8"))).alias("b"), F.min(F.when(ask, F.struct("p8", "q8"))).alias("a"))
    return best.where("b is not null and a is not null").select(key, "ts", F.col("b.p8").alias("b8"), F.col("b.q8").alias("bq8"), F.col("a.p8").alias("a8"), F.col("a.q8").alias("aq8"))


def order_flow_imbalance(tops: DataFrame, key: str, n: int) -> DataFrame:
    """Signed queue changes at the touch per observation, their sum over n observations, and that over the mean depth."""
    s = session(key, "ts")
    prev = {c: F.lag(c).over(s) for c in ("b8", "bq8", "a8", "aq8")}
    rows = tops.withColumns({f"l_{c}": x for c, x in prev.items()})
    c = F.col
    e = F.when(c("b8") >= c("l_b8"), c("bq8")).otherwise(0) - F.when(c("b8") <= c("l_b8"), c("l_bq8")).otherwise(0) - F.when(c("a8") <= c("l_a8"), c("aq8")).otherwise(0) + F.when(c("a8") >= c("l_a8"), c("l_aq8")).otherwise(0)
    rows = rows.withColumns({"ofi8": F.when(c("l_b8").isNotNull(), e).otherwise(0), "depth8": F.call_function("div", c("bq8") + c("aq8"), F.lit(2).cast("bigint"))})
    w = s.rowsBetween(1 - n, 0)
    roll, depth = F.sum("ofi8").over(w), F.sum("depth8").over(w)
    return rows.select(key, "ts", "ofi8", roll.alias("ofi_sum8"), ratio(roll * F.count("*").over(w), depth).alias("ofi_norm"))


def absorption(trades: DataFrame, key: str, n: int) -> DataFrame:
    """Over the last n trades with the quote b8, a8 at each: volume that hit a held touch, by side."""
    w = session(key).rowsBetween(1 - n, 0)
    c = F.col
    sells = F.coalesce(F.sum(F.when((c("sgn") < 0) & (c("p8") <= c("b8")), c("q8"))).over(w), F.lit(0))
    buys = F.coalesce(F.sum(F.when((c("sgn") > 0) & (c("p8") >= c("a8")), c("q8"))).over(w), F.lit(0))
    held = {"bid_held": c("b8") >= F.first("b8").over(w), "ask_held": c("a8") <= F.first("a8").over(w)}
    return trades.select(key, "seq", "ts", sells.alias("sell_at_bid8"), buys.alias("buy_at_ask8"), *[F.coalesce(v, F.lit(False)).alias(k) for k, v in held.items()])


def sampled(rows: DataFrame, key: str, grid_ms: int, value: Column) -> DataFrame:
    """The first row of each grid slot: key, ts (slot start), v."""
    slot = F.col("ts") - F.pmod("ts", F.lit(grid_ms))
    return rows.groupBy(key, slot.alias("slot")).agg(F.min(F.struct("ts", "seq", value.alias("v"))).alias("x")).select(key, F.col("slot").alias("ts"), F.col("x.v").alias("v"))


def efficiency(samples: DataFrame, key: str, n: int, trending: float = 0.6, sideways: float = 0.3) -> DataFrame:
    """Net over absolute path of v over n steps and the regime it says; null until n steps are there."""
    s = session(key, "ts")
    step = F.abs(F.col("v") - F.lag("v").over(s))
    rows = samples.withColumns({"step": step, "far": F.lag("v", n).over(s)})
    er = F.when(F.col("far").isNotNull(), ratio(F.abs(F.col("v") - F.col("far")).cast("double"), F.sum("step").over(s.rowsBetween(1 - n, 0)).cast("double")))
    regime = F.when(F.col("er").isNull(), "warming").when(F.col("er") >= trending, "trending").when(F.col("er") <= sideways, "sideways").otherwise("neutral")
    return rows.withColumn("er", er).select(key, "ts", "v", "er", regime.alias("regime"))


def basis(rows: DataFrame, key: str, n: int, k: int) -> DataFrame:
    """Gap of a price v to a reference r in bps, its baseline over the n samples before, deviation, spread and velocity over k."""
    s = session(key, "ts")
    gap = (F.col("v") / F.col("r") - 1) * 1e4
    x = rows.withColumn("gap", gap)
    before = s.rowsBetween(-n, -1)
    x = x.withColumns({"base": F.avg("gap").over(before), "sd": F.stddev_pop("gap").over(before), "seen": F.count("gap").over(before)})
    x = x.withColumn("dev", F.when(F.col("seen") >= n, F.col("gap") - F.col("base")))
    return x.select(key, "ts", "gap", "base", "sd", "dev", (F.col("dev") - F.lag("dev", k).over(s)).alias("velocity"))


def trailing_flow(trades: DataFrame, key: str, width_ms: int) -> DataFrame:
    """Signed volume in [now - width, now], by time and not by rows."""
    w = session(key, "ts").rangeBetween(-width_ms, 0)
    return trades.select(key, "seq", "ts", F.sum(F.col("sgn") * F.col("q8")).over(w).alias("flow8"), F.count("*").over(w).alias("n"))


def trailing_change(samples: DataFrame, key: str, width_ms: int) -> DataFrame:
    """v against the first sample in [now - width, now], once the samples span half the width."""
    w = session(key, "ts").rangeBetween(-width_ms, 0)
    first, at = F.first("v").over(w), F.min("ts").over(w)
    return samples.select(key, "ts", "v", F.when(F.col("ts") - at >= width_ms / 2, first).alias("then"))


def range_breaks(samples: DataFrame, key: str, width_ms: int, margin: float) -> DataFrame:
    """Where v leaves the range of [now - width, now) by the margin: hi, lo and side (+1, -1, 0)."""
    w = session(key, "ts").rangeBetween(-width_ms, -1)
    x = samples.withColumns({"hi": F.max("v").over(w), "lo": F.min("v").over(w), "t0": F.min("ts").over(w)})
    side = F.when(F.col("v") >= F.col("hi") * (1 + margin), 1).when(F.col("v") <= F.col("lo") * (1 - margin), -1).otherwise(0)
    return x.where(F.col("ts") - F.col("t0") >= width_ms / 2).select(key, "ts", "v", "hi", "lo", side.alias("side"))


def autocorrelation_regime(samples: DataFrame, key: str, n: int, volatile: float, trending: float) -> DataFrame:
    """Lag-1 autocorrelation and sample deviation of the last n returns (bps, two at least) around their mean, and the regime they say.

    rho is the sum of products of neighbouring deviations over the sum of squared ones from the second return on.
    """
    s = session(key, "ts")
    x = samples.withColumn("ret", F.when(F.lag("v").over(s) > 0, (F.col("v") / F.lag("v").over(s) - 1) * 1e4)).where("ret is not null")
    x = x.withColumn("both", F.col("ret") * F.lag("ret").over(s))
    w = s.rowsBetween(1 - n, 0)
    m = {"r1": F.sum("ret").over(w), "r2": F.sum(F.col("ret") * F.col("ret")).over(w), "k": F.count("ret").over(w), "first": F.first("ret").over(w), "p": F.sum("both").over(s.rowsBetween(2 - n, 0))}
    x = x.withColumns(m).where("k >= 2")
    k, mean = F.col("k"), F.col("r1") / F.col("k")
    x = x.withColumns({"mean": mean, "sd": F.sqrt(F.greatest(F.col("r2") - F.col("r1") * mean, F.lit(0.0)) / (k - 1))})
    rest = F.col("r1") - F.col("first")
    num = F.col("p") - F.col("mean") * (rest + F.col("r1") - F.col("ret")) + (k - 1) * F.col("mean") * F.col("mean")
    den = F.col("r2") - F.col("first") * F.col("first") - 2 * F.col("mean") * rest + (k - 1) * F.col("mean") * F.col("mean")
    x = x.withColumn("rho", F.when(den > 1e-12, num / den).otherwise(0.0))
    kind = F.when(F.col("sd") > volatile, "volatile").when(F.col("rho") > trending, "trending").otherwise("ranging")
    return x.select(key, "ts", "rho", "sd", kind.alias("regime"))


def wall_flow(events: DataFrame, key: str, n: int) -> DataFrame:
    """Of what the touch lost at an unmoved price between observations, how much trades explain: executed, cancelled, over n observations.

    events: tops of book with traded8, the opposite-aggressor volume at that touch since the observation before, for each side.
    """
    s = session(key, "ts")
    c = F.col
    out = events
    for side, px, q in (("bid", "b8", "bq8"), ("ask", "a8", "aq8")):
        lost = F.when(c(px) == F.lag(px).over(s), F.greatest(F.lag(q).over(s) - c(q), F.lit(0))).otherwise(0)
        out = out.withColumn(f"{side}_lost", F.coalesce(lost, F.lit(0)))
        out = out.withColumns({f"{side}_done": F.least(F.col(f"{side}_lost"), F.col(f"{side}_traded8"))})
    w = s.rowsBetween(1 - n, 0)
    done, lost = F.sum(c("bid_done") + c("ask_done")).over(w), F.sum(c("bid_lost") + c("ask_lost")).over(w)
    skew = F.sum(c("bid_lost") - c("bid_done") - c("ask_lost") + c("ask_done")).over(w)
    return out.select(key, "ts", done.alias("executed8"), (lost - done).alias("cancelled8"), ratio(lost - done, lost).alias("cancel_ratio"), skew.alias("cancel_skew8"))


def depth_imbalance(bid8: Column, ask8: Column) -> Column:
    return imbalance(bid8, ask8)


def rolling_moments(bars: DataFrame, key: str, x: str, n: int) -> DataFrame:
    """Mean and sample deviation (0 of one value) of x over the last n bars, this one included."""
    w = session(key, "ts").rowsBetween(1 - n, 0)
    return bars.select(key, "ts", x, F.avg(x).over(w).alias("mean"), F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)).alias("sd"))


def momentum(samples: DataFrame, key: str, k: int) -> DataFrame:
    """The return of v over k samples in bps."""
    return samples.select(key, "ts", ((F.col("v") / F.lag("v", k).over(session(key, "ts")) - 1) * 1e4).alias("momentum"))


def multi_reference(rows: DataFrame, key: str, source: str, sources: list[str], price: str) -> DataFrame:
    """At each row the mean over the named sources of their last price above 0, and of how many; rows before any source's first are left out.

    rows: key, seq, ts, source, price. The sources are a short fixed list: each is one running column.
    """
    w = session(key).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when((F.col(source) == s) & (F.col(price) > 0), F.col(price)), True).over(w) for s in sources]
    x = rows.withColumns({f"last{i}__": c for i, c in enumerate(last)})
    seen = [F.col(f"last{i}__") for i in range(len(sources))]
    n = sum((c.isNotNull().cast("int") for c in seen), F.lit(0))
    return x.select(key, "seq", "ts", n.alias("n_sources"), (sum((F.coalesce(c, F.lit(0.0)) for c in seen), F.lit(0.0)) / n).alias("reference")).where("n_sources > 0")
