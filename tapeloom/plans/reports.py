"""Summaries over walls, theses, regimes, low-volume nodes, fills and sweeps, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import market as M
from tapeloom.functions.clean import DAY_MS
from tapeloom.operators import flow, profile, sim, stats
from tapeloom.operators.asof import asof_backward
from tapeloom.plans import engine, studies
from tapeloom.plans.base import FUNDING, OI, SNAPS, TRADES, funding, instruments, open_interest, snapshots, trades
from tapeloom.plans.flow import BARS5, DAY, PROFILE, TOPS, _bins, rounded, wall_tracker
from tapeloom.plans.studies import TB

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


SQL_DISLOC = studies.SQL["dislocation_scan"]


def day_no(c: str = "ts"):
    return F.call_function("div", F.col(c), F.lit(DAY_MS).cast("bigint"))


@query(f"""with {SNAPS}, ix as (select coin, ts, ts {DAY} * 86400000 as day, row_number() over (partition by coin, ts {DAY} order by ts) as no from (select distinct coin, ts from sl)),
lastno as (select coin, day, max(no) as n from ix group by all),
big as (select sl.*, day, no from sl join ix using (coin, ts) where q8 >= 3000000000),
x as (select *, no - row_number() over (partition by coin, day, side, p8 order by no) as isle from big),
w as (select coin, day, side, p8, isle, min(ts) as a, max(ts) as b, max(no) as last_no, count(*) as seen, max(q8) as peak8, arg_max(q8, no) as end8 from x group by all)
select coin, side, count(*) as walls, count(*) filter (last_no < n) as completed, count(*) filter (last_no < n and end8 * 2 >= peak8) as vanished, cast(sum(b - a) as bigint) as lived_ms
from w join lastno using (coin, day) group by coin, side""")
def wall_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per coin and side: walls, those that ended within the day, those that vanished at half their peak or more, and how long they stood."""
    w = wall_tracker(spark, d)
    n = snapshots(spark, d).select("coin", "ts").distinct().groupBy("coin", (F.col("ts") - F.pmod("ts", F.lit(DAY_MS))).alias("day")).agg(F.count("*").alias("n"))
    x = w.join(n, ["coin", "day"])
    done = F.col("last_no") < F.col("n")
    return x.groupBy("coin", "side").agg(F.count("*").alias("walls"), F.count_if(done).alias("completed"), F.count_if(done & (F.col("end8") * 2 >= F.col("peak8"))).alias("vanished"), F.sum(F.col("to_ts") - F.col("from_ts")).alias("lived_ms"))


@query(f"""with {TOPS}, e as (
  select *, case when lag(b8) over s is null then 0 else
      (case when b8 >= lag(b8) over s then bq8 else 0 end) - (case when b8 <= lag(b8) over s then lag(bq8) over s else 0 end)
    - (case when a8 <= lag(a8) over s then aq8 else 0 end) + (case when a8 >= lag(a8) over s then lag(aq8) over s else 0 end) end as ofi8, (bq8 + aq8) // 2 as depth8
  from tops window s as (partition by coin, ts {DAY} order by ts)),
w as (select coin, ts, cast(sum(ofi8) over r as bigint) * count(*) over r / nullif(cast(sum(depth8) over r as bigint), 0) as norm, (bq8 - aq8) / (bq8 + aq8) as imb from e window r as (partition by coin, ts {DAY} order by ts rows 9 preceding))
select coin, ts, 'ofi' as thesis, case when norm > 0 then 1 else -1 end as side from w where abs(norm) >= 2 union all select coin, ts, 'imbalance', case when imb > 0 then 1 else -1 end from w where abs(imb) >= 0.5""")
def thesis_signals(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the order-flow and the book-imbalance thesis, at thresholds 2 and 0.5."""
    tops = flow.top_of_book(snapshots(spark, d), "coin")
    o = flow.order_flow_imbalance(tops, "coin", 10).where(F.abs("ofi_norm") >= 2).select("coin", "ts", F.lit("ofi").alias("thesis"), F.when(F.col("ofi_norm") > 0, 1).otherwise(-1).alias("side"))
    b = tops.withColumn("imb", M.imbalance(F.col("bq8"), F.col("aq8"))).where(F.abs("imb") >= 0.5).select("coin", "ts", F.lit("imbalance"), F.when(F.col("imb") > 0, 1).otherwise(-1))
    return o.union(b)


@query()
def sweep_by_regime(spark: SparkSession, d: str) -> DataFrame:
    """The flow thesis' trips by configuration and the efficiency regime as of their entry."""
    trips = studies.sim_flow_thesis(spark, d).join(instruments(spark, d), "coin")
    t = trips.select("sym", F.col("open_ts").alias("ts"), F.xxhash64("config_id", "close_ts", "open_ts").alias("seq"), "config_id", "pnl8")
    r = flow.efficiency(flow.sampled(trades(spark, d), "sym", 60_000, F.col("p8")), "sym", 10).select("sym", "ts", F.lit(0).cast("bigint").alias("seq"), "regime")
    x = asof_backward(t, r, ["sym"], "ts", "seq", ["regime"])
    return x.groupBy("config_id", "regime").agg(F.count("*").alias("trips"), F.sum("pnl8").alias("pnl8"), F.avg((F.col("pnl8") > 0).cast("double")).alias("win_rate"))


@query(f"""with {PROFILE.replace(DAY, "// 3600000")}, mx as (select sym, day, low8, max(vol8) as m8, max(bin) filter (vol8 = mm) as poc from (select *, max(vol8) over (partition by sym, day) as mm from pb) group by all),
nd as (select pb.sym, pb.day, pb.low8, bin, vol8, poc from pb join mx on pb.sym = mx.sym and pb.day = mx.day where vol8 > 0 and vol8 < m8 * 0.2),
nx as (select sym, ts, p8, seq, ts // 3600000 as day from tr),
hit as (select nd.sym, nd.day, bin, poc, nd.low8, arg_min(p8, (ts, seq)) as p8, min(ts) as ts from nd join nx on nx.sym = nd.sym and nx.day = nd.day + 1 and nx.p8 >= nd.low8 and (nx.p8 - nd.low8) // greatest(nd.low8 // 2000, 1) = nd.bin group by all)
select sym, day as hour, bin, poc, ts, p8 from hit""")
def lvn_scan(spark: SparkSession, d: str) -> DataFrame:
    """The low-volume nodes of each hour and the first trade of the next hour that enters each: an equi join on the bin, not a search."""
    b = _bins(spark, d, 3_600_000)
    poc = profile.value_area(b, ["sym", "day"]).select("sym", "day", "poc")
    nodes = profile.low_volume_nodes(b, ["sym", "day"], 0.2).join(poc, ["sym", "day"])
    low = b.select("sym", "day", "low8").distinct()
    nxt = trades(spark, d).withColumn("day", F.call_function("div", F.col("ts"), F.lit(3_600_000).cast("bigint")) - 1).join(low, ["sym", "day"]).where("p8 >= low8")
    width = F.greatest(F.call_function("div", F.col("low8"), F.lit(2000).cast("bigint")), F.lit(1)).cast("bigint")
    nxt = nxt.withColumn("bin", F.call_function("div", F.col("p8") - F.col("low8"), width)).select("sym", "day", "bin", "ts", "seq", "p8")
    return nodes.join(nxt, ["sym", "day", "bin"]).groupBy("sym", "day", "bin", "poc").agg(F.min("ts").alias("ts"), F.min_by("p8", F.struct("ts", "seq")).alias("p8")).withColumnRenamed("day", "hour")


@query()
def lvn_outcome(spark: SparkSession, d: str) -> DataFrame:
    """After a trade enters a low-volume node: whether the price reaches 20 bps towards the hour's fullest bin first, or 20 bps away, within half an hour."""
    h = lvn_scan(spark, d)
    side = F.when(F.col("poc") > F.col("bin"), 1).otherwise(-1)
    e = h.select(F.concat_ws("@", "sym", "hour", "bin").alias("id"), F.col("sym").alias("key"), "ts", side.alias("side"), "p8")
    s = flow.sampled(trades(spark, d), "sym", 10_000, F.col("p8")).select(F.col("sym").alias("key"), "ts", F.col("v").alias("v8"))
    from tapeloom.operators.studies import first_touch, paths

    return first_touch(paths(e, s, 1_800_000), 0, 1_800_000, 20.0, 20.0, fade=False)


@query()
def maker_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per coin of the quoter: fills, quotes, fills per 100 quotes (0 to 100), largest inventory, net, expectancy per fill."""
    f = engine.maker_quoter(spark, d)
    g = f.groupBy("coin").agg(F.max("fills").alias("fills"), F.max("quotes").alias("quotes"), F.max(F.abs("position8")).alias("inventory8"), F.max_by("net8", "ts").alias("net8"))
    share = F.least(F.greatest(M.ratio(F.col("fills") * 100.0, F.col("quotes")), F.lit(0.0)), F.lit(100.0))
    return g.withColumns({"fill_rate": F.round(share, 2), "expectancy8": F.round(M.ratio(F.col("net8"), F.col("fills")), 2)})


@query(f"""with {TB}, n as (select *, case k when 1 then 25.0 when 2 then -20.0 else m end as x from bt) select sym, count(*) as n, count(*) filter (k = 1) as targets, count(*) filter (k = 2) as stops, count(*) filter (k = 3) as expiries,
  cast(sum(exit_no - no) as bigint) as held, round(sum(x), 4) + 0.0 as gross_bps, round(sum(x - 5), 4) + 0.0 as net_bps, round(min(x), 4) + 0.0 as worst_bps from n group by sym""")
def trade_log(spark: SparkSession, d: str) -> DataFrame:
    """The barrier trades' counts by barrier, bars held, gross and net of 5 bps."""
    x = studies._barriers(spark, d)
    n = lambda b: F.count_if(F.col("barrier") == b)
    g = x.groupBy("sym").agg(F.count("*").alias("n"), n("target").alias("targets"), n("stop").alias("stops"), n("time").alias("expiries"), F.sum(F.col("exit_no") - F.col("no")).alias("held"), F.sum("gross_bps").alias("gross_bps"), F.sum(F.col("gross_bps") - 5).alias("net_bps"), F.min("gross_bps").alias("worst_bps"))
    return rounded(g, 4, "gross_bps", "net_bps", "worst_bps")


@query(f"""with recursive {studies.CASC} select case when grouping(key) = 0 then key end as key, case when grouping(day) = 0 then day end as day, count(*) as n, round(avg(oi_drop), 7) + 0.0 as oi_drop, round(avg(abs(move_bps)), 4) + 0.0 as move_bps, round(avg((side > 0)::int::double), 6) + 0.0 as up
from ca group by grouping sets ((key, day), (key), ())""")
def cascade_report(spark: SparkSession, d: str) -> DataFrame:
    """Cascades pooled and per day in one pass: counts, drops, moves."""
    c = studies.cascade_scan(spark, d).withColumn("day", day_no())
    g = c.groupingSets([["key", "day"], ["key"], []], "key", "day").agg(F.count("*").alias("n"), F.avg("oi_drop").alias("oi_drop"), F.avg(F.abs("move_bps")).alias("move_bps"), F.avg((F.col("side") > 0).cast("double")).alias("up"))
    return g.withColumns({"oi_drop": F.round("oi_drop", 7) + F.lit(0.0), "move_bps": F.round("move_bps", 4) + F.lit(0.0), "up": F.round("up", 6) + F.lit(0.0)})


@query(f"""with x as ({SQL_DISLOC}) select key, count(*) as n, avg((end_ts is not null)::int::double) as closed, median(end_ts - fired_ts) as median_ms, round(avg(peak), 4) + 0.0 as peak, avg((side > 0)::int::double) as above from x group by key""")
def dislocation_report(spark: SparkSession, d: str) -> DataFrame:
    """Per coin: dislocations, those that closed within the day, median time to close, peaks."""
    x = studies.dislocation_scan(spark, d)
    took = F.col("end_ts") - F.col("fired_ts")
    return x.groupBy("key").agg(F.count("*").alias("n"), F.avg(F.col("end_ts").isNotNull().cast("double")).alias("closed"), F.percentile(took, 0.5).alias("median_ms"), (F.round(F.avg("peak"), 4) + F.lit(0.0)).alias("peak"), F.avg((F.col("side") > 0).cast("double")).alias("above"))


@query()
def paper_gate(spark: SparkSession, d: str) -> DataFrame:
    """The paper account's end with the t-statistic of its trips; passed with a profit and no ruin."""
    t = sim.simulate(studies._sim_events(spark, d), "coin", studies.GRID[:1], studies._flow_signal).withColumn("ret", F.col("pnl8") / F.col("notional8"))
    a = sim.paper_accounts(t, "coin", "close_ts", "ret")
    m = stats.moments(t, ["coin"], "ret").select("coin", "n", "mean", "t")
    return a.join(m, "coin").withColumn("passed", (F.col("final") > 500) & ~F.col("ruined"))


@query(f"""with {BARS5}, x as (select sym, ts, trades, vol8, buy8, 2 * buy8 - vol8 as d8 from tb)
select sym, ts, d8, cast(round((trades * (1.0 + d8 / vol8)) / 2) as bigint) as buys_est, trades - cast(round((trades * (1.0 + d8 / vol8)) / 2) as bigint) as sells_est from x""")
def trade_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Buys and sells of a bar estimated from its volume delta, for bars whose trades are missing."""
    from tapeloom.operators.bars import time_bars

    b = time_bars(trades(spark, d), "sym", 300_000)
    delta = 2 * F.col("buy8") - F.col("vol8")
    est = F.round(F.col("trades") * (1.0 + delta / F.col("vol8")) / 2).cast("bigint")
    return b.select("sym", "ts", delta.alias("d8"), est.alias("buys_est"), (F.col("trades") - est).alias("sells_est"))


@query(f"""with {TRADES}, g as (select sym, ts {DAY} as day, cast(sum(sgn * q8) as bigint) as net8 from tr group by all) select day, arg_max(sym, (net8, sym)) as sym, max(net8) as net8 from g group by day""")
def best_cell(spark: SparkSession, d: str) -> DataFrame:
    """The symbol with the largest net flow of each day, of equal ones the last by name."""
    g = trades(spark, d).groupBy("sym", day_no().alias("day")).agg(F.sum(F.col("sgn") * F.col("q8")).alias("net8"))
    return g.groupBy("day").agg(F.max_by("sym", F.struct("net8", "sym")).alias("sym"), F.max("net8").alias("net8"))


@query("""select cast(row_number() over (order by tp, sl, hold) - 1 as integer) as id, tp, sl, hold from (values (0), (10), (40)) a(tp), (values (0), (20), (60)) b(sl), (values (12), (48)) c(hold) where not (tp > 0 and sl > 0 and tp < 0.3 * sl)""")
def barrier_grid(spark: SparkSession, d: str) -> DataFrame:
    """Targets x stops x holds without targets under three tenths of their stop."""
    ax = lambda n, v: spark.createDataFrame([(x,) for x in v], f"{n} int")
    g = ax("tp", [0, 10, 40]).join(F.broadcast(ax("sl", [0, 20, 60])), how="cross").join(F.broadcast(ax("hold", [12, 48])), how="cross")
    g = g.where(~((F.col("tp") > 0) & (F.col("sl") > 0) & (F.col("tp") < 0.3 * F.col("sl"))))
    return g.select((F.row_number().over(Window.orderBy("tp", "sl", "hold")) - 1).alias("id"), "tp", "sl", "hold")


@query(f"""with {BARS5}, {FUNDING}, {OI}, b as (select coin, tb.ts, close8 from tb join instrument on symbol = sym), f as (select b.*, rate, mark, idx from b asof left join fu on b.coin = fu.coin and b.ts >= fu.ts),
o as (select f.*, oi8 from f asof left join op on f.coin = op.coin and f.ts >= op.ts), l as (select *, lag(oi8) over (partition by coin, ts {DAY} order by ts) as l8 from o)
select coin, ts, close8, rate, case when idx > 0 then round((mark / idx - 1) * 1e4, 5) + 0.0 end as mark_index_bps, oi8, case when l8 > 0 then round((oi8 / l8 - 1) * 100, 7) + 0.0 end as oi_change from l""")
def funding_oi_bars(spark: SparkSession, d: str) -> DataFrame:
    """Five-minute bars with funding, mark to index and open interest as of them and the change of open interest."""
    from tapeloom.operators.bars import time_bars

    b = time_bars(trades(spark, d), "sym", 300_000).join(instruments(spark, d), "sym").select("coin", "ts", F.lit(0).cast("bigint").alias("seq"), "close8", "vol8")
    x = asof_backward(b, funding(spark, d), ["coin"], "ts", "seq", ["rate", "mark", "idx"])
    x = asof_backward(x, open_interest(spark, d), ["coin"], "ts", "seq", ["oi8"])
    before = F.lag("oi8").over(flow.session("coin", "ts"))
    return x.select("coin", "ts", "close8", "rate", F.when(F.col("idx") > 0, F.round((F.col("mark") / F.col("idx") - 1) * 1e4, 5) + F.lit(0.0)).alias("mark_index_bps"), "oi8", F.when(before > 0, F.round((F.col("oi8") / before - 1) * 100, 7) + F.lit(0.0)).alias("oi_change"))
