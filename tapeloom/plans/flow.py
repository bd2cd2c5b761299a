"""Queries over tapes, quotes, bars and profiles, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.clean import DAY_MS
from tapeloom.functions.market import TAIL_B, TAIL_P
from tapeloom.operators import bars, book, flow, profile
from tapeloom.operators.asof import asof_backward, asof_forward, interval_bins, nearest_horizon
from tapeloom.plans.base import DELTAS, FUNDING, OI, QUOTES, SNAPS, TRADES, deltas, funding, instruments, open_interest, quotes, snapshots, trades

Q: dict = {}
SQL: dict[str, str] = {}
LARGE8 = 500_000_000
DAY = "// 86400000"


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    # + 0.0 makes -0.0 plain 0.0, here and in the SQL
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


@query(f"""with {TRADES}, g as (
  select sym, ts // 3600000 * 3600000 as period_ms, cast(coalesce(sum(q8) filter (sgn > 0), 0) as bigint) as buy8, cast(coalesce(sum(q8) filter (sgn < 0), 0) as bigint) as sell8,
         count(*) filter (sgn > 0) as n_buy, count(*) filter (sgn < 0) as n_sell from tr group by all)
select *, buy8 - sell8 as delta8, case when buy8 + sell8 <> 0 then buy8 / (buy8 + sell8) else 0.5 end as cvd_ratio, (n_buy - n_sell) / (n_buy + n_sell) as count_imbalance from g""")
def flow_cvd_hourly(spark: SparkSession, d: str) -> DataFrame:
    return flow.cvd(trades(spark, d), "sym", 3_600_000)


@query(f"""with {TRADES}, g as (
  select sym, ts // 300000 * 300000 as period_ms, count(*) as trades, count(*) filter (sgn > 0) as buys,
    count(*) filter (q8 >= {LARGE8} and sgn > 0) as large_buys, count(*) filter (q8 >= {LARGE8} and sgn < 0) as large_sells,
    cast(coalesce(sum(q8) filter (q8 >= {LARGE8} and sgn > 0), 0) as bigint) as large_buy8, cast(coalesce(sum(q8) filter (q8 >= {LARGE8} and sgn < 0), 0) as bigint) as large_sell8,
    max(q8) as max8, cast(sum(q8) as bigint) as vol8 from tr group by all)
select *, buys / trades as aggressor_ratio, case when large_buy8 + large_sell8 <> 0 then large_buy8 / (large_buy8 + large_sell8) else 0.5 end as large_ratio,
       least(20.0, trades * 1e8 / vol8) as intensity from g""")
def flow_trade_bar_stats(spark: SparkSession, d: str) -> DataFrame:
    return flow.trade_stats(trades(spark, d), "sym", 300_000, LARGE8)


@query(f"""with {TRADES}
select sym, seq, ts, cast(sum(sgn * q8) over w as bigint) as net8, cast(sum(q8) over w as bigint) as gross8,
       coalesce(cast(sum(sgn * q8) over w as bigint) / nullif(cast(sum(q8) over w as bigint), 0), 0.0) as cvd_ratio
from tr window w as (partition by sym, ts {DAY} order by ts, seq rows 19 preceding)""")
def flow_cvd_rolling(spark: SparkSession, d: str) -> DataFrame:
    return flow.rolling_cvd(trades(spark, d), "sym", 20)


TOPS = f"""{SNAPS}, tops as (
  select coin, ts, max(p8) filter (side = 'bid') as b8, arg_max(q8, p8) filter (side = 'bid') as bq8, min(p8) filter (side = 'ask') as a8, arg_min(q8, p8) filter (side = 'ask') as aq8
  from sl group by coin, ts having b8 is not null and a8 is not null)"""


@query(f"""with {TOPS}, e as (
  select *, case when lag(b8) over s is null then 0 else
      (case when b8 >= lag(b8) over s then bq8 else 0 end) - (case when b8 <= lag(b8) over s then lag(bq8) over s else 0 end)
    - (case when a8 <= lag(a8) over s then aq8 else 0 end) + (case when a8 >= lag(a8) over s then lag(aq8) over s else 0 end) end as ofi8, (bq8 + aq8) // 2 as depth8
  from tops window s as (partition by coin, ts {DAY} order by ts)),
w as (select coin, ts, ofi8, cast(sum(ofi8) over r as bigint) as ofi_sum8, cast(sum(depth8) over r as bigint) as dep, count(*) over r as k
  from e window r as (partition by coin, ts {DAY} order by ts rows 9 preceding))
select coin, ts, ofi8, ofi_sum8, case when dep <> 0 then ofi_sum8 * k / dep else 0.0 end as ofi_norm from w""")
def flow_ofi_rolling(spark: SparkSession, d: str) -> DataFrame:
    return flow.order_flow_imbalance(flow.top_of_book(snapshots(spark, d), "coin"), "coin", 10)


def _quoted_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades with the last quote of their coin at or before them."""
    t = trades(spark, d).join(instruments(spark, d), "sym")
    return asof_backward(t, quotes(spark, d), ["coin"], "ts", "seq", ["b8", "a8"])


QUOTED = f"""{TRADES}, {QUOTES}, tc as (select tr.*, coin from tr join instrument on symbol = sym),
  q1 as (select * from qt qualify row_number() over (partition by coin, ts order by seq desc) = 1),
  qd as (select tc.*, q1.b8, q1.a8 from tc asof left join q1 on tc.coin = q1.coin and tc.ts >= q1.ts)"""


@query(f"""with {QUOTED} select coin, sym, seq, ts, p8, b8, a8 from qd""")
def asof_backward_quotes(spark: SparkSession, d: str) -> DataFrame:
    return _quoted_trades(spark, d).select("coin", "sym", "seq", "ts", "p8", "b8", "a8")


@query(f"""with {QUOTED}
select coin, seq, ts, cast(coalesce(sum(q8) filter (sgn < 0 and p8 <= b8) over w, 0) as bigint) as sell_at_bid8, cast(coalesce(sum(q8) filter (sgn > 0 and p8 >= a8) over w, 0) as bigint) as buy_at_ask8,
       coalesce(b8 >= first_value(b8) over w, false) as bid_held, coalesce(a8 <= first_value(a8) over w, false) as ask_held
from qd window w as (partition by coin, ts {DAY} order by ts, seq rows 19 preceding)""")
def flow_absorption(spark: SparkSession, d: str) -> DataFrame:
    return flow.absorption(_quoted_trades(spark, d), "coin", 20)


SAMPLED = f"""{TRADES}, sm as (select sym, ts // 60000 * 60000 as ts, arg_min(p8, (ts, seq)) as v from tr group by 1, ts // 60000 * 60000)"""


@query(f"""with {SAMPLED}, x as (
  select sym, ts, v, abs(v - lag(v) over s) as step, lag(v, 10) over s as far from sm window s as (partition by sym, ts {DAY} order by ts)),
y as (select sym, ts, v, case when far is not null then coalesce(cast(abs(v - far) as double) / nullif(cast(sum(step) over (partition by sym, ts {DAY} order by ts rows 9 preceding) as double), 0), 0.0) end as er from x)
select *, case when er is null then 'warming' when er >= 0.6 then 'trending' when er <= 0.3 then 'sideways' else 'neutral' end as regime from y""")
def flow_efficiency_regime(spark: SparkSession, d: str) -> DataFrame:
    return flow.efficiency(flow.sampled(trades(spark, d), "sym", 60_000, F.col("p8")), "sym", 10)


def _basis_samples(spark: SparkSession, d: str) -> DataFrame:
    """Per minute the first quote mid v and the first trade price r of each coin, where both are there."""
    q = flow.sampled(quotes(spark, d), "coin", 60_000, (F.col("b8") + F.col("a8")) / 2)
    t = flow.sampled(trades(spark, d).join(instruments(spark, d), "sym"), "coin", 60_000, F.col("p8")).withColumnRenamed("v", "r")
    return q.join(t, ["coin", "ts"])


BASIS = f"""{TRADES}, {QUOTES}, qs as (select coin, ts // 60000 * 60000 as ts, arg_min((b8 + a8) / 2, (ts, seq)) as v from qt group by 1, ts // 60000 * 60000),
  rs as (select coin, tr.ts // 60000 * 60000 as ts, arg_min(p8, (tr.ts, seq)) as r from tr join instrument on symbol = sym group by 1, tr.ts // 60000 * 60000),
  bs as (select coin, ts, v, r, (v / r - 1) * 1e4 as gap from qs join rs using (coin, ts)),
  dv as (select coin, ts, gap, avg(gap) over w as base, stddev_pop(gap) over w as sd, case when count(gap) over w >= 20 then gap - avg(gap) over w end as dev
    from bs window w as (partition by coin, ts {DAY} order by ts rows between 20 preceding and 1 preceding))"""


@query(f"""with {BASIS}
select coin, ts, round(gap, 4) + 0.0 as gap, round(base, 4) + 0.0 as base, round(sd, 4) + 0.0 as sd, round(dev, 4) + 0.0 as dev, round(dev - lag(dev, 3) over (partition by coin, ts {DAY} order by ts), 4) + 0.0 as velocity from dv""")
def basis_gap_baseline(spark: SparkSession, d: str) -> DataFrame:
    return rounded(flow.basis(_basis_samples(spark, d), "coin", 20, 3), 4, "gap", "base", "sd", "dev", "velocity")


@query(f"""with {BASIS}, f as (select *, dev / nullif(sd, 0) as z, dev - lag(dev, 3) over (partition by coin, ts {DAY} order by ts) as vel from dv)
select coin, ts, case when dev > 0 then -1 else 1 end as side from f where abs(dev) >= 3 and abs(z) >= 2 and vel * dev <= 0""")
def basis_filters(spark: SparkSession, d: str) -> DataFrame:
    """Entries against a deviation of at least 3 bps and 2 deviations that has stopped growing."""
    b = flow.basis(_basis_samples(spark, d), "coin", 20, 3)
    z = F.when(F.col("sd") != 0, F.col("dev") / F.col("sd"))
    return b.where((F.abs("dev") >= 3) & (F.abs(z) >= 2) & (F.col("velocity") * F.col("dev") <= 0)).select("coin", "ts", F.when(F.col("dev") > 0, -1).otherwise(1).alias("side"))


@query(f"""with {TRADES} select sym, seq, ts, cast(sum(sgn * q8) over w as bigint) as flow8, count(*) over w as n
from tr window w as (partition by sym, ts {DAY} order by ts range between 600000 preceding and current row)""")
def flow_range_signed(spark: SparkSession, d: str) -> DataFrame:
    return flow.trailing_flow(trades(spark, d), "sym", 600_000)


@query(f"""with {OI}, x as (select coin, ts, oi8, first_value(oi8) over w as o0, min(ts) over w as t0 from op window w as (partition by coin, ts {DAY} order by ts range between 1800000 preceding and current row))
select coin, ts, oi8 as v, case when ts - t0 >= 900000 then o0 end as "then" from x""")
def oi_drop_detect(spark: SparkSession, d: str) -> DataFrame:
    return flow.trailing_change(open_interest(spark, d).withColumnRenamed("oi8", "v"), "coin", 1_800_000)


@query(f"""with {SAMPLED}, x as (select sym, ts, v, max(v) over w as hi, min(v) over w as lo, min(ts) over w as t0 from sm window w as (partition by sym, ts {DAY} order by ts range between 3600000 preceding and 1 preceding))
select sym, ts, v, hi, lo, case when v >= hi * (1 + 0.001) then 1 when v <= lo * (1 - 0.001) then -1 else 0 end as side from x where ts - t0 >= 1800000""")
def range_sweep_detect(spark: SparkSession, d: str) -> DataFrame:
    return flow.range_breaks(flow.sampled(trades(spark, d), "sym", 60_000, F.col("p8")), "sym", 3_600_000, 0.001)


@query(f"""with {SAMPLED}, x as (select sym, ts, case when lag(v) over s > 0 then (v / lag(v) over s - 1) * 1e4 end as ret from sm window s as (partition by sym, ts {DAY} order by ts)),
y as (select sym, ts, list(ret) over (partition by sym, ts {DAY} order by ts rows 29 preceding) as r from x where ret is not null),
m as (select sym, ts, r, len(r) as k, list_avg(r) as mean from y where len(r) >= 2),
v as (select sym, ts, sqrt(list_sum(list_transform(r, lambda a: (a - mean) ** 2)) / (k - 1)) as sd, list_sum(list_transform(range(2, k + 1), lambda i: (r[i] - mean) * (r[i - 1] - mean))) as num, list_sum(list_transform(r[2:], lambda a: (a - mean) ** 2)) as den from m)
select sym, ts, round(case when den > 1e-12 then num / den else 0 end, 6) + 0.0 as rho, round(sd, 6) + 0.0 as sd, case when sd > 20 then 'volatile' when den > 1e-12 and num / den > 0.2 then 'trending' else 'ranging' end as regime from v""")
def flow_autocorrelation_regime(spark: SparkSession, d: str) -> DataFrame:
    return rounded(flow.autocorrelation_regime(flow.sampled(trades(spark, d), "sym", 60_000, F.col("p8")), "sym", 30, 20.0, 0.2), 6, "rho", "sd")


@query(f"""with {FUNDING}, {OI}, o1 as (select coin, ts, oi8 from op), first_ as (select coin, arg_min(oi8, ts) as f8 from op group by coin),
x as (select fu.coin, fu.seq, fu.ts, rate, oi8 from fu asof left join o1 on fu.coin = o1.coin and fu.ts >= o1.ts)
select x.coin, seq, ts, rate, coalesce(oi8, f8) as oi8 from x left join first_ using (coin)""")
def asof_clip(spark: SparkSession, d: str) -> DataFrame:
    """Funding readings with the open interest as of them; those before the first get the first."""
    f = funding(spark, d).select("coin", "seq", "ts", "rate")
    return asof_backward(f, open_interest(spark, d), ["coin"], "ts", "seq", ["oi8"], clip=True)


BARS5 = f"""{TRADES}, tb as (
  select sym, ts // 300000 * 300000 as ts, min(ts) as first_ts, max(ts) as last_ts, count(*) as trades, cast(sum(q8) as bigint) as vol8, cast(sum(case when sgn > 0 then q8 else 0 end) as bigint) as buy8,
    arg_min(p8, (ts, seq)) as open8, max(p8) as high8, min(p8) as low8, arg_max(p8, (ts, seq)) as close8 from tr group by sym, tr.ts // 300000)"""


@query(f"with {BARS5} select * from tb")
def bars_time(spark: SparkSession, d: str) -> DataFrame:
    return bars.time_bars(trades(spark, d), "sym", 300_000)


@query(f"""with {TRADES}, c as (
  select *, ts {DAY} * 86400000 as day, (cast(sum(q8) over (partition by sym, ts {DAY} order by ts, seq rows unbounded preceding) as bigint) - 1) // 200000000000 as bar_no from tr)
select sym, day, bar_no, min(ts) as first_ts, max(ts) as ts, count(*) as trades, cast(sum(q8) as bigint) as vol8, cast(sum(case when sgn > 0 then q8 else 0 end) as bigint) as buy8,
  arg_min(p8, (ts, seq)) as open8, max(p8) as high8, min(p8) as low8, arg_max(p8, (ts, seq)) as close8 from c group by sym, day, bar_no""")
def bars_volume(spark: SparkSession, d: str) -> DataFrame:
    return bars.volume_bars(trades(spark, d), "sym", 200_000_000_000)


@query(f"""with {BARS5}, c as (select sym, ts, close8, cast(sum(2 * buy8 - vol8) over (partition by sym, ts {DAY} order by ts) as bigint) as cvd8 from tb),
m as (select *, coalesce(cvd8 - lag(cvd8) over s, 0) as momentum8, lag(cvd8, 2) over s as c2 from c window s as (partition by sym, ts {DAY} order by ts))
select sym, ts, close8, cvd8, momentum8, case when c2 is not null then momentum8 - lag(momentum8) over (partition by sym, ts {DAY} order by ts) else 0 end as acceleration8 from m""")
def bars_changes(spark: SparkSession, d: str) -> DataFrame:
    return bars.bar_changes(bars.time_bars(trades(spark, d), "sym", 300_000), "sym").select("sym", "ts", "close8", "cvd8", "momentum8", "acceleration8")


def _horizon_sql(h: int, tie: str) -> str:
    return f"""(select arg_min(b.close8, (abs(b.ts - a.ts - {h}), {tie}b.ts)) from tb b where b.sym = a.sym and b.ts > a.ts)"""


@query(f"with {BARS5} select sym, ts, close8, {_horizon_sql(900000, '')} as later8, (({_horizon_sql(900000, '')}) / close8 - 1) * 1e4 as fwd_15m_bps from tb a")
def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    """Return to the bar nearest to 15 minutes later; equal distance goes to the earlier bar, past the end to the last."""
    b = bars.time_bars(trades(spark, d), "sym", 300_000).select("sym", "ts", "close8").withColumn("no", F.col("ts"))
    r = nearest_horizon(b, ["sym"], "ts", "no", "close8", 900_000, "later8")
    return r.select("sym", "ts", "close8", "later8", ((F.col("later8") / F.col("close8") - 1) * 1e4).alias("fwd_15m_bps"))


@query(f"with {BARS5} select sym, ts, close8, coalesce((({_horizon_sql(3750000, '-')}) / close8 - 1) * 1e4, 0.0) as fwd_bps from tb a")
def forward_returns_stitched(spark: SparkSession, d: str) -> DataFrame:
    """The same with a horizon between bars; equal distance goes to the later bar, 0 at the end."""
    b = bars.time_bars(trades(spark, d), "sym", 300_000).select("sym", "ts", "close8").withColumn("no", F.col("ts"))
    r = nearest_horizon(b, ["sym"], "ts", "no", "close8", 3_750_000, "later8", later_on_tie=True)
    return r.select("sym", "ts", "close8", F.coalesce((F.col("later8") / F.col("close8") - 1) * 1e4, F.lit(0.0)).alias("fwd_bps"))


@query(f"""with {BARS5}, tk as (select sym, ts, q8, sgn, seq from tr), e as (select sym, ts as bar from tb),
b as (select tk.sym, tk.q8, tk.sgn, e.bar from tk asof join e on tk.sym = e.sym and tk.ts <= e.bar)
select sym, bar, cast(sum(case when sgn > 0 then q8 else 0 end) as bigint) as buy8, cast(sum(case when sgn < 0 then q8 else 0 end) as bigint) as sell8, count(*) as n from b group by all""")
def interval_bins_liq(spark: SparkSession, d: str) -> DataFrame:
    """Ticks by the bar in (previous bar, bar]."""
    return _binned(spark, d, "right")


@query(f"""with {BARS5}, tk as (select sym, ts, q8, sgn, seq from tr), e as (select sym, ts as bar from tb),
b as (select tk.sym, tk.q8, tk.sgn, e.bar from tk asof join e on tk.sym = e.sym and tk.ts < e.bar)
select sym, bar, cast(sum(case when sgn > 0 then q8 else 0 end) as bigint) as buy8, cast(sum(case when sgn < 0 then q8 else 0 end) as bigint) as sell8, count(*) as n from b group by all""")
def interval_bins_trades(spark: SparkSession, d: str) -> DataFrame:
    """Ticks by the bar in [previous bar, bar); those at or after the last bar are dropped."""
    return _binned(spark, d, "left")


def _binned(spark: SparkSession, d: str, closed: str) -> DataFrame:
    t = trades(spark, d)
    b = bars.time_bars(t, "sym", 300_000).select("sym", "ts", F.col("ts").alias("bar"))
    x = interval_bins(b, t.select("sym", "ts", "seq", "q8", "sgn"), ["sym"], "ts", "seq", "bar", closed)
    return x.groupBy("sym", "bar").agg(F.sum(F.when(F.col("sgn") > 0, F.col("q8")).otherwise(0)).alias("buy8"), F.sum(F.when(F.col("sgn") < 0, F.col("q8")).otherwise(0)).alias("sell8"), F.count("*").alias("n"))


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    b = bars.time_bars(trades(spark, d), "sym", 300_000).join(instruments(spark, d), "sym").select("coin", "ts", F.lit(0).cast("bigint").alias("seq"), "vol8", "buy8", "close8")
    x = asof_backward(b, funding(spark, d), ["coin"], "ts", "seq", ["rate"])
    return asof_backward(x, open_interest(spark, d), ["coin"], "ts", "seq", ["oi8"])


@query(f"""with {BARS5}, {FUNDING}, {OI}, b as (select coin, tb.ts, vol8, buy8 from tb join instrument on symbol = sym),
f as (select b.*, cast(round(rate * 1e12) as bigint) as rate12 from b asof left join fu on b.coin = fu.coin and b.ts >= fu.ts), o as (select f.*, oi8 from f asof left join op on f.coin = op.coin and f.ts >= op.ts)
select coin, ts, {", ".join(f'''cast(sum(vol8) over w{n} as bigint) as vol8_sum_{n}, cast(sum(buy8) over w{n} as bigint) as buy8_sum_{n}, avg(rate12) over w{n} as rate12_avg_{n},
  round(case when lag(oi8, {n}) over s <> 0 then (oi8 / lag(oi8, {n}) over s - 1) * 100 end, 6) + 0.0 as oi8_change_{n}''' for n in (10, 25, 50, 100))}
from o window s as (partition by coin, ts {DAY} order by ts), {", ".join(f"w{n} as (partition by coin, ts {DAY} order by ts rows {n - 1} preceding)" for n in (10, 25, 50, 100))}""")
def bars_enriched_rolling(spark: SparkSession, d: str) -> DataFrame:
    r = bars.rolling_enrichment(_enriched(spark, d).withColumn("rate12", F.round(F.col("rate") * 1e12).cast("bigint")), "coin", (10, 25, 50, 100), ["vol8", "buy8"], ["rate12"], ["oi8"])
    return r.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in r.columns if "change" in c})


PROFILE = f"""{TRADES}, pl as (select sym, ts {DAY} as day, min(p8) as low8, max(p8) as high8 from tr group by all),
  pb as (select tr.sym, pl.day, low8, (p8 - low8) // greatest(low8 // 2000, 1) as bin, cast(coalesce(sum(q8) filter (sgn > 0), 0) as bigint) as buy8, cast(coalesce(sum(q8) filter (sgn < 0), 0) as bigint) as sell8, cast(sum(q8) as bigint) as vol8
    from tr join pl on tr.sym = pl.sym and tr.ts {DAY} = pl.day group by all)"""


def _bins(spark: SparkSession, d: str, period_ms: int = DAY_MS) -> DataFrame:
    """Bins of 5 bps of the day's (or other period's) lowest price."""
    t = trades(spark, d).withColumn("day", F.call_function("div", F.col("ts"), F.lit(period_ms).cast("bigint")))
    low = t.groupBy("sym", "day").agg(F.min("p8").alias("low8"))
    width = F.greatest(F.call_function("div", F.col("low8"), F.lit(2000).cast("bigint")), F.lit(1))
    b = t.join(low, ["sym", "day"]).withColumn("bin", F.call_function("div", F.col("p8") - F.col("low8"), width.cast("bigint")))
    buy = F.col("sgn") > 0
    return b.groupBy("sym", "day", "low8", "bin").agg(F.coalesce(F.sum(F.when(buy, F.col("q8"))), F.lit(0)).alias("buy8"), F.coalesce(F.sum(F.when(~buy, F.col("q8"))), F.lit(0)).alias("sell8"), F.sum("q8").alias("vol8"))


@query(f"""with {PROFILE} select sym, day, max(bin) filter (vol8 = m8) as poc, max(vol8) as poc8, cast(sum(vol8) as bigint) as total8, max(bin) + 1 as n_bins
from (select *, max(vol8) over (partition by sym, day) as m8 from pb) group by sym, day""")
def profile_hist_poc(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_area(_bins(spark, d), ["sym", "day"]).select("sym", "day", "poc", "poc8", "total8", "n_bins")


@query()
def profile_value_area(spark: SparkSession, d: str) -> DataFrame:
    return profile.value_area(_bins(spark, d), ["sym", "day"])


@query(f"""with {PROFILE}, t as (select *, cast(sum(vol8) over (partition by sym, day) as bigint) as total8 from pb)
select sym, day, max(bin) + 1 as n_bins, round(case when max(bin) > 0 then 1 + sum(vol8 / total8 * log2(vol8 / total8)) / log2(max(bin) + 1) else 0 end, 6) + 0.0 as concentration from t group by sym, day""")
def profile_entropy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.concentration(_bins(spark, d), ["sym", "day"]), 6, "concentration")


@query(f"""with {PROFILE} select sym, day, low8, bin, buy8, sell8, vol8 from (select *, max(vol8) over (partition by sym, day) as m8 from pb) where vol8 > 0 and vol8 < m8 * 0.2""")
def profile_lvn(spark: SparkSession, d: str) -> DataFrame:
    return profile.low_volume_nodes(_bins(spark, d), ["sym", "day"], 0.2)


@query(f"""with {TRADES}, sp as (select sym, ts {DAY} as day, min(p8) as low8, max(p8) as high8 from tr group by all)
select tr.sym, day, low8, high8, case when high8 > low8 then cast(least(23, floor((p8 - low8) * 24 / (high8 - low8))) as bigint) else 0 end as bin, cast(sum(q8) as bigint) as vol8
from tr join sp on tr.sym = sp.sym and tr.ts {DAY} = sp.day group by all""")
def profile_even_bins(spark: SparkSession, d: str) -> DataFrame:
    t = trades(spark, d).withColumn("day", F.call_function("div", F.col("ts"), F.lit(DAY_MS).cast("bigint")))
    return profile.even_bins(t, ["sym", "day"], 24)


def _book_bars(spark: SparkSession, d: str) -> DataFrame:
    """Depth snapshots with the trades of the last whole minute before them."""
    f = book.depth_features(book.depth_snapshot(snapshots(spark, d), "coin"), "coin")
    t = bars.time_bars(trades(spark, d), "sym", 60_000).join(instruments(spark, d), "sym").select("coin", (F.col("ts") + 60_000).alias("bar_ts"), "vol8", "buy8", "close8")
    probe = f.withColumn("seq", F.lit(0).cast("bigint"))
    return asof_backward(probe, t.withColumnRenamed("bar_ts", "ts").withColumn("seq", F.lit(0).cast("bigint")), ["coin"], "ts", "seq", ["vol8", "buy8", "close8"]).where("vol8 is not null").drop("seq")


DEPTH = f"""{SNAPS}, lv as (select *, row_number() over (partition by coin, ts, side order by case when side = 'bid' then -p8 else p8 end) as n from sl),
  dp as (select coin, ts, max(p8) filter (side = 'bid') as b8, min(p8) filter (side = 'ask') as a8, cast(coalesce(sum(q8) filter (side = 'bid'), 0) as bigint) as bid8, cast(coalesce(sum(q8) filter (side = 'ask'), 0) as bigint) as ask8,
    count(*) filter (side = 'bid') as bid_levels, count(*) filter (side = 'ask') as ask_levels,
    cast(coalesce(sum(q8) filter (side = 'bid' and n <= 5), 0) as bigint) as b5, cast(coalesce(sum(q8) filter (side = 'ask' and n <= 5), 0) as bigint) as a5,
    sum(q8 * pow(0.95, n - 1)) filter (side = 'bid' and n <= 20) as bw, sum(q8 * pow(0.95, n - 1)) filter (side = 'ask' and n <= 20) as aw,
    arg_max(q8, p8) filter (side = 'bid') as bq, arg_min(q8, p8) filter (side = 'ask') as aq
    from lv group by coin, ts having b8 < a8)"""


@query(f"""with {DEPTH} select coin, ts, (b8 + a8) / 2.0 as mid8, round((a8 - b8) / ((b8 + a8) / 2) * 1e4, 6) + 0.0 as spread_bps, round((bid8 - ask8) / (bid8 + ask8), 9) + 0.0 as full_imbalance, round((b5 - a5) / (b5 + a5), 9) + 0.0 as top5_imbalance,
  round((bw - aw) / (bw + aw), 9) + 0.0 as weighted_imbalance, round((b8::double * aq + a8::double * bq) / (bq + aq), -3) + 0.0 as micro8, bid_levels, ask_levels, bid8, ask8, round(b5 / bid8, 9) + 0.0 as bid_concentration, round(ask8 / bid8, 9) + 0.0 as cross_ask_ratio from dp""")
def bars_features(spark: SparkSession, d: str) -> DataFrame:
    f = book.depth_features(book.depth_snapshot(snapshots(spark, d), "coin"), "coin")
    r = lambda c, k: F.round(c, k).alias(c)
    return f.select("coin", "ts", "mid8", r("spread_bps", 6), r("full_imbalance", 9), r("top5_imbalance", 9), r("weighted_imbalance", 9), r("micro8", -3), "bid_levels", "ask_levels", "bid8", "ask8", r("bid_concentration", 9), r("cross_ask_ratio", 9))


@query()
def bars_depth_frame(spark: SparkSession, d: str) -> DataFrame:
    """All depth features of each snapshot."""
    return book.depth_features(book.depth_snapshot(snapshots(spark, d), "coin"), "coin", (1, 3, 5, 10, 20, 50, 100))


def _bar_features(spark: SparkSession, d: str) -> DataFrame:
    x = _book_bars(spark, d).withColumnsRenamed({"mean_bid_gap_bps": "bid_gap_bps", "mean_ask_gap_bps": "ask_gap_bps"})
    return bars.bar_features(x, "coin")


BARSIG = f"""{DEPTH}, {TRADES},
  gp as (select lv.coin, lv.ts, side, n, abs(p8 - lag(p8) over (partition by lv.coin, lv.ts, side order by n)) / ((b8 + a8) / 2.0) * 1e4 as g from lv join dp on lv.coin = dp.coin and lv.ts = dp.ts where n <= 20),
  gm as (select coin, ts, coalesce(avg(g) filter (side = 'bid'), 0.0) as bg, coalesce(avg(g) filter (side = 'ask'), 0.0) as ag from gp group by all),
  mb as (select coin, tr.ts // 60000 * 60000 + 60000 as bt, cast(sum(q8) as bigint) as vol8, cast(sum(case when sgn > 0 then q8 else 0 end) as bigint) as buy8, arg_max(p8, (tr.ts, seq)) as close8 from tr join instrument on symbol = sym group by coin, tr.ts // 60000),
  bx as (select dp.coin, dp.ts, b8, a8, bid8, ask8, (a8 - b8) / ((b8 + a8) / 2) * 1e4 as sp, bg, ag, vol8, buy8, close8 from dp join gm on dp.coin = gm.coin and dp.ts = gm.ts asof join mb on dp.coin = mb.coin and dp.ts >= mb.bt),
  bl as (select *, {", ".join(f"lag({c}) over (partition by coin, ts {DAY} order by ts) as l_{c}" for c in ("b8", "a8", "bid8", "ask8", "sp", "bg", "ag", "close8"))} from bx),
  br as (select *, (close8 / l_close8 - 1) * 1e4 as ret, 2 * buy8 - vol8 as dl from bl where l_b8 is not null),
  bs_ as (select coin, ts,
    ((case when b8 >= l_b8 then bid8 else 0 end) - (case when b8 <= l_b8 then l_bid8 else 0 end) - (case when a8 <= l_a8 then ask8 else 0 end) + (case when a8 >= l_a8 then l_ask8 else 0 end)) as ofi8, ret as ret_bps,
    case when b8 >= l_b8 then (vol8 - buy8) / vol8 * least(1 + abs(ret) / 100, 3.0) else 0.0 end as bid_absorption, case when a8 <= l_a8 then buy8 / vol8 * least(1 + abs(ret) / 100, 3.0) else 0.0 end as ask_absorption,
    {", ".join(f"""0.5 * (case when l_{d_} > 0 then least(greatest((l_{d_} - {d_}) / l_{d_}, 0.0), 1.0) else 0.0 end) + 0.3 * (case when l_{g_} > 0 then least(greatest(({g_} - l_{g_}) / l_{g_}, 0.0), 1.0) when {g_} > 0 then 1.0 else 0.0 end)
      + 0.2 * (case when l_sp > 0 then least(greatest((sp - l_sp) / l_sp, 0.0), 1.0) when sp > 0 then 1.0 else 0.0 end) as {n_}""" for d_, g_, n_ in (("bid8", "bg", "bid_vacuum"), ("ask8", "ag", "ask_vacuum")))},
    case when (ret >= 0) <> (dl >= 0) then abs(dl / vol8) else 0.0 end as divergence from br)"""
ROUND = {"ofi8": 0, "ret_bps": 5, "bid_absorption": 6, "ask_absorption": 6, "bid_vacuum": 6, "ask_vacuum": 6, "divergence": 6}
_W = f"over (partition by coin, ts {DAY} order by ts rows between 20 preceding and 1 preceding)"
ZSIG = f"""{BARSIG}, zs as (select coin, ts, {", ".join(f"case when count(*) {_W} >= 20 and stddev_pop({c}) {_W} > 1e-12 then ({c} - avg({c}) {_W}) / stddev_pop({c}) {_W} else 0.0 end as z_{c}" for c in ROUND)} from bs_),
  zu as (unpivot zs on columns('z_.*') into name kind value z)"""


@query(f"""with {BARSIG} select coin, ts, {", ".join(f"round({c}, {k}) + 0.0 as {c}" if k else c for c, k in ROUND.items())} from bs_""")
def bar_signals(spark: SparkSession, d: str) -> DataFrame:
    """Bar OFI, absorption, vacuum and divergence of each snapshot against the one before."""
    f = _bar_features(spark, d)
    return f.withColumns({c: F.round(c, k) + F.lit(0.0) for c, k in ROUND.items() if k})


FEATURES = ["ofi8", "ret_bps", "bid_absorption", "ask_absorption", "bid_vacuum", "ask_vacuum", "divergence"]


@query(f"""with {BARS5}, z as (select *, count(*) over w >= 20 as enough, avg(vol8) over w as m, stddev_pop(vol8) over w as s, avg(trades) over w as m2, stddev_pop(trades) over w as s2
  from tb window w as (partition by sym, ts {DAY} order by ts rows between 20 preceding and 1 preceding))
select sym, ts, round(case when enough and s > 1e-12 then (vol8 - m) / s else 0 end, 5) + 0.0 as z_vol8, round(case when enough and s2 > 1e-12 then (trades - m2) / s2 else 0 end, 5) + 0.0 as z_trades from z""")
def bar_zscores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bars.zscores(bars.time_bars(trades(spark, d), "sym", 300_000), "sym", ["vol8", "trades"], 20), 5, "z_vol8", "z_trades")


def _tail(z: str) -> str:
    t = f"(1 / (1 + {TAIL_P} * abs({z})))"
    poly = "0"
    for b in reversed(TAIL_B):
        poly = f"({poly} + {b}) * {t}"
    return f"least(1.0, 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * ({poly}))"


@query(f"""with {ZSIG}, t as (select *, {_tail("z")} as p from zu), r as (select *, row_number() over (partition by coin, ts order by p, kind, z) as i from t),
c as (select *, coalesce(max(case when p <= i / 7 * 0.05 then i end) over (partition by coin, ts), 0) as cut from r)
select coin, ts, kind, round(z, 4) + 0.0 as z, round(p, 5) + 0.0 as p, i <= cut as discovered from c""")
def bar_fdr(spark: SparkSession, d: str) -> DataFrame:
    z = bars.zscores(_bar_features(spark, d), "coin", FEATURES, 20)
    f = bars.false_discovery(z, "coin", [f"z_{c}" for c in FEATURES], 0.05)
    return f.withColumns({"z": F.round("z", 4) + F.lit(0.0), "p": F.round("p", 5) + F.lit(0.0)})


@query(f"""with {ZSIG}, a as (select *, case when kind in ('z_bid_vacuum', 'z_ask_vacuum') then 1.8 else 2.0 end as lim from zu) select coin, ts, kind, round(z, 4) + 0.0 as z, lim::double as "limit" from a where abs(z) >= lim""")
def bar_anomalies(spark: SparkSession, d: str) -> DataFrame:
    z = bars.zscores(_bar_features(spark, d), "coin", FEATURES, 20)
    return rounded(bars.z_anomalies(z, "coin", [f"z_{c}" for c in FEATURES], 2.0, {"z_bid_vacuum": 1.8, "z_ask_vacuum": 1.8}), 4, "z")


@query()
def bar_mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    return bars.mahalanobis(_bar_features(spark, d), "coin", FEATURES, 50)


@query(f"""with {BARS5}, g as (select sym, ts, vol8, quantile_cont(vol8::double, 0.5) over (partition by sym, ts {DAY} order by ts rows 19 preceding) as median from tb) select sym, ts, median from g""")
def bar_rolling_median(spark: SparkSession, d: str) -> DataFrame:
    return bars.rolling_mad(bars.time_bars(trades(spark, d), "sym", 300_000), "sym", "vol8", 20).select("sym", "ts", "median")


@query(f"""with {BARS5}, l as (select sym, ts, list(vol8::double) over (partition by sym, ts {DAY} order by ts rows 19 preceding) as a from tb), m as (select *, list_median(a) as median from l)
select sym, ts, median, list_median([abs(v - median) for v in a]) as mad from m""")
def bar_rolling_mad(spark: SparkSession, d: str) -> DataFrame:
    return bars.rolling_mad(bars.time_bars(trades(spark, d), "sym", 300_000), "sym", "vol8", 20)


@query(f"""with {SNAPS}, b as (select coin, ts, max(p8) filter (side = 'bid') as b8, min(p8) filter (side = 'ask') as a8 from sl group by all having b8 is not null and a8 is not null),
x as (select *, lag(b8) over s as lb, lag(a8) over s as la from b window s as (partition by coin, ts {DAY} order by ts))
select coin, ts, b8, a8 from x where b8 is distinct from lb or a8 is distinct from la""")
def bbo_changes(spark: SparkSession, d: str) -> DataFrame:
    return book.best_quotes(snapshots(spark, d), "coin")


@query(f"""with {SNAPS}, w as (select *, coalesce(sum(q8) over (partition by coin, ts order by p8 rows between unbounded preceding and 1 preceding), 0) as before from sl where side = 'ask'),
t as (select coin, ts, p8, greatest(least(q8, 2000000000 - before), 0) as take from w)
select coin, ts, cast(sum(take) as bigint) as filled8, count(*) as levels, cast(sum(p8::hugeint * take) // sum(take) as bigint) as avg8, sum(take) = 2000000000 as complete from t where take > 0 group by coin, ts""")
def book_market_walk(spark: SparkSession, d: str) -> DataFrame:
    return book.market_walk(snapshots(spark, d), "coin", 2_000_000_000)


@query(f"""with {SNAPS} select coin, ts, side, p8, q8, cast(row_number() over (partition by coin, ts, side order by case when side = 'bid' then -p8 else p8 end) as integer) as level_no from sl qualify level_no <= 3""")
def book_top_levels(spark: SparkSession, d: str) -> DataFrame:
    return book.top_levels(snapshots(spark, d), "coin", 3)


@query(f"""with {SNAPS}, ix as (select coin, ts, ts {DAY} * 86400000 as day, row_number() over (partition by coin, ts {DAY} order by ts) as no from (select distinct coin, ts from sl)),
big as (select sl.*, day, no from sl join ix using (coin, ts) where q8 >= 3000000000),
x as (select *, no - row_number() over p as isle, case when lag(no) over p = no - 1 then q8 - lag(q8) over p end as step from big window p as (partition by coin, day, side, p8 order by no))
select coin, day, side, p8, min(ts) as from_ts, max(ts) as to_ts, cast(max(no) as integer) as last_no, count(*) as seen, max(q8) as peak8, arg_max(q8, no) as end8, count(*) filter (step > 0) as grew, count(*) filter (step < 0) as shrank from x group by coin, day, side, p8, isle""")
def wall_tracker(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = snapshots(spark, d)
    day = F.col("ts") - F.pmod("ts", F.lit(DAY_MS))
    ix = s.select("coin", "ts").distinct().withColumn("day", day).withColumn("no", F.row_number().over(Window.partitionBy("coin", "day").orderBy("ts")))
    return book.walls(s, ix, "coin", 3_000_000_000)


@query(f"""with {DELTAS}, x as (select coin, ts {DAY} * 86400000 as day, side, p8, q8, ts as from_ts, lead(ts) over (partition by coin, ts {DAY}, side, p8 order by ts, seq) as to_ts from de)
select * from x where q8 > 0 and (to_ts is null or to_ts > from_ts)""")
def book_level_intervals(spark: SparkSession, d: str) -> DataFrame:
    return book.level_intervals(deltas(spark, d), "coin")


@query(f"""with {DELTAS}, x as (select coin, ts {DAY} * 86400000 as day, side, p8, q8, ts as from_ts, lead(ts) over (partition by coin, ts {DAY}, side, p8 order by ts, seq) as to_ts from de),
y as (select * from x where q8 > 0 and (to_ts is null or to_ts > from_ts)),
z as (select coin, side, p8, q8, unnest(generate_series((from_ts + 3599999) // 3600000 * 3600000, coalesce(to_ts - 1, day + 86399999), 3600000)) as ts from y)
select coin, ts, count(*) filter (side = 'bid') as bids, count(*) filter (side = 'ask') as asks, max(p8) filter (side = 'bid') as b8, min(p8) filter (side = 'ask') as a8 from z group by coin, ts""")
def book_sampled_depth(spark: SparkSession, d: str) -> DataFrame:
    """The native book: what stands at each full hour, from the levels' validity intervals."""
    s = book.sampled_levels(book.level_intervals(deltas(spark, d), "coin"), "coin", 3_600_000)
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    return s.groupBy("coin", "ts").agg(F.count_if(bid).alias("bids"), F.count_if(ask).alias("asks"), F.max(F.when(bid, F.col("p8"))).alias("b8"), F.min(F.when(ask, F.col("p8"))).alias("a8"))


@query()
def book_fold_top5(spark: SparkSession, d: str) -> DataFrame:
    """Books rebuilt with crossing trims, the five best levels at the end of each minute with a change."""
    return book.fold_books(deltas(spark, d), "coin", 60_000, 5)


@query()
def book_fold_capped(spark: SparkSession, d: str) -> DataFrame:
    """The same with at most 20 levels a side; what a cap evicts does not come back."""
    return book.fold_books(deltas(spark, d), "coin", 3_600_000, 5, cap=20).select("coin", "ts", "trimmed", "evicted", "book_hash")


def _touch_events(spark: SparkSession, d: str) -> DataFrame:
    tops = flow.top_of_book(snapshots(spark, d), "coin").withColumn("seq", F.lit(0).cast("bigint"))
    t = trades(spark, d).join(instruments(spark, d), "sym").select("coin", "ts", "seq", "sgn", "p8", "q8")
    at = asof_forward(t, tops.select("coin", "ts", "seq", F.col("ts").alias("top_ts"), "b8", "a8"), ["coin"], "ts", "seq", ["top_ts", "b8", "a8"])
    v = at.where("top_ts is not null").groupBy("coin", F.col("top_ts").alias("ts")).agg(
        F.coalesce(F.sum(F.when((F.col("sgn") < 0) & (F.col("p8") <= F.col("b8")), F.col("q8"))), F.lit(0)).alias("bid_traded8"), F.coalesce(F.sum(F.when((F.col("sgn") > 0) & (F.col("p8") >= F.col("a8")), F.col("q8"))), F.lit(0)).alias("ask_traded8"),
    )
    return tops.join(v, ["coin", "ts"], "left").fillna(0, ["bid_traded8", "ask_traded8"])


@query(f"""with {TOPS}, {TRADES}, tk as (select coin, tr.ts, sgn, p8, q8 from tr join instrument on symbol = sym), hit as (select tk.coin, tops.ts, sgn, p8, q8, b8, a8 from tk asof join tops on tk.coin = tops.coin and tk.ts <= tops.ts),
v as (select coin, ts, coalesce(sum(q8) filter (sgn < 0 and p8 <= b8), 0) as bt, coalesce(sum(q8) filter (sgn > 0 and p8 >= a8), 0) as at_ from hit group by all),
e as (select tops.*, coalesce(bt, 0) as bt, coalesce(at_, 0) as at_ from tops left join v on tops.coin = v.coin and tops.ts = v.ts),
l as (select *, coalesce(case when b8 = lag(b8) over s then greatest(lag(bq8) over s - bq8, 0) end, 0) as bl, coalesce(case when a8 = lag(a8) over s then greatest(lag(aq8) over s - aq8, 0) end, 0) as al from e window s as (partition by coin, ts {DAY} order by ts)),
w as (select coin, ts, cast(sum(least(bl, bt) + least(al, at_)) over r as bigint) as executed8, cast(sum(bl + al) over r as bigint) as lost, cast(sum(bl - least(bl, bt) - al + least(al, at_)) over r as bigint) as cancel_skew8
  from l window r as (partition by coin, ts {DAY} order by ts rows 19 preceding))
select coin, ts, executed8, lost - executed8 as cancelled8, coalesce((lost - executed8) / nullif(lost, 0), 0.0) as cancel_ratio, cancel_skew8 from w""")
def flow_wall_split(spark: SparkSession, d: str) -> DataFrame:
    """Of what the touch lost, how much trades explain and how much was cancelled, over 20 observations."""
    return flow.wall_flow(_touch_events(spark, d), "coin", 20)
