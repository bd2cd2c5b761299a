"""Order placement, walls against the tape, gates and rolling statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import market as M
from tapeloom.functions.clean import DAY_MS, known, restore_ms
from tapeloom.operators import anomaly, book, flow, orders, stats
from tapeloom.plans.base import SNAPS, TRADES, instruments, ms, snapshots, trades
from tapeloom.plans.flow import BASIS, DAY, SAMPLED, TOPS, _basis_samples, rounded, wall_tracker
from tapeloom.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}
SOURCES = ["live", "replay", "vendor"]


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _coin_trades(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).join(instruments(spark, d), "sym").withColumnRenamed("coin", "key")


@query(f"""with {TOPS}, {TRADES}, tc as (select coin as key, tr.* from tr join instrument on symbol = sym),
od as (select coin || '/' || ts || '/' || k as id, coin as key, ts, k < 2 as is_bid, case k when 0 then b8 when 1 then a8 when 2 then a8 else b8 end as p8, case k when 0 then aq8 // 2 + 1 when 1 then 2 * aq8 when 2 then bq8 // 2 + 1 else 2 * bq8 end as q8
  from tops, range(4) t(k) where b8 < a8),
cx as (select od.*, sl.p8 as lp, sl.q8 as lq, coalesce(sum(sl.q8) over (partition by id order by case when is_bid then sl.p8 else -sl.p8 end rows between unbounded preceding and 1 preceding), 0) as before
  from od join sl on sl.coin = od.key and sl.ts = od.ts and sl.side = case when is_bid then 'ask' else 'bid' end and case when is_bid then sl.p8 <= od.p8 else sl.p8 >= od.p8 end),
tk as (select id, sum(greatest(least(lq, q8 - before), 0)) as taken, sum(cast(greatest(least(lq, q8 - before), 0) as hugeint) * lp) as cost from cx group by id),
rs as (select od.*, coalesce((select sum(q8) from sl where sl.coin = od.key and sl.ts = od.ts and sl.p8 = od.p8 and sl.side = case when is_bid then 'bid' else 'ask' end), 0) as ahead from od where id not in (select id from tk)),
mt as (select rs.*, tc.ts as at_, sum(tc.q8) over (partition by id order by tc.ts, tc.seq) as cum from rs join tc on tc.key = rs.key and tc.ts > rs.ts and tc.ts <= rs.ts + 120000 and case when is_bid then sgn < 0 and tc.p8 <= rs.p8 else sgn > 0 and tc.p8 >= rs.p8 end),
fl as (select id, max(least(greatest(cum - ahead, 0), q8)) as filled, min(at_) filter (cum > ahead) as first_ts, min(at_) filter (cum >= ahead + q8) as done_ts from mt group by id)
select od.id, od.key, od.ts, case when taken > 0 then 'taker' else 'rested' end as placed, cast(coalesce(taken, 0) as bigint) as taken8, cast(cost // taken as bigint) as avg8, cast(ahead as bigint) as ahead8, cast(coalesce(filled, 0) as bigint) as filled8, first_ts, done_ts
from od left join tk using (id) left join rs on rs.id = od.id left join fl on fl.id = od.id""")
def limit_orders(spark: SparkSession, d: str) -> DataFrame:
    """At every snapshot four orders: a bid and an ask at the own touch, and one of each across at twice the other touch's size; two minutes of life."""
    s = snapshots(spark, d)
    both = book.depth_snapshot(s, "coin").select("coin", "ts", F.col("bid")[0].alias("b"), F.col("ask")[0].alias("a"))
    half = lambda c: F.call_function("div", c, F.lit(2).cast("bigint")) + 1
    kinds = [(True, "b", half(F.col("a.q8"))), (True, "a", 2 * F.col("a.q8")), (False, "a", half(F.col("b.q8"))), (False, "b", 2 * F.col("b.q8"))]
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(bid).alias("is_bid"), F.col(f"{at}.p8").alias("p8"), q.alias("q8")) for k, (bid, at, q) in enumerate(kinds)])
    o = both.select("coin", "ts", F.inline(each)).select(F.concat_ws("/", "coin", "ts", "k").alias("id"), F.col("coin").alias("key"), "ts", "is_bid", "p8", "q8")
    return orders.place_limits(o, s.withColumnRenamed("coin", "key"), _coin_trades(spark, d), 120_000)


@query(f"""with {SNAPS}, {TRADES}, ix as (select coin, ts, ts {DAY} * 86400000 as day, row_number() over (partition by coin, ts {DAY} order by ts) as no from (select distinct coin, ts from sl)),
big as (select sl.*, day, no from sl join ix using (coin, ts) where q8 >= 3000000000), x as (select *, no - row_number() over (partition by coin, day, side, p8 order by no) as isle from big),
wl as (select coin, day, side, p8, min(ts) as from_ts, max(ts) as to_ts from x group by coin, day, side, p8, isle), tc as (select coin, tr.* from tr join instrument on symbol = sym)
select wl.coin, wl.side, wl.p8, from_ts, to_ts, count(tc.seq) as trades, cast(coalesce(sum(tc.q8), 0) as bigint) as traded8, cast(coalesce(sum(tc.q8) filter (sgn = case when wl.side = 'bid' then -1 else 1 end), 0) as bigint) as hit8
from wl left join tc on tc.coin = wl.coin and tc.p8 = wl.p8 and tc.ts between from_ts and to_ts group by wl.coin, wl.side, wl.p8, from_ts, to_ts""")
def wall_trades(spark: SparkSession, d: str) -> DataFrame:
    """What traded at exactly a wall's price while it stood, and how much of it hit the wall."""
    return book.traded_at(wall_tracker(spark, d), _coin_trades(spark, d).withColumnRenamed("key", "coin"), "coin")


@query(f"""with {TRADES}, b as (select sym, ts // 60000 * 60000 as ts, cast(sum(sgn * q8) as bigint) / 1e8 as delta from tr group by sym, tr.ts // 60000),
l as (select *, list(delta) over (partition by sym, ts {DAY} order by ts rows 49 preceding) as x from b)
select sym, ts, delta, round(list_avg(x), 9) + 0.0 as mean, round(coalesce(list_stddev_samp(x), 0), 9) + 0.0 as sd from l""")
def flow_cvd_moments(spark: SparkSession, d: str) -> DataFrame:
    """Mean and sample deviation of the minute's signed volume over the last 50 bars, this one included."""
    b = flow.cvd(trades(spark, d), "sym", 60_000).select("sym", F.col("period_ms").alias("ts"), (F.col("delta8") / 1e8).alias("delta"))
    return rounded(flow.rolling_moments(b, "sym", "delta", 50), 9, "mean", "sd")


@query(f"""with {BASIS} select coin, ts, round((v / lag(v, 3) over (partition by coin, ts {DAY} order by ts) - 1) * 1e4, 4) + 0.0 as momentum, case when dev is not null then round(least(greatest(abs(dev) / 3.0, 1.0), 4.0), 6) + 0.0 end as size from bs join dv using (coin, ts)""")
def basis_momentum(spark: SparkSession, d: str) -> DataFrame:
    """The quote's return over three samples and the size multiplier of the basis deviation against 3 bps, 4 at most."""
    s = _basis_samples(spark, d)
    x = flow.basis(s, "coin", 20, 3).join(flow.momentum(s, "coin", 3), ["coin", "ts"])
    return rounded(x.select("coin", "ts", "momentum", M.size_multiplier(F.col("dev"), 3.0, 4.0).alias("size")), 6, "size").withColumn("momentum", F.round("momentum", 4) + F.lit(0.0))


@query(f"""with {BASIS}, s as (select coin, gap, row_number() over (partition by coin order by gap) - 1 as i, count(*) over (partition by coin) as n from bs)
select coin, round(avg(gap), 4) + 0.0 as mean, round(max(gap) filter (i = n // 10), 4) + 0.0 as p10, round(max(gap) filter (i = n // 2), 4) + 0.0 as med, round(max(gap) filter (i = 9 * n // 10), 4) + 0.0 as p90 from s group by coin""")
def feed_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean and floor ranks (n/10, n/2, 9n/10) of the basis."""
    gap = _basis_samples(spark, d).select("coin", ((F.col("v") / F.col("r") - 1) * 1e4).alias("gap"))
    return rounded(stats.floor_ranks(gap, ["coin"], "gap"), 4, "mean", "p10", "med", "p90")


_LAST = {s: f"last_value(case when source = '{s}' then mid end ignore nulls) over (partition by coin, ts {DAY} order by ts, seq rows unbounded preceding)" for s in SOURCES}


@query(f"""with q as (select src_ordinal as seq, coin, {ms('ts')} as ts, source, mid from hlquote where coin is not null and mid > 0 and not isnan(mid)), l as (select coin, seq, ts, {", ".join(f"{e} as {s}_" for s, e in _LAST.items())} from q)
select coin, seq, ts, cast({" + ".join(f"({s}_ is not null)::int" for s in SOURCES)} as integer) as n_sources, round(({" + ".join(f"coalesce({s}_, 0)" for s in SOURCES)}) / ({" + ".join(f"({s}_ is not null)::int" for s in SOURCES)}), 6) + 0.0 as reference from l where {" or ".join(f"{s}_ is not null" for s in SOURCES)}""")
def reference_price(spark: SparkSession, d: str) -> DataFrame:
    """At each quote the mean of the last mid above 0 of every source of the day."""
    q = table(spark, d, "hlquote").where(F.col("coin").isNotNull() & known(F.col("mid")) & (F.col("mid") > 0)).select("coin", F.col("src_ordinal").alias("seq"), restore_ms(F.col("ts")).alias("ts"), "source", "mid")
    return rounded(flow.multi_reference(q, "coin", "source", SOURCES, "mid"), 6, "reference")


_RANGE = f"""{SAMPLED}, x as (select sym, ts, v, max(v) over w as hi, min(v) over w as lo, min(ts) over w as t0 from sm window w as (partition by sym, ts {DAY} order by ts range between 3600000 preceding and 1 preceding)),
  rb as (select sym, ts, case when v >= hi * 1.001 then 1 when v <= lo * 0.999 then -1 else 0 end as side from x where ts - t0 >= 1800000)"""


@query(f"""with {_RANGE.replace("hi * 1.001", "hi * (1 + 0.001)").replace("lo * 0.999", "lo * (1 - 0.001)")}, n as (select sym, ts, ts % 86400000 // 60000 as no, side from rb where side <> 0)
select * from n qualify row_number() over (partition by sym, ts {DAY}, no // 100 order by no) <= 8""")
def gate_per_hundred(spark: SparkSession, d: str) -> DataFrame:
    """Range breaks let through: the first eight of each hundred minutes."""
    s = flow.range_breaks(flow.sampled(trades(spark, d), "sym", 60_000, F.col("p8")), "sym", 3_600_000, 0.001).where("side <> 0")
    n = s.select("sym", "ts", F.call_function("div", F.pmod("ts", F.lit(DAY_MS)), F.lit(60_000).cast("bigint")).alias("no"), "side")
    return anomaly.gate_per_block(n, "sym", 100, 8)


@query(f"""with {SNAPS}, lv as (select *, row_number() over (partition by coin, ts, side order by case when side = 'bid' then -p8 else p8 end) as n from sl),
im as (select coin, ts, coalesce(sum(q8) filter (side = 'bid'), 0) as b, coalesce(sum(q8) filter (side = 'ask'), 0) as a from lv where n <= 5 group by all), i as (select coin, ts, case when a + b > 0 then (b - a) / (a + b) else 0 end as imb from im),
s as (select coin, ts, imb, imb - lag(imb, 3) over (partition by coin, ts {DAY} order by ts) as shift from i)
select coin, ts, round(imb, 9) + 0.0 as imb, shift >= 0.1 as revert_down, -shift >= 0.1 as revert_up, shift <= 0.0 as trend_down, -shift <= 0.0 as trend_up, round((1 - imb) / 2, 9) + 0.0 as defends_ask from s where shift is not null""")
def depth_confirms(spark: SparkSession, d: str) -> DataFrame:
    """Whether the top-five imbalance came back to the hit side over three snapshots (revert, 0.1) or stayed away (trend), for a fall and a rise."""
    lv = book.top_levels(snapshots(spark, d), "coin", 5)
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("q8"))), F.lit(0))
    i = lv.groupBy("coin", "ts").agg(side("bid").alias("b"), side("ask").alias("a")).select("coin", "ts", M.imbalance(F.col("b"), F.col("a")).alias("imb"))
    before = F.lag("imb", 3).over(Window.partitionBy("coin", F.col("ts") - F.pmod("ts", F.lit(DAY_MS))).orderBy("ts"))
    x = i.withColumn("was", before).where("was is not null")
    was, imb = F.col("was"), F.col("imb")
    marks = {f"{name}_{way}": f(was, imb, F.lit(down), limit) for name, f, limit in (("revert", M.confirms_revert, 0.1), ("trend", M.confirms_trend, 0.0)) for way, down in (("down", True), ("up", False))}
    return rounded(x.select("coin", "ts", "imb", *[c.alias(n) for n, c in marks.items()], M.defending_depth(imb, F.lit(1)).alias("defends_ask")), 9, "imb", "defends_ask")
