"""Queries over episodes, simulations, sweeps and statistics, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import market as M
from tapeloom.functions.clean import DAY_MS
from tapeloom.operators import bars, flow, sim, stats, studies
from tapeloom.operators.asof import asof_backward
from tapeloom.plans.base import FUNDING, OI, QUOTES, SNAPS, TRADES, funding, instruments, open_interest, quotes, snapshots, trades
from tapeloom.plans.flow import BARS5, BASIS, DAY, SAMPLED, _basis_samples, _quoted_trades, rounded
from tapeloom.sources.files import exclude_dates
from tapeloom.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# --- scalars -----------------------------------------------------------------------------------


def _horner(x: str, cs: tuple) -> str:
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + ({c!r}))"
    return out


ERF = lambda x: f"(sign({x}) * (1 - {_horner(f'(1 / (1 + {M.ERF_P} * abs({x})))', (*reversed(M.ERF_A), 0.0))} * exp(-({x}) * ({x}))))"
Z = "((rate - avg(rate) over w) / nullif(stddev_pop(rate) over w, 0))"


@query(f"""with {FUNDING}, z as (select coin, ts, {Z} as z from fu window w as (partition by coin, ts {DAY})),
c as (select coin, ts, z, 0.5 * (1 + {ERF('(z / sqrt(2))')}) as cdf, least(1.0, 2 * exp(-z * z / 2) / sqrt(2 * pi()) * {_horner(f'(1 / (1 + {M.TAIL_P} * abs(z)))', (*reversed(M.TAIL_B), 0.0))}) as p from z where z is not null)
select coin, ts, round(z, 5) + 0.0 as z, round(cdf, 5) + 0.0 as cdf, round(p, 5) + 0.0 as p from c where z <> 0""")
def scalar_normal(spark: SparkSession, d: str) -> DataFrame:
    """z-scores of funding rates within coin and day, their normal CDF and two-sided p."""
    w = Window.partitionBy("coin", F.call_function("div", F.col("ts"), F.lit(DAY_MS).cast("bigint")))
    z = (F.col("rate") - F.avg("rate").over(w)) / F.nullif(F.stddev_pop("rate").over(w), F.lit(0.0))
    x = funding(spark, d).withColumn("z", z).where("z is not null and z <> 0")
    return x.select("coin", "ts", F.round("z", 5).alias("z"), F.round(M.normal_cdf(F.col("z")), 5).alias("cdf"), F.round(M.two_sided_p(F.col("z")), 5).alias("p"))


def _inverse(p: str) -> str:
    tail = lambda q: f"({_horner(q, M.ACKLAM_C)} / {_horner(q, (*M.ACKLAM_D, 1.0))})"
    m = f"({p} - 0.5)"
    mid = f"({_horner(f'({m} * {m})', M.ACKLAM_A)} * {m} / {_horner(f'({m} * {m})', (*M.ACKLAM_B, 1.0))})"
    return f"(case when {p} < {M.ACKLAM_LOW} then {tail(f'sqrt(-2 * ln({p}))')} when {p} > {1 - M.ACKLAM_LOW} then -{tail(f'sqrt(-2 * ln(1 - {p}))')} else {mid} end)"


@query(f"""with g as (select i / 1000.0::double as p from range(1, 1000) t(i)), z as (select p, {_inverse("p")} as z from g) select p, round(z, 6) + 0.0 as z, round(0.5 * (1 + {ERF("(z / sqrt(2))")}), 6) + 0.0 as back from z""")
def scalar_normal_inverse(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles and the way back through the CDF, over a grid of probabilities."""
    p = spark.range(1, 1000).select((F.col("id") / 1000.0).alias("p"))
    z = p.withColumn("z", M.normal_inverse(F.col("p")))
    return z.select("p", F.round("z", 6) + F.lit(0.0), F.round(M.normal_cdf(F.col("z")), 6) + F.lit(0.0)).toDF("p", "z", "back")


@query(f"""with {TRADES} select sym, seq, cast(p8::hugeint * q8 // 100000000 as varchar) as notional, cast((p8::hugeint * q8 // 100000000) * 50000 // 100000000 as varchar) as taker_fee, cast(-((p8::hugeint * q8 // 100000000) * 4000 // 100000000) as varchar) as maker_fee from tr""")
def scalar_fees(spark: SparkSession, d: str) -> DataFrame:
    """Exact notionals and fees in units of 1e-8, as text; the maker's rate is negative."""
    n = M.notional8(F.col("p8"), F.col("q8"))
    return trades(spark, d).withColumn("n", n).select("sym", "seq", F.col("n").cast("string").alias("notional"), M.fee8(F.col("n"), 50_000).cast("string").alias("taker_fee"), M.fee8(F.col("n"), -4_000).cast("string").alias("maker_fee"))


@query("""select src_ordinal, cast(round(price * 1e8) as bigint) as raw, abs(price * 1e8 - round(price * 1e8)) <= 1e-6 as exact from trade where price is not null and not isnan(price) and abs(price) < 9e10""")
def scalar_fixed_point(spark: SparkSession, d: str) -> DataFrame:
    """Prices as fixed point and whether that is exact."""
    s = F.col("price") * 1e8
    t = table(spark, d, "trade").where("price is not null and not isnan(price) and abs(price) < 9e10")
    return t.select("src_ordinal", F.round(s).cast("bigint").alias("raw"), (F.abs(s - F.round(s)) <= 1e-6).alias("exact"))


@query("""select text, ns from (values ('250ms', 250000000), ('2h', 7200000000000), ('7', 7), ('15m', 900000000000), ('30s', 30000000000), ('12us', 12000), ('9ns', 9)) t(text, ns)""")
def scalar_durations(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(x,) for x in ("250ms", "2h", "7", "15m", "30s", "12us", "9ns")], "text string")
    return t.withColumn("ns", M.duration_ns(F.col("text")))


@query(f"""with {TRADES} select sym, cast(make_date(cast(ts {DAY} as integer)) as varchar) as date, ts {DAY} * 86400000 as from_ms, count(*) as n from tr group by sym, ts {DAY}""")
def scalar_civil_dates(spark: SparkSession, d: str) -> DataFrame:
    no = F.call_function("div", F.col("ts"), F.lit(DAY_MS).cast("bigint")).cast("int")
    return trades(spark, d).groupBy("sym", no.alias("no")).agg(F.count("*").alias("n")).select("sym", F.date_from_unix_date("no").cast("string").alias("date"), (F.col("no").cast("bigint") * DAY_MS).alias("from_ms"), "n")


# --- ingest ------------------------------------------------------------------------------------


@query(f"""with {TRADES}, {QUOTES}
select coin, kind, exch_ns, local_ns, side, p8, q8, seq, row_number() over (partition by coin, exch_ns // 86400000000000 order by local_ns, exch_ns, kind, side, p8, seq) as no from (
  select coin, 1 as kind, ts * 1000000 as exch_ns, ts * 1000000 + 250000000 as local_ns, case when sgn > 0 then 1 else 2 end as side, p8, q8, seq from tr join instrument on symbol = sym
  union all select coin, 4, ts * 1000000, ts * 1000000 + 250000000, 1, b8, 0, seq from qt union all select coin, 4, ts * 1000000, ts * 1000000 + 250000000, 2, a8, 0, seq from qt)""")
def ingest_merge_order(spark: SparkSession, d: str) -> DataFrame:
    """One totally ordered event table per coin and day: trades, and quotes as two events each, seen 250 ms later."""
    return merged_events(spark, d)


def merged_events(spark: SparkSession, d: str) -> DataFrame:
    ns = (F.col("ts") * 1_000_000).alias("exch_ns")
    seen = (F.col("ts") * 1_000_000 + 250_000_000).alias("local_ns")
    t = trades(spark, d).join(instruments(spark, d), "sym").select("coin", F.lit(1).alias("kind"), ns, seen, F.when(F.col("sgn") > 0, 1).otherwise(2).alias("side"), "p8", "q8", "seq")
    sides = F.inline(F.array(F.struct(F.lit(1).alias("side"), F.col("b8").alias("p8")), F.struct(F.lit(2).alias("side"), F.col("a8").alias("p8"))))
    q = quotes(spark, d).select("coin", F.lit(4).alias("kind"), ns, seen, sides, F.lit(0).cast("bigint").alias("q8"), "seq")
    w = Window.partitionBy("coin", F.call_function("div", F.col("exch_ns"), F.lit(DAY_MS * 1_000_000).cast("bigint"))).orderBy("local_ns", "exch_ns", "kind", "side", "p8", "seq")
    return t.unionByName(q).withColumn("no", F.row_number().over(w).cast("bigint"))


@query(f"""with {TRADES} select sym, count(*) as n, min(ts) as first_ts, max(ts) as last_ts, count(*) filter (before > ts) as backwards from (select *, lag(ts) over (partition by sym, ts {DAY} order by seq) as before from tr) group by sym""")
def ingest_validate(spark: SparkSession, d: str) -> DataFrame:
    """Per symbol: rows, time range and rows that arrive after a later one."""
    t = trades(spark, d).withColumn("before", F.lag("ts").over(flow.session("sym", "seq")))
    return t.groupBy("sym").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(F.col("before") > F.col("ts")).alias("backwards"))


@query(f"with {QUOTES} select coin, ts, seq, 1 as side, b8 as p8, 0 as q8 from qt union all select coin, ts, seq, 2, a8, 0 from qt")
def quote_explode(spark: SparkSession, d: str) -> DataFrame:
    return quotes(spark, d).select("coin", "ts", "seq", F.inline(F.array(F.struct(F.lit(1).alias("side"), F.col("b8").alias("p8")), F.struct(F.lit(2).alias("side"), F.col("a8").alias("p8")))), F.lit(0).alias("q8"))


@query(f"""with {FUNDING} select * exclude (mark, idx), case when isnan(mark) then 0.0 else coalesce(mark, 0.0) end as mark, case when isnan(idx) then 0.0 else coalesce(idx, 0.0) end as idx from fu""")
def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    """Funding readings, the last delivery of each instant, missing marks as 0."""
    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias(c)
    return funding(spark, d).select("coin", "ts", "seq", "rate", zero("mark"), zero("idx"))


BAD_DATES = ["2018-01-02", "2018-01-05"]


@query(f"""with {TRADES} select tr.* from tr where make_date(cast(ts {DAY} as integer)) not in ({", ".join(f"date '{x}'" for x in BAD_DATES)})""")
def bad_date_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Trades without those of the listed dates, as ranges of ts that reach the scan."""
    return exclude_dates(trades(spark, d), "ts", BAD_DATES)


@query(f"""with {SNAPS}, ix as (select coin, ts, lead(ts) over (partition by coin, ts {DAY} order by ts) as nxt from (select distinct coin, ts from sn)),
now_ as (select sl.*, ix.nxt from sl join ix using (coin, ts)), 
g as (select coalesce(n.coin, o.coin) as coin, coalesce(n.ts, o.nxt) as ts, coalesce(n.side, o.side) as side, coalesce(n.p8, o.p8) as p8, n.q8 as q8, o.q8 as old8
  from sl n full join (select * from now_ where nxt is not null) o on n.coin = o.coin and n.ts = o.nxt and n.side = o.side and n.p8 = o.p8)
select coin, ts, side, p8, coalesce(q8, 0) as q8, case when q8 is null then 'remove' else 'change' end as kind from g where q8 is distinct from old8""")
def snapshot_to_deltas(spark: SparkSession, d: str) -> DataFrame:
    """A change feed from consecutive snapshots: the first of a day comes whole, a level that is gone is removed."""
    from tapeloom.operators.snapshots import snapshot_index

    raw = table(spark, d, "hl_orderbook").select("coin", F.col("event_time").alias("ts")).dropna()
    s = snapshots(spark, d)
    ix = snapshot_index(raw, ["coin"], "ts", F.col("ts") - F.pmod("ts", F.lit(DAY_MS)))
    x = s.join(ix, ["coin", "ts"])
    both = x.select("coin", "side", "p8", "q8", F.inline(F.array(F.struct(F.col("ts").alias("at"), F.lit(True).alias("new")), F.struct(F.col("next_at").alias("at"), F.lit(False).alias("new"))))).where("at is not null")
    g = both.groupBy("coin", F.col("at").alias("ts"), "side", "p8").agg(F.max(F.when(F.col("new"), F.col("q8"))).alias("n"), F.max(F.when(~F.col("new"), F.col("q8"))).alias("o"))
    return g.where("not (n <=> o)").select("coin", "ts", "side", "p8", F.coalesce("n", F.lit(0)).alias("q8"), F.when(F.col("n").isNull(), "remove").otherwise("change").alias("kind"))


# --- episodes ----------------------------------------------------------------------------------


def _breaks(spark: SparkSession, d: str) -> DataFrame:
    """Range breaks as episodes (id = ts per key), with the broken edge; one per 30 minutes."""
    s = flow.sampled(trades(spark, d), "sym", 60_000, F.col("p8"))
    b = flow.range_breaks(s, "sym", 3_600_000, 0.001).where("side <> 0")
    e = b.select(F.col("sym").alias("key"), "ts", "side", F.col("v").alias("p8"), F.when(F.col("side") > 0, F.col("hi")).otherwise(F.col("lo")).alias("edge8"), (F.col("ts") + 1_800_000).alias("until"))
    e = sim.non_overlapping(e, "key", "ts", "until")
    return e.select(F.concat_ws("@", "key", "ts").alias("id"), "key", "ts", "side", "p8", "edge8")


def _paths(spark: SparkSession, d: str, width: int = 1_800_000) -> tuple[DataFrame, DataFrame]:
    e = _breaks(spark, d)
    s = flow.sampled(trades(spark, d), "sym", 10_000, F.col("p8")).select(F.col("sym").alias("key"), "ts", F.col("v").alias("v8"))
    return e, studies.paths(e, s, width)


BREAKS = f"""{SAMPLED}, rg as (select sym, ts, v, max(v) over w as hi, min(v) over w as lo, min(ts) over w as t0 from sm window w as (partition by sym, ts {DAY} order by ts range between 3600000 preceding and 1 preceding)),
  bk as (select sym as key, ts, case when v >= hi * (1 + 0.001) then 1 when v <= lo * (1 - 0.001) then -1 else 0 end as side, v as p8, hi, lo from rg where ts - t0 >= 1800000),
  cand as (select key, ts, side, p8, case when side > 0 then hi else lo end as edge8, ts {DAY} as day from bk where side <> 0),
  pick as (
    select key, day, min(ts) as ts from cand group by all
    union all
    select p.key, p.day, (select min(c.ts) from cand c where c.key = p.key and c.day = p.day and c.ts > p.ts + 1800000) from pick p where p.ts is not null),
  ep as (select key || '@' || ts as id, key, ts, side, p8, edge8 from cand join (select key, ts from pick where ts is not null) using (key, ts)),
  s10 as (select sym as key, ts // 10000 * 10000 as ts, arg_min(p8, (ts, seq)) as v8 from tr group by 1, tr.ts // 10000 * 10000),
  pa as (select ep.*, s10.ts as path_ts, v8 from ep join s10 on s10.key = ep.key and s10.ts between ep.ts and ep.ts + 1800000),
  ru as (select *, (v8 / p8 - 1) * 1e4 * side as run from pa)"""


@query(f"with recursive {BREAKS} select id, key, ts, side, p8, edge8 from ep")
def study_range_breaks(spark: SparkSession, d: str) -> DataFrame:
    return _breaks(spark, d)


@query(f"""with recursive {BREAKS}, top as (select id, key, greatest(max(run), 0) as spike, max(run) as m from ru group by all),
pk as (select ru.id, min(path_ts) as peak_ts from ru join top using (id) where run = m group by ru.id),
af as (select ru.*, spike, peak_ts from ru join top using (id) join pk using (id) where path_ts >= peak_ts)
select id, key, round(spike, 4) + 0.0 as spike_bps, peak_ts, round(least(coalesce(max(spike - run) / nullif(spike, 0), 0.0), 1.0), 4) + 0.0 as reverted, min(path_ts) filter (spike - run >= spike / 2) - peak_ts as half_ms, min(path_ts) filter (run <= 0) - peak_ts as full_ms
from af group by id, key, spike, peak_ts""")
def reversion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(studies.reversion(_paths(spark, d)[1]), 4, "spike_bps", "reverted")


def _touch_sql(delay: int, hold: int, target: float, stop: float, sign: int) -> str:
    return f"""with recursive {BREAKS}, la as (select * from pa where path_ts >= ts + {delay}), en as (select id, min(path_ts) as t0, arg_min(v8, path_ts) as e8 from la group by id),
  x as (select la.id, key, path_ts, (v8 / e8 - 1) * 1e4 * side * {sign} as gain from la join en using (id) where path_ts <= t0 + {hold}),
  t as (select id, key, min(path_ts) filter (gain >= {target} or gain <= -{stop}) as touch, max(path_ts) as last from x group by all)
select t.id, t.key, round(x.gain, 4) + 0.0 as bps, coalesce(touch, last) as exit_ts, touch is not null as touched from t join x on x.id = t.id and x.path_ts = coalesce(touch, last)"""


@query(_touch_sql(0, 600_000, 15.0, 10.0, 1))
def first_touch(spark: SparkSession, d: str) -> DataFrame:
    """With the break: target 15, stop 10 bps, 10 minutes."""
    return rounded(studies.first_touch(_paths(spark, d)[1], 0, 600_000, 15.0, 10.0, fade=False), 4, "bps")


@query(" union all ".join(f"select {k} as delay_ms, * from ({_touch_sql(k, 900_000, 20.0, 20.0, -1)})" for k in (0, 30_000, 120_000)))
def fade_delays(spark: SparkSession, d: str) -> DataFrame:
    """Against the break, entered after several delays."""
    path = _paths(spark, d)[1]
    out = [rounded(studies.first_touch(path, k, 900_000, 20.0, 20.0), 4, "bps").select(F.lit(k).alias("delay_ms"), "*") for k in (0, 30_000, 120_000)]
    return out[0].union(out[1]).union(out[2])


@query(f"""with recursive {BREAKS}, g as (select id, key, min(path_ts) filter (run >= 10) as on_ts, min(path_ts) filter ((v8 - edge8) * side < 0) as back_ts from ru group by all)
select id, key, case when on_ts is null and back_ts is null then 0 when back_ts is null or on_ts < back_ts then 1 else -1 end as outcome, on_ts, back_ts from g""")
def outcome_class(spark: SparkSession, d: str) -> DataFrame:
    e, p = _paths(spark, d)
    return studies.outcome_class(p.join(e.select("id", "edge8"), "id"), "edge8", 10.0)


@query(f"""with recursive {BREAKS} select id, key, min(path_ts) as reclaim_ts, arg_min(v8, path_ts) as v8 from pa where (v8 - edge8) * side < 0 group by id, key""")
def reclaim_entry(spark: SparkSession, d: str) -> DataFrame:
    e, p = _paths(spark, d)
    return studies.reclaims(p.join(e.select("id", "edge8"), "id"), "edge8")


@query(f"""with recursive {BREAKS}, x as (select ep.*, tr.ts as path_ts, sgn, q8, tr.p8 as v8, seq from ep join tr on tr.sym = ep.key and tr.ts between ep.ts and ep.ts + 600000),
g as (select id, key, p8, side, cast(sum(case when sgn = side then q8 else 0 end) as bigint) as forced8, cast(sum(case when sgn = side and path_ts < ts + 300000 then q8 else 0 end) as bigint) as early8 from x group by all)
select id, key, forced8, early8, forced8 - early8 as late8 from g""")
def flow_forced(spark: SparkSession, d: str) -> DataFrame:
    """Volume forced in the break's direction, early and late."""
    return studies.flow_metrics(_breaks(spark, d), trades(spark, d).withColumnRenamed("sym", "key"), 600_000).select("id", "key", "forced8", "early8", "late8")


FLOWM = f"""{BREAKS}, fx as (select ep.*, tr.ts as path_ts, sgn, q8, tr.p8 as v8, seq from ep join tr on tr.sym = ep.key and tr.ts between ep.ts and ep.ts + 600000),
  fg as (select id, key, p8, side, cast(sum(case when sgn = side then q8 else 0 end) as bigint) as forced8, cast(sum(case when sgn = side and path_ts < ts + 300000 then q8 else 0 end) as bigint) as early8, arg_max(v8, (path_ts, seq)) as last8 from fx group by all),
  fm as (select id, key, forced8, early8, forced8 - early8 as late8, (last8 / p8 - 1) * 1e4 * side as push_bps, coalesce((forced8 - early8) / nullif(forced8, 0), 0.0) as late_share from fg)"""


@query(f"""with recursive {FLOWM} select id, key, forced8, early8, late8, round(push_bps, 5) + 0.0 as push_bps, round(late_share, 9) + 0.0 as late_share,
  case when push_bps >= 5 and late_share >= 0.5 then 'continuation' when forced8 > 0 and push_bps < 1 then 'absorbed' when late_share < 0.3 then 'exhausted' else 'unclassified' end as state from fm""")
def flow_metrics_states(spark: SparkSession, d: str) -> DataFrame:
    m = studies.flow_metrics(_breaks(spark, d), trades(spark, d).withColumnRenamed("sym", "key"), 600_000)
    return m.withColumns({"push_bps": F.round("push_bps", 5) + F.lit(0.0), "late_share": F.round("late_share", 9) + F.lit(0.0)})


@query(f"""with recursive {FLOWM}, oc as (select id, key, min(path_ts) filter (run >= 10) as on_ts, min(path_ts) filter ((v8 - edge8) * side < 0) as back_ts from ru group by all),
x as (select fm.key, late_share < 0.3 as s, case when on_ts is null and back_ts is null then 0 when back_ts is null or on_ts < back_ts then 1 else -1 end < 0 as y from fm join oc using (id))
select key, count(*) filter (s) as with_signal, count(*) filter (not s) as without, avg(y::int::double) filter (s) as p_with, avg(y::int::double) filter (not s) as p_without, avg(y::int::double) as p_all from x group by key""")
def separation(spark: SparkSession, d: str) -> DataFrame:
    """Whether forced flow that ends early says that a break fails."""
    e, p = _paths(spark, d)
    out = studies.outcome_class(p.join(e.select("id", "edge8"), "id"), "edge8", 10.0)
    m = studies.flow_metrics(e, trades(spark, d).withColumnRenamed("sym", "key"), 600_000)
    x = out.join(m, ["id", "key"])
    return stats.separation(x, ["key"], F.col("late_share") < 0.3, F.col("outcome") < 0)


@query(f"""with recursive {BREAKS}, wk as (select id, key, side, arg_max(v8, v8 * side) as w8, arg_max(v8, path_ts) as e8 from pa where path_ts <= ts + 60000 group by all), rk as (select *, (w8 / e8 - 1) * 1e4 * side + 2 as risk from wk),
x as (select pa.id, pa.key, risk, path_ts, -((v8 / e8 - 1) * 1e4) * pa.side / risk as r from pa join rk on pa.id = rk.id where path_ts > ts + 60000)
select id, key, round(risk, 5) + 0.0 as risk_bps, round(coalesce(arg_min(r, path_ts) filter (r >= 2 or r <= -1), arg_max(r, path_ts)), 5) + 0.0 as r from x group by id, key, risk""")
def struct_stop(spark: SparkSession, d: str) -> DataFrame:
    return rounded(studies.structural_stop(_paths(spark, d)[1], 60_000, 2.0, 2.0), 5, "risk_bps", "r")


LADDER_N = "least(3, greatest(cast(floor(far / 10.0) as integer), 0))"


@query(f"""with recursive {BREAKS}, g as (select id, key, p8, side, max(run) as far, arg_max(v8, path_ts) as last8 from ru where path_ts <= ts + 900000 group by all)
select id, key, {LADDER_N} as filled, round(case when {LADDER_N} > 0 then 10.0 * ({LADDER_N} + 1) / 2 - (last8 / p8 - 1) * 1e4 * side end, 4) + 0.0 as bps from g""")
def ladder(spark: SparkSession, d: str) -> DataFrame:
    return rounded(studies.ladder(_paths(spark, d)[1], 3, 30.0, 900_000), 4, "bps")


@query(f"""with recursive {BREAKS}, pt as (select id, key, unnest(generate_series(ts, ts + 240000, 60000)) as at from ep), g as (select pt.id, pt.key, s10.v8 from pt asof join s10 on pt.key = s10.key and pt.at >= s10.ts)
select id, key, count(*) as points, avg(v8) as twap8 from g group by id, key""")
def twap(spark: SparkSession, d: str) -> DataFrame:
    s = flow.sampled(trades(spark, d), "sym", 10_000, F.col("p8")).select(F.col("sym").alias("key"), "ts", F.col("v").alias("v8"))
    return studies.twap(_breaks(spark, d), s, 5, 60_000)


@query(f"""with recursive {BREAKS}, o as (select id, key, ts, side < 0 as is_bid, edge8 as p8 from ep)
select o.*, (select min(tr.ts) from tr where tr.sym = o.key and tr.ts between o.ts and o.ts + 900000 and case when is_bid then sgn < 0 and tr.p8 <= o.p8 else sgn > 0 and tr.p8 >= o.p8 end) as fill_ts from o""")
def through_trade_fill(spark: SparkSession, d: str) -> DataFrame:
    """Orders resting at the broken edge and the first trade that goes through them."""
    o = _breaks(spark, d).select("id", "key", "ts", (F.col("side") < 0).alias("is_bid"), F.col("edge8").alias("p8"))
    return studies.through_trades(o, trades(spark, d).withColumnRenamed("sym", "key"), 900_000)


@query(f"""with recursive {BREAKS}, e as (select ep.id, ep.key, side, ep.ts, (select sum(case when sgn = side then q8 else 0 end) from tr where tr.sym = ep.key and tr.ts >= ep.ts - 60000 and tr.ts < ep.ts) as base,
  (select arg_min((tr.ts, tr.p8), (tr.ts, tr.seq)) from tr where tr.sym = ep.key and tr.ts between ep.ts and ep.ts + 1800000) as en from ep),
x as (select id, key, side, base, en[1] as t0, tr.ts as t, tr.seq, (tr.p8 / en[2] - 1) * 1e4 * -side as bps, (select sum(case when t2.sgn = side then t2.q8 else 0 end) from tr t2 where t2.sym = e.key and t2.ts between tr.ts - 60000 and tr.ts) as trail
  from e join tr on tr.sym = e.key and tr.ts >= e.ts and tr.ts <= least(en[1] + 1800000, e.ts + 1800000)),
k as (select *, case when bps >= 30 then 'target' when base > 0 and t > t0 and trail / 60000 >= 2.0 * base / 60000 then 'flow' when t - t0 >= 900000 then 'hold' end as kind from x)
select id, key, coalesce(min(t) filter (kind is not null), max(t)) as exit_ts, coalesce(arg_min(kind, (t, seq)) filter (kind is not null), 'end') as exit,
  round(coalesce(arg_min(bps, (t, seq)) filter (kind is not null), arg_max(bps, (t, seq))), 4) + 0.0 as bps from k group by id, key""")
def flow_exit(spark: SparkSession, d: str) -> DataFrame:
    """Reversals of broken ranges: target 30 bps, flow at twice the rate of the minute before, 15 minutes at most."""
    return rounded(studies.flow_exit(_breaks(spark, d), trades(spark, d).withColumnRenamed("sym", "key"), 900_000, 60_000, 2.0, 60_000, 30.0), 4, "bps")


def _coin_prices(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).join(instruments(spark, d), "sym").select(F.col("coin").alias("key"), "ts", "seq", F.col("p8").alias("v8"))


def _cascades(spark: SparkSession, d: str) -> DataFrame:
    oi = open_interest(spark, d).select(F.col("coin").alias("key"), "ts", "seq", "oi8")
    return studies.cascades(oi, _coin_prices(spark, d), 1_800_000, 0.002, 5.0, 3_600_000)


CASC = f"""{TRADES}, {OI}, pr as (select coin as key, tr.ts, p8 as v8, seq from tr join instrument on symbol = sym), p1 as (select * from pr qualify row_number() over (partition by key, ts order by seq desc) = 1),
  o as (select op.coin as key, op.ts, op.seq, oi8, v8 from op asof join p1 on op.coin = p1.key and op.ts >= p1.ts),
  ow as (select *, first_value(oi8) over w as oi0, first_value(v8) over w as v0, min(ts) over w as t0 from o window w as (partition by key, ts {DAY} order by ts range between 1800000 preceding and current row)),
  cc as (select key, ts, seq as id, (oi0 - oi8) / oi0 as oi_drop, (v8 / v0 - 1) * 1e4 as move_bps, v8 as p8, ts {DAY} as day from ow where ts - t0 >= 900000 and (oi0 - oi8) / oi0 >= 0.002 and abs((v8 / v0 - 1) * 1e4) >= 5),
  ck as (select key, day, min(ts) as ts from cc group by all union all select k.key, k.day, (select min(c.ts) from cc c where c.key = k.key and c.day = k.day and c.ts > k.ts + 3600000) from ck k where k.ts is not null),
  ca as (select key, ts, id, round(oi_drop, 8) + 0.0 as oi_drop, round(move_bps, 5) + 0.0 as move_bps, case when move_bps > 0 then 1 else -1 end as side, p8, ts + 3600000 as until, day from cc join (select key, ts from ck where ts is not null) using (key, ts))"""


@query(f"with recursive {CASC} select * exclude (day) from ca")
def cascade_scan(spark: SparkSession, d: str) -> DataFrame:
    c = _cascades(spark, d)
    return c.withColumns({"oi_drop": F.round("oi_drop", 8) + F.lit(0.0), "move_bps": F.round("move_bps", 5) + F.lit(0.0)})


@query()
def cascade_exhaustion(spark: SparkSession, d: str) -> DataFrame:
    oi = open_interest(spark, d).select(F.col("coin").alias("key"), "ts", "seq", "oi8")
    s = asof_backward(oi, _coin_prices(spark, d), ["key"], "ts", "seq", ["v8"]).where("v8 is not null").select("key", "ts", "oi8", "v8")
    e = _cascades(spark, d).select(F.concat_ws("@", "key", "ts").alias("id"), "key", "ts", "side", "p8")
    return studies.exhaustion(s, e, 3_600_000, 5.0)


@query(f"""with {BASIS}, x as (select coin as key, ts, dev, abs(dev) > 1 as out, lead(ts) over (partition by coin, ts {DAY} order by ts) as nxt, sum((abs(dev) <= 1)::int) over (partition by coin, ts {DAY} order by ts rows unbounded preceding) as isle from dv where dev is not null)
select key, min(ts) as from_ts, min(ts) filter (abs(dev) >= 3) as fired_ts, arg_max(nxt, ts) filter (ts = mx) as end_ts, round(max(abs(dev)), 4) + 0.0 as peak, case when arg_min(dev, ts) > 0 then 1 else -1 end as side, count(*) as samples
from (select *, max(ts) over (partition by key, ts {DAY}, isle) as mx from x where out) group by key, ts {DAY}, isle having fired_ts is not null""")
def dislocation_scan(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of the quote's deviation from the trades, from 1 bps on, that reach 3 bps."""
    b = flow.basis(_basis_samples(spark, d), "coin", 20, 3).withColumnRenamed("coin", "key")
    return rounded(studies.dislocations(b, 3.0, 1.0), 4, "peak")


# --- barriers, simulations, sweeps -------------------------------------------------------------


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    b = bars.time_bars(trades(spark, d), "sym", 300_000)
    w = Window.partitionBy("sym").orderBy("ts")
    half = F.call_function("div", F.col("high8") - F.col("low8"), F.lit(20).cast("bigint"))
    return b.select("sym", "ts", (F.row_number().over(w) - 1).cast("bigint").alias("no"), F.col("close8").alias("mid8"), (F.col("close8") - half).alias("b8"), (F.col("close8") + half).alias("a8"), "buy8", "vol8")


NUMBERED = f"""{BARS5}, nb as (select sym, ts, row_number() over (partition by sym order by ts) - 1 as no, close8 as mid8, close8 - (high8 - low8) // 20 as b8, close8 + (high8 - low8) // 20 as a8, buy8, vol8 from tb),
  sg as (select sym, no, 2 * buy8 > vol8 as is_long from nb)"""
TB = f"""{NUMBERED}, x as (select sg.sym, sg.no, is_long, e.mid8 as e8, p.no as at_, p.mid8, p.b8, p.a8, max(p.no) over (partition by sg.sym, sg.no) as lastno
    from sg join nb e using (sym, no) join nb p on p.sym = sg.sym and p.no > sg.no and p.no <= sg.no + 12),
  y as (select *, case when is_long then 1 else -1 end as sd from x),
  z as (select sym, no, is_long, at_, case when (case when is_long then a8 else b8 end / e8 - 1) * 1e4 * sd >= 25 then 1 when (case when is_long then b8 else a8 end / e8 - 1) * 1e4 * sd <= -20 then 2 when at_ = lastno then 3 end as k, (mid8 / e8 - 1) * 1e4 * sd as m from y),
  bt as (select sym, no, is_long, min(at_) as exit_no, arg_min(k, at_) as k, arg_min(m, at_) as m from z where k is not null group by all)"""


@query(f"with {TB} select sym, no, is_long, exit_no, case k when 1 then 'target' when 2 then 'stop' else 'time' end as barrier, round(case k when 1 then 25.0 when 2 then -20.0 else m end, 4) + 0.0 as gross_bps from bt")
def barrier_triple(spark: SparkSession, d: str) -> DataFrame:
    """Every bar, with the bar's flow (even flow is short): target 25, stop 20 bps, 12 bars."""
    return rounded(_barriers(spark, d), 4, "gross_bps")


def _barriers(spark: SparkSession, d: str) -> DataFrame:
    n = _numbered(spark, d)
    s = n.select("sym", "no", (2 * F.col("buy8") > F.col("vol8")).alias("is_long"))
    return sim.triple_barrier(n, s, "sym", 12, 25.0, 20.0)


GREEDY = f"""{TB}, gt as (select bt.sym, a.ts as entry_ts, b.ts as exit_ts, bt.is_long, case bt.k when 1 then 'target' when 2 then 'stop' else 'time' end as barrier, case bt.k when 1 then 25.0 when 2 then -20.0 else bt.m end - 5 as x, a.ts {DAY} as day
    from bt join nb a on a.sym = bt.sym and a.no = bt.no join nb b on b.sym = bt.sym and b.no = bt.exit_no),
  gk as (select sym, day, min(entry_ts) as ts, arg_min(exit_ts, entry_ts) as e from gt group by all
    union all select n.sym, n.day, n.ts, n.e from (select k.sym, k.day, min(g.entry_ts) as ts, arg_min(g.exit_ts, g.entry_ts) as e from gk k join gt g on g.sym = k.sym and g.day = k.day and g.entry_ts > k.e group by k.sym, k.day, k.e) n)"""


@query(f"with recursive {GREEDY} select gt.sym, entry_ts, exit_ts, is_long, barrier, round(x, 4) + 0.0 as net_bps from gt join (select distinct sym, ts from gk) k on k.sym = gt.sym and k.ts = gt.entry_ts")
def grid_backtest(spark: SparkSession, d: str) -> DataFrame:
    """The barrier trades without overlap, net of 5 bps: one row each."""
    n = _numbered(spark, d).select("sym", "no", "ts")
    x = _barriers(spark, d).join(n, ["sym", "no"]).join(n.select("sym", F.col("no").alias("exit_no"), F.col("ts").alias("exit_ts")), ["sym", "exit_no"])
    x = x.select("sym", F.col("ts").alias("entry_ts"), "exit_ts", "is_long", "barrier", (F.col("gross_bps") - 5).alias("net_bps"))
    return rounded(sim.non_overlapping(x, "sym", "entry_ts", "exit_ts"), 4, "net_bps")


MOM = f"""{TB}, g as (select sym, case k when 1 then 25.0 when 2 then -20.0 else m end as x from bt),
  mo as (select sym, count(*) as n, avg(x) as mean, avg(x * x) as m2, avg(x ** 3) as m3, avg(x ** 4) as m4, avg((x > 0)::int::double) as win_rate, sum(x) as total, min(x) as worst, max(x) as best from g group by sym),
  ms as (select *, case when n >= 2 then sqrt(greatest(m2 - mean ** 2, 0)) else 0 end as std from mo),
  mt as (select *, case when std > 1e-12 then (m3 - 3 * mean * m2 + 2 * mean ** 3) / std ** 3 else 0 end as skew, case when std > 1e-12 then (m4 - 4 * mean * m3 + 6 * mean ** 2 * m2 - 3 * mean ** 4) / std ** 4 else 0 end as kurtosis,
    case when std > 1e-12 then mean / std else 0 end as sharpe, case when std > 1e-12 then mean / (std * sqrt(n / (n - 1.0)) / sqrt(n)) else 0 end as t from ms)"""


@query(f"""with {MOM} select sym, n, round(total, 4) + 0.0 as total, round(mean, 6) + 0.0 as mean, round(win_rate, 6) + 0.0 as win_rate, round(worst, 4) + 0.0 as worst, round(best, 4) + 0.0 as best, round(std, 5) + 0.0 as std, round(skew, 4) + 0.0 as skew, round(kurtosis, 4) + 0.0 as kurtosis, round(sharpe, 5) + 0.0 as sharpe, round(t, 4) + 0.0 as t from mt""")
def stat_moments(spark: SparkSession, d: str) -> DataFrame:
    m = stats.moments(_barriers(spark, d), ["sym"], "gross_bps")
    digits = {"total": 4, "mean": 6, "win_rate": 6, "worst": 4, "best": 4, "std": 5, "skew": 4, "kurtosis": 4, "sharpe": 5, "t": 4}
    return m.withColumns({k: F.round(k, v) for k, v in digits.items()})


CDF = lambda x: f"0.5 * (1 + {ERF(f'(({x}) / sqrt(2))')})"


@query(f"with {MOM} select sym, n, round(sharpe, 5) + 0.0 as sharpe, round(case when n >= 2 then {CDF('sharpe * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe ** 2, 1e-12))')} else 0 end, 4) + 0.0 as psr from mt where sharpe <> 0")
def stat_psr(spark: SparkSession, d: str) -> DataFrame:
    m = stats.moments(_barriers(spark, d), ["sym"], "gross_bps").where("sharpe <> 0")
    p = stats.probabilistic_sharpe(F.col("sharpe"), F.lit(0.0), F.col("n"), F.col("skew"), F.col("kurtosis"))
    return m.select("sym", "n", F.round("sharpe", 5).alias("sharpe"), F.round(p, 4).alias("psr"))


def _dsr(of: str) -> str:
    """CTEs ds: the rows of `of` with trials, benchmark and dsr."""
    return f"""dv as (select *, count(*) over () as trials, var_pop(sharpe) over () as vs from {of}),
  db as (select *, sqrt(vs) * ((1 - {stats.EULER}) * {_inverse("(1 - 1 / greatest(trials, 2))")} + {stats.EULER} * {_inverse("(1 - 1 / (greatest(trials, 2) * exp(1)))")}) as benchmark from dv),
  dz as (select *, (sharpe - benchmark) * sqrt(n - 1) / sqrt(greatest(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe ** 2, 1e-12)) as zz from db),
  ds as (select *, case when n >= 2 then {CDF("zz")} else 0 end as dsr from dz)"""


@query(f"with {MOM}, {_dsr('mt')} select sym, n, round(sharpe, 5) + 0.0 as sharpe, trials, round(vs, 7) + 0.0 as var_sharpe, round(benchmark, 5) + 0.0 as benchmark, round(dsr, 4) + 0.0 as dsr from ds")
def stat_dsr(spark: SparkSession, d: str) -> DataFrame:
    m = stats.moments(_barriers(spark, d), ["sym"], "gross_bps").withColumn("sweep", F.lit(1))
    x = stats.deflated_sharpe(m, ["sweep"]).select("sym", "n", "sharpe", "trials", "var_sharpe", "benchmark", "dsr")
    return x.withColumns({c: F.round(c, k) + F.lit(0.0) for c, k in (("sharpe", 5), ("var_sharpe", 7), ("benchmark", 5), ("dsr", 4))})


def _sweep_returns(spark: SparkSession, d: str) -> DataFrame:
    """Per hour of a day and symbol (the configurations) the hourly return in bps over the days and hours, densely numbered."""
    b = bars.time_bars(trades(spark, d), "sym", 3_600_000).select("sym", "ts", ((F.col("close8") / F.col("open8") - 1) * 1e4).alias("x"))
    w = Window.partitionBy("sym").orderBy("ts")
    return b.select(F.lit("hourly").alias("sweep"), F.col("sym").alias("config"), (F.row_number().over(w) - 1).alias("no"), "x")


PBO_TAIL = f"""hb as (select sym, ts // 3600000 * 3600000 as ts, (arg_max(p8, (ts, seq)) / arg_min(p8, (ts, seq)) - 1) * 1e4 as x from tr group by sym, tr.ts // 3600000),
  hn as (select sym, x, row_number() over (partition by sym order by ts) - 1 as no from hb), ht as (select min(k) as t, max(b) as s from (select min(k) as k from (select count(*) as k from hb group by sym)), (values (16), (12), (10), (8), (6), (4)) v(b) where k >= b),
  hk as (select sym, x, ((no + 1) * s - 1) // t as b from hn, ht where no < t),
  hs as (select sym, b, count(x) as n, sum(x) as s, sum(x * x) as q from hk group by all), ms_ as (select i from range(65536) t(i), ht where i < (1 << s) and bit_count(i) = s // 2),
  hp as (select sym, i, sum(case when (i >> b) & 1 = 1 then n else 0 end) as n1, sum(case when (i >> b) & 1 = 1 then s else 0 end) as s1, sum(case when (i >> b) & 1 = 1 then q else 0 end) as q1,
    sum(case when (i >> b) & 1 = 0 then n else 0 end) as n0, sum(case when (i >> b) & 1 = 0 then s else 0 end) as s0, sum(case when (i >> b) & 1 = 0 then q else 0 end) as q0 from hs, ms_ group by sym, i),
  hr as (select sym, i, case when q1 / greatest(n1, 1) - (s1 / greatest(n1, 1)) ** 2 > 1e-24 then s1 / greatest(n1, 1) / sqrt(q1 / greatest(n1, 1) - (s1 / greatest(n1, 1)) ** 2) else 0 end as a,
    case when q0 / greatest(n0, 1) - (s0 / greatest(n0, 1)) ** 2 > 1e-24 then s0 / greatest(n0, 1) / sqrt(q0 / greatest(n0, 1) - (s0 / greatest(n0, 1)) ** 2) else 0 end as o from hp),
  hw as (select *, row_number() over (partition by i order by a desc, sym) as best, count(*) over (partition by i order by o range unbounded preceding) as rk, count(*) over (partition by i) as cf from hr),
  hl as (select i, ln(rk / (cf + 1) / (1 - rk / (cf + 1))) as lg from hw where best = 1),
  hq as (select lg, row_number() over (order by lg) as nth, count(*) over () as k from hl),
  pb_ as (select 'hourly' as sweep, count(*) as splits, avg((lg <= 0)::int::double) as pbo, round(max(lg) filter (nth = k // 2 + 1), 6) + 0.0 as median_logit from hq)"""
PBO = f"{TRADES}, {PBO_TAIL}"


@query(f"with {PBO} select * from pb_")
def stat_pbo(spark: SparkSession, d: str) -> DataFrame:
    """Over as many blocks as fit the shortest symbol's hours, 16 at most."""
    return rounded(stats.overfit_probability(_sweep_returns(spark, d), "sweep", "config", "no", "x"), 6, "median_logit")


@query(f"""with {TRADES}, r as (select sym, q8, row_number() over (partition by sym order by q8) - 1 as i, count(*) over (partition by sym) as n from tr)
select sym, {", ".join(f"max(q8) filter (i = round({p} / 100.0 * (n - 1))) as p{p}" for p in (10, 50, 90, 99))} from r group by sym""")
def stat_percentile_nr(spark: SparkSession, d: str) -> DataFrame:
    return stats.nearest_rank(trades(spark, d), ["sym"], "q8", [10, 50, 90, 99])


@query(f"""with {TRADES} select sym, median(q8) as median, count(*) as n from tr group by sym""")
def stat_median(spark: SparkSession, d: str) -> DataFrame:
    """Exact medians, even numbers averaged."""
    t = trades(spark, d)
    return stats.median(t, ["sym"], "q8").join(t.groupBy("sym").agg(F.count("*").alias("n")), "sym")


@query(f"""with {BARS5}, e as (select sym, ts, cast(sum(2 * buy8 - vol8) over w as bigint) as eq from tb window w as (partition by sym order by ts)), p as (select *, greatest(max(eq) over (partition by sym order by ts), 0) - eq as dd from e)
select sym, arg_max(eq, ts) as net, max(dd) as max_drawdown, count(*) as n from p group by sym""")
def drawdown(spark: SparkSession, d: str) -> DataFrame:
    """Of the cumulative signed volume, as an equity curve."""
    b = bars.time_bars(trades(spark, d), "sym", 300_000).withColumn("x", 2 * F.col("buy8") - F.col("vol8"))
    return stats.drawdown(b, ["sym"], ["ts"], "x")


SIGNALS = f"{TB}, sv as (select sym, case k when 1 then 25.0 when 2 then -20.0 else m end as ret, 10.0 + no % 7 as expected from bt)"


@query(f"with {SIGNALS} select sym, count(*) as n, round(avg((ret > 0)::int::double), 6) + 0.0 as hit_rate, round(avg(ret), 5) + 0.0 as mean, round(median(ret), 5) + 0.0 as median, round(stddev_pop(ret), 5) + 0.0 as std, round(max(ret), 5) + 0.0 as best, round(min(ret), 5) + 0.0 as worst, round(avg(expected), 5) + 0.0 as expected, round(avg(ret) / avg(expected), 5) + 0.0 as realized from sv group by sym")
def eval_signals(spark: SparkSession, d: str) -> DataFrame:
    x = _barriers(spark, d).select("sym", F.col("gross_bps").alias("ret"), (F.col("no") % 7 + 10.0).alias("expected"))
    r = stats.signal_evaluation(x, ["sym"], "ret", "expected")
    return r.withColumns({c: F.round(c, 6 if c == "hit_rate" else 5) for c in r.columns if c not in ("sym", "n")})


@query(f"with {SIGNALS} select sym, count(*) as n, round(case when count(*) < 3 then 3.0 else greatest(sum(expected * abs(ret)) / sum(expected ** 2), 0) end, 5) + 0.0 as factor from sv group by sym")
def expected_move(spark: SparkSession, d: str) -> DataFrame:
    x = _barriers(spark, d).select("sym", F.col("gross_bps").alias("ret"), (F.col("no") % 7 + 10.0).alias("expected"))
    return rounded(stats.expected_move(x, ["sym"], "expected", "ret"), 5, "factor")


@query(f"with {TB} select bt.sym, nb.ts {DAY} as day, count(*) as trades, round(sum(case k when 1 then 25.0 when 2 then -20.0 else m end), 4) + 0.0 as net_bps, round(avg((case k when 1 then 25.0 when 2 then -20.0 else m end > 0)::int::double), 6) + 0.0 as win_rate from bt join nb using (sym, no) group by all")
def per_date(spark: SparkSession, d: str) -> DataFrame:
    n = _numbered(spark, d).select("sym", "no", F.call_function("div", F.col("ts"), F.lit(DAY_MS).cast("bigint")).alias("day"))
    g = _barriers(spark, d).join(n, ["sym", "no"]).groupBy("sym", "day")
    return g.agg(F.count("*").alias("trades"), F.round(F.sum("gross_bps"), 4).alias("net_bps"), F.round(F.avg((F.col("gross_bps") > 0).cast("double")), 6).alias("win_rate"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Barrier results per symbol and side as sweep cells."""
    n = _numbered(spark, d).select("sym", "no", F.call_function("div", F.col("ts"), F.lit(DAY_MS).cast("bigint")).alias("day"))
    x = _barriers(spark, d).join(n, ["sym", "no"]).withColumn("name", F.concat_ws("_", "sym", F.when(F.col("is_long"), "long").otherwise("short"), F.lit("01")))
    dd = stats.drawdown(x, ["name"], ["no"], "gross_bps").select("name", "max_drawdown")
    half = F.col("day") % 2 == 1
    return x.groupBy("name").agg(F.sum("gross_bps").alias("net"), F.sum(F.when(half, F.col("gross_bps")).otherwise(0.0)).alias("oos_net"), F.count_distinct("day").alias("dates"), F.count("*").alias("trips")).join(dd, "name")


CELLS = f"""{TB}, cx as (select bt.sym || case when is_long then '_long_01' else '_short_01' end as name, bt.no, case k when 1 then 25.0 when 2 then -20.0 else m end as x, nb.ts {DAY} as day from bt join nb on nb.sym = bt.sym and nb.no = bt.no),
  ce as (select *, sum(x) over (partition by name order by no) as eq from cx), cd as (select *, greatest(max(eq) over (partition by name order by no), 0) - eq as dd from ce),
  cl as (select name, sum(x) as net, sum(case when day % 2 = 1 then x else 0.0 end) as oos, count(distinct day) as dates, max(dd) as dd from cd group by name)"""


@query(f"""with {CELLS} select regexp_replace(regexp_replace(name, '_\\d+$', ''), '_(long|short)$', '') as family, count(*) as cells, round(max(net), 4) + 0.0 as best_net, round(min(dd), 4) + 0.0 as min_drawdown, round(max(oos), 4) + 0.0 as best_oos, max(dates) as dates,
  count(distinct regexp_extract(name, '_(long|short)_', 1)) as sides, max(net) > 0 and max(oos) > 0 and max(dates) >= 3 and count(distinct regexp_extract(name, '_(long|short)_', 1)) = 2 and min(dd) <= max(net) as promote from cl group by family""")
def family_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.family_rollup(_cells(spark, d)), 4, "best_net", "min_drawdown", "best_oos")


NAMED = MOM.replace("g as (select sym, case", "g as (select sym || case when is_long then '_long' else '_short' end as sym, case")


@query(f"""with {NAMED}, {PBO_TAIL}, {_dsr('mt')} select sym as name, n, round(total, 4) + 0.0 as total, round(sharpe, 5) + 0.0 as sharpe, round(dsr, 4) + 0.0 as dsr, pbo,
  case when total <= 0 or n < {stats.MIN_TRIPS} or dsr < {stats.RETIRE_DSR} then 'retire' when dsr >= {stats.PROMOTE_DSR} and pbo <= {stats.PROMOTE_PBO} then 'promote' when dsr >= {stats.PARK_DSR} and pbo <= {stats.PARK_PBO} then 'park' else 'retire' end as verdict from ds, pb_""")
def sweep_report(spark: SparkSession, d: str) -> DataFrame:
    """Cells with their deflated Sharpe, the sweep's overfitting probability and the verdict."""
    x = _barriers(spark, d).withColumn("name", F.concat_ws("_", "sym", F.when(F.col("is_long"), "long").otherwise("short")))
    m = stats.deflated_sharpe(stats.moments(x, ["name"], "gross_bps").withColumn("sweep", F.lit("hourly")), ["sweep"])
    p = stats.overfit_probability(_sweep_returns(spark, d), "sweep", "config", "no", "x").select("sweep", "pbo")
    r = lambda c, k: (F.round(c, k) + F.lit(0.0)).alias(c)
    pbo = F.coalesce("pbo", F.lit(1.0))  # a sweep too short for one promotes nothing
    return m.join(F.broadcast(p), "sweep", "left").select("name", "n", r("total", 4), r("sharpe", 5), r("dsr", 4), "pbo", stats.verdict(F.col("total"), F.col("n"), F.col("dsr"), pbo).alias("verdict"))


@query(f"""with {TRADES}, g as (select sym, make_date(cast(ts {DAY} as integer)) as date, ts // 300000 as b from tr), k as (select sym, date, count(distinct b) as k from g group by all),
x as (select *, row_number() over (partition by sym order by date) - 1 as no, count(*) over (partition by sym) as nd, sum(k) over (partition by sym order by date) as en, sum(k) over (partition by sym) as bars from k),
f as (select sym, least(no // greatest(nd // 2, 1), 1) as fold, min(en - k) as a, max(en) as b, max(bars) as bars from x group by all)
select sym, fold, cast(a as bigint) as oos_from, cast(b as bigint) as oos_to, cast(greatest(a - 5, 0) as bigint) as is_left_to, cast(least(b + 5, bars) as bigint) as is_right_from, cast(bars as bigint) as bars from f""")
def purged_folds(spark: SparkSession, d: str) -> DataFrame:
    b = bars.time_bars(trades(spark, d), "sym", 300_000).withColumn("date", F.date_from_unix_date(F.call_function("div", F.col("ts"), F.lit(DAY_MS).cast("bigint")).cast("int")))
    return stats.purged_folds(b, "sym", 2, 5)


@query(f"""with {TB}, g as (select sym, no, case k when 1 then 25.0 when 2 then -20.0 else m end <= 0 as l from bt), i as (select *, row_number() over w - sum(l::int) over w as isle from g window w as (partition by sym order by no)),
r as (select sym, isle, sum(l::int) as run, sum((not l)::int) as wins from i group by all) select sym, cast(max(run) as bigint) as max_losses, cast(sum(wins) as bigint) as wins, cast(sum(run) as bigint) as losses from r group by sym""")
def losing_streaks(spark: SparkSession, d: str) -> DataFrame:
    return stats.losing_streaks(_barriers(spark, d), ["sym"], ["no"], "gross_bps")


GRID = [{"hold_ms": h, "latency_ms": lat, "threshold": th} for h in (300_000, 900_000) for lat in (0, 300) for th in (0.3, 0.6)]


@query("""select cast(row_number() over (order by h, l, t) - 1 as integer) as config_id, h as hold_ms, l as latency_ms, t as threshold from (values (300000), (900000)) a(h), (values (0), (300)) b(l), (values (0.3::double), (0.6::double)) c(t)""")
def sweep_grid_expand(spark: SparkSession, d: str) -> DataFrame:
    """The grid in a fixed order, its position as id."""
    ax = lambda name, vals, kind: spark.createDataFrame([(v,) for v in vals], f"{name} {kind}")
    g = ax("hold_ms", [300_000, 900_000], "int").join(F.broadcast(ax("latency_ms", [0, 300], "int")), how="cross").join(F.broadcast(ax("threshold", [0.3, 0.6], "double")), how="cross")
    w = Window.orderBy("hold_ms", "latency_ms", "threshold")
    return g.select((F.row_number().over(w) - 1).alias("config_id"), "hold_ms", "latency_ms", "threshold")


def _sim_events(spark: SparkSession, d: str) -> DataFrame:
    """Trades with the quote at each and the rolling flow ratio as what signals see."""
    q = _quoted_trades(spark, d).where("b8 is not null")
    w = flow.session("coin").rowsBetween(-19, 0)
    net, all_ = F.sum(F.col("sgn") * F.col("q8")).over(w), F.sum("q8").over(w)
    return q.select("coin", "ts", "seq", "b8", "a8", M.ratio(net, all_).alias("x"))


def _flow_signal(config: dict, key: str, day: int):
    return lambda e: 1 if e[3] >= config["threshold"] else -1 if e[3] <= -config["threshold"] else 0


def _coin_signal(config: dict, key: str, day: int):
    coin = sim.Coin(sim.splitmix64(day ^ sum(key.encode())))
    return lambda e: coin.side() if coin.next() % 50 == 0 else 0


@query()
def sim_flow_thesis(spark: SparkSession, d: str) -> DataFrame:
    """Trips of the flow thesis over the grid."""
    return sim.simulate(_sim_events(spark, d), "coin", GRID, _flow_signal)


@query()
def sim_coinflip(spark: SparkSession, d: str) -> DataFrame:
    """Trips of the coin-flip control: it must lose about its fees."""
    return sim.simulate(_sim_events(spark, d), "coin", [{"hold_ms": 300_000}], _coin_signal)


@query()
def knob_bite(spark: SparkSession, d: str) -> DataFrame:
    """Whether the latency and holding knobs of the sweep change anything."""
    grid = sweep_grid_expand(spark, d)
    trips = sim.simulate(_sim_events(spark, d), "coin", GRID, _flow_signal)
    r = trips.groupBy("config_id").agg(F.count("*").alias("trips"), F.sum("pnl8").alias("pnl8"), F.sum(F.col("close_ts") % 1_000_003).alias("ts_sum"))
    x = grid.join(r, "config_id", "left").fillna(0)
    return stats.knob_bite(x, ["threshold", "hold_ms", "latency_ms"], "latency_ms", ["trips", "pnl8", "ts_sum"])


@query()
def paper_account(spark: SparkSession, d: str) -> DataFrame:
    """The flow thesis' first configuration on a compounding account per coin."""
    t = sim.simulate(_sim_events(spark, d), "coin", GRID[:1], _flow_signal).withColumn("ret", F.col("pnl8") / F.col("notional8"))
    return sim.paper_accounts(t, "coin", "close_ts", "ret")
