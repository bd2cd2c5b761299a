"""Queries over the anomaly engine, quoting, predicates, and the file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import market as M
from tapeloom.functions.clean import DAY_MS
from tapeloom.operators import anomaly, bars, maker
from tapeloom.plans.base import TRADES, instruments, quotes, trades
from tapeloom.plans.flow import BARS5, DAY, FEATURES, _bar_features
from tapeloom.sources.files import synthetic_events

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _events(spark: SparkSession, d: str) -> DataFrame:
    f = _bar_features(spark, d)
    z = bars.zscores(f, "coin", FEATURES, 20)
    fdr = bars.false_discovery(z, "coin", [f"z_{c}" for c in FEATURES], 0.2).where("discovered")
    x = fdr.join(f.select("coin", "ts", F.col("ofi8").alias("flow"), (F.col("ask_vacuum") - F.col("bid_vacuum")).alias("vac")), ["coin", "ts"])
    x = x.withColumns({"confidence": anomaly.event_confidence(F.col("z"), F.lit(2.0)), "direction": anomaly.event_direction(F.col("kind"), F.col("z"), F.col("flow"), F.col("vac"))})
    return x.select("coin", "ts", "kind", "z", "confidence", "direction")


@query()
def anomaly_events(spark: SparkSession, d: str) -> DataFrame:
    """Discovered anomalies with confidence and direction."""
    return _events(spark, d)


def _signals(spark: SparkSession, d: str) -> DataFrame:
    dist = bars.mahalanobis(_bar_features(spark, d), "coin", FEATURES, 20)
    return anomaly.compose_signals(_events(spark, d), dist, "coin", 0.1, 1.0)


@query()
def anomaly_signals(spark: SparkSession, d: str) -> DataFrame:
    return _signals(spark, d)


def _numbered(x: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key, F.col("ts") - F.pmod("ts", F.lit(DAY_MS))).orderBy("ts")
    return x.withColumn("no", F.row_number().over(w).cast("bigint"))


@query()
def anomaly_rate_gate(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.rate_limited(_numbered(_signals(spark, d), "coin").select("coin", "ts", "no", "side"), "coin", 50, 4.0)


@query()
def pattern_counter(spark: SparkSession, d: str) -> DataFrame:
    """Repeated sequences of the strongest anomaly of each bar, of volume or trade count."""
    z = bars.zscores(bars.time_bars(trades(spark, d), "sym", 300_000), "sym", ["vol8", "trades"], 20)
    kinds = F.filter(F.array(*[F.struct(F.abs(c).alias("s"), F.lit(k).alias("k"), (F.col(c) > 0).cast("int").alias("up")) for k, c in enumerate(("z_vol8", "z_trades"))]), lambda x: x["s"] >= 1.0)
    top = _numbered(z, "sym").withColumn("kinds", kinds).where(F.size("kinds") > 0).withColumn("top", F.array_max("kinds"))
    strength = F.when(F.col("top.s") < 1.6, 0).when(F.col("top.s") < 2.5, 1).otherwise(2)
    mean = F.aggregate("kinds", F.lit(0.0), lambda a, x: a + x["s"]) / F.size("kinds")
    return anomaly.repeated_patterns(top.select("sym", "ts", "no", F.col("top.k").alias("kind_no"), (F.col("top.up") * 3 + strength).alias("tag"), mean.alias("avg_z")), "sym", 8)


@query()
def causal_absorption(spark: SparkSession, d: str) -> DataFrame:
    """Pressure, absorption, deceleration over five-minute bars."""
    b = bars.time_bars(trades(spark, d), "sym", 300_000)
    w = Window.partitionBy("sym", F.col("ts") - F.pmod("ts", F.lit(DAY_MS))).orderBy("ts")
    push = M.ratio(2 * F.col("buy8") - F.col("vol8"), F.col("vol8"))
    ret = (F.col("close8") / F.lag("close8").over(w) - 1) * 1e4
    x = _numbered(b, "sym").withColumns({"push": push, "ret": F.coalesce(ret, F.lit(0.0))})
    against = F.when(F.signum("push") * F.col("ret") <= 2, F.abs("push") * 2).otherwise(0.0)
    return anomaly.causal_absorption(x.select("sym", "ts", "no", "push", against.alias("absorb"), F.abs("ret").alias("speed")), "sym", 6, 0.3, 0.4)


@query()
def maker_quoter(spark: SparkSession, d: str) -> DataFrame:
    """Fills of a quoter around the quote mid."""
    q = quotes(spark, d).select("coin", "ts", "seq", F.lit("quote").alias("kind"), F.col("b8").alias("a"), F.col("a8").alias("b"), F.lit(0).alias("sgn"))
    t = trades(spark, d).join(instruments(spark, d), "sym").select("coin", "ts", "seq", F.lit("trade").alias("kind"), F.col("p8").alias("a"), F.col("q8").alias("b"), "sgn")
    return maker.run_quoter(q.unionByName(t), "coin", maker.QuoteConfig(offset_bps=0.5))


# Entry predicates: name, column, operator, threshold; one plan for all of them.
PREDICATES = [
    ("cvd_delta_short", "delta", ">", 0.4), ("cvd_delta_long", "delta", "<", -0.4), ("aggressor_long", "aggressor", ">", 0.7), ("aggressor_short", "aggressor", "<", 0.3),
    ("intensity_long", "intensity", ">", 5.0), ("range_short", "range_bps", ">", 30.0), ("range_absorb", "range_bps", "<", 1.0),
]


@query(f"""with {BARS5}, f as (select sym, ts, (2 * buy8 - vol8) / vol8 as delta, buy8 / vol8 as aggressor, least(20.0, trades * 1e8 / vol8) as intensity, (high8 - low8) / low8 * 1e4 as range_bps from tb),
u as (select * from f unpivot (v for col in (delta, aggressor, intensity, range_bps))),
p(name, col, op, threshold) as (values {", ".join(f"('{n}', '{c}', '{o}', {t})" for n, c, o, t in PREDICATES)})
select sym, ts, name, regexp_matches(name, '_long|_buy|_absorb|_discount') as is_long from u join p using (col) where case op when '>' then v > threshold else v < threshold end""")
def grid_predicates(spark: SparkSession, d: str) -> DataFrame:
    """All bar predicates as one join of the unpivoted bars with a small table of rules."""
    b = bars.time_bars(trades(spark, d), "sym", 300_000)
    f = b.select("sym", "ts", M.ratio(2 * F.col("buy8") - F.col("vol8"), F.col("vol8")).alias("delta"), M.ratio(F.col("buy8"), F.col("vol8")).alias("aggressor"), F.least(F.lit(20.0), M.ratio(F.col("trades") * 1e8, F.col("vol8"))).alias("intensity"), ((F.col("high8") - F.col("low8")) / F.col("low8") * 1e4).alias("range_bps"))
    u = f.unpivot(["sym", "ts"], ["delta", "aggressor", "intensity", "range_bps"], "col", "v")
    p = F.broadcast(spark.createDataFrame(PREDICATES, "name string, col string, op string, threshold double"))
    hit = F.when(F.col("op") == ">", F.col("v") > F.col("threshold")).otherwise(F.col("v") < F.col("threshold"))
    return u.join(p, "col").where(~F.isnan("v") & hit).select("sym", "ts", "name", F.col("name").rlike("_long|_buy|_absorb|_discount").alias("is_long"))


@query(f"""with {BARS5}, n as (select sym, ts, close8, row_number() over (partition by sym, ts {DAY} order by ts) - 1 as no from tb)
select sym, ts, no, (row_number() over (partition by sym, ts {DAY} order by ts) - 1) % 2 = 0 as is_long from n where no % 7 = 0""")
def null_random_entries(spark: SparkSession, d: str) -> DataFrame:
    """The control: every seventh bar, sides in turn."""
    n = _numbered(bars.time_bars(trades(spark, d), "sym", 300_000), "sym").withColumn("no", F.col("no") - 1).where("no % 7 = 0")
    w = Window.partitionBy("sym", F.col("ts") - F.pmod("ts", F.lit(DAY_MS))).orderBy("ts")
    return n.select("sym", "ts", "no", ((F.row_number().over(w) - 1) % 2 == 0).alias("is_long"))


@query(f"""with {TRADES} select sym, cast(sum(q8) as bigint) as vol8, count(*) as n from tr group by sym order by vol8 desc, sym limit 10""")
def top_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The ten symbols with the most volume: a top-k report."""
    return trades(spark, d).groupBy("sym").agg(F.sum("q8").alias("vol8"), F.count("*").alias("n")).orderBy(F.desc("vol8"), "sym").limit(10)


@query(f"""with {TRADES} select case when grouping(sym) = 1 then 'all' else sym end as sym, case when grouping(day) = 1 then -1 else day end as day, count(*) as n, cast(sum(q8) as bigint) as vol8
from (select *, ts {DAY} as day from tr) group by grouping sets ((sym, day), (sym), ())""")
def pooled_report(spark: SparkSession, d: str) -> DataFrame:
    """Volume per symbol and day, per symbol and in all, in one pass."""
    t = trades(spark, d).withColumn("day", F.call_function("div", F.col("ts"), F.lit(DAY_MS).cast("bigint")))
    g = t.groupingSets([["sym", "day"], ["sym"], []], "sym", "day").agg(F.count("*").alias("n"), F.sum("q8").alias("vol8"), F.grouping("sym").alias("gs"), F.grouping("day").alias("gd"))
    return g.select(F.when(F.col("gs") == 1, "all").otherwise(F.col("sym")).alias("sym"), F.when(F.col("gd") == 1, -1).otherwise(F.col("day")).alias("day"), "n", "vol8")


@query()
def synthetic_tape(spark: SparkSession, d: str) -> DataFrame:
    return synthetic_events(spark, 20_000, 7)
