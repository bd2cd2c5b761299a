"""Performance and overfitting statistics over trips, returns and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.market import normal_cdf, normal_inverse, ratio

# Euler's constant and the verdict's thresholds.
EULER = 0.5772156649015329
MIN_TRIPS, RETIRE_DSR, PROMOTE_DSR, PROMOTE_PBO, PARK_DSR, PARK_PBO = 30, 0.5, 0.9, 0.3, 0.6, 0.5
BLOCKS = (16, 12, 10, 8, 6, 4)


def moments(rows: DataFrame, key: list[str], x: str) -> DataFrame:
    """n, total, mean, std (population), skew, kurtosis (not excess), sharpe, win_rate, t; 0 where undefined."""
    g = rows.groupBy(*key).agg(
        F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.avg(F.col(x) * F.col(x)).alias("m2"), F.avg(F.col(x) ** 3).alias("m3"), F.avg(F.col(x) ** 4).alias("m4"),
        F.avg((F.col(x) > 0).cast("double")).alias("win_rate"), F.min(x).alias("worst"), F.max(x).alias("best"),
    )
    c = F.col
    var = F.greatest(c("m2") - c("mean") ** 2, F.lit(0.0))
    g = g.withColumn("std", F.when(c("n") >= 2, F.sqrt(var)).otherwise(0.0))
    ok = c("std") > 1e-12
    third = c("m3") - 3 * c("mean") * c("m2") + 2 * c("mean") ** 3
    fourth = c("m4") - 4 * c("mean") * c("m3") + 6 * c("mean") ** 2 * c("m2") - 3 * c("mean") ** 4
    return g.withColumns({
        "skew": F.when(ok, third / c("std") ** 3).otherwise(0.0), "kurtosis": F.when(ok, fourth / c("std") ** 4).otherwise(0.0), "sharpe": F.when(ok, c("mean") / c("std")).otherwise(0.0),
        "t": F.when(ok, c("mean") / (c("std") * F.sqrt(c("n") / (c("n") - 1.0)) / F.sqrt("n"))).otherwise(0.0),
    }).drop("m2", "m3", "m4")


def probabilistic_sharpe(sharpe: Column, benchmark: Column, n: Column, skew: Column, kurtosis: Column) -> Column:
    spread = F.greatest(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2, F.lit(1e-12))
    return F.when(n >= 2, normal_cdf((sharpe - benchmark) * F.sqrt(n - 1) / F.sqrt(spread))).otherwise(0.0)


def expected_max_sharpe(variance: Column, n: Column) -> Column:
    """What the best of n skill-less trials is expected to show."""
    n = F.greatest(n, F.lit(2)).cast("double")
    return F.sqrt(variance) * ((1 - EULER) * normal_inverse(1 - 1 / n) + EULER * normal_inverse(1 - 1 / (n * F.exp(F.lit(1.0)))))


def deflated_sharpe(summary: DataFrame, sweep: list[str]) -> DataFrame:
    """dsr of each configuration of a sweep, from moments(); the benchmark is the sweep's expected maximum."""
    w = Window.partitionBy(*sweep)
    x = summary.withColumns({"trials": F.count("*").over(w), "var_sharpe": F.var_pop("sharpe").over(w)})
    bench = expected_max_sharpe(F.col("var_sharpe"), F.col("trials"))
    return x.withColumn("benchmark", bench).withColumn("dsr", probabilistic_sharpe(F.col("sharpe"), F.col("benchmark"), F.col("n"), F.col("skew"), F.col("kurtosis")))


def fitting_blocks(n: Column) -> Column:
    """The largest block number of which n rows fill every block, or null."""
    return F.coalesce(*[F.when(n >= b, F.lit(b)) for b in BLOCKS])


def overfit_probability(rows: DataFrame, sweep: str, config: str, order: str, x: str, blocks: int | None = None) -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation: sweep, splits, pbo, logit (upper median).

    rows: x per sweep, config and order (a dense number per config); the shortest config's length counts. Each half of the
    blocks picks its best configuration by Sharpe; its rank out of sample says whether it held. Without a number of blocks
    the sweep has the largest that fits; sweeps of less than two configs or rows than blocks have no result. Only block
    sums are joined with the C(blocks, blocks/2) masks (12,870 at most), so the cost does not depend on the number of rows.
    """
    spark = rows.sparkSession
    n = rows.groupBy(sweep, config).agg((F.max(order) + 1).alias("n__")).groupBy(sweep).agg(F.min("n__").alias("t__"), F.count("*").alias("k__"))
    n = n.withColumn("blocks__", fitting_blocks(F.col("t__")) if blocks is None else F.when(F.col("t__") >= blocks, F.lit(blocks))).where("blocks__ is not null and k__ > 1").drop("k__")
    block = F.call_function("div", (F.col(order) + 1) * F.col("blocks__") - 1, F.col("t__")).cast("int")
    sums = rows.join(F.broadcast(n), sweep).where(F.col(order) < F.col("t__")).withColumn("block__", block)
    sums = sums.groupBy(sweep, config, "blocks__", "block__").agg(F.count(x).alias("n__"), F.sum(x).alias("s__"), F.sum(F.col(x) * F.col(x)).alias("q__"))
    sizes = BLOCKS if blocks is None else (blocks,)
    mask = spark.range(1 << max(sizes)).select(F.col("id").cast("int").alias("split__"), F.explode(F.array(*[F.lit(b) for b in sizes])).alias("blocks__"))
    mask = mask.where((F.expr("shiftright(split__, blocks__)") == 0) & (F.bit_count("split__") * 2 == F.col("blocks__")))
    each = sums.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), sweep, config).join(F.broadcast(mask), "blocks__").withColumn("inside__", F.expr("shiftright(split__, block__) & 1 = 1"))

    def sharpe(inside: bool) -> Column:
        part = lambda c: F.sum(F.when(F.col("inside__") == inside, F.col(c)).otherwise(0))
        mean = part("s__") / F.greatest(part("n__"), F.lit(1))
        var = F.greatest(part("q__") / F.greatest(part("n__"), F.lit(1)) - mean**2, F.lit(0.0))
        return F.when(var > 1e-24, mean / F.sqrt(var)).otherwise(0.0)

    each = each.groupBy(sweep, "split__", config).agg(sharpe(True).alias("i__"), sharpe(False).alias("o__"))
    w = Window.partitionBy(sweep, "split__")
    ranked = each.withColumns({"best": F.row_number().over(w.orderBy(F.desc("i__"), config)), "rank": F.count("*").over(w.orderBy("o__").rangeBetween(Window.unboundedPreceding, 0)), "configs": F.count("*").over(w)})
    share = F.col("rank") / (F.col("configs") + 1)
    logit = ranked.where("best = 1").withColumn("logit", F.ln(share / (1 - share)))
    nth = F.row_number().over(Window.partitionBy(sweep).orderBy("logit", "split__"))
    k = F.count("*").over(Window.partitionBy(sweep))
    z = logit.withColumns({"nth__": nth, "k__": k})
    return z.groupBy(sweep).agg(F.count("*").alias("splits"), F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.max(F.when(F.col("nth__") == F.floor(F.col("k__") / 2) + 1, F.col("logit"))).alias("median_logit"))


def verdict(net: Column, trips: Column, dsr: Column, pbo: Column) -> Column:
    return (
        F.when((net <= 0) | (trips < MIN_TRIPS) | (dsr < RETIRE_DSR), "retire")
        .when((dsr >= PROMOTE_DSR) & (pbo <= PROMOTE_PBO), "promote")
        .when((dsr >= PARK_DSR) & (pbo <= PARK_PBO), "park")
        .otherwise("retire")
    )


def exact_ranks(rows: DataFrame, key: list[str], x: str, wanted: dict[str, Column]) -> DataFrame:
    """The values at given indexes (0 is the smallest) of each group's order, exact, one column per name in wanted.

    wanted: expressions over n__, the group's rows. Two levels of counts: 64 buckets per octave of |x| find each index's
    bucket, and only that bucket's values are counted one by one. No group is sorted or gathered as a whole. x is
    numeric; nulls and NaN are left out.
    """
    v = F.col(x)
    octave = F.floor(F.log2(1 + F.abs(v.cast("double"))) * 64).cast("int")
    r = rows.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*key, v.alias("x__"), F.when(v < 0, -1 - octave).otherwise(octave).alias("b__"))
    c = r.groupBy(*key, "b__").agg(F.count("*").alias("k__"))
    w = Window.partitionBy(*key).orderBy("b__")
    c = c.withColumns({"from__": F.coalesce(F.sum("k__").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n__": F.sum("k__").over(Window.partitionBy(*key))})
    asks = F.array(*[F.struct(F.lit(name).alias("name__"), i.cast("bigint").alias("i__")) for name, i in wanted.items()])
    hits = c.select(*key, "b__", "k__", "from__", F.inline(asks)).where((F.col("i__") >= F.col("from__")) & (F.col("i__") < F.col("from__") + F.col("k__")))
    inside = r.join(hits.select(*key, "b__").distinct(), [*key, "b__"], "left_semi").groupBy(*key, "b__", "x__").agg(F.count("*").alias("m__"))
    up = F.sum("m__").over(Window.partitionBy(*key, "b__").orderBy("x__").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("upto__", up).join(hits, [*key, "b__"])
    at = F.col("i__") - F.col("from__")
    found = found.where((F.col("upto__") > at) & (F.col("upto__") - F.col("m__") <= at))
    return found.groupBy(*key).agg(*[F.max(F.when(F.col("name__") == name, F.col("x__"))).alias(name) for name in wanted])


def nearest_rank(rows: DataFrame, key: list[str], x: str, percents: list[int]) -> DataFrame:
    """The values at index round(p/100 (n-1)) of each group's order, one column p{percent} each."""
    return exact_ranks(rows, key, x, {f"p{p}": F.round(F.lit(p) / 100 * (F.col("n__") - 1)) for p in percents})


def median(rows: DataFrame, key: list[str], x: str) -> DataFrame:
    """The exact median of each group, the middle two averaged."""
    half = {"lo__": F.floor((F.col("n__") - 1) / 2), "hi__": F.ceil((F.col("n__") - 1) / 2)}
    return exact_ranks(rows, key, x, half).select(*key, ((F.col("lo__") + F.col("hi__")) / 2).alias("median"))


def drawdown(equity: DataFrame, key: list[str], order: list[str], x: str) -> DataFrame:
    """Final equity and the largest fall from a running peak (which starts at 0)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = equity.withColumn("eq", F.sum(x).over(w))
    e = e.withColumn("dd", F.greatest(F.max("eq").over(w), F.lit(0)) - F.col("eq"))
    return e.groupBy(*key).agg(F.max_by("eq", F.struct(*order)).alias("net"), F.max("dd").alias("max_drawdown"), F.count("*").alias("n"))


def signal_evaluation(signals: DataFrame, key: list[str], ret: str, expected: str) -> DataFrame:
    """How signed returns compare with what was expected: hit rate, mean, median, std, best, worst, realized share."""
    g = signals.groupBy(*key).agg(F.count(ret).alias("n"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"), F.avg(ret).alias("mean"), F.percentile(ret, 0.5).alias("median"), F.stddev_pop(ret).alias("std"), F.max(ret).alias("best"), F.min(ret).alias("worst"), F.avg(expected).alias("expected"))
    return g.withColumn("realized", ratio(F.col("mean"), F.col("expected")))


def expected_move(signals: DataFrame, key: list[str], size: str, ret: str) -> DataFrame:
    """The factor that maps a signal's size to the move that follows: 3 with fewer than 3 signals or sizes of 0 only, never negative."""
    g = signals.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col(size) * F.abs(ret)).alias("a"), F.sum(F.col(size) ** 2).alias("b"))
    return g.select(*key, "n", F.when(F.col("n") < 3, 3.0).otherwise(F.when(F.col("b") > 1e-12, F.greatest(F.col("a") / F.col("b"), F.lit(0.0))).otherwise(3.0)).alias("factor"))


def separation(rows: DataFrame, key: list[str], signal: Column, outcome: Column) -> DataFrame:
    """P(outcome | signal) against P(outcome | no signal), with the counts."""
    y = outcome.cast("double")
    return rows.groupBy(*key).agg(F.count_if(signal).alias("with_signal"), F.count_if(~signal).alias("without"), F.avg(F.when(signal, y)).alias("p_with"), F.avg(F.when(~signal, y)).alias("p_without"), F.avg(y).alias("p_all"))


def family_rollup(cells: DataFrame) -> DataFrame:
    """Families of configurations, numbers and side suffixes stripped from their names; promoted if both sides, three dates, profit and drawdown agree."""
    family = F.regexp_replace(F.regexp_replace("name", r"_\d+$", ""), r"_(long|short|buy|sell)$", "")
    side = F.when(F.col("name").rlike(r"_(long|buy)(_\d+)?$"), "long").when(F.col("name").rlike(r"_(short|sell)(_\d+)?$"), "short")
    g = cells.groupBy(family.alias("family")).agg(F.count("*").alias("cells"), F.max("net").alias("best_net"), F.min("max_drawdown").alias("min_drawdown"), F.max("oos_net").alias("best_oos"), F.max("dates").alias("dates"), F.count_distinct(side).alias("sides"))
    good = (F.col("best_net") > 0) & (F.col("best_oos") > 0) & (F.col("dates") >= 3) & (F.col("sides") == 2) & (F.col("min_drawdown") <= F.col("best_net"))
    return g.withColumn("promote", good)


def knob_bite(runs: DataFrame, axes: list[str], axis: str, fingerprint: list[str]) -> DataFrame:
    """Whether changing one knob, the others held, changed anything: the fingerprint against that of the next lower setting."""
    fp = F.struct(*fingerprint)
    w = Window.partitionBy(*[a for a in axes if a != axis]).orderBy(axis)
    return runs.withColumns({"fp": fp, "before": F.lag(fp).over(w)}).select(*axes, F.when(F.col("before").isNull(), F.lit(None)).otherwise(~F.col("fp").eqNullSafe(F.col("before"))).alias("bites"))


def purged_folds(bars: DataFrame, key: str, folds: int, purge: int) -> DataFrame:
    """Per fold the out-of-sample bar range and the in-sample ranges at `purge` bars from it, folds by whole dates."""
    w = Window.partitionBy(key)
    dates = bars.groupBy(key, "date").agg(F.count("*").alias("k__"))
    d = dates.withColumns({"no": F.row_number().over(w.orderBy("date")) - 1, "n_dates": F.count("*").over(w), "end": F.sum("k__").over(w.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)), "bars": F.sum("k__").over(w)})
    per = F.greatest(F.call_function("div", F.col("n_dates"), F.lit(folds).cast("bigint")), F.lit(1))
    fold = F.least(F.call_function("div", F.col("no").cast("bigint"), per), F.lit(folds - 1))
    g = d.groupBy(key, fold.alias("fold")).agg(F.min(F.col("end") - F.col("k__")).alias("oos_from"), F.max("end").alias("oos_to"), F.max("bars").alias("bars"))
    return g.select(key, "fold", "oos_from", "oos_to", F.greatest(F.col("oos_from") - purge, F.lit(0)).alias("is_left_to"), F.least(F.col("oos_to") + purge, F.col("bars")).alias("is_right_from"), "bars")


def losing_streaks(trips: DataFrame, key: list[str], order: list[str], x: str) -> DataFrame:
    """The longest run of losses by gaps and islands, and the counts of wins and losses."""
    w = Window.partitionBy(*key).orderBy(*order)
    loss = (F.col(x) <= 0).cast("int")
    t = trips.withColumns({"loss": loss, "isle": F.row_number().over(w) - F.sum(loss).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    runs = t.groupBy(*key, "isle").agg(F.sum("loss").alias("run"), F.sum(1 - F.col("loss")).alias("wins"))
    return runs.groupBy(*key).agg(F.max("run").alias("max_losses"), F.sum("wins").alias("wins"), F.sum("run").alias("losses"))


def floor_ranks(rows: DataFrame, key: list[str], x: str) -> DataFrame:
    """Mean and the values at index n/10, n/2 and 9n/10 (rounded down) of each group's order."""
    at = {"p10": F.floor(F.col("n__") / 10), "med": F.floor(F.col("n__") / 2), "p90": F.floor(F.col("n__") * 9 / 10)}
    return exact_ranks(rows, key, x, at).join(rows.groupBy(*key).agg(F.avg(x).alias("mean")), key)
