"""Limit orders: taken at once if they cross the book, else resting behind what the book shows at their price."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.asof import range_join


def place_limits(orders: DataFrame, levels: DataFrame, trades: DataFrame, life_ms: int) -> DataFrame:
    """What becomes of each order: id, key, ts, placed ('taker', 'rested', 'rejected'), taken8, avg8, ahead8, filled8, first_ts, done_ts.

    orders: id, key, ts, is_bid, p8, q8; levels: key, ts, side, p8, q8 of the book at the orders' ts; trades: key, ts, seq, p8, q8, sgn.
    An order that crosses takes the other side's levels up to its price, best first, for as much as they hold; the rest is
    not placed. One that does not rests behind the quantity at its price (ahead8); trades of the opposite aggressor at its price
    or through it, later than ts and for life_ms, first use up the queue, then fill it. Without a book at ts: 'rejected'.
    Null values in an order: it is ignored. Orders are known by id, which must be unique.

    Plan: the books are joined on (key, ts), the trades by buckets of life_ms; running sums are per order.
    """
    o = orders.select("id", "key", "ts", "is_bid", "p8", "q8").dropna()
    book = levels.select("key", "ts", F.col("side").alias("s"), F.col("p8").alias("lp"), F.col("q8").alias("lq"))
    at = o.join(book, ["key", "ts"], "left")
    other = F.when(F.col("is_bid"), F.col("s") == "ask").otherwise(F.col("s") == "bid")
    cross = other & F.when(F.col("is_bid"), F.col("lp") <= F.col("p8")).otherwise(F.col("lp") >= F.col("p8"))
    best = Window.partitionBy("id").orderBy(F.when(F.col("is_bid"), F.col("lp")).otherwise(-F.col("lp")), "lp", "s")
    crossing = F.when(cross, F.col("lq")).otherwise(0)
    at = at.withColumn("before", F.coalesce(F.sum(crossing).over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    take = F.greatest(F.least(crossing, F.col("q8") - F.col("before")), F.lit(0))
    own = ~other & (F.col("lp") == F.col("p8"))
    placed = at.groupBy("id", "key", "ts", "is_bid", "p8", "q8").agg(
        F.count("lp").alias("n"), F.coalesce(F.sum(take), F.lit(0)).alias("taken8"), F.sum(take.cast("decimal(38,0)") * F.col("lp")).alias("cost"), F.coalesce(F.sum(F.when(own, F.col("lq"))), F.lit(0)).alias("ahead8"),
    )
    kind = F.when(F.col("n") == 0, "rejected").when(F.col("taken8") > 0, "taker").otherwise("rested")
    avg = F.when(F.col("taken8") > 0, F.floor(F.col("cost") / F.col("taken8")).cast("bigint"))
    placed = placed.select("id", "key", "ts", "is_bid", "p8", "q8", kind.alias("placed"), "taken8", avg.alias("avg8"), F.when(kind == "rested", F.col("ahead8")).alias("ahead8"))
    rest = placed.where("placed = 'rested'").select("id", "key", (F.col("ts") + 1).alias("ts"), "is_bid", "p8", "q8", "ahead8")
    tape = trades.select("key", "ts", "seq", F.col("p8").alias("tp"), F.col("q8").alias("tq"), "sgn")
    hit = F.when(F.col("is_bid"), (F.col("sgn") < 0) & (F.col("tp") <= F.col("p8"))).otherwise((F.col("sgn") > 0) & (F.col("tp") >= F.col("p8")))
    met = range_join(rest, tape, ["key"], "ts", life_ms - 1).where(hit)
    met = met.withColumn("cum", F.sum("tq").over(Window.partitionBy("id").orderBy("path_ts", "seq")))
    fills = met.groupBy("id").agg(
        F.max(F.least(F.greatest(F.col("cum") - F.col("ahead8"), F.lit(0)), F.col("q8"))).alias("filled8"), F.min(F.when(F.col("cum") > F.col("ahead8"), F.col("path_ts"))).alias("first_ts"), F.min(F.when(F.col("cum") >= F.col("ahead8") + F.col("q8"), F.col("path_ts"))).alias("done_ts"),
    )
    x = placed.join(fills, "id", "left")
    return x.select("id", "key", "ts", "placed", "taken8", "avg8", "ahead8", F.coalesce("filled8", F.lit(0)).alias("filled8"), "first_ts", "done_ts")
