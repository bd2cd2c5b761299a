"""Level-two books: ordered fold, validity intervals, depth features, walls, market walks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.clean import DAY_MS
from tapeloom.functions.market import imbalance, microprice, ratio, spread_bps

FNV_OFFSET, FNV_PRIME, U64 = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


class Book:
    """One book: price to quantity per side. A change that crosses the other side removes what it crosses; levels beyond the cap are lost."""

    def __init__(self, cap: int | None = None):
        self.bid: dict[int, int] = {}
        self.ask: dict[int, int] = {}
        self.cap = cap
        self.trimmed = self.evicted = 0

    def apply(self, side: str, price: int, qty: int) -> None:
        own, other = (self.bid, self.ask) if side == "bid" else (self.ask, self.bid)
        if qty <= 0:
            own.pop(price, None)
            return
        own[price] = qty
        if other:
            crossed = [p for p in other if p <= price] if side == "bid" else [p for p in other if p >= price]
            for p in crossed:
                del other[p]
            self.trimmed += len(crossed)
        if self.cap is not None and len(own) > self.cap:
            worst = min(own) if side == "bid" else max(own)
            del own[worst]
            self.evicted += 1

    def top(self, n: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        return sorted(self.bid.items(), reverse=True)[:n], sorted(self.ask.items())[:n]

    def hash(self) -> int:
        """FNV-1a over both sides in price order, as a signed 64-bit number."""
        h = FNV_OFFSET
        for side in (self.bid, self.ask):
            for p, q in sorted(side.items()):
                for b in p.to_bytes(8, "little", signed=True) + q.to_bytes(8, "little", signed=True):
                    h = ((h ^ b) * FNV_PRIME) & U64
        return h - (1 << 64) if h >> 63 else h


def fold_books(deltas: DataFrame, key: str, sample_ms: int = 60_000, levels: int = 5, cap: int | None = None) -> DataFrame:
    """The book of each key at the end of every sampled period with a change, rebuilt from its changes of that UTC day in order.

    Result: key, ts (end of period), trimmed, evicted, bid and ask (arrays of best levels first, p8 and q8), book_hash.
    Crossing trims and lossy caps depend on the path, so this is an ordered fold: Arrow batches of one
    (key, day) stream through a book, and no day is held as a whole. Days and keys run side by side.
    """
    day = F.col("ts") - F.pmod("ts", F.lit(DAY_MS))
    parts = deltas.select(key, day.alias("day"), "ts", "seq", "side", "p8", "q8").repartition(key, "day").sortWithinPartitions(key, "day", "ts", "seq")
    level = pa.list_(pa.struct([("p8", pa.int64()), ("q8", pa.int64())]))
    names = [key, "ts", "trimmed", "evicted", "bid", "ask", "book_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, group, slot = Book(cap), None, None
        out: list[list] = [[] for _ in names]

        def emit() -> None:
            b, a = book.top(levels)
            row = [group[0], slot + sample_ms, book.trimmed, book.evicted, [{"p8": p, "q8": q} for p, q in b], [{"p8": p, "q8": q} for p, q in a], book.hash()]
            for c, v in zip(out, row, strict=True):
                c.append(v)

        def flush() -> pa.RecordBatch:
            b = pa.record_batch([pa.array(out[0]), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], level), pa.array(out[5], level), pa.array(out[6], pa.int64())], names=names)
            for c in out:
                c.clear()
            return b

        for batch in batches:
            for k, d, t, side, p, q in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6)), strict=True):
                if (k, d) != group:
                    if group is not None:
                        emit()
                    book, group, slot = Book(cap), (k, d), t - t % sample_ms
                elif t - t % sample_ms != slot:
                    emit()
                    slot = t - t % sample_ms
                book.apply(side, p, q)
            if len(out[0]) >= 2000:
                yield flush()
        if group is not None:
            emit()
        if out[0]:
            yield flush()

    kind = deltas.schema[key].dataType.simpleString()
    side = "array<struct<p8:bigint,q8:bigint>>"
    return parts.mapInArrow(run, f"{key} {kind}, ts bigint, trimmed bigint, evicted bigint, bid {side}, ask {side}, book_hash bigint")


def level_intervals(deltas: DataFrame, key: str) -> DataFrame:
    """When each level held which quantity: key, day, side, p8, q8, from_ts, to_ts (null: to the day's end). No crossing trims, so no fold."""
    day = F.col("ts") - F.pmod("ts", F.lit(DAY_MS))
    w = Window.partitionBy(key, "day", "side", "p8").orderBy("ts", "seq")
    x = deltas.withColumn("day", day).withColumn("to_ts", F.lead("ts").over(w))
    return x.where((F.col("q8") > 0) & (F.col("to_ts").isNull() | (F.col("to_ts") > F.col("ts")))).select(key, "day", "side", "p8", "q8", F.col("ts").alias("from_ts"), "to_ts")


def sampled_levels(intervals: DataFrame, key: str, sample_ms: int) -> DataFrame:
    """The live levels at each sampling point that a level lives through: key, ts, side, p8, q8. Levels are exploded, never joined."""
    day_end = F.col("day") + DAY_MS - 1
    first = F.col("from_ts") + sample_ms - 1 - F.pmod(F.col("from_ts") + sample_ms - 1, F.lit(sample_ms))
    last = F.coalesce(F.col("to_ts") - 1, day_end)
    points = F.when(first <= last, F.sequence(first, last, F.lit(sample_ms).cast("bigint")))
    return intervals.select(key, "side", "p8", "q8", F.explode(points).alias("ts")).select(key, "ts", "side", "p8", "q8")


def top_levels(levels: DataFrame, key: str, n: int) -> DataFrame:
    """The n best levels of each side at each ts, numbered from 1."""
    best = F.when(F.col("side") == "bid", -F.col("p8")).otherwise(F.col("p8"))
    w = Window.partitionBy(key, "ts", "side").orderBy(best)
    return levels.withColumn("level_no", F.row_number().over(w)).where(F.col("level_no") <= n)


def depth_snapshot(levels: DataFrame, key: str) -> DataFrame:
    """One row per key and ts: touch, total depth, counts, arrays of all levels best first."""
    def side(name: str) -> Column:
        sign = -1 if name == "bid" else 1
        a = F.array_sort(F.collect_list(F.when(F.col("side") == name, F.struct((F.col("p8") * sign).alias("o"), "p8", "q8"))))
        return F.transform(a, lambda x: F.struct(x["p8"].alias("p8"), x["q8"].alias("q8")))

    total = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("q8"))), F.lit(0))
    g = levels.groupBy(key, "ts").agg(side("bid").alias("bid"), side("ask").alias("ask"), total("bid").alias("bid8"), total("ask").alias("ask8"), F.count_if(F.col("side") == "bid").alias("bid_levels"), F.count_if(F.col("side") == "ask").alias("ask_levels"))
    return g.where((F.size("bid") > 0) & (F.size("ask") > 0)).where(F.col("bid")[0]["p8"] < F.col("ask")[0]["p8"])


def _sum(a: Column, field: str = "q8") -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x[field])


def depth_features(snaps: DataFrame, key: str, bands: tuple[int, ...] = (1, 3, 5, 10, 20), depth: int = 20) -> DataFrame:
    """Scalars of a depth snapshot: mid, spread, imbalances (full, top 5, decayed), gaps, bands, concentration, skew, breadth, VWAP mid.

    Bands and totals are over all levels; gaps, the decayed imbalance and the VWAP mid over the `depth` best.
    """
    c, best = F.col, lambda s: F.slice(s, 1, depth)
    b0, a0 = c("bid")[0], c("ask")[0]
    mid = (b0["p8"] + a0["p8"]) / 2.0

    def decayed(a: Column) -> Column:
        return F.aggregate(F.transform(a, lambda x, i: x["q8"] * F.pow(F.lit(0.95), i)), F.lit(0.0), lambda s, v: s + v)

    def gaps(a: Column) -> Column:
        n = F.size(a)
        return F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.abs(F.get(a, i)["p8"] - F.get(a, i - 1)["p8"]) / mid * 1e4))

    mean = lambda a: F.when(a.isNotNull(), F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)).otherwise(0.0)
    wavg = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["p8"].cast("double") * x["q8"]) / _sum(a)
    band = {f"{s}_top{n}8": _sum(F.slice(c(s), 1, n)) for s in ("bid", "ask") for n in bands}
    x = snaps.withColumns(band)
    conc = lambda s: ratio(c(f"{s}_top58"), c(f"{s}8"))
    skew = lambda s: ratio(c(f"{s}_top58"), c(f"{s}_top208"))
    return x.select(
        key, "ts", mid.alias("mid8"), spread_bps(b0["p8"], a0["p8"]).alias("spread_bps"), imbalance(c("bid8"), c("ask8")).alias("full_imbalance"),
        imbalance(c("bid_top58"), c("ask_top58")).alias("top5_imbalance"), ratio(decayed(best("bid")) - decayed(best("ask")), decayed(best("bid")) + decayed(best("ask"))).alias("weighted_imbalance"),
        microprice(b0["p8"].cast("double"), a0["p8"].cast("double"), b0["q8"], a0["q8"]).alias("micro8"), mean(gaps(best("bid"))).alias("mean_bid_gap_bps"), mean(gaps(best("ask"))).alias("mean_ask_gap_bps"),
        F.coalesce(F.get(gaps(best("bid")), F.lit(0)), F.lit(0.0)).alias("best_bid_gap_bps"), F.coalesce(F.get(gaps(best("ask")), F.lit(0)), F.lit(0.0)).alias("best_ask_gap_bps"),
        conc("bid").alias("bid_concentration"), conc("ask").alias("ask_concentration"), skew("bid").alias("bid_depth_skew"), skew("ask").alias("ask_depth_skew"),
        ratio(c("ask8"), c("bid8")).alias("cross_ask_ratio"), (wavg(best("bid")) * c("ask8") / (c("bid8") + c("ask8")) + wavg(best("ask")) * c("bid8") / (c("bid8") + c("ask8"))).alias("vwap_mid8"),
        b0["p8"].alias("b8"), a0["p8"].alias("a8"), "bid_levels", "ask_levels", "bid8", "ask8", *band,
    )


def best_quotes(levels: DataFrame, key: str) -> DataFrame:
    """Best bid and ask per ts where they differ from those before: key, ts, b8, a8."""
    g = levels.groupBy(key, "ts").agg(F.max(F.when(F.col("side") == "bid", F.col("p8"))).alias("b8"), F.min(F.when(F.col("side") == "ask", F.col("p8"))).alias("a8")).where("b8 is not null and a8 is not null")
    w = Window.partitionBy(key, F.col("ts") - F.pmod("ts", F.lit(DAY_MS))).orderBy("ts")
    x = g.withColumns({"lb": F.lag("b8").over(w), "la": F.lag("a8").over(w)})
    return x.where(~(F.col("b8").eqNullSafe(F.col("lb")) & F.col("a8").eqNullSafe(F.col("la")))).select(key, "ts", "b8", "a8")


def walls(levels: DataFrame, index: DataFrame, key: str, threshold8: int) -> DataFrame:
    """Stretches of consecutive snapshots in which a level holds at least threshold8: first, last, peak, growth and shrinkage steps.

    index: one row per key and ts with no, its dense number per day. Gaps and islands per (key, day, side, price).
    """
    big = levels.where(F.col("q8") >= threshold8).join(index, [key, "ts"])
    p = Window.partitionBy(key, "day", "side", "p8").orderBy("no")
    x = big.withColumns({"isle": F.col("no") - F.row_number().over(p), "before": F.lag("q8").over(p), "prev": F.lag("no").over(p)})
    step = F.when(F.col("prev") == F.col("no") - 1, F.col("q8") - F.col("before"))
    return x.withColumn("step", step).groupBy(key, "day", "side", "p8", "isle").agg(
        F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.max("no").alias("last_no"), F.count("*").alias("seen"), F.max("q8").alias("peak8"), F.max_by("q8", "no").alias("end8"), F.count_if(F.col("step") > 0).alias("grew"), F.count_if(F.col("step") < 0).alias("shrank"),
    ).drop("isle")


def market_walk(levels: DataFrame, key: str, want8: int, buy: bool = True, cap8: int | None = None) -> DataFrame:
    """What a market order of want8 takes from each snapshot, from the touch on, at most to the price cap: filled8, cost, levels, average, complete."""
    side = levels.where(F.col("side") == ("ask" if buy else "bid"))
    if cap8 is not None:
        side = side.where((F.col("p8") <= cap8) if buy else (F.col("p8") >= cap8))
    w = Window.partitionBy(key, "ts").orderBy("p8" if buy else F.desc("p8")).rowsBetween(Window.unboundedPreceding, -1)
    take = F.greatest(F.least(F.col("q8"), F.lit(want8) - F.coalesce(F.sum("q8").over(w), F.lit(0))), F.lit(0))
    x = side.withColumn("take8", take).where("take8 > 0")
    g = x.groupBy(key, "ts").agg(F.sum("take8").alias("filled8"), F.sum(F.col("p8").cast("decimal(20,0)") * F.col("take8").cast("decimal(18,0)")).alias("cost"), F.count("*").alias("levels"))
    whole = (F.col("cost") - F.pmod("cost", F.col("filled8").cast("decimal(20,0)"))) / F.col("filled8").cast("decimal(20,0)")
    return g.select(key, "ts", "filled8", "levels", whole.cast("bigint").alias("avg8"), (F.col("filled8") == want8).alias("complete"))


def fnv1a(values: np.ndarray) -> int:
    """FNV-1a of an int64 array's bytes, as an unsigned number."""
    h = FNV_OFFSET
    for b in np.asarray(values, "<i8").tobytes():
        h = ((h ^ b) * FNV_PRIME) & U64
    return h


def traded_at(walls: DataFrame, trades: DataFrame, key: str) -> DataFrame:
    """For each wall the trades at exactly its price while it stood: key, side, p8, from_ts, to_ts, trades, traded8, hit8 (by aggressors against it)."""
    w = walls.select(key, "side", "p8", "from_ts", "to_ts")
    t = trades.select(key, "p8", F.col("ts").alias("at"), "q8", "sgn")
    x = w.alias("w").join(t.alias("t"), (F.col(f"w.{key}") == F.col(f"t.{key}")) & (F.col("w.p8") == F.col("t.p8")) & F.col("at").between(F.col("from_ts"), F.col("to_ts")), "left")
    against = F.col("sgn") == F.when(F.col("side") == "bid", -1).otherwise(1)
    return x.groupBy(f"w.{key}", "side", "w.p8", "from_ts", "to_ts").agg(F.count("at").alias("trades"), F.coalesce(F.sum("q8"), F.lit(0)).alias("traded8"), F.coalesce(F.sum(F.when(against, F.col("q8"))), F.lit(0)).alias("hit8"))
