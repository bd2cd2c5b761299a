"""Bars, trailing windows and books over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeloom.operators.book import Book


def time_bars(trades: DataFrame, period: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars with a watermark; trades: sym, ts (ms), seq, p8, q8, sgn."""
    e = trades.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    at = F.struct("ts", "seq")
    return e.groupBy("sym", F.window("at", period)).agg(F.count("*").alias("trades"), F.sum("q8").alias("vol8"), F.sum(F.when(F.col("sgn") > 0, F.col("q8")).otherwise(0)).alias("buy8"), F.min_by("p8", at).alias("open8"), F.max("p8").alias("high8"), F.min("p8").alias("low8"), F.max_by("p8", at).alias("close8")).select("sym", F.unix_millis("window.start").alias("ts"), "trades", "vol8", "buy8", "open8", "high8", "low8", "close8")


def sliding_flow(trades: DataFrame, width: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Signed volume over sliding windows."""
    e = trades.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return e.groupBy("sym", F.window("at", width, slide)).agg(F.sum(F.col("sgn") * F.col("q8")).alias("flow8"), F.count("*").alias("n")).select("sym", F.unix_millis("window.end").alias("ts"), "flow8", "n")


def bursts(trades: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of trading that a gap ends."""
    e = trades.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return e.groupBy("sym", F.session_window("at", gap)).agg(F.count("*").alias("n"), F.sum("q8").alias("vol8")).select("sym", F.unix_millis("session_window.start").alias("from_ts"), F.unix_millis("session_window.end").alias("to_ts"), "n", "vol8")


def volume_bars(trades: DataFrame, volume8: int) -> DataFrame:
    """Bars that close when the running volume of a symbol crosses the next multiple of volume8; the open bar is state. Micro-batches must arrive in order of ts."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cum, no, n, first, hi, lo = state.get if state.exists else (0, 0, 0, 0, 0, 0)
        out = []
        rows = sorted((int(x.ts), int(x.seq), int(x.p8), int(x.q8)) for f in frames for x in f.itertuples(index=False))
        for _, _, p, q in rows:
            nxt = (cum + q - 1) // volume8
            if n and nxt != no:
                out.append((k[0], no, n, first, hi, lo))
                n = 0
            if not n:
                no, first, hi, lo = nxt, p, p, p
            cum, n, hi, lo = cum + q, n + 1, max(hi, p), min(lo, p)
        state.update(tuple(map(int, (cum, no, n, first, hi, lo))))
        yield pd.DataFrame(out, columns=["sym", "bar_no", "trades", "open8", "high8", "low8"])

    return trades.groupBy("sym").applyInPandasWithState(update, "sym string, bar_no bigint, trades bigint, open8 bigint, high8 bigint, low8 bigint", "cum bigint, no bigint, n bigint, first bigint, hi bigint, lo bigint", "append", GroupStateTimeout.NoTimeout)


def books(deltas: DataFrame, levels: int = 5) -> DataFrame:
    """The best levels of each coin's book after each micro-batch; the book is state. Micro-batches must arrive in order of ts."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b = Book()
        if state.exists:
            bp, bq, ap, aq = state.get
            b.bid, b.ask = dict(zip(bp, bq, strict=True)), dict(zip(ap, aq, strict=True))
        last = 0
        for ts, _, side, p, q in sorted((int(x.ts), int(x.seq), x.side, int(x.p8), int(x.q8)) for f in frames for x in f.itertuples(index=False)):
            b.apply(side, p, q)
            last = ts
        state.update((list(b.bid), list(b.bid.values()), list(b.ask), list(b.ask.values())))
        bid, ask = b.top(levels)
        yield pd.DataFrame({"coin": [k[0]], "ts": [last], "bid_p8": [[p for p, _ in bid]], "bid_q8": [[q for _, q in bid]], "ask_p8": [[p for p, _ in ask]], "ask_q8": [[q for _, q in ask]]})

    arr = "array<bigint>"
    return deltas.groupBy("coin").applyInPandasWithState(update, f"coin string, ts bigint, bid_p8 {arr}, bid_q8 {arr}, ask_p8 {arr}, ask_q8 {arr}", f"bp {arr}, bq {arr}, ap {arr}, aq {arr}", "update", GroupStateTimeout.NoTimeout)
