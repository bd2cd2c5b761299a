"""Queries of the general data problems over the market tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.clean import day_start, e8, side_name
from tapeloom.operators.changefeed import apply_changes
from tapeloom.operators.drift import bar_cells, column_catalogue, consistent_bars, consistent_table, lifespans, schema_changes
from tapeloom.operators.grid import regular_grid
from tapeloom.operators.late import late_corrected
from tapeloom.operators.nearest import nearest_in_time
from tapeloom.operators.snapshots import snapshot_diff
from tapeloom.operators.spikes import Feed, FieldRule, flag_faults
from tapeloom.sources.tables import restored, table


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    rows = restored(table(spark, d, "funding"), "ts").select(F.lit("funding").alias("feed"), "coin", "ts", F.col("mark").alias("value"), "src_ordinal")
    rows = rows.union(restored(table(spark, d, "open_interest"), "ts").select(F.lit("open_interest"), "coin", "ts", "oi", "src_ordinal"))
    return regular_grid(rows, ["feed", "coin"], "ts", "value", "src_ordinal")


def p1_series(spark: SparkSession, d: str) -> DataFrame:
    g = p1_grid(spark, d)
    return g.select("feed", "coin", "period_ms", "state", "n_readings", F.round("twa", 4).alias("twa"), F.round("coverage", 6).alias("coverage"), "fill")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_grid(spark, d).where("state = 'gap'").select("feed", "coin", "period_ms")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(bar_cells(table(spark, d, "raw_bar_line")))


def p2_lifespans(spark: SparkSession, d: str) -> DataFrame:
    return lifespans(column_catalogue(bar_cells(table(spark, d, "raw_bar_line"))))


def p2_bars(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table of all bars with a row per bar and field."""
    return consistent_bars(bar_cells(table(spark, d, "raw_bar_line")))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    return consistent_table(bar_cells(table(spark, d, "raw_bar_line")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hl_orderbook").select("src_ordinal", "received_time", "event_time", "coin", side_name(F.col("side")).alias("side"), e8(F.col("price")).alias("price_e8"), e8(F.col("quantity")).alias("qty_e8"))
    absent = F.col("qty_e8").isNull() | (F.col("qty_e8") == 0)
    return snapshot_diff(rows, ["coin"], "event_time", ["side", "price_e8"], ["qty_e8"], ["received_time", "src_ordinal"], absent).select("coin", "event_time", "side", "price_e8", "change_kind")


def p4_minutes(spark: SparkSession, d: str) -> DataFrame:
    trades = restored(table(spark, d, "trade"), "ts", "localts")
    deltas = restored(table(spark, d, "book_delta"), "venuets", "capturets")
    t = late_corrected(trades, ["symbol"], "ts", "localts", "price", "qty", "src_ordinal")
    b = late_corrected(deltas, ["coin"], "venuets", "capturets", "price", "qty", "src_ordinal")
    return t.select(F.lit("trade").alias("feed"), F.col("symbol").alias("tape_key"), *t.columns[1:]).union(b.select(F.lit("book_delta"), "coin", *b.columns[1:]))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.filter(F.array(F.when(F.col("revision") > 0, "corrected"), F.when(F.col("refused") > 0, "refused")), lambda x: x.isNotNull())
    return p4_minutes(spark, d).where("is_final").select("feed", "tape_key", F.col("period_ms").alias("minute_ms"), F.explode(outcome).alias("outcome"))


def p4_bars(spark: SparkSession, d: str) -> DataFrame:
    """The final aggregate of each minute."""
    m = p4_minutes(spark, d).where("is_final")
    return m.select("feed", "tape_key", F.col("period_ms").alias("minute_ms"), "events", F.round("qty", 4).alias("qty"), "low", "high", "open", "close", "refused")


def _p5_feeds(spark: SparkSession, d: str) -> list[Feed]:
    below = lambda c: c <= 0
    return [
        Feed("trade", table(spark, d, "trade"), "symbol", "ts", "src_ordinal", [FieldRule("price", below, 20, relative=True), FieldRule("qty", below, 20, spike_factor=None, high_factor=100.0)], ["localts"]),
        Feed("funding", restored(table(spark, d, "funding"), "ts"), "coin", "ts", "src_ordinal", [FieldRule("funding", lambda c: F.abs(c) >= 1, 12, zero_missing=True)]),
        Feed("open_interest", restored(table(spark, d, "open_interest"), "ts"), "coin", "ts", "src_ordinal", [FieldRule("oi", lambda c: c < 0, 12, relative=True, zero_missing=True)]),
    ]


def p5_faults(spark: SparkSession, d: str) -> DataFrame:
    f = flag_faults(_p5_feeds(spark, d))
    return f.select("feed", "field", F.col("src").alias("source"), F.col("ordinal").alias("src_ordinal"), "fault")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_faults(spark, d).select("feed", "field", "src_ordinal").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    num = lambda c: F.when(~F.isnan(c), F.col(c))
    rows = table(spark, d, "book_delta").withColumns({"price": num("price"), "qty": num("qty")}).where("price is not null and (qty is not null or kind = 'remove')")
    rows = rows.withColumns({"day_ms": day_start(F.col("venuets")), "side_name": side_name(F.col("side")), "price_e8": e8(F.col("price")), "qty_e8": e8(F.col("qty"))})
    book = apply_changes(rows, ["coin", "day_ms", "side_name", "price_e8"], ["venuets"], ["qty_e8"], "src_ordinal", ["capturets"], deletes="coalesce(kind = 'remove', false) or qty <= 0")
    return book.select("coin", "day_ms", F.col("side_name").alias("side"), "price_e8", "qty_e8")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    narrow = lambda df: restored(df, "ts").select("coin", "ts", "src_ordinal")
    funding, oi = narrow(table(spark, d, "funding")), narrow(table(spark, d, "open_interest"))
    quote = narrow(table(spark, d, "hlquote").where("mid is not null and not isnan(mid)"))
    coins = table(spark, d, "instrument").select("coin", "symbol").dropna().dropDuplicates(["symbol"])
    trade = narrow(table(spark, d, "trade").join(coins, "symbol"))
    pairs = [("funding_oi", funding, oi, 90_000), ("funding_quote", funding, quote, 60_000), ("oi_trade", oi, trade, 30_000)]
    parts = [nearest_in_time(a, b, ["coin"], "ts", "src_ordinal", tol).select(F.lit(kind).alias("pair_kind"), "left_ordinal", "right_ordinal") for kind, a, b, tol in pairs]
    return parts[0].union(parts[1]).union(parts[2])


def queries() -> dict:
    names = [p1_found, p1_series, p2_found, p2_lifespans, p2_bars, p2_table, p3_found, p4_found, p4_bars, p5_found, p5_faults, p6_found, p7_found]
    return {f.__name__: f for f in names}
