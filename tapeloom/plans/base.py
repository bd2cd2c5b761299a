"""The cleaned market series that the plans start from, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.clean import e8, known, restore_ms, side_name
from tapeloom.plans.problems_sql import E8, SIDE, ms
from tapeloom.sources.tables import table


def trades(spark: SparkSession, d: str) -> DataFrame:
    """seq, sym, ts (ms), price, qty, p8, q8 (units of 1e-8), sgn (+1 aggressive buy): rows with a usable price and quantity."""
    t = table(spark, d, "trade").where(F.col("symbol").isNotNull() & (F.col("price") > 0) & (F.col("qty") > 0) & ~F.isnan("price") & ~F.isnan("qty"))
    return t.select(F.col("src_ordinal").alias("seq"), F.col("symbol").alias("sym"), "ts", "price", "qty", e8(F.col("price")).alias("p8"), e8(F.col("qty")).alias("q8"), F.when(F.col("isbuyermaker"), -1).otherwise(1).alias("sgn"))


TRADES = f"""tr as (
  select src_ordinal as seq, symbol as sym, ts, price, qty, {E8.format('price')} as p8, {E8.format('qty')} as q8, case when isbuyermaker then -1 else 1 end as sgn
  from trade where symbol is not null and price > 0 and qty > 0 and not isnan(price) and not isnan(qty))"""


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """seq, coin, ts, b8, a8: quotes with both sides that are not crossed."""
    q = table(spark, d, "hlquote").where(F.col("coin").isNotNull() & known(F.col("bid")) & known(F.col("ask")) & (F.col("bid") > 0) & (F.col("bid") < F.col("ask")))
    return q.select(F.col("src_ordinal").alias("seq"), "coin", restore_ms(F.col("ts")).alias("ts"), e8(F.col("bid")).alias("b8"), e8(F.col("ask")).alias("a8"))


QUOTES = f"""qt as (
  select src_ordinal as seq, coin, {ms('ts')} as ts, {E8.format('bid')} as b8, {E8.format('ask')} as a8
  from hlquote where coin is not null and bid > 0 and bid < ask and not isnan(bid) and not isnan(ask))"""


def funding(spark: SparkSession, d: str) -> DataFrame:
    """seq, coin, ts, rate, mark, idx: one row per coin and instant, the last delivered."""
    f = table(spark, d, "funding").where(F.col("coin").isNotNull() & known(F.col("funding"), True) & (F.abs("funding") < 1))
    f = f.select("coin", restore_ms(F.col("ts")).alias("ts"), F.struct(F.col("src_ordinal").alias("seq"), F.col("funding").alias("rate"), "mark", F.col("index_px").alias("idx")).alias("x"))
    return f.groupBy("coin", "ts").agg(F.max_by("x", "x.seq").alias("x")).select("coin", "ts", "x.*")


FUNDING = f"""fu as (
  select coin, {ms('ts')} as ts, src_ordinal as seq, funding as rate, mark, index_px as idx
  from funding where coin is not null and funding is not null and not isnan(funding) and funding <> 0 and abs(funding) < 1
  qualify row_number() over (partition by coin, {ms('ts')} order by src_ordinal desc) = 1)"""


def open_interest(spark: SparkSession, d: str) -> DataFrame:
    """seq, coin, ts, oi8: one row per coin and instant, the last delivered."""
    o = table(spark, d, "open_interest").where(F.col("coin").isNotNull() & known(F.col("oi")) & (F.col("oi") > 0))
    o = o.select("coin", restore_ms(F.col("ts")).alias("ts"), F.struct(F.col("src_ordinal").alias("seq"), e8(F.col("oi")).alias("oi8")).alias("x"))
    return o.groupBy("coin", "ts").agg(F.max_by("x", "x.seq").alias("x")).select("coin", "ts", "x.*")


OI = f"""op as (
  select coin, {ms('ts')} as ts, src_ordinal as seq, {E8.format('oi')} as oi8
  from open_interest where coin is not null and oi > 0 and not isnan(oi)
  qualify row_number() over (partition by coin, {ms('ts')} order by src_ordinal desc) = 1)"""


def deltas(spark: SparkSession, d: str) -> DataFrame:
    """seq, coin, ts, side, p8, q8 (0: the level goes): change rows of the book, skipping those without what they need."""
    b = table(spark, d, "book_delta").where(F.col("coin").isNotNull() & known(F.col("price")) & (known(F.col("qty")) | (F.col("kind") == "remove")))
    gone = F.coalesce(F.col("kind") == "remove", F.lit(False)) | (F.col("qty") <= 0)
    return b.select(F.col("src_ordinal").alias("seq"), "coin", F.col("venuets").alias("ts"), side_name(F.col("side")).alias("side"), e8(F.col("price")).alias("p8"), F.when(gone, 0).otherwise(e8(F.col("qty"))).cast("bigint").alias("q8")).where("side is not null")


DELTAS = f"""de as (
  select * from (select src_ordinal as seq, coin, venuets as ts, {SIDE} as side, {E8.format('price')} as p8,
         case when coalesce(kind = 'remove', false) or qty <= 0 then 0 else {E8.format('qty')} end as q8
  from book_delta where coin is not null and price is not null and not isnan(price) and ((qty is not null and not isnan(qty)) or kind = 'remove')) where side is not null)"""


def instruments(spark: SparkSession, d: str) -> DataFrame:
    """coin and symbol, one to one; a dimension of fixed size."""
    return F.broadcast(table(spark, d, "instrument").select("coin", F.col("symbol").alias("sym")))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """coin, ts, side, p8, q8: the levels of each full snapshot, the latest delivery of each."""
    r = table(spark, d, "hl_orderbook").select("coin", F.col("event_time").alias("ts"), side_name(F.col("side")).alias("side"), e8(F.col("price")).alias("p8"), F.struct("received_time", "src_ordinal", e8(F.col("quantity")).alias("q8")).alias("x"))
    r = r.dropna(subset=["coin", "ts", "side", "p8"]).groupBy("coin", "ts", "side", "p8").agg(F.max("x").alias("x"))
    return r.select("coin", "ts", "side", "p8", F.col("x.q8").alias("q8")).where("q8 > 0")


SNAPS = f"""sn as (
  select coin, event_time as ts, side_ as side, p8, q8 from (
    select *, {SIDE} as side_, {E8.format('price')} as p8, {E8.format('quantity')} as q8 from hl_orderbook)
  where coin is not null and event_time is not null and side_ is not null and p8 is not null
  qualify row_number() over (partition by coin, event_time, side_, p8 order by received_time desc, src_ordinal desc) = 1),
  sl as (select * from sn where q8 > 0)"""
