"""Feed folders, bar and signal CSV files, scorecards and ledgers, synthetic tapes."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.clean import DAY_MS

# The feed files' declared schemas.
TRADE = "ts bigint, localts bigint, symbol string, price double, qty double, isbuyermaker boolean"
BOOK_DELTA = "venuets bigint, capturets bigint, side string, price double, qty double, kind string"
QUOTE = "ts bigint, coin string, bid double, ask double, mid double, source string"
FUNDING = "ts bigint, funding double, mark double, index_px double"
OPEN_INTEREST = "ts bigint, oi double, oi_usd double"
NS_DAY = 86_400_000_000_000


def hours(root: str, key: str, stream: str, first: date, last: date) -> list[str]:
    """The paths root/key/stream/date/HH.parquet of the hours of [first, last], whether they exist or not."""
    days = [first + timedelta(k) for k in range((last - first).days + 1)]
    return [f"{root}/{key}/{stream}/{d:%Y-%m-%d}/{h:02d}.parquet" for d in days for h in range(24)]


def read_feed(spark: SparkSession, root: str, stream: str, schema: str, key: str = "*", dates: str = "*") -> DataFrame:
    """A stream's files by glob, missing hours left out, with feed_key, date and hour from the path."""
    df = spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(f"{root}/{key}/{stream}/{dates}/*.parquet")
    path = F.col("_metadata.file_path")
    part = lambda k: F.regexp_extract(path, rf"([^/]+)/{stream}/([^/]+)/(\d+)\.parquet", k)
    return df.select("*", part(1).alias("feed_key"), part(2).cast("date").alias("date"), part(3).cast("int").alias("hour"))


def strict(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, which fails on a null in the columns when it is read."""
    return df.withColumns({c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null {c}")).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in columns})


def lenient(df: DataFrame, columns: list[str]) -> DataFrame:
    """df without the rows that lack one of the columns."""
    return df.dropna(subset=columns)


def write_bars(bars: DataFrame, path: str, digits: dict[str, int], default: int = 6) -> None:
    """Bars as CSV with fixed decimals; what is read back are the rounded values."""
    cols = [F.format_string(f"%.{digits.get(f.name, default)}f", f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in bars.schema]
    bars.select(*cols).write.mode("overwrite").option("header", "true").csv(path)


def read_bars(spark: SparkSession, path: str, schema: str, nan_defaults: bool = False) -> DataFrame:
    """Bar CSVs sorted by ts within their file's day: extra columns ignored, missing values 0 (or NaN), bar_index per day, bar_vol from cum_vol.

    bar_vol is the first bar's cum_vol, then its rise, never below 0.
    """
    names = [f.name for f in T._parse_datatype_string(schema)]
    df = spark.read.option("header", "true").csv(path)
    have = set(df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in T._parse_datatype_string(schema)}
    blank = lambda n: F.lit(float("nan")) if nan_defaults and kinds[n] == "double" else F.lit(0).cast(kinds[n])
    df = df.select(*[F.coalesce(F.col(n).try_cast(kinds[n]), blank(n)).alias(n) if n in have else blank(n).alias(n) for n in names])
    day = F.call_function("div", F.col("ts"), F.lit(NS_DAY).cast("bigint"))
    w = Window.partitionBy(day).orderBy("ts")
    return df.withColumns({"bar_index": F.row_number().over(w) - 1, "bar_vol": F.greatest(F.col("cum_vol") - F.lag("cum_vol", 1, 0).over(w), F.lit(0.0)), "date": F.date_from_unix_date(day.cast("int"))})


def day_window(bars: DataFrame, first: str, last: str) -> DataFrame:
    """Bars of the days [first, last], renumbered per day, each day's first bar with its whole cum_vol as bar_vol."""
    d = bars.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    per_day = Window.partitionBy("date").orderBy("ts")
    return d.withColumns({"bar_index": F.row_number().over(per_day) - 1, "bar_vol": F.greatest(F.col("cum_vol") - F.lag("cum_vol", 1, 0).over(per_day), F.lit(0.0))})


def read_signals(spark: SparkSession, path: str, bars: DataFrame, min_confidence: float) -> DataFrame:
    """Signals of direction long or short with enough confidence whose bar exists."""
    s = spark.read.option("header", "true").schema("bar_index bigint, direction string, expected_move_bps double, hold_bars int, confidence double").csv(path)
    s = s.withColumn("direction", F.lower(F.trim("direction"))).where(F.col("direction").isin("long", "short") & (F.col("confidence") >= min_confidence))
    return s.join(bars.select("bar_index").distinct(), "bar_index", "left_semi")


def write_scorecard(cells: DataFrame, path: str, ledger: str, top: int = 0) -> None:
    """The sweep's cells as one CSV table, by net; a line per cell appended to the ledger."""
    best = cells.orderBy(F.desc("net"), "name")
    (best.limit(top) if top else best).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
    cells.write.mode("append").parquet(ledger)


def synthetic_events(spark: SparkSession, n: int, seed: int, partitions: int = 8) -> DataFrame:
    """A seeded tape of all kinds and sides with monotone local_ts, made in parallel: each row is hashed from (seed, its number)."""
    i = spark.range(0, n, 1, partitions).withColumn("h", F.xxhash64(F.lit(seed), "id"))
    bits = lambda shift, width: F.shiftrightunsigned("h", shift) % F.lit(width)
    exch = F.col("id") * 1_000_000 + bits(3, 900_000)
    return i.select(
        F.col("id").alias("src_ordinal"), exch.alias("exch_ts"), ((F.col("id") + 1) * 1_000_000).alias("local_ts"), (F.lit(10_000_000_000) + bits(11, 1_000_000)).alias("price"), (1 + bits(19, 100_000_000)).alias("qty"),
        (1 + bits(29, 4)).cast("int").alias("kind"), (1 + bits(37, 2)).cast("int").alias("side"), F.lit(0).alias("flags"),
    )


def exclude_dates(rows: DataFrame, ts: str, dates: list[str]) -> DataFrame:
    """rows (ts in epoch ms) without those of the UTC dates, which are a short list; the ranges can be pushed to the scan. A null ts stays."""
    t = F.col(ts)
    for x in dates:
        start = int(datetime.fromisoformat(x).replace(tzinfo=UTC).timestamp()) * 1000
        rows = rows.where(t.isNull() | (t < start) | (t >= start + DAY_MS))
    return rows
