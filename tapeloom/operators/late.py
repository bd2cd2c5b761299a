"""Event-time aggregates corrected by late rows: checkpoint and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "struct<n:bigint,qty:double,notional:double,lo:double,hi:double,open:struct<t:bigint,o:bigint,p:double>,close:struct<t:bigint,o:bigint,p:double>>"


def _merge(a: Column, b: Column) -> Column:
    """The ordered state of two adjoining stretches of events; least and greatest skip nulls."""
    return F.struct(
        (a["n"] + b["n"]).alias("n"), (a["qty"] + b["qty"]).alias("qty"), (a["notional"] + b["notional"]).alias("notional"),
        F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"),
        F.least(a["open"], b["open"]).alias("open"), F.greatest(a["close"], b["close"]).alias("close"),
    )


def late_corrected(
    events: DataFrame,
    key: list[str],
    ts: str,
    arrival: str,
    price: str,
    qty: str,
    ordinal: str,
    period_ms: int = 60_000,
    close_after_ms: int = 65_000,
    cutoff_ms: int = 600_000,
    checkpoint_ms: int = 10_000,
    trigger_ms: int = 60_000,
) -> DataFrame:
    """Per key and period of event time the aggregate as first put out and each correction of it.

    A period closes close_after_ms after its start. A row that arrives at or after the close is
    late; cutoff_ms or more after it, refused. Rows without an arrival are on time. Rows equal in
    all columns but ordinal and arrival are one event, with the earliest arrival, on time if any
    copy lacks it. A null key or ts: the row is ignored. A null or NaN price or qty counts as an
    event but adds nothing to the sums, bounds, open and close.

    Checkpoint and replay: the events of a period are folded into ordered states (count, sums,
    bounds, open, close), one per stretch of checkpoint_ms and revision; revision 0 holds what
    was on time, revision r the late rows of the r-th trigger_ms after the close. The states up to each
    stretch are the checkpoints. A revision restores the checkpoint before its earliest late
    event, replays the sorted stretches from there, and replaces the period's output.

    Result: key, period_ms, revision, is_final, events, qty, notional, low, high, open, close,
    replayed (stretches replayed), refused (rows beyond the cut-off; the same in each revision).
    A period whose rows were all refused has one row, revision 0 with 0 events.

    Plan: copies vanish in a map-side combine; one more shuffle by (key, period) serves both the states
    and their gathering, and spreads a hot key over all tasks. What is gathered per period is bounded by
    (period/checkpoint) x (1 + cutoff/trigger) states, however many events.
    """
    other = [c for c in events.columns if c not in (arrival, ordinal)]
    e = (
        events.dropna(subset=[*key, ts]).groupBy(*other)
        .agg(F.min(arrival).alias("arr__"), (F.count(arrival) < F.count("*")).alias("any__"), F.min(ordinal).alias("ord__"))
        .withColumn("minute__", F.col(ts) - F.pmod(F.col(ts), F.lit(period_ms)))
    )
    over = F.col("arr__") - F.col("minute__") - close_after_ms
    rev = F.when(F.col("any__") | (over < 0), 0).when(over < cutoff_ms, 1 + F.floor(over / trigger_ms)).otherwise(-1).cast("int")
    p, q = (F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in (price, qty))
    at = F.when(F.col("p__").isNotNull(), F.struct(F.col("t__").alias("t"), F.col("ord__").alias("o"), F.col("p__").alias("p")))
    e = e.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], F.col(ts).alias("t__"), "minute__", "ord__", p.alias("p__"), q.alias("q__"), rev.alias("rev"))
    keys = [f"k{i}" for i in range(len(key))]
    e = e.repartition(*keys, "minute__")  # serves the states and what is gathered of them
    stretch = F.floor((F.col("t__") - F.col("minute__")) / checkpoint_ms).cast("int").alias("cut")
    zero = F.lit(0.0)
    states = e.groupBy(*keys, "minute__", "rev", stretch).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("q__"), zero).alias("qty"), F.coalesce(F.sum(F.col("p__") * F.col("q__")), zero).alias("notional"),
        F.min("p__").alias("lo"), F.max("p__").alias("hi"), F.min(at).alias("open"), F.max(at).alias("close"),
    )
    s = F.struct("n", "qty", "notional", "lo", "hi", "open", "close").cast(STATE)
    piece = F.when(F.col("rev") >= 0, F.struct("rev", "cut", s.alias("s")))
    gathered = states.groupBy(*keys, "minute__").agg(
        F.array_sort(F.collect_list(piece)).alias("pieces"), F.coalesce(F.sum(F.when(F.col("rev") < 0, F.col("n"))), F.lit(0)).alias("refused"),
    )
    null = F.lit(None)
    empty = F.struct(F.lit(0), zero, zero, null, null, null, null).cast(STATE)
    cuts = F.sequence(F.lit(0), F.lit(-(-period_ms // checkpoint_ms) - 1))
    fold = lambda pieces, start: F.aggregate(pieces, start, lambda a, x: _merge(a, x["s"]).cast(STATE))

    def replay(acc: Column, r: Column) -> Column:
        """One revision: the checkpoints before its earliest late stretch stay, the rest is folded anew."""
        mine = F.filter("pieces", lambda x: x["rev"] == r)
        restore = F.array_min(F.transform(mine, lambda x: x["cut"]))
        seen = F.filter("pieces", lambda x: x["rev"] <= r)
        base = F.when(restore > 0, F.element_at(acc["marks"], restore)).otherwise(F.col("empty"))
        kept = F.slice(acc["marks"], 1, restore)
        suffix = F.filter(cuts, lambda c: c >= restore)
        marks = F.aggregate(
            suffix, kept,
            lambda m, c: F.concat(m, F.array(fold(F.filter(seen, lambda x: x["cut"] == c), F.when(F.size(m) > 0, F.element_at(m, -1)).otherwise(base)))),
        )
        out = F.struct(r.alias("revision"), F.size(suffix).alias("replayed"), F.element_at(marks, -1).alias("s"))
        return F.struct(F.concat(acc["outs"], F.array(out)).alias("outs"), marks.alias("marks"))

    outs_type = f"struct<outs:array<struct<revision:int,replayed:int,s:{STATE}>>,marks:array<{STATE}>>"
    revs = F.array_sort(F.array_union(F.array(F.lit(0)), F.array_distinct(F.transform("pieces", lambda x: x["rev"]))))
    start = F.struct(F.array().alias("outs"), F.transform(cuts, lambda c: F.col("empty")).alias("marks")).cast(outs_type)

    def step(acc: Column, r: Column) -> Column:
        none = F.struct(F.concat(acc["outs"], F.array(F.struct(r.alias("revision"), F.lit(0).alias("replayed"), F.col("empty").alias("s")))).alias("outs"), acc["marks"].alias("marks"))
        return F.when(F.exists("pieces", lambda x: x["rev"] == r), replay(acc, r).cast(outs_type)).otherwise(none.cast(outs_type))

    # without late rows there is nothing to replay: the fold of all stretches is the only output
    only = F.array(F.struct(F.lit(0).alias("revision"), F.lit(0).alias("replayed"), fold("pieces", F.col("empty")).alias("s")))
    outs = F.when(F.exists("pieces", lambda x: x["rev"] > 0), F.aggregate(revs, start, step)["outs"]).otherwise(only.cast(f"array<struct<revision:int,replayed:int,s:{STATE}>>"))
    done = gathered.withColumn("empty", empty).withColumn("outs", outs)
    return done.select(*keys, "minute__", "refused", F.size("outs").alias("last"), F.posexplode("outs").alias("i", "x")).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(key)], F.col("minute__").alias("period_ms"), "x.revision", (F.col("i") == F.col("last") - 1).alias("is_final"),
        F.col("x.s.n").alias("events"), F.col("x.s.qty").alias("qty"), F.col("x.s.notional").alias("notional"), F.col("x.s.lo").alias("low"), F.col("x.s.hi").alias("high"),
        F.col("x.s.open.p").alias("open"), F.col("x.s.close.p").alias("close"), "x.replayed", "refused",
    )
