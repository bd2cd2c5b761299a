"""Implausible readings: phase-space thresholds, bounds and stuck runs."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.clean import known
from tapeloom.session import cut, small


@dataclass(frozen=True)
class FieldRule:
    """What is implausible in one field of a feed."""

    field: str
    impossible: Callable[[Column], Column]
    stuck_run: int
    spike_factor: float | None = 25.0
    relative: bool = False
    high_factor: float | None = None
    zero_missing: bool = False


@dataclass(frozen=True)
class Feed:
    """A table of readings: ts is BIGINT ms; ignore lists what differs between repeated deliveries besides ordinal."""

    name: str
    rows: DataFrame
    source: str
    ts: str
    ordinal: str
    rules: list[FieldRule]
    ignore: list[str] = field(default_factory=list)


KEY = ["feed", "src"]
COMBOS = [(1, 1), (1, 2), (2, 1), (1, 3), (2, 2), (3, 1)]
BLOCK_ROWS = 20_000
IN_BLOCK = "(partition by feed, src, block order by t, o)"
CELL_SCHEMA = "feed int, src string, slot int, c double, cos double, sin double, a double, b double, d double, rounds int"


def _deliveries(feed: Feed, no: int, width: int) -> DataFrame:
    """feed (its number), src, t, o, h and the feed's fields as v0, v1, ...; h names what else the delivery holds."""
    fields = [r.field for r in feed.rules]
    same = sorted(c for c in feed.rows.columns if c not in {feed.source, feed.ts, feed.ordinal, *feed.ignore, *fields})
    rest = F.xxhash64(*[x for c in same for x in (F.col(c).isNull(), F.col(c))]) if same else F.lit(0).cast("bigint")
    values = [F.when(known(F.col(r.field).cast("double"), r.zero_missing), F.col(r.field).cast("double")) for r in feed.rules]
    values += [F.lit(None).cast("double")] * (width - len(values))
    raw = [F.col(c).cast("double") for c in fields]
    # a missing value and the kind of it are part of the content, so that copies stay copies
    h = F.xxhash64(rest, *[x for c in raw for x in (c.isNull(), F.coalesce(F.isnan(c), F.lit(False)))])
    return feed.rows.select(F.lit(no).alias("feed"), F.col(feed.source).cast("string").alias("src"), F.col(feed.ts).alias("t"), F.col(feed.ordinal).alias("o"), h.alias("h"), *[v.alias(f"v{i}") for i, v in enumerate(values)]).where("src is not null and t is not null")


def _halo(a: DataFrame, halo: int, values: list[str]) -> DataFrame:
    """For each block of a the halo readings of every field before and after it, whatever nulls or blocks lie between.

    Only the rows near a block's edges are looked at for it. A list with one line per block says
    where the readings of each block begin, counted along the source, and so which blocks want which edge rows.
    """
    part = Window.partitionBy(*KEY, "block")
    order = part.orderBy("t", "o")
    ranks = {f"n_{v}": F.count(v).over(order) for v in values} | {f"c_{v}": F.count(v).over(part) for v in values}
    near_edge = reduce(lambda x, y: x | y, [(F.col(f"c_{v}") > 0) & ((F.col(f"n_{v}") <= halo) | (F.col(f"n_{v}") > F.col(f"c_{v}") - halo)) for v in values])
    edges = cut(a.withColumns(ranks | {"first": F.row_number().over(order) == 1}).where(near_edge | F.col("first")))

    starts = edges.where("first").select(*KEY, "block", *[f"c_{v}" for v in values])
    source = Window.partitionBy(*KEY).orderBy("block")
    wanted = []
    for k, v in enumerate(values):
        at = starts.where(F.col(f"c_{v}") > 0).select(*KEY, "block", F.col(f"c_{v}").alias("c"))
        at = at.withColumn("end", F.sum("c").over(source)).withColumn("here", F.struct("block", "c", "end"))
        at = at.withColumns({"prev": F.collect_list("here").over(source.rowsBetween(-halo, -1)), "next": F.collect_list("here").over(source.rowsBetween(1, halo))})
        # the readings of `block` are wanted in `into` if their rank there is above lo or up to hi
        prev = at.select(*KEY, F.col("block").alias("into"), (F.col("end") - F.col("c")).alias("begin"), F.inline("prev")).select(*KEY, "block", "into", (F.col("begin") - halo - (F.col("end") - F.col("c"))).alias("lo"), F.lit(None).cast("bigint").alias("hi"))
        after = at.select(*KEY, F.col("block").alias("into"), F.col("end").alias("stop"), F.inline("next")).select(*KEY, "block", "into", F.lit(None).cast("bigint").alias("lo"), (F.col("stop") + halo - (F.col("end") - F.col("c"))).alias("hi"))
        wanted.append(prev.unionByName(after).withColumn("slot", F.lit(k)))
    bounds = [F.min(F.when(F.col("slot") == k, F.col("lo"))).alias(f"lo_{v}") for k, v in enumerate(values)] + [F.max(F.when(F.col("slot") == k, F.col("hi"))).alias(f"hi_{v}") for k, v in enumerate(values)]
    pairs = reduce(DataFrame.unionByName, wanted).groupBy(*KEY, "block", "into").agg(*bounds)
    cols = ["t", "o", "h", "copies", *values]
    take = reduce(lambda x, y: x | y, [F.coalesce(F.col(f"n_{v}") > F.col(f"lo_{v}"), F.lit(False)) | F.coalesce(F.col(f"n_{v}") <= F.col(f"hi_{v}"), F.lit(False)) for v in values])
    return cut(edges.join(pairs, [*KEY, "block"]).where(take).select(*KEY, F.col("into").alias("block"), *cols))


def fit_ellipsoid(n: np.ndarray, u: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float, float, float, int]:
    """(c, cos, sin, a, b, d, rounds) of the ellipsoid around cells of n points with values u, first differences x and second differences y.

    Semi-axes are sqrt(2 ln n) robust deviations (1.4826 median absolute deviations); the plane of value
    against second difference is turned to its regression line. Points outside go and the rest is
    fitted again, until no point goes. The axis of the first difference never grows.
    """

    def mid(v: np.ndarray, w: np.ndarray) -> float:
        at = np.argsort(v, kind="stable")
        return float(v[at[np.searchsorted(np.cumsum(w[at]), w.sum() / 2)]])

    inside, rounds, turn, most = np.ones(len(n), dtype=bool), 0, 0.0, np.inf
    while True:
        w, q = n[inside], np.abs(x[inside])
        lam = math.sqrt(2 * math.log(max(2.0, float(w.sum()))))
        c = mid(u[inside], w)
        if rounds:
            turn = math.atan2(float((w * (u[inside] - c) * y[inside]).sum()), float((w * (u[inside] - c) ** 2).sum()) or 1.0)
        cos, sin = math.cos(turn), math.sin(turn)
        along, across = (u - c) * cos + y * sin, y * cos - (u - c) * sin
        a, d = (lam * 1.4826 * mid(np.abs(v[inside]), w) for v in (along, across))
        most = b = min(most, lam * 1.4826 * mid(q, w))
        far = np.zeros(len(n))
        for v, axis in ((along, a), (x, b), (across, d)):
            far += (v / axis) ** 2 if axis > 0 else np.where(v != 0, np.inf, 0.0)
        rounds, kept = rounds + 1, inside & (far <= 1)
        if kept.sum() == inside.sum() or not kept.any():
            return c, cos, sin, a, b, d, rounds
        inside = kept


def _fit_cells(cells: pd.DataFrame) -> pd.DataFrame:
    fit = fit_ellipsoid(*(cells[k].to_numpy(dtype=float) for k in ("n", "u", "x", "y")))
    return pd.DataFrame([(int(cells.feed.iat[0]), cells.src.iat[0], int(cells.slot.iat[0]), *fit)], columns=[x.split()[0] for x in CELL_SCHEMA.split(", ")])


def _bin(v: Column) -> Column:
    """A number of the readings' order: 64 bins to a doubling of size."""
    at = F.floor(F.log2(F.abs(v)) * 64) + 100_000
    return F.when(v > 0, at).when(v < 0, -at).otherwise(F.when(v == 0, F.lit(0).cast("bigint")))


def _grade(v: Column, per: int) -> Column:
    """Sign and size of a coordinate, `per` to a doubling; 0 stays 0."""
    at = (F.greatest(F.floor(F.log2(F.abs(v)) * per), F.lit(-60 * per)) + 60 * per + 1).cast("int")
    return F.when(v > 0, at).when(v < 0, -at).otherwise(0)


class _Judge:
    """The steps of flag_faults; suspects() stands apart, so that what the ellipsoids leave to test can be counted."""

    def __init__(self, feeds: list[Feed], block_ms: int | None):
        self.feeds = feeds
        width = max(len(f.rules) for f in feeds)
        self.slots = range(width)
        self.values = [f"v{i}" for i in self.slots]
        self.raw = reduce(DataFrame.unionByName, [_deliveries(f, no, width) for no, f in enumerate(feeds)])
        self.spiky = [i for i in self.slots if any(i < len(f.rules) and f.rules[i].spike_factor is not None for f in feeds)]
        self.high = [i for i in self.slots if any(i < len(f.rules) and f.rules[i].high_factor is not None for f in feeds)]
        self.block_ms = block_ms

    def rule(self, i: int, pick: Callable[[FieldRule], Column]) -> Column:
        cases = [(F.col("feed") == no, pick(f.rules[i])) for no, f in enumerate(self.feeds) if i < len(f.rules)]
        return reduce(lambda acc, c: acc.when(*c), cases[1:], F.when(*cases[0]))

    def relative(self, i: int, yes: Column, no: Column) -> Column:
        kinds = {f.rules[i].relative for f in self.feeds if i < len(f.rules)}
        return (yes if kinds == {True} else no) if len(kinds) == 1 else F.when(self.rule(i, lambda r: F.lit(r.relative)), yes).otherwise(no)

    def far(self, i: int, x: Column, y: Column) -> Column:
        return self.relative(i, F.abs(x / y - 1), F.abs(x - y))

    def readings(self) -> DataFrame:
        """Each delivery once, in blocks with halo (own = false); self.kept stays on the executors' disks for the passes until it is unpersisted."""
        q = F.percentile_approx("t", [0.05, 0.95], 100)
        scale = [F.percentile_approx(f"v{i}", [0.25, 0.5, 0.75], 100).alias(f"q{i}") for i in self.spiky]
        span = self.raw.groupBy(*KEY).agg(F.count("*").alias("n"), q.alias("q"), *scale)
        # blocks of about BLOCK_ROWS rows by the middle nine tenths of a source's time, so that stray stamps do not widen them
        width = F.lit(self.block_ms) if self.block_ms else F.greatest(F.ceil((F.col("q")[1] - F.col("q")[0]) / (F.col("n") * 0.9) * BLOCK_ROWS), F.lit(1))
        spans = cut(span.select(*KEY, width.cast("bigint").alias("wide"), *[f"q{i}" for i in self.spiky]))
        self.n_sources = spans.count()
        # only the width of the fit's cells depends on these quartiles
        self.scales = spans.select(*KEY, *[f"q{i}" for i in self.spiky])
        widths = spans.select(*KEY, "wide")
        once = self.raw.groupBy(*KEY, "t", "h", *self.values).agg(F.min("o").alias("o"), F.count("*").alias("copies"))
        once = once.withColumn("h", F.when(F.col("copies") > 1, F.col("h")))  # only copies are looked for again
        once = once.join(small(widths, self.n_sources), KEY).withColumn("block", F.col("t") - F.pmod("t", "wide")).drop("wide")
        halo = max(3, *(r.stuck_run - 1 for f in self.feeds for r in f.rules)) + 3
        # as many partitions on both sides, so that their union is still parted by block
        parted = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY, "block")
        cols = [*KEY, "block", "t", "o", "h", "copies", *self.values]
        self.kept = parted(once.select(*cols)).persist(StorageLevel.DISK_ONLY)
        beside = _halo(self.kept, halo, self.values)
        return self.kept.withColumn("own", F.lit(True)).union(parted(beside.select(*cols)).withColumn("own", F.lit(False)))

    def points(self, rows: DataFrame) -> DataFrame:
        """bad{i}: impossible; g{i}: the reading if it is not and spikes are looked for; u{i}, x{i}, y{i}: its value and its first and second difference, in the units of the rule (logarithm, steps relative to the reading before)."""
        rows = rows.withColumns({f"bad{i}": F.coalesce(self.rule(i, lambda r, i=i: r.impossible(F.col(f"v{i}"))), F.lit(False)) for i in self.slots})
        rows = rows.withColumns({f"g{i}": F.when(~F.col(f"bad{i}") & self.rule(i, lambda r: F.lit(r.spike_factor is not None)), F.col(f"v{i}")) for i in self.spiky})
        rows = rows.withColumns({f"{n}{i}": F.expr(f"{f}(g{i}) ignore nulls over {IN_BLOCK}") for i in self.spiky for n, f in (("l", "lag"), ("r", "lead"))})
        step = lambda i, x, y: self.relative(i, x / y - 1, x - y)
        rows = rows.withColumns({f"x{i}": F.when(F.col(f"g{i}").isNotNull(), step(i, F.col(f"g{i}"), F.col(f"l{i}"))) for i in self.spiky})
        value = {f"u{i}": self.relative(i, F.when(F.col(f"g{i}") > 0, F.ln(f"g{i}")), F.col(f"g{i}")) for i in self.spiky}
        return rows.withColumns(value | {f"y{i}": step(i, F.col(f"r{i}"), F.col(f"g{i}")) - F.col(f"x{i}") for i in self.spiky}).drop(*[f"r{i}" for i in self.spiky])

    def limits(self, points: DataFrame) -> DataFrame:
        """Per source: e{i} the ellipsoid; m{i} and mv{i} the bins that hold the median step and, for high_factor, the median, as (bin, rank in it, its least and largest value)."""
        none = lambda kind: F.lit(None).cast(kind)
        place = lambda i: F.least(F.greatest(F.coalesce(F.floor((F.col(f"g{i}") - F.col(f"q{i}")[1]) / (F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) * 4), F.lit(0)), F.lit(-200)), F.lit(200))
        lines = []
        for i in self.spiky:
            u, x, y = (F.col(f"{n}{i}") for n in "uxy")
            cell = F.struct(F.lit(i).alias("slot"), F.lit("e").alias("kind"), place(i).alias("k"), _grade(F.abs(x), 2).alias("kx"), _grade(y, 1).alias("ky"), u.alias("u"), F.abs(x).alias("x"), y.alias("y"))
            lines.append(F.when(u.isNotNull() & x.isNotNull() & y.isNotNull(), cell))
            lines.append(F.when(x.isNotNull(), F.struct(F.lit(i).alias("slot"), F.lit("m").alias("kind"), _bin(F.abs(x)).alias("k"), F.lit(0).alias("kx"), F.lit(0).alias("ky"), none("double").alias("u"), F.abs(x).alias("x"), none("double").alias("y"))))
        for i in self.high:
            v = F.when(self.rule(i, lambda r: F.lit(r.high_factor is not None)), F.col(f"v{i}"))
            lines.append(F.when(v.isNotNull(), F.struct(F.lit(i).alias("slot"), F.lit("v").alias("kind"), _bin(v).alias("k"), F.lit(0).alias("kx"), F.lit(0).alias("ky"), none("double").alias("u"), v.alias("x"), none("double").alias("y"))))
        cells = points.where("own").join(small(self.scales, self.n_sources), KEY).select(*KEY, F.inline(F.array(*lines))).where("slot is not null")
        cells = cells.groupBy(*KEY, "slot", "kind", "k", "kx", "ky").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "uxy"], F.min("x").alias("least"), F.max("x").alias("most"))
        cells = cells.persist(StorageLevel.DISK_ONLY)
        fits = cells.where("kind = 'e'").groupBy(*KEY, "slot").applyInPandas(_fit_cells, CELL_SCHEMA)
        fits = fits.groupBy(*KEY).agg(*[F.max(F.when(F.col("slot") == i, F.struct("c", "cos", "sin", "a", "b", "d", "rounds"))).alias(f"e{i}") for i in self.spiky])
        series = Window.partitionBy(*KEY, "slot", "kind")
        mids = cells.where("kind <> 'e'").withColumns({"upto": F.sum("n").over(series.orderBy("k")), "half": F.ceil(F.sum("n").over(series) / 2)})
        mids = mids.withColumn("rank", F.col("half") - F.col("upto") + F.col("n")).where("upto >= half and rank > 0")
        mid = lambda i, kind: F.max(F.when((F.col("slot") == i) & (F.col("kind") == kind), F.struct("k", "rank", "least", "most")))
        mids = mids.groupBy(*KEY).agg(*[mid(i, "m").alias(f"m{i}") for i in self.spiky], *[mid(i, "v").alias(f"mv{i}") for i in self.high])
        found = cut(mids.join(fits, KEY, "left"))
        cells.unpersist()
        return found

    def outside(self, i: int) -> Column:
        """Whether a point lies outside its source's ellipsoid; a missing coordinate counts as in the middle."""
        e, u, y = F.col(f"e{i}"), F.coalesce(F.col(f"u{i}") - F.col(f"e{i}.c"), F.lit(0.0)), F.coalesce(F.col(f"y{i}"), F.lit(0.0))
        part = lambda v, axis: F.when(axis > 0, (v / axis) * (v / axis)).when(v != 0, F.lit(float("inf"))).otherwise(0.0)
        distance = part(u * e["cos"] + y * e["sin"], e["a"]) + part(F.col(f"x{i}"), e["b"]) + part(y * e["cos"] - u * e["sin"], e["d"])
        return F.coalesce(distance > 1, F.col(f"x{i}").isNotNull())

    def suspects(self, rows: DataFrame) -> DataFrame:
        """The few rows that any test may flag, and those around them.

        out{i}: outside the ellipsoid; near{i}: such a reading, or up to three behind one; l{i}: the reading before; eq{i},
        run{i}: equal to it, in which run; high{i}: perhaps too high; mid{i}, midv{i}: in the bin of a median.
        """
        w = Window.partitionBy(*KEY, "block").orderBy("t", "o")
        points = self.points(rows)
        limits = small(self.limits(points), self.n_sources)
        judged = points.withColumns({f"b{i}": F.expr(f"lag(v{i}) ignore nulls over {IN_BLOCK}") for i in self.slots} | {f"at{i}": F.count(f"g{i}").over(w) for i in self.spiky})
        judged = judged.join(limits, KEY, "left")
        judged = judged.withColumns({f"out{i}": F.when(F.col(f"g{i}").isNotNull(), self.outside(i)) for i in self.spiky} | {f"eq{i}": F.coalesce(F.col(f"v{i}") == F.col(f"b{i}"), F.lit(False)) for i in self.slots})
        latest = {f"latest{i}": F.max(F.when(F.col(f"out{i}"), F.col(f"at{i}"))).over(w) for i in self.spiky}
        runs = {f"run{i}": F.sum(F.when(F.col(f"v{i}").isNotNull() & ~F.col(f"eq{i}"), 1).otherwise(0)).over(w) for i in self.slots}
        judged = judged.withColumns(latest | runs)
        marks = {f"near{i}": F.coalesce(F.col(f"g{i}").isNotNull() & (F.col(f"at{i}") - F.col(f"latest{i}") <= 3), F.lit(False)) for i in self.spiky}
        marks |= {f"high{i}": F.coalesce(F.col(f"v{i}") > self.rule(i, lambda r: F.lit(r.high_factor)) * F.col(f"mv{i}.least"), F.lit(False)) for i in self.high}
        mid = lambda v, m: F.coalesce(F.col("own") & (m["least"] < m["most"]) & (_bin(v) == m["k"]), F.lit(False))
        marks |= {f"mid{i}": mid(F.abs(f"x{i}"), F.col(f"m{i}")) for i in self.spiky} | {f"midv{i}": mid(F.col(f"v{i}"), F.col(f"mv{i}")) for i in self.high}
        any_of = [*marks, *[f"{n}{i}" for i in self.slots for n in ("bad", "eq")]]
        judged = judged.withColumns(marks).where(reduce(lambda x, y: x | y, [F.col(c) for c in any_of]))
        return judged.select(*KEY, "block", "own", "t", "o", "h", "copies", *self.values, *any_of, *[f"run{i}" for i in self.slots], *[f"{n}{i}" for i in self.spiky for n in ("g", "l", "x", "out", "m")], *[f"mv{i}" for i in self.high])

    def tested(self, few: DataFrame) -> DataFrame:
        """The suspects that the exact tests flag, and those that the medians or the length of a run need.

        spike{i}: (lo, hi) for each run of one to three readings that would hold this one as a spike for a limit between lo and hi.
        A run's readings and the one behind it are all among the suspects and the one before it is known to its
        first, so the windows over these few rows see all; they keep the rows' order.
        """
        behind = lambda c, k: F.expr(f"lag({c}, {k}) ignore nulls over {IN_BLOCK}")
        ahead = lambda c, k: F.expr(f"lead({c}, {k}) ignore nulls over {IN_BLOCK}")
        few = few.withColumns({f"eqrun{i}": F.when(F.col(f"eq{i}"), F.col(f"run{i}")) for i in self.slots} | {f"before{i}": F.when(F.col(f"g{i}").isNotNull(), F.coalesce(f"l{i}", F.lit(float("nan")))) for i in self.spiky})
        seen = {}
        for i in self.spiky:
            seen |= {f"g{i}_{k}": behind(f"g{i}", k) for k in (1, 2)} | {f"before{i}_{k}": behind(f"before{i}", k) for k in (1, 2)} | {f"out{i}_{k}": behind(f"out{i}", k) for k in (1, 2)} | {f"next{i}_{k}": ahead(f"g{i}", k) for k in (1, 2, 3)}
        half = {i: (min(f.rules[i].stuck_run for f in self.feeds if i < len(f.rules)) - 1) // 2 for i in self.slots}
        # of a run of r readings any one but the first has r/2-1 others on one side
        seen |= {f"{n}eq{i}": f(f"eqrun{i}", half[i]) if half[i] else F.col(f"eqrun{i}") for i in self.slots for n, f in (("p", behind), ("q", ahead))}
        few = few.withColumns(seen)

        def runs(i: int) -> list[tuple[Column, Column, Column]]:
            at = {-2: F.col(f"g{i}_2"), -1: F.col(f"g{i}_1"), 0: F.col(f"g{i}")} | {k: F.col(f"next{i}_{k}") for k in (1, 2, 3)}
            factor, found = self.rule(i, lambda r: F.lit(r.spike_factor)), []
            for a, b in COMBOS:
                before, begins = (F.col(f"before{i}"), F.col(f"out{i}")) if a == 1 else (F.col(f"before{i}_{a - 1}"), F.col(f"out{i}_{a - 1}"))
                lo, hi = self.far(i, at[b], before), F.least(*[self.far(i, at[j], e) for j in range(1 - a, b) for e in (before, at[b])])
                hit = F.col(f"near{i}") & begins & ~F.isnan(before) & at[b].isNotNull() & (lo < hi) & (hi > factor * F.col(f"m{i}.least")) & (lo < factor * F.col(f"m{i}.most"))
                found.append((F.coalesce(hit, F.lit(False)), lo, hi))
            return found

        either = lambda cs: reduce(lambda x, y: x | y, cs)
        few = few.withColumns({f"spiky{i}": either([hit for hit, *_ in runs(i)]) for i in self.spiky} | {f"long{i}": F.coalesce((F.col(f"peq{i}") == F.col(f"eqrun{i}")) | (F.col(f"qeq{i}") == F.col(f"eqrun{i}")), F.lit(False)) for i in self.slots})
        hits = [f"{n}{i}" for i in self.slots for n in ("bad", "long")] + [f"{n}{i}" for i in self.high for n in ("high", "midv")] + [f"{n}{i}" for i in self.spiky for n in ("spiky", "mid")]
        few = few.where(either([F.col(c) for c in hits]))
        few = few.withColumns({f"spike{i}": F.when(F.col(f"spiky{i}"), F.array(*[F.when(hit, F.struct(lo.alias("lo"), hi.alias("hi"))) for hit, lo, hi in runs(i)])) for i in self.spiky})
        names = [f"{n}{i}" for i in self.slots for n in ("bad", "long", "run")] + [f"{n}{i}" for i in self.high for n in ("high", "midv", "mv")] + [f"{n}{i}" for i in self.spiky for n in ("spike", "mid", "m", "x")]
        return few.select(*KEY, "block", "own", "t", "h", "o", "copies", *self.values, *names)

    def _median(self, few: DataFrame, mark: str, value: Column, at: str, name: str) -> DataFrame:
        """Per source the exact median: counts of the values in its bin, taken up to its rank there, or the bin's only value."""
        series = Window.partitionBy(*KEY)
        seen = few.where(mark).groupBy(*KEY, value.alias("value")).agg(F.count("*").alias("n"), F.first(f"{at}.rank").alias("rank"))
        return seen.withColumn("upto", F.sum("n").over(series.orderBy("value"))).where("upto >= rank").groupBy(*KEY).agg(F.min("value").alias(name))

    def faults(self, rows: DataFrame) -> DataFrame:
        few = cut(self.tested(self.suspects(rows)))
        medians = [(f"median{i}", self._median(few, f"mid{i}", F.abs(f"x{i}"), f"m{i}", f"median{i}"), f"m{i}") for i in self.spiky]
        medians += [(f"vmedian{i}", self._median(few, f"midv{i}", F.col(f"v{i}"), f"mv{i}", f"vmedian{i}"), f"mv{i}") for i in self.high]
        head = [*KEY, "t", "h", "o", "copies", *self.values]
        parts = []
        for i in self.slots:
            label = self.rule(i, lambda r: F.lit(r.field))
            run = few.where(f"long{i}").withColumn("len", 1 + F.count("*").over(Window.partitionBy(*KEY, "block", f"run{i}")))
            run = run.where(F.col("own") & (F.col("len") >= self.rule(i, lambda r: F.lit(r.stuck_run))))
            parts.append(run.select(*head, label.alias("field"), F.lit("stuck").alias("fault")))
        few = few.where("own")
        for name, median, at in medians:
            few = few.join(small(median, self.n_sources), KEY, "left").withColumn(name, F.coalesce(name, f"{at}.least"))
        faults = []
        for i in self.slots:
            label = self.rule(i, lambda r: F.lit(r.field))
            mark = lambda hit, kind: faults.append(F.when(hit, F.struct(label.alias("field"), F.lit(kind).alias("fault"))))  # noqa: B023, E731
            mark(F.col(f"bad{i}"), "impossible")
            if i in self.high:
                mark(F.col(f"v{i}") > self.rule(i, lambda r: F.lit(r.high_factor)) * F.col(f"vmedian{i}"), "high")
            if i in self.spiky:
                limit = self.rule(i, lambda r: F.lit(r.spike_factor)) * F.col(f"median{i}")
                mark(F.exists(f"spike{i}", lambda x: (x["lo"] < limit) & (limit < x["hi"])), "spike")  # noqa: B023
        parts.append(few.select(*head, F.inline(F.array(*faults))).where("fault is not null"))
        return cut(reduce(DataFrame.unionByName, parts))


def suspects(feeds: list[Feed], block_ms: int | None = None) -> DataFrame:
    """The rows that flag_faults tests exactly, with the marks that brought them there."""
    judge = _Judge(feeds, block_ms)
    return judge.suspects(judge.readings())


def flag_faults(feeds: list[Feed], block_ms: int | None = None) -> DataFrame:
    """The readings that carry an implausible value, judged by what is normal for their source.

    Repeated deliveries (equal in all but ordinal and the ignored columns) are one reading at the smallest
    ordinal; every copy of a faulty reading is reported. Null, NaN (and 0.0 if zero_missing) are no
    readings; rows with a null source or ts are ignored. Readings of one instant go by ordinal.
    Empty tables give an empty result.

    fault: 'impossible' (the rule's bound), 'spike' (one to three readings in a row, impossible ones set
    aside, away from the reading before and the one after by more than spike_factor median steps,
    while these two are closer), 'high' (above high_factor medians), 'stuck' (all but the first of
    stuck_run or more equal readings in a row). A reading may have several.

    Phase-space thresholding: each reading is a point (value, first, second difference), in logarithms
    and relative steps for relative fields. Per source a robust ellipsoid, turned in the plane of value and
    second difference, is fitted to the points, those outside go, and it is fitted again until none goes. Only
    readings outside the last one can start a run of wrong readings: they and their neighbours are
    written, a few per cent of all, and tested exactly there. A step of more than 25 medians is
    outside for any n below e^140, as the axis of the first difference is at most sqrt(2 ln n) times 1.4826 medians; nothing is lost.
    The fit works on counts per cell of the phase space, so its size does not grow with the rows. Medians are
    exact (the lower one of an even number): counts of 64 bins to a doubling find the bin, counts of the values in it the median.

    Result: feed, field, src, t, ordinal, fault.

    Plan: sources are cut into blocks of about BLOCK_ROWS rows (or of block_ms) with a halo of neighbours, so
    that a source with a third of the rows is many tasks; a list with a line per block is all that meets per source.
    All fields of a feed are judged in one row. The blocks are kept on the executors' disks (lost ones are made again
    from the shuffle), so that the passes over them do not shuffle.
    What is normal for a source is broadcast if the counted sources are few, joined otherwise.
    """
    judge = _Judge(feeds, block_ms)
    flagged = judge.faults(judge.readings())
    judge.kept.unpersist()
    values = judge.values
    same = reduce(lambda x, y: x & y, [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) if c in values else F.col(f"r.{c}") == F.col(f"f.{c}") for c in [*KEY, "t", "h", *values]])
    repeated = flagged.where("copies > 1")
    again = judge.raw.alias("r").join(small(repeated, repeated.count()).alias("f"), same).select(*[F.col(f"r.{c}") for c in [*KEY, "t", "o"]], "f.field", "f.fault")
    every = flagged.where("copies = 1").select(*KEY, "t", "o", "field", "fault").unionByName(again)
    names = F.array(*[F.lit(f.name) for f in feeds])
    return every.select(names[F.col("feed")].alias("feed"), "src", "t", F.col("o").alias("ordinal"), "field", "fault")
