"""Path-dependent simulation: fills, positions, queues, shells, accounts. One ordered fold per (configuration, key, day)."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.clean import DAY_MS
from tapeloom.functions.market import SCALE

U64 = (1 << 64) - 1


def towards_zero(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a >= 0) == (b >= 0) else -q


def market_fill(levels: list[tuple[int, int]], want: int, cap: int | None = None, buy: bool = True) -> tuple[int, int, int]:
    """(filled, average price, levels) of an order that walks the levels, best first, to a price cap."""
    filled = cost = used = 0
    for p, q in levels:
        if filled >= want or (cap is not None and ((p > cap) if buy else (p < cap))):
            break
        take = min(q, want - filled)
        filled, cost, used = filled + take, cost + take * p, used + 1
    return filled, (cost // filled if filled else 0), used


def fee(price: int, qty: int, rate8: int) -> int:
    return towards_zero(towards_zero(price * qty, SCALE) * rate8, SCALE)


@dataclass
class Account:
    """Position with average entry; realizes on reduction; a trip ends when the position closes or flips.

    A trip's profit is that of its closing fill, net of this fill's fee and the opening fills' fees. After a flip the
    new leg keeps the opening fees and notional of the old one until it is flat.
    """

    position: int = 0
    entry: int = 0
    realized: int = 0
    fees: int = 0
    opened: int = 0
    trips: list[tuple[int, int, int, int]] = field(default_factory=list)  # close ts, pnl net of fees, notional, open ts
    _fees: int = 0
    _notional: int = 0

    def fill(self, ts: int, signed: int, price: int, rate8: int) -> None:
        cost = fee(price, abs(signed), rate8)
        self.fees += cost
        held, size = abs(self.position), abs(signed)
        if not held or (self.position > 0) == (signed > 0):
            if not held:
                self.opened, self._fees, self._notional = ts, 0, 0
            self.entry = (self.entry * held + price * size) // (held + size)
            self.position += signed
            self._fees += cost
            self._notional += towards_zero(price * size, SCALE)
            return
        gain = towards_zero((price - self.entry) * min(held, size), SCALE) * (1 if self.position > 0 else -1)
        self.realized += gain
        self.position += signed
        if size >= held:
            self.trips.append((ts, gain - self._fees - cost, self._notional, self.opened))
            self.entry, self.opened = (price, ts) if self.position else (0, 0)

    def unrealized(self, mark: int) -> int:
        return towards_zero((mark - self.entry) * abs(self.position), SCALE) * (1 if self.position >= 0 else -1)


@dataclass
class RestingOrder:
    """A limit order that waits behind the quantity displayed at its price when it came."""

    side: str
    price: int
    qty: int
    ahead: int

    def match(self, sgn: int, price: int, qty: int) -> int:
        """What a trade fills of it: an opposite aggressor at or through the price first uses up the queue."""
        if self.side == "bid" and (sgn > 0 or price > self.price) or self.side == "ask" and (sgn < 0 or price < self.price):
            return 0
        burned = min(self.ahead, qty)
        self.ahead -= burned
        got = min(self.qty, qty - burned)
        self.qty -= got
        return got


class Coin:
    """Seeded xorshift64* bits."""

    def __init__(self, seed: int):
        self.s = seed & U64 or 1

    def next(self) -> int:
        x = self.s
        x ^= x >> 12
        x = (x ^ (x << 25)) & U64
        x ^= x >> 27
        self.s = x
        return (x * 0x2545F4914F6CDD1D) & U64

    def side(self) -> int:
        return 1 if self.next() >> 63 else -1


def splitmix64(x: int) -> int:
    z = (x + 0x9E3779B97F4A7C15) & U64
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & U64
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & U64
    return z ^ (z >> 31)


@dataclass(frozen=True)
class ShellConfig:
    """How signals become orders: latency to the market, holding time, cool-down, target and stop in bps of the entry, size and fees."""

    latency_ms: int = 300
    hold_ms: int = 600_000
    cooldown_ms: int = 60_000
    target_bps: float = 0.0
    stop_bps: float = 0.0
    qty8: int = SCALE
    taker8: int = 50_000


class Shell:
    """Flat or open, one order in flight; orders reach the market after the latency and fill at the touch seen then.

    step() takes one event in order: ts, bid, ask and the side the signal wants now (0: none).
    """

    def __init__(self, c: ShellConfig):
        self.c = c
        self.account = Account()
        self.queue: list[tuple[int, int, int]] = []  # arrival, number, signed quantity
        self.no = 0
        self.ready = -(1 << 62)
        self.since = self.entry_mid = 0

    def send(self, ts: int, signed: int) -> None:
        heapq.heappush(self.queue, (ts + self.c.latency_ms, self.no, signed))
        self.no += 1

    def step(self, ts: int, bid: int, ask: int, want: int) -> None:
        a = self.account
        while self.queue and self.queue[0][0] <= ts:
            at, _, signed = heapq.heappop(self.queue)
            a.fill(at, signed, ask if signed > 0 else bid, self.c.taker8)
            if a.position:
                self.since, self.entry_mid = at, (bid + ask) // 2
            else:
                self.ready = at + self.c.cooldown_ms
        if self.queue:
            return
        if a.position:
            move = ((bid + ask) / 2 / self.entry_mid - 1) * 1e4 * (1 if a.position > 0 else -1)
            if ts - self.since >= self.c.hold_ms or (self.c.target_bps and move >= self.c.target_bps) or (self.c.stop_bps and move <= -self.c.stop_bps):
                self.send(ts, -a.position)
        elif want and ts >= self.ready:
            self.send(ts, want * self.c.qty8)


def simulate(events: DataFrame, key: str, configs: list[dict], signal: Callable[[dict, str, int], Callable[[tuple], int]], together: int = 256) -> DataFrame:
    """Trips of every configuration over every (key, day): config_id, key, close_ts, open_ts, pnl8, notional8.

    events: key, ts, seq, b8, a8 and x, what the signal sees; signal(config, key, day) gives the function that
    is called with (ts, b8, a8, x) for each event in order and returns the side it wants. Events later than the one before
    raise. The tape is shuffled and sorted once by (key, day) and each event steps all configurations, Arrow batch by
    batch; of grids with more than `together` configurations each such part of them reads the tape on its own.
    """
    parts = max(1, -(-len(configs) // together))
    day = F.col("ts") - F.pmod("ts", F.lit(DAY_MS))
    rows = events.select(key, day.alias("day"), "ts", "seq", "b8", "a8", "x", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part") if parts > 1 else F.lit(0).alias("part"))
    rows = rows.repartition("part", key, "day").sortWithinPartitions("part", key, "day", "ts", "seq")
    names = ["config_id", key, "close_ts", "open_ts", "pnl8", "notional8"]
    shells = [ShellConfig(**{k: v for k, v in c.items() if k in ShellConfig.__dataclass_fields__}) for c in configs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, steps = None, []
        last = 0
        out: list[tuple] = []

        def close() -> None:
            for no, shell, _ in steps:
                out.extend((no, group[1], t, o, p, n) for t, p, n, o in shell.account.trips)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            out.clear()
            return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=names)

        for batch in batches:
            for k, d, t, b, a, x, part in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6, 7)), strict=True):
                if (part, k, d) != group:
                    if group is not None:
                        close()
                    group, last = (part, k, d), t
                    steps = [(no, Shell(shells[no]), signal(configs[no], k, d)) for no in range(part * together, min(len(configs), (part + 1) * together))]
                if t < last:
                    raise ValueError("events go back in time")
                last = t
                for _, shell, want in steps:
                    shell.step(t, b, a, want((t, b, a, x)))
            if len(out) > 5000:
                yield flush()
        if group is not None:
            close()
        yield flush()

    return rows.mapInArrow(run, f"config_id int, {key} string, close_ts bigint, open_ts bigint, pnl8 bigint, notional8 bigint")


@dataclass(frozen=True)
class PaperConfig:
    start: float = 500.0
    leverage: float = 5.0
    margin_share: float = 0.2
    daily_limit: float = 0.05


def paper_account(returns: list[tuple[int, float]], c: PaperConfig = PaperConfig()) -> dict:
    """Compounding account over (ts ms, return of a trip): margin and leverage scale each trip, a day's loss limit (0: none) halts the day, a balance of 0 or less ruins."""
    equity = peak = c.start
    day, day_start, halted_days, taken, worst, ruined, halted = None, c.start, 0, 0, 0.0, False, False
    for ts, r in returns:
        d = ts // DAY_MS
        if d != day:
            day, day_start, halted = d, equity, False
        if halted or ruined:
            continue
        equity += equity * c.margin_share * c.leverage * r
        taken += 1
        if equity <= 0:
            equity, ruined = 0.0, True
            continue
        peak = max(peak, equity)
        worst = max(worst, 1 - equity / peak)
        if c.daily_limit > 0 and (day_start - equity) / day_start >= c.daily_limit:
            halted = True
            halted_days += 1
    return {"final": equity, "taken": taken, "halted_days": halted_days, "max_drawdown": worst, "ruined": ruined}


def paper_accounts(trips: DataFrame, key: str, ts: str, ret: str, c: PaperConfig = PaperConfig()) -> DataFrame:
    """paper_account for each key, its trips streamed in order; halts and ruin depend on the path."""
    rows = trips.select(F.col(key).cast("string").alias("k"), F.col(ts).alias("t"), F.col(ret).cast("double").alias("r")).dropna().repartition("k").sortWithinPartitions("k", "t", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, have, res = None, [], []
        for batch in batches:
            for k, t, r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != group:
                    if group is not None:
                        res.append((group, paper_account(have, c)))
                    group, have = k, []
                have.append((t, r))
        if group is not None:
            res.append((group, paper_account(have, c)))
        yield pa.record_batch([pa.array([k for k, _ in res], pa.string()), *[pa.array([x[n] for _, x in res], t) for n, t in (("final", pa.float64()), ("taken", pa.int64()), ("halted_days", pa.int64()), ("max_drawdown", pa.float64()), ("ruined", pa.bool_()))]], names=[key, "final", "taken", "halted_days", "max_drawdown", "ruined"])

    return rows.mapInArrow(run, f"{key} string, final double, taken bigint, halted_days bigint, max_drawdown double, ruined boolean")


def non_overlapping(signals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Greedy selection per key and day: a signal counts if it starts after the last counted one ended."""
    day = F.col(start) - F.pmod(start, F.lit(DAY_MS))
    rows = signals.withColumn("day__", day).repartition(key, "day__").sortWithinPartitions(key, "day__", start, end)
    cols = signals.columns
    i_key, i_start, i_end, i_day = cols.index(key), cols.index(start), cols.index(end), len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, free = None, 0
        for batch in batches:
            keep = []
            for n, (k, d, s, e) in enumerate(zip(*(batch.column(i).to_pylist() for i in (i_key, i_day, i_start, i_end)), strict=True)):
                if (k, d) != group:
                    group, free = (k, d), -(1 << 62)
                if s > free:
                    keep.append(n)
                    free = e
            yield batch.take(pa.array(keep, pa.int64())).select(cols)

    return rows.mapInArrow(run, signals.schema)


def triple_barrier(bars: DataFrame, signals: DataFrame, key: str, hold: int, target_bps: float, stop_bps: float) -> DataFrame:
    """First of target, stop or expiry after each signal, in bars: exit number, kind, bps. A target or stop of 0 is none.

    bars: key, no (dense), mid8, b8, a8; signals: key, no, is_long. A long's target is judged by the ask and its stop by the
    bid; the target is looked at first; touched barriers pay the barrier, expiry pays the mid. A range join over buckets of hold bars.
    """
    b = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(hold))
    entry = bars.select(key, "no", F.col("mid8").alias("entry8"))
    s = signals.join(entry, [key, "no"]).withColumn("b__", F.explode(F.array(b("no"), b("no") + hold)))
    last = bars.groupBy(key).agg(F.max("no").alias("end"))
    p = bars.select(key, F.col("no").alias("at"), "mid8", "b8", "a8").join(last, key).withColumn("b__", b("at"))
    x = s.join(p, [key, "b__"]).where((F.col("at") > F.col("no")) & (F.col("at") <= F.col("no") + hold))
    side = F.when(F.col("is_long"), 1).otherwise(-1)
    bps = lambda c: (F.col(c) / F.col("entry8") - 1) * 1e4 * side
    hit_t = F.lit(target_bps > 0) & (F.when(F.col("is_long"), bps("a8")).otherwise(bps("b8")) >= target_bps)
    hit_s = F.lit(stop_bps > 0) & (F.when(F.col("is_long"), bps("b8")).otherwise(bps("a8")) <= -stop_bps)
    kind = F.when(hit_t, F.struct(F.lit("target").alias("kind"), F.lit(float(target_bps)).alias("bps"))).when(hit_s, F.struct(F.lit("stop").alias("kind"), F.lit(-float(stop_bps)).alias("bps"))).when((F.col("at") == F.col("no") + hold) | (F.col("at") == F.col("end")), F.struct(F.lit("time").alias("kind"), bps("mid8").alias("bps")))
    g = x.where(kind.isNotNull()).groupBy(key, "no", "is_long").agg(F.min(F.struct("at", kind.alias("x"))).alias("m"))
    return g.select(key, "no", "is_long", F.col("m.at").alias("exit_no"), F.col("m.x.kind").alias("barrier"), F.col("m.x.bps").alias("gross_bps"))
