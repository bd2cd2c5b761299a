"""Quoting around a fair value: targets, inventory skew, repricing, queue fills. An ordered fold per (key, day)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tapeloom.functions.market import SCALE
from tapeloom.operators.anomaly import ordered_fold
from tapeloom.operators.sim import Account, RestingOrder


@dataclass(frozen=True)
class QuoteConfig:
    offset_bps: float = 2.0
    reprice_bps: float = 1.0
    danger_bps: float = 20.0
    stale_ms: int = 60_000
    qty8: int = SCALE
    max_inventory8: int = 3 * SCALE
    skew: float = 0.5
    maker8: int = -4_000

    def __post_init__(self) -> None:
        for name, lo, hi in (("offset_bps", 0, 100), ("reprice_bps", 0.1, 100), ("danger_bps", 1, 500), ("skew", 0, 1)):
            if not lo <= getattr(self, name) <= hi:
                raise ValueError(f"{name} must be in [{lo}, {hi}]")


def target(fair: int, side: str, position: int, c: QuoteConfig) -> int:
    """Fair value less or plus the offset; inventory on the side widens it, on the other side narrows it, down to 0."""
    lean = position / c.max_inventory8 * (1 if side == "bid" else -1)
    offset = max(c.offset_bps * (1 + c.skew * lean), 0.0) / 1e4
    return int(fair * (1 - offset if side == "bid" else 1 + offset))


class Quoter:
    """Keeps a bid and an ask around the fair value: places, keeps, reprices, pulls when the value is stale or jumps; fills come from trades through the queue."""

    def __init__(self, c: QuoteConfig):
        self.c = c
        self.account = Account()
        self.orders: dict[str, RestingOrder] = {}
        self.fair = self.changed = 0
        self.quotes = self.fills = self.rejected = 0

    def step(self, ts: int, kind: str, a: int, b: int, sgn: int) -> tuple | None:
        """A quote (bid a, ask b) moves the fair value; a trade (price a, quantity b, aggressor sgn) may fill."""
        if kind == "trade":
            got = 0
            for side, o in list(self.orders.items()):
                if q := o.match(sgn, a, b):
                    self.account.fill(ts, q if side == "bid" else -q, o.price, self.c.maker8)
                    self.fills += 1
                    got += q if side == "bid" else -q
                    if not o.qty:
                        del self.orders[side]
            return (ts, got, self.account.position, self.account.realized - self.account.fees, self.quotes, self.fills) if got else None
        fair = (a + b) // 2
        jump = abs(fair / self.fair - 1) * 1e4 if self.fair else 0.0
        if fair != self.fair:
            self.fair, self.changed = fair, ts
        if jump >= self.c.danger_bps or ts - self.changed >= self.c.stale_ms:
            self.orders.clear()
            return None
        for side, touch in (("bid", b), ("ask", a)):
            full = abs(self.account.position) >= self.c.max_inventory8 and (self.account.position > 0) == (side == "bid")
            if full:
                self.orders.pop(side, None)
                continue
            px = target(fair, side, self.account.position, self.c)
            if px >= touch if side == "bid" else px <= touch:  # post-only: what would cross is rejected
                self.rejected += 1
                self.orders.pop(side, None)
                continue
            o = self.orders.get(side)
            if o is None or abs(px / o.price - 1) * 1e4 >= self.c.reprice_bps:
                self.orders[side] = RestingOrder(side, px, self.c.qty8, 0)
                self.quotes += 1
        return None


def run_quoter(events: DataFrame, key: str, c: QuoteConfig = QuoteConfig()) -> DataFrame:
    """The fills of a quoter over each (key, day): ts, filled8, position8, net8, quotes, fills. events: ts, seq, kind ('quote', 'trade'), a, b, sgn."""
    out = "ts bigint, filled8 bigint, position8 bigint, net8 bigint, quotes int, fills int"
    return ordered_fold(events, key, ["ts", "seq"], ["kind", "a", "b", "sgn"], out, lambda: Quoter(c), lambda q, r: q.step(r[0], *r[2:]))
