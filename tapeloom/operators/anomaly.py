"""From bar features to gated signals: events, confidences, patterns, null gates, causal sequences."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.clean import DAY_MS

REVERSALS = ("divergence", "absorption")


def event_confidence(z: Column, threshold: Column) -> Column:
    """0 at the threshold, towards 1 far beyond it."""
    beyond = F.abs(z) - threshold
    return F.when(beyond > 0, beyond / (F.abs(z) + 5.5 * threshold)).otherwise(0.0)


def event_direction(kind: Column, z: Column, flow: Column, vacuum: Column) -> Column:
    """+1 or -1: the sign of z, but of the flow for divergences and of the ask-less-bid vacuum for vacuums."""
    sign = lambda v: F.when(v > 0, 1).when(v < 0, -1).otherwise(0)
    return F.when(kind.contains("divergence"), sign(flow)).when(kind.contains("vacuum"), sign(vacuum)).otherwise(sign(z))


def compose_signals(events: DataFrame, distances: DataFrame, key: str, min_confidence: float = 0.48, min_distance: float = 2.0) -> DataFrame:
    """One signal per bar from its events (kind, z, confidence, direction) and its distance.

    Direction: the side with the larger sum of |z|, none on a tie. Confidence: the |z|-weighted mean, raised by the distance
    and by agreement, at most 1. Class: reversal if a divergence is there, or an absorption against the flow, else momentum.
    """
    w = F.abs("z")
    g = events.groupBy(key, "ts").agg(
        F.sum(F.when(F.col("direction") > 0, w).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("direction") < 0, w).otherwise(0.0)).alias("down"), (F.sum(w * F.col("confidence")) / F.sum(w)).alias("conf"),
        F.bool_or(F.col("kind").contains("divergence")).alias("div"), F.bool_or(F.col("kind").contains("absorption")).alias("absorb"), F.max(F.when(F.col("kind").contains("ofi"), F.signum("z"))).alias("flow"), F.count("*").alias("events"),
    )
    side = F.when(F.col("up") > F.col("down"), 1).when(F.col("down") > F.col("up"), -1).otherwise(0)
    x = g.join(distances.select(key, "ts", "distance"), [key, "ts"]).withColumn("side", side).where("side <> 0")
    agree = F.greatest(F.col("up"), F.col("down")) / (F.col("up") + F.col("down"))
    conf = F.least(F.col("conf") * (1 + F.least(F.col("distance") / 10, F.lit(1.0))) * (0.5 + agree / 2), F.lit(1.0))
    kind = F.when(F.col("div") | (F.col("absorb") & (F.coalesce(F.col("flow"), F.lit(0.0)) != F.col("side"))), "reversal").otherwise("momentum")
    x = x.withColumns({"confidence": conf, "class": kind})
    return x.where((F.col("confidence") >= min_confidence) & (F.col("distance") >= min_distance)).select(key, "ts", "side", "class", "confidence", "distance", "events")


def ordered_fold(rows: DataFrame, key: str, order: list[str], columns: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], tuple | None]) -> DataFrame:
    """A fold per (key, UTC day of the first order column): step(state, row) may return an output row (key comes first). Arrow batches stream through."""
    day = F.col(order[0]) - F.pmod(order[0], F.lit(DAY_MS))
    own = list(dict.fromkeys([*order, *columns]))
    parts = rows.select(F.col(key).cast("string").alias("key__"), day.alias("day__"), *own).repartition("key__", "day__").sortWithinPartitions("key__", "day__", *order)
    target = pa.schema([("key", pa.string())])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(f"{key} string, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            out = []
            for k, d, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, d) != group:
                    group, state = (k, d), start()
                made = step(state, tuple(row))
                if made is not None:
                    out.append((k, *made))
            cols = list(zip(*out, strict=True)) if out else [()] * len(target)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    return parts.mapInArrow(run, f"{key} string, {schema}")


def rate_limited(signals: DataFrame, key: str, window: int, limit: float) -> DataFrame:
    """Signals (ts, no, side) of which at most ceil(limit x window / 100) pass within `window` bars; a signal that is dropped does not count."""
    most = int(np.ceil(limit * window / 100))

    def step(past: deque, row: tuple) -> tuple | None:
        ts, no, side = row
        while past and past[0] <= no - window:
            past.popleft()
        if len(past) >= most:
            return None
        past.append(no)
        return ts, no, side

    return ordered_fold(signals, key, ["ts", "no"], ["side"], "ts bigint, no bigint, side int", deque, step)


# fixed values of the pattern score
MIN_AVG_Z, FINAL_SCORE, FULL_FREQUENCY = 1.35, 0.42, 5


def repeated_patterns(top: DataFrame, key: str, lookback: int = 20) -> DataFrame:
    """Sequences of the strongest anomalies of lookback/4 (2 to 8) bars that come back: pattern, how often, score >= 0.42.

    top: ts, no (of the bar), kind_no, tag (direction and strength of the strongest anomaly), avg_z (mean |z| of the bar's
    anomalies); bars without anomalies are left out. A sequence counts if its mean |z| is 1.35 or more, not below the
    background (the median of lookback bars) and not of one kind only; equal neighbours raise the bar by a tenth each.
    It is counted again only if its own last count is at least half its length of bars ago (2 at least). Score: 0.6 min(frequency/5, 1)
    + 0.4 quality, which weighs the last mean |z| against 2.7 (0.6) and the background (0.4). Starts anew each UTC day.
    """
    length = min(max(lookback // 4, 2), 8)
    cooldown = max(2, (length + 1) // 2)

    def middle(xs: deque) -> float:
        s = sorted(xs)
        return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2

    def sequence(s: dict) -> int | None:
        if len(s["bars"]) < length:
            return None
        last = list(s["bars"])[-length:]
        mean, back = sum(z for *_, z in last) / length, middle(s["z"])
        same = sum(a[0] == b[0] for a, b in zip(last, last[1:], strict=False))
        if back > mean * 1.1 or same >= length - 1 or mean < MIN_AVG_Z * (1 + 0.1 * same):
            return None
        h = 7
        for kind, tag, _ in last:
            h = (h * 1_000_003 + kind * 31 + tag + 1) & 0x7FFFFFFFFFFFFFFF
        return h

    def step(s: dict, row: tuple) -> tuple | None:
        ts, no, kind, tag, z = row
        s["bars"].append((kind, tag, z))
        s["z"].append(z)
        h = sequence(s)
        if h is None:
            return None
        if no - s["counted"].get(h, 0) >= cooldown:
            s["seen"][h] = s["seen"].get(h, 0) + 1
            s["counted"][h] = no
        freq, back = s["seen"].get(h, 0), middle(s["z"])
        quality = 0.6 * min(z / MIN_AVG_Z * 0.5, 1.0) + 0.4 * (min(max((z / back - 1) * 0.5, 0.0), 1.0) if back > 0 else 0.0) if z > 0 else 0.5
        score = 0.6 * min(freq / FULL_FREQUENCY, 1.0) + 0.4 * quality
        return (ts, no, h, freq, float(score)) if freq >= 2 and score >= FINAL_SCORE else None

    start = lambda: {"bars": deque(maxlen=lookback), "z": deque(maxlen=lookback), "seen": {}, "counted": {}}
    return ordered_fold(top, key, ["ts", "no"], ["kind_no", "tag", "avg_z"], "ts bigint, no bigint, pattern bigint, freq int, score double", start, step)


def causal_absorption(bars: DataFrame, key: str, within: int = 6, pressure: float = 0.6, absorption: float = 1.0) -> DataFrame:
    """Pressure, then absorption of it on a held touch, then deceleration, in this order within `within` bars: one reversal each.

    bars: ts, no, push (signed share of aggressive volume), absorb (absorption against the push), speed (|return| in bps).
    """

    def step(s: dict, row: tuple) -> tuple | None:
        ts, no, push, absorb, speed = row
        if s["stage"] and no - s["from"] > within:
            s.update(stage=0)
        if not s["stage"]:
            if abs(push) >= pressure:
                s.update(stage=1, side=1 if push > 0 else -1, **{"from": no}, strength=[abs(push) / pressure])
        elif s["stage"] == 1:
            if absorb >= absorption:
                s.update(stage=2, speed=speed)
                s["strength"].append(absorb / absorption)
        elif speed < s["speed"]:
            side, strength = -s["side"], s["strength"]
            s.update(stage=0)
            mean = min(max(sum(strength) / len(strength), 0.0), 1.5)
            return ts, no, side, float(min(1.0, 0.8 + min(max(mean - 1, 0.0), 0.2)))
        elif speed > s["speed"]:
            s["speed"] = speed
        return None

    return ordered_fold(bars, key, ["ts", "no"], ["push", "absorb", "speed"], "ts bigint, no bigint, side int, completeness double", lambda: {"stage": 0}, step)


def shuffled_distance(vectors: np.ndarray, seed: int, times: int = 100) -> float:
    """Mean distance of a window's last vector to the rest after shuffling and sign-flipping its features: what chance gives."""
    r = np.random.default_rng(seed)
    base = vectors[:-1]
    mean, cov = base.mean(0), np.cov(base, rowvar=False) + 1e-6 * np.eye(base.shape[1])
    inv = np.linalg.inv(cov)
    out = []
    for _ in range(times):
        x = r.permutation(vectors[-1]) * r.choice([-1, 1], vectors.shape[1]) - mean
        out.append(np.sqrt(max(x @ inv @ x, 0)))
    return float(np.mean(out))


def gate_per_block(signals: DataFrame, key: str, bars: int, most: int) -> DataFrame:
    """The first `most` signals of each block of `bars` bars (of the day's numbers no): the count starts anew with each block."""
    w = Window.partitionBy(key, F.col("ts") - F.pmod("ts", F.lit(DAY_MS)), F.call_function("div", F.col("no"), F.lit(bars).cast("bigint"))).orderBy("no", "ts")
    return signals.withColumn("nth__", F.row_number().over(w)).where(F.col("nth__") <= most).drop("nth__")
