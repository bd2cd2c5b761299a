import math
import random

from pyspark.sql import functions as F

from tapeloom.operators.grid import regular_grid

SCHEMA = "coin string, ts bigint, v double, o bigint, cell int, t int, k0 string"
P, DAY = 300_000, 86_400_000


def brute(rows, validity):
    by = {}
    for c, t, v, o, *_ in rows:
        if c is not None and t is not None and v is not None and not math.isnan(v) and v != 0:
            by.setdefault((c, t // DAY), {}).setdefault(t, []).append((o, v))
    out = {}
    for (c, _), ticks in by.items():
        seq = [(t, max(x)[1]) for t, x in sorted(ticks.items())]
        cells = range(seq[0][0] // P * P, seq[-1][0] // P * P + 1, P)
        for p in cells:
            area = cov = 0.0
            for k, (t, v) in enumerate(seq):
                end = min(seq[k + 1][0] if k + 1 < len(seq) else 1 << 60, t + validity)
                held = max(0, min(end, p + P) - max(t, p))
                area, cov = area + v * held, cov + held
            n = sum(p <= t < p + P for t, _ in seq)
            fill = [v for t, v in seq if t < p + P][-1]
            out[c, p] = ("observed" if n else "gap", n, area / cov if cov else None, cov / P, fill)
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for c in ("A", "B", None):
        for k in range(400):
            t = r.randrange(0, 2 * DAY, 1000)
            v = r.choice([None, float("nan"), 0.0, *[r.uniform(1, 9)] * 12])
            rows.append((c, t, v, len(rows), 1, 2, "x"))
            if k % 7 == 0:
                rows.append((c, t, v if k % 2 else r.uniform(1, 9), len(rows) + 10_000, 1, 2, "x"))
    rows.append(("A", None, 1.0, 99_999, 0, 0, None))
    got = regular_grid(spark.createDataFrame(rows, SCHEMA), ["coin"], "ts", "v", "o").collect()
    want = brute(rows, 900_000)
    assert len(got) == len(want)
    for g in got:
        state, n, twa, cov, fill = want[g.coin, g.period_ms]
        assert (g.state, g.n_readings, g.fill) == (state, n, fill)
        assert math.isclose(g.coverage, cov, abs_tol=1e-9)
        assert (g.twa is None) == (twa is None) and (twa is None or math.isclose(g.twa, twa, rel_tol=1e-9))


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert regular_grid(empty, ["coin"], "ts", "v", "o").count() == 0
    one = spark.createDataFrame([("A", 1234, 5.0, 1, 0, 0, "")], SCHEMA)
    assert [(r.period_ms, r.state) for r in regular_grid(one, ["coin"], "ts", "v", "o").collect()] == [(0, "observed")]


def test_hot_copies_count_once(spark):
    rows = spark.range(20_000).select(F.lit("A").alias("coin"), F.lit(1000).cast("bigint").alias("ts"), F.lit(2.0).alias("v"), F.col("id").alias("o"))
    assert regular_grid(rows, ["coin"], "ts", "v", "o").collect()[0].n_readings == 1
