import math
import random
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from tapeloom.operators import spikes
from tapeloom.operators.spikes import Feed, FieldRule, fit_ellipsoid, flag_faults, suspects

SCHEMA = "src string, ts bigint, v double, w double, o bigint, arr bigint, feed string, field string, block int, h int, copies int"
RULES = [FieldRule("v", lambda c: c <= 0, 6, relative=True), FieldRule("w", lambda c: c < -50, 4, spike_factor=None, high_factor=100.0)]


def run(spark, rows, block_ms=86_400_000, rules=RULES):
    df = spark.createDataFrame([(*r, "a", "b", 1, 2, 3) for r in rows], SCHEMA)
    got = flag_faults([Feed("f", df, "src", "ts", "o", rules, ["arr"])], block_ms).collect()
    return sorted((r.field, r.src, r.ordinal, r.fault) for r in got)


def brute(rows):
    ok = lambda x: x is not None and not math.isnan(x)
    text = lambda x: str(x)
    out = []
    once = {}
    for s, t, v, w, o, _ in rows:
        if s is not None and t is not None:
            once.setdefault((s, t, text(v), text(w)), []).append((o, v, w))
    for name, pick, run_len in (("v", 1, 6), ("w", 2, 4)):
        per = {}
        for (s, t, *_), copies in once.items():
            if ok(copies[0][pick]):
                per.setdefault(s, []).append((t, min(c[0] for c in copies), copies[0][pick], [c[0] for c in copies]))
        for s, seq in per.items():
            seq.sort()
            found = [set() for _ in seq]
            bad = [x[2] <= 0 if name == "v" else x[2] < -50 for x in seq]
            for i, b in enumerate(bad):
                if b:
                    found[i].add("impossible")
            k = 0
            while k < len(seq):
                e = k
                while e + 1 < len(seq) and seq[e + 1][2] == seq[k][2]:
                    e += 1
                if e - k + 1 >= run_len:
                    for i in range(k + 1, e + 1):
                        found[i].add("stuck")
                k = e + 1
            if name == "v":
                good = [i for i, b in enumerate(bad) if not b]
                x = [seq[i][2] for i in good]
                if len(x) > 1:
                    lim = 25 * median(abs(b / a - 1) for a, b in zip(x, x[1:]))
                    for length in (1, 2, 3):
                        for i in range(1, len(x) - length):
                            p, q = x[i - 1], x[i + length]
                            r = x[i : i + length]
                            if abs(q / p - 1) < lim and all(abs(y / p - 1) > lim and abs(y / q - 1) > lim for y in r):
                                for j in range(i, i + length):
                                    found[good[j]].add("spike")
            else:
                top = 100 * median(y[2] for y in seq)
                for i, y in enumerate(seq):
                    if y[2] > top:
                        found[i].add("high")
            for y, f in zip(seq, found):
                out += [(name, s, o, k) for o in y[3] for k in f]
    return sorted(out)


def tape(seed, n=700):
    r = random.Random(seed)
    rows, o = [], 0
    for s in ("A", "B"):
        x, t = 100.0, 0
        k = 0
        while k < n:
            t += r.randrange(1, 60_000)
            x *= 1 + r.uniform(-1, 1) * 1e-3
            event = r.random()
            if event < 0.02:
                burst = [x * r.choice([0.5, 1.8])] * r.choice([1, 2, 3])
            elif event < 0.03:
                burst = [x] * r.choice([5, 6, 12, 40])
            elif event < 0.04:
                burst = [r.choice([0.0, -1.0])]
            elif event < 0.06:
                burst = [r.choice([None, float("nan")])]
            else:
                burst = [x]
            for v in burst:
                t += r.randrange(0, 5_000)
                w = r.choice([None, 3.0, 5000.0, -60.0, *[r.uniform(1, 9)] * 40])
                o += 1
                rows.append((s, t, v, w, o, t + 5))
                if r.random() < 0.05:
                    rows.append((s, t, v, w, o + 100_000, t + 9))
                k += 1
    return rows


def test_against_brute_force(spark):
    rows = tape(4) + [(None, 5, 1.0, 1.0, 1_000_000, 0), ("A", None, 1.0, 1.0, 1_000_001, 0)]
    assert run(spark, rows) == brute(rows)


def test_blocks_do_not_change_anything(spark):
    rows = tape(8, 400)
    assert run(spark, rows, block_ms=200_000) == brute(rows)


def test_all_copies_and_empty(spark):
    assert run(spark, []) == []
    rows = [("A", k * 1000, 100 + (k % 3) * 0.01, 1.0 + k, k, 0) for k in range(50)]
    rows[20] = ("A", 20_000, 300.0, 1.0, 20, 0)
    rows.append(("A", 20_000, 300.0, 1.0, 777, 9))
    assert [x for x in run(spark, rows) if x[3] == "spike"] == [("v", "A", 20, "spike"), ("v", "A", 777, "spike")]


def test_many_copies_of_one_delivery(spark):
    rows = spark.range(5_000).select(F.lit("A").alias("src"), F.lit(7).cast("bigint").alias("ts"), F.lit(-1.0).alias("v"), F.lit(1.0).alias("w"), F.col("id").alias("o"), F.col("id").alias("arr"))
    got = flag_faults([Feed("f", rows, "src", "ts", "o", RULES, ["arr"])])
    assert got.where("fault = 'impossible'").count() == 5_000


def test_outage_of_one_field_at_a_block_edge(spark):
    """60 rows on each side of the edge have no v, and its stuck run and spike lie across them; w has readings all along."""
    rows = [("A", k * 1000, None if 340 <= k < 460 else 100 + (k % 3) * 0.01, 1.0 + k % 7, k, 0) for k in range(800)]
    for k in (338, 339, 460, 461, 462, 463):
        rows[k] = ("A", k * 1000, 55.0 if k > 461 else 100.5, 1.0, k, 0)
    rows[464] = ("A", 464_000, 100.5, 1.0, 464, 0)
    for k in (336, 337):
        rows[k] = ("A", k * 1000, 100.5, 1.0, k, 0)
    got = run(spark, rows, block_ms=400_000)
    assert got == brute(rows) and {"stuck", "spike"} <= {x[3] for x in got}


def test_the_ellipsoid_prunes_and_loses_none(spark, monkeypatch):
    """With it only the spikes and readings beside them are tested, without it all; the faults are the same."""
    r = random.Random(3)
    rows, x = [], 100.0
    for k in range(4_000):
        x *= 1 + r.gauss(0, 1e-3)
        rows.append(("A", k * 1000, x * (1.6 if k % 97 == 5 or k % 501 in (7, 8, 9) else 1.0), None, k, 0))
    df = spark.createDataFrame([(*row, "a", "b", 1, 2, 3) for row in rows], SCHEMA)
    feed = Feed("f", df, "src", "ts", "o", RULES, ["arr"])
    tested = suspects([feed]).where("own and near0").count()
    found = run(spark, rows)
    assert found == brute(rows) and sum(f[3] == "spike" for f in found) > 40
    assert tested < 0.15 * len(rows)  # 65 runs, each with the readings beside it
    monkeypatch.setattr(spikes._Judge, "outside", lambda self, i: F.col(f"x{i}").isNotNull())
    assert suspects([feed]).where("own and near0").count() > 0.99 * len(rows)
    assert run(spark, rows) == found


def test_the_fit_ends_when_no_point_goes_and_turns():
    rng = np.random.default_rng(5)
    u = rng.normal(0, 3, 5_000)
    x = rng.normal(0, 1, 5_000)
    y = 0.5 * u + rng.normal(0, 0.2, 5_000)
    x[:50] = 200
    c, cos, sin, a, b, d, rounds = fit_ellipsoid(np.ones(5_000), u, x, y)
    assert rounds > 1 and abs(c) < 0.3 and abs(sin / cos - 0.5) < 0.05 and 3 < b < 6 and d < 2
    again = np.ones(5_000) * ((((u - c) * cos + y * sin) / a) ** 2 + (x / b) ** 2 + ((y * cos - (u - c) * sin) / d) ** 2 <= 1)
    assert (again[:50] == 0).all() and again.mean() > 0.97


def test_single_readings_have_their_faults(spark):
    """A source whose only reading is impossible has no step and no median, and is reported all the same."""
    rows = [("A", 1, -1.0, None, 1, 0), ("B", 1, None, -60.0, 2, 0), ("C", 1, None, None, 3, 0)]
    assert run(spark, rows) == brute(rows) and {f[2] for f in brute(rows)} == {1, 2}
