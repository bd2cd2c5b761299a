import math
import random

import numpy as np
from pyspark.sql import functions as F

from tapeloom.functions import market as M
from tapeloom.functions.clean import e8, restore_ms, side_name
from tapeloom.operators import anomaly, bars, stats
from tapeloom.operators.asof import asof_backward, asof_forward, interval_bins, nearest_horizon, range_join


def value(spark, c):
    return spark.range(1).select(c.alias("x")).collect()[0].x


def test_scalars(spark):
    assert math.isclose(value(spark, M.normal_cdf(F.lit(1.95996398))), 0.975, abs_tol=1e-4)
    assert math.isclose(value(spark, M.normal_inverse(F.lit(0.975))), 1.959964, abs_tol=1e-5)
    assert math.isclose(value(spark, M.two_sided_p(F.lit(-1.95996398))), 0.05, abs_tol=1e-4)
    assert value(spark, M.normal_inverse(F.lit(0.0))) < -7 and value(spark, M.erf(F.lit(-0.5))) == -value(spark, M.erf(F.lit(0.5)))
    assert (M.bps_to_rate8(5), M.bps_to_rate8(-0.4), M.duration_text(7_200_000_000_000), M.duration_text(250_000_000), M.duration_text(7)) == (50_000, -4_000, "2h", "250ms", "7ns")
    assert value(spark, M.duration_ns(F.lit("3 days"))) is None
    assert (value(spark, M.relative_rise(F.lit(0.0), F.lit(2.0))), value(spark, M.relative_drop(F.lit(4.0), F.lit(1.0)))) == (1.0, 0.75)
    assert [value(spark, M.close_mechanism(F.lit(t), F.lit(m))) for t, m in ((0.8, 1.0), (0.1, 1.0), (0.0, 0.0))] == ["trade", "re-quote", "re-quote"]
    assert [value(spark, M.wall_outcome(F.lit(10), F.lit(0), F.lit(t))) for t in (8, 1, 5)] == ["absorbed", "pulled", "absorbed"]
    assert value(spark, M.microprice(F.lit(100.0), F.lit(102.0), F.lit(3), F.lit(1))) == 101.5


def test_cleaning(spark):
    rows = [(None,), (1_514_765_153,), (1_514_765_153_664,), (1_514_765_153_664_988,), (1_514_765_153_664_988_999,), (-1_514_765_153_664_988,)]
    got = [r.x for r in spark.createDataFrame(rows, "t bigint").select(restore_ms(F.col("t")).alias("x")).collect()]
    assert got == [None, 1_514_765_153_000, 1_514_765_153_664, 1_514_765_153_664, 1_514_765_153_664, -1_514_765_153_665]
    assert [value(spark, e8(F.lit(x))) for x in (0.1, -0.000000005, float("nan"), None, 1e300)] == [10_000_000, -1, None, None, None]
    assert [value(spark, side_name(F.lit(x))) for x in (" BUY", "b", "Ask ", "x", None)] == ["bid", "bid", "ask", None, None]


def test_moments_and_t(spark):
    m = stats.moments(spark.createDataFrame([("a", float(x)) for x in range(1, 6)] + [("b", 2.0), ("c", None)], "k string, x double"), ["k"], "x")
    r = {x.k: x for x in m.collect()}
    assert (r["a"].mean, round(r["a"].std ** 2, 9), round(r["a"].skew, 9), r["b"].std, r["b"].sharpe, r["c"].n) == (3.0, 2.0, 0.0, 0.0, 0.0, 0)
    assert math.isclose(r["a"].kurtosis, 1.7) and math.isclose(r["a"].t, 3 / (math.sqrt(2.5) / math.sqrt(5)))


def test_overfit_probability_against_brute_force(spark):
    from itertools import combinations

    r = random.Random(2)
    data = {c: [r.gauss(0.05 * k, 1) for _ in range(48)] for k, c in enumerate("abcde")}
    got = stats.overfit_probability(spark.createDataFrame([("s", c, k, x) for c, xs in data.items() for k, x in enumerate(xs)], "s string, c string, no bigint, x double"), "s", "c", "no", "x", 6).collect()[0]
    sharpe = lambda xs: np.mean(xs) / np.std(xs)
    logits = []
    for chosen in combinations(range(6), 3):
        inside = lambda k: k // 8 in chosen  # noqa: B023, E731
        i = {c: sharpe([x for k, x in enumerate(xs) if inside(k)]) for c, xs in data.items()}
        o = {c: sharpe([x for k, x in enumerate(xs) if not inside(k)]) for c, xs in data.items()}
        rank = sum(v <= o[max(i, key=i.get)] for v in o.values()) / 6
        logits.append(math.log(rank / (1 - rank)))
    assert got.splits == 20 and math.isclose(got.pbo, np.mean([x <= 0 for x in logits])) and math.isclose(got.median_logit, sorted(logits)[10])
    n = spark.createDataFrame([(k, n) for k, n in enumerate((100, 20, 15, 9, 7, 4, 3))], "k int, n int").orderBy("k")
    assert [r.b for r in n.select(stats.fitting_blocks(F.col("n")).alias("b")).collect()] == [16, 16, 12, 8, 6, 4, None]
    e = spark.createDataFrame([("few", 1.0, 2.0)] * 2 + [("flat", 0.0, 2.0)] * 3 + [("ok", 2.0, -3.0)] * 3, "k string, size double, ret double")
    assert {r.k: r.factor for r in stats.expected_move(e, ["k"], "size", "ret").collect()} == {"few": 3.0, "flat": 3.0, "ok": 1.5}


def test_ranks_folds_and_streaks(spark):
    r = random.Random(4)
    xs = [r.randrange(30) for _ in range(101)]
    got = stats.nearest_rank(spark.createDataFrame([("a", x) for x in xs], "k string, x int"), ["k"], "x", [0, 10, 50, 100]).collect()[0]
    s = sorted(xs)
    assert (got.p0, got.p10, got.p50, got.p100) == (s[0], s[10], s[50], s[100])
    b = spark.createDataFrame([("a", d) for d in range(5) for _ in range(20)], "k string, date int")
    f = {x.fold: (x.oos_from, x.oos_to, x.is_left_to, x.is_right_from) for x in stats.purged_folds(b, "k", 5, 5).collect()}
    assert f[2] == (40, 60, 35, 65) and f[0] == (0, 20, 0, 25)
    t = spark.createDataFrame([("a", k, x) for k, x in enumerate([1, -1, -2, -1, 5, -1])], "k string, no int, x int")
    x = stats.losing_streaks(t, ["k"], ["no"], "x").collect()[0]
    assert (x.max_losses, x.wins, x.losses) == (3, 2, 4)


def test_exact_ranks_over_all_magnitudes(spark):
    r = random.Random(6)
    data = {"a": [r.choice([-1, 1]) * r.randrange(10 ** r.randrange(1, 12)) for _ in range(500)], "b": [7], "c": [0, 0, 0, 1]}
    rows = spark.createDataFrame([(k, x) for k, xs in data.items() for x in xs] + [("a", None)], "k__x string, x bigint")
    got = {q.k__x: q for q in stats.nearest_rank(rows, ["k__x"], "x", [0, 3, 50, 97, 100]).collect()}
    for k, xs in data.items():
        s = sorted(xs)
        assert [got[k][f"p{p}"] for p in (0, 3, 50, 97, 100)] == [s[math.floor(p / 100 * (len(s) - 1) + 0.5)] for p in (0, 3, 50, 97, 100)]
    assert {q.k__x: q.median for q in stats.median(rows, ["k__x"], "x").collect()} == {k: float(np.median(xs)) for k, xs in data.items()}


def test_asof_over_many_buckets_against_brute_force(spark):
    r = random.Random(7)
    left = [(r.choice("AB"), r.randrange(400), k, 0) for k in range(120)]
    right = [(r.choice("ABC"), r.randrange(400), k, k) for k in range(60)]
    schema = "k string, ts bigint, o bigint, v bigint"
    lf, rt = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema).withColumnRenamed("v", "w")
    for strict in (False, True):
        ok_b = lambda u, t: u < t if strict else u <= t  # noqa: B023, E731
        ok_f = lambda u, t: u > t if strict else u >= t  # noqa: B023, E731
        back = {x.o: x.w for x in asof_backward(lf, rt, ["k"], "ts", "o", ["w"], strict=strict, width=25).collect()}
        fore = {x.o: x.w for x in asof_forward(lf, rt, ["k"], "ts", "o", ["w"], strict=strict, width=25).collect()}
        clip = {x.o: x.w for x in asof_backward(lf, rt, ["k"], "ts", "o", ["w"], strict=strict, clip=True, width=25).collect()}
        for k, t, o, _ in left:
            b = [(u, p, w) for q, u, p, w in right if q == k and ok_b(u, t)]
            f = [(u, p, w) for q, u, p, w in right if q == k and ok_f(u, t)]
            assert back[o] == (max(b)[2] if b else None) and fore[o] == (min(f)[2] if f else None)
            assert clip[o] == (max(b)[2] if b else min((u, p, w) for q, u, p, w in right if q == k)[2])


def test_asof_and_intervals(spark):
    schema = "k string, ts bigint, o bigint, v bigint"
    left = spark.createDataFrame([("A", 5, 1, 0), ("A", 10, 2, 0), ("A", 12, 3, 0), ("B", 1, 4, 0)], schema)
    right = spark.createDataFrame([("A", 10, 1, 7), ("A", 10, 2, 8), ("A", 11, 3, 9)], schema).withColumnRenamed("v", "w")
    take = lambda df: {r.o: r.w for r in df.collect()}
    assert take(asof_backward(left, right, ["k"], "ts", "o", ["w"])) == {1: None, 2: 8, 3: 9, 4: None}
    assert take(asof_backward(left, right, ["k"], "ts", "o", ["w"], strict=True)) == {1: None, 2: None, 3: 9, 4: None}
    assert take(asof_backward(left, right, ["k"], "ts", "o", ["w"], clip=True)) == {1: 7, 2: 8, 3: 9, 4: None}
    assert take(asof_forward(left, right, ["k"], "ts", "o", ["w"])) == {1: 7, 2: 7, 3: None, 4: None}
    assert take(asof_forward(left, right, ["k"], "ts", "o", ["w"], strict=True)) == {1: 7, 2: 9, 3: None, 4: None}
    bars_ = spark.createDataFrame([("A", 10, 1), ("A", 20, 2)], "k string, ts bigint, bar bigint")
    ticks = spark.createDataFrame([("A", t, t, 1) for t in (5, 10, 11, 20, 21)], schema)
    bins = lambda c: {r.o: r.bar for r in interval_bins(bars_, ticks, ["k"], "ts", "o", "bar", c).collect()}
    assert bins("right") == {5: 1, 10: 1, 11: 2, 20: 2} and bins("left") == {5: 1, 10: 2, 11: 2}
    rows = spark.createDataFrame([("A", t, n, t * 10) for n, t in enumerate((0, 4, 6, 20))], "k string, ts bigint, no bigint, v bigint")
    near = lambda late: {r.no: r.x for r in nearest_horizon(rows, ["k"], "ts", "no", "v", 5, "x", late).collect()}
    assert near(False) == {0: 40, 1: 60, 2: 200, 3: None} and near(True)[0] == 60
    j = range_join(left.select("k", "ts", "o"), right.select("k", "ts", "w"), ["k"], "ts", 5).collect()
    assert sorted((r.o, r.path_ts, r.w) for r in j) == [(1, 10, 7), (1, 10, 8), (2, 10, 7), (2, 10, 8), (2, 11, 9)]


def test_discoveries_and_distance(spark):
    z = spark.createDataFrame([("A", 1, 4.0, 0.1, -3.0), ("A", 2, 0.0, 0.0, 0.0)], "k string, ts bigint, a double, b double, c double")
    got = {(r.ts, r.kind): r.discovered for r in bars.false_discovery(z, "k", ["a", "b", "c"], 0.05).collect()}
    assert got == {(1, "a"): True, (1, "c"): True, (1, "b"): False, (2, "a"): False, (2, "b"): False, (2, "c"): False}
    r = np.random.default_rng(1)
    v = r.normal(size=(60, 2))
    v[50] = (9, -9)
    rows = spark.createDataFrame([("A", k, float(a), float(b)) for k, (a, b) in enumerate(v)], "k string, ts bigint, a double, b double")
    d = {x.ts: x.distance for x in bars.mahalanobis(rows, "k", ["a", "b"], 20, ridge=0.0).collect()}
    assert all(d[k] is None for k in range(20)) and max((x, k) for k, x in d.items() if x)[1] == 50
    base, diff = v[30:50], v[50] - v[30:50].mean(0)
    assert math.isclose(d[50], min(40.0, math.sqrt(diff @ np.linalg.inv(np.cov(base, rowvar=False)) @ diff)), rel_tol=1e-6)
    assert anomaly.shuffled_distance(v[30:51], 1) == anomaly.shuffled_distance(v[30:51], 1) > 0


def test_a_singular_covariance_concerns_its_own_row_only():
    cov = np.stack([np.eye(2), np.zeros((2, 2)), 4 * np.eye(2)])
    assert bars._distances(cov, np.array([[3.0, 4.0], [1.0, 1.0], [6.0, 8.0]])).tolist() == [5.0, 0.0, 5.0]


def test_gates_and_sequences(spark):
    s = spark.createDataFrame([("A", k, k, 1) for k in range(20)], "k string, ts bigint, no bigint, side int")
    assert [x.no for x in anomaly.rate_limited(s, "k", 10, 20).orderBy("ts").collect()] == [0, 1, 10, 11]
    p = spark.createDataFrame([("A", k, k, k % 3, 0, 3.0) for k in range(40)] + [("B", k, k, 1, 0, 3.0) for k in range(40)] + [("C", k, k, k % 3, 0, 1.0) for k in range(40)], "k string, ts bigint, no bigint, kind_no int, tag int, avg_z double")
    got = anomaly.repeated_patterns(p, "k", 20).orderBy("ts").collect()
    # three sequences of five bars, each counted from bar 4, 5, 6 on and again every third bar; one kind only or weak bars are none
    assert {x.k for x in got} == {"A"} and [(x.no, x.freq) for x in got][:5] == [(7, 2), (8, 2), (9, 2), (10, 3), (11, 3)] and len({x.pattern for x in got}) == 3
    assert math.isclose(got[0].score, 0.6 * 0.4 + 0.4 * 0.6)
    b = spark.createDataFrame([("A", k, k, push, ab, sp) for k, (push, ab, sp) in enumerate([(0.1, 0.0, 1.0), (0.9, 0.0, 3.0), (0.2, 1.5, 4.0), (0.1, 0.0, 2.0), (0.9, 0.0, 1.0)])], "k string, ts bigint, no bigint, push double, absorb double, speed double")
    assert [(x.no, x.side) for x in anomaly.causal_absorption(b, "k").collect()] == [(3, -1)]
