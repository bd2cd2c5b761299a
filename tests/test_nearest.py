import random

from tapeloom.operators.nearest import nearest_in_time

SCHEMA = "coin string, ts bigint, o bigint, b string, is_left int, t double"


def run(spark, left, right, tol):
    frame = lambda rows: spark.createDataFrame([(*r, "z", 1, 0.5) for r in rows], SCHEMA)
    got = nearest_in_time(frame(left), frame(right), ["coin"], "ts", "o", tol).collect()
    return sorted((r.left_ordinal, r.right_ordinal, r.dt_ms) for r in got)


def brute(left, right, tol):
    out = []
    for c, t, o in left:
        near = [(abs(u - t), u, p) for d, u, p in right if c is not None and d == c and t is not None and u is not None and abs(u - t) <= tol]
        if near:
            _, u, p = min(near)
            out.append((o, p, u - t))
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(9)
    for tol, span in ((90, 3000), (7, 300), (1000, 2000)):
        make = lambda base, n: [(r.choice(["A", "B", None]), r.choice([None, *[r.randrange(-span, span) for _ in range(9)]]), base + k) for k in range(n)]  # noqa: B023, E731
        left, right = make(0, 150), make(1000, 200)
        right += [(c, t, o + 5000) for c, t, o in right[:40]]  # repeated deliveries
        assert run(spark, left, right, tol) == brute(left, right, tol)


def test_bounds_ties_and_empty(spark):
    left = [("A", 100, 1)]
    assert run(spark, left, [("A", 190, 9), ("A", 10, 8)], 90) == [(1, 8, -90)]
    assert run(spark, left, [("A", 191, 9)], 90) == []
    assert run(spark, left, [("A", 100, 9), ("A", 100, 8)], 90) == [(1, 8, 0)]
    assert run(spark, [], [("A", 1, 1)], 5) == [] == run(spark, left, [], 5)
