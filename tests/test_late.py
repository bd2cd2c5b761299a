import math
import random

import pytest

from tapeloom.operators.late import late_corrected

SCHEMA = "sym string, ts bigint, arr bigint, price double, qty double, o bigint, rev int, n int, minute string, cut int"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2, "m", 3) for r in rows], SCHEMA)
    return late_corrected(df, ["sym"], "ts", "arr", "price", "qty", "o", **kw).collect()


def brute(rows):
    once = {}
    for s, t, a, p, q, o in rows:
        if s is None or t is None:
            continue
        key = (s, t, None if p is not None and math.isnan(p) else p, q, p is not None and math.isnan(p))
        arrivals, first = once.get(key, ([], o))
        once[key] = ([*arrivals, a], min(first, o))
    out = {}
    for (s, t, p, q, _), (arrivals, o) in once.items():
        m = t // 60_000 * 60_000
        over = -1 if None in arrivals else min(arrivals) - m - 65_000
        rev = 0 if over < 0 else 1 + over // 60_000 if over < 600_000 else None
        out.setdefault((s, m), []).append((rev, t, o, p, q))
    return out


def test_each_revision_is_what_was_known_by_then(spark):
    r = random.Random(1)
    rows = []
    for k in range(1500):
        t = r.randrange(0, 1_200_000)
        a = r.choice([None, t + 5, t + 40, t + r.randrange(60_000, 300_000), t + r.randrange(0, 900_000)])
        rows.append((r.choice(["A", "B", None]), r.choice([t, t, t, t, None]), a, r.choice([None, float("nan"), *[r.uniform(1, 9)] * 8]), r.choice([None, *[r.uniform(1, 2)] * 8]), k))
        if k % 6 == 0:
            rows.append((*rows[-1][:2], t + r.randrange(0, 900_000), *rows[-1][3:5], k + 10_000))
    want, seen = brute(rows), {}
    for g in run(spark, rows):
        seen.setdefault((g.sym, g.period_ms), []).append(g)
    assert set(seen) == set(want)
    for key, got in seen.items():
        ev = want[key]
        revs = sorted({0} | {e[0] for e in ev if e[0] is not None})
        assert sorted(g.revision for g in got) == revs
        for g in got:
            known = [e for e in ev if e[0] is not None and e[0] <= g.revision]
            priced = sorted((t, o, p) for _, t, o, p, _ in known if p is not None)
            assert g.events == len(known) and g.is_final == (g.revision == revs[-1])
            assert g.refused == sum(e[0] is None for e in ev)
            assert math.isclose(g.qty, sum(e[4] for e in known if e[4] is not None), abs_tol=1e-9)
            assert (g.open, g.close) == ((priced[0][2], priced[-1][2]) if priced else (None, None))
            assert (g.low, g.high) == ((min(p for *_, p in priced), max(p for *_, p in priced)) if priced else (None, None))


def test_replay_starts_at_the_checkpoint_before_the_late_event(spark):
    rows = [("A", t, t, 1.0, 1.0, t) for t in (1000, 11_000, 31_000, 51_000)] + [("A", 32_000, 70_000, 5.0, 1.0, 99)]
    first, second = sorted(run(spark, rows), key=lambda g: g.revision)
    assert (first.replayed, first.events, second.revision, second.events, second.high) == (6, 4, 1, 5, 5.0)
    assert second.replayed == 3  # stretches 3 to 5 of six


def test_cutoff_bounds_and_empty(spark):
    rows = [("A", 0, 65_000, 1.0, 1.0, 1), ("A", 1, 664_999, 1.0, 1.0, 2), ("A", 2, 665_000, 1.0, 1.0, 3), ("A", 3, 64_999, 1.0, 1.0, 4)]
    last = max(run(spark, rows), key=lambda g: g.revision)
    assert (last.events, last.refused) == (3, 1)
    only = run(spark, [("A", 0, 10_000_000, 1.0, 1.0, 1)])
    assert [(g.revision, g.events, g.refused) for g in only] == [(0, 0, 1)]
    assert run(spark, []) == []


@pytest.mark.parametrize("checkpoint", [7_000, 60_000])
def test_checkpoint_interval_does_not_change_results(spark, checkpoint):
    rows = [("A", k * 777 % 120_000, k * 777 % 120_000 + k * 100, float(k % 9 + 1), 1.0, k) for k in range(300)]
    key = lambda gs: sorted((g.period_ms, g.revision, g.events, g.open, g.close, g.low, g.high) for g in gs)
    assert key(run(spark, rows)) == key(run(spark, rows, checkpoint_ms=checkpoint))
