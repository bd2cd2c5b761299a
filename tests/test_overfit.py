"""The overfitting probability over as many blocks as fit the rows, against brute force."""

import math
from itertools import combinations

import numpy as np
from test_oracles import FOLDER, duck, pytestmark  # noqa: F401

import __spark_entry__ as entry
from tapeloom.operators import stats
from tapeloom.plans.base import TRADES


def brute(series: dict) -> tuple:
    t = min(map(len, series.values()))
    s = next(b for b in (16, 12, 10, 8, 6, 4) if t >= b)
    parts = [slice(b * t // s, (b + 1) * t // s) for b in range(s)]
    names = sorted(series)
    logits = []
    sums = np.array([[(p.stop - p.start, sum(series[c][p]), sum(x * x for x in series[c][p])) for p in parts] for c in names])
    for chosen in combinations(range(s), s // 2):
        i, o = [], []
        for blocks, out in ((list(chosen), i), ([b for b in range(s) if b not in chosen], o)):
            n, a, q = sums[:, blocks].sum(1).T
            var = q / n - (a / n) ** 2
            out += list(np.where(var > 1e-24, a / n / np.sqrt(np.maximum(var, 1e-300)), 0.0))
        best = max(range(len(names)), key=lambda k: (i[k], -k))
        rank = sum(x <= o[best] for x in o) / (len(names) + 1)
        logits.append(math.log(rank / (1 - rank)))
    return len(logits), sum(x <= 0 for x in logits) / len(logits), sorted(logits)[len(logits) // 2]


def test_blocks_that_fit_and_ragged_rows(spark):
    r = np.random.default_rng(5)
    sweeps = {w: {c: list(r.normal(0.05 * k, 1, n + k)) for k, c in enumerate("abc")} for w, n in (("u", 13), ("v", 7))} | {"short": {"a": [1.0, 2.0], "b": [1.0, 3.0]}, "single": {"a": [1.0] * 40}}
    data = [(w, c, no, float(x)) for w, cs in sweeps.items() for c, xs in cs.items() for no, x in enumerate(xs)]
    got = {x.sweep: x for x in stats.overfit_probability(spark.createDataFrame(data, "sweep string, c string, no bigint, x double"), "sweep", "c", "no", "x").collect()}
    assert set(got) == {"u", "v"}
    for w in got:
        splits, pbo, logit = brute(sweeps[w])
        assert got[w].splits == splits and math.isclose(got[w].pbo, pbo) and math.isclose(got[w].median_logit, logit)
    assert (got["u"].splits, got["v"].splits) == (924, 20)


def test_queries_against_brute_force(spark, duck):  # noqa: F811
    hours = duck.execute(f"with {TRADES} select sym, (arg_max(p8, (ts, seq)) / arg_min(p8, (ts, seq)) - 1) * 1e4 as x from tr group by sym, ts // 3600000 order by sym, ts // 3600000").fetchall()
    series: dict = {}
    for c, x in hours:
        series.setdefault(c, []).append(x)
    splits, pbo, logit = brute(series)
    got = entry.queries()["stat_pbo"](spark, FOLDER).collect()[0]
    assert (got.splits, splits) == (12_870, 12_870) and math.isclose(got.pbo, pbo) and math.isclose(got.median_logit, logit, abs_tol=1e-6)
