import random

import pytest

from tapeloom.operators.profile import concentration, even_bins, grow_area, low_volume_nodes, profile_bins, value_area


def slow(volumes, poc, lo, hi, need, tie_low):
    a = b = poc
    held = volumes[poc]
    while held < need and (a > lo or b < hi):
        low = volumes.get(a - 1, 0) if a > lo else -1
        high = volumes.get(b + 1, 0) if b < hi else -1
        if low >= high if tie_low else low > high:
            a, held = a - 1, held + low
        else:
            b, held = b + 1, held + high
    return a, b


@pytest.mark.parametrize("tie_low", [True, False])
def test_growth_crosses_empty_bins_as_single_steps_do(tie_low):
    r = random.Random(1)
    for _ in range(300):
        v = {r.randrange(60): r.randrange(1, 9) for _ in range(r.randrange(1, 15))}
        poc = max(v, key=lambda b: (v[b], b))
        need = sum(v.values()) * r.choice([0.3, 0.7, 1.0])
        assert grow_area(v, poc, min(v), max(v), need, tie_low) == slow(v, poc, min(v), max(v), need, tie_low)


def test_profile(spark):
    rows = [("A", 1, 100, 5, 1), ("A", 2, 112, 5, -1), ("A", 3, 125, 1, 1), ("A", 4, 180, 2, 1), ("B", 1, 7, 3, 1)]
    t = spark.createDataFrame(rows, "sym string, ts bigint, p8 bigint, q8 bigint, sgn int")
    bins = profile_bins(t, ["sym"], 10)
    va = {r.sym: r for r in value_area(bins, ["sym"]).collect()}
    assert (va["A"].poc, va["A"].va_lo, va["A"].va_hi, va["A"].n_bins, va["A"].total8) == (1, 0, 1, 9, 13)
    assert (va["B"].poc, va["B"].n_bins) == (0, 1)
    assert value_area(bins, ["sym"], first_max=True).where("sym = 'A'").collect()[0].poc == 0
    assert [(r.sym, r.bin) for r in low_volume_nodes(bins, ["sym"], 0.3).collect()] == [("A", 2)]
    assert {r.sym: r.concentration for r in concentration(bins, ["sym"]).collect()}["B"] == 0.0
    assert sorted((r.sym, r.bin) for r in even_bins(t, ["sym"], 8).collect()) == [("A", 0), ("A", 1), ("A", 2), ("A", 7), ("B", 0)]
    assert value_area(bins.limit(0), ["sym"]).count() == 0
