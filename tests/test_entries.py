"""The barrier queries enter at every bar, not at a sample of them."""

from pathlib import Path

import __spark_entry__ as entry

def test_every_bar_on_a_small_tape(spark, tmp_path):
    """Against brute force: 30 bars of two trades, target 25, stop 20 bps, 12 bars."""
    tape = [(2 * k + j, "A", 300_000 * k + 1_000 * j, 100.0 + (k * 7 % 11) * 0.05 + 0.02 * j, 1.0 + (k + j) % 3, k % 2 == 0) for k in range(30) for j in (0, 1)]
    spark.createDataFrame(tape, "src_ordinal bigint, symbol string, ts bigint, price double, qty double, isbuyermaker boolean").write.parquet(str(Path(tmp_path, "trade.parquet")))
    bars = []
    for k in range(30):
        px = [round(x[3] * 1e8) for x in tape if x[2] // 300_000 == k]
        half = (max(px) - min(px)) // 20
        bars.append((px[-1], px[-1] - half, px[-1] + half, k % 2 == 1))
    want = {}
    for no, (e, _, _, long) in enumerate(bars[:-1]):
        side = 1 if long else -1
        last = min(no + 12, 29)
        for at in range(no + 1, last + 1):
            mid, b, a, _ = bars[at]
            bps = lambda v: (v / e - 1) * 1e4 * side  # noqa: B023, E731
            if bps(a if long else b) >= 25:
                want[no] = (at, "target")
            elif bps(b if long else a) <= -20:
                want[no] = (at, "stop")
            elif at == last:
                want[no] = (at, "time")
            if no in want:
                break
    got = {r.no: (r.exit_no, r.barrier) for r in entry.queries()["barrier_triple"](spark, str(tmp_path)).collect()}
    assert got == want and set(got) == set(range(29))
