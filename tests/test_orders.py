import pytest
from pyspark.sql import functions as F

from tapeloom.functions import market as M
from tapeloom.operators.book import traded_at
from tapeloom.operators.flow import multi_reference
from tapeloom.operators.orders import place_limits
from tapeloom.operators.sim import RestingOrder


def test_limits_cross_rest_and_wait_in_the_queue(spark):
    levels = spark.createDataFrame([("A", 10, "bid", 99, 5), ("A", 10, "bid", 98, 7), ("A", 10, "ask", 101, 4), ("A", 10, "ask", 102, 6), ("A", 10, "ask", 103, 9)], "key string, ts bigint, side string, p8 bigint, q8 bigint")
    tape = [(11, 1, 98, 3, -1), (12, 2, 99, 4, 1), (12, 3, 99, 6, -1), (15, 4, 97, 2, -1), (40, 5, 99, 50, -1), (13, 6, 101, 5, 1)]
    trades = spark.createDataFrame([("A", *t) for t in tape], "key string, ts bigint, seq bigint, p8 bigint, q8 bigint, sgn int")
    orders = spark.createDataFrame(
        [(1, "A", 10, True, 99, 5), (2, "A", 10, True, 102, 8), (3, "A", 10, True, 102, 50), (4, "A", 10, False, 101, 3), (5, "A", 11, True, 99, 1), (6, "A", 10, True, None, 1), (7, "A", 10, True, 100, 2)],
        "id int, key string, ts bigint, is_bid boolean, p8 bigint, q8 bigint",
    )
    got = {r.id: tuple(r)[3:] for r in place_limits(orders, levels, trades, 20).collect()}
    assert got[2] == ("taker", 8, (4 * 101 + 4 * 102) // 8, None, 0, None, None)
    assert got[3] == ("taker", 10, (4 * 101 + 6 * 102) // 10, None, 0, None, None)
    assert got[5][0] == "rejected" and 6 not in got
    for k, side, price, qty, ahead in ((1, "bid", 99, 5, 5), (4, "ask", 101, 3, 4), (7, "bid", 100, 2, 0)):
        o, filled, first, done = RestingOrder(side, price, qty, ahead), 0, None, None
        for ts, _, p, q, sgn in sorted(t for t in tape if t[0] <= 30):
            part = o.match(sgn, p, q)
            filled += part
            first = ts if part and first is None else first
            done = ts if part and not o.qty else done
        assert got[k] == ("rested", 0, None, ahead, filled, first, done)
    assert place_limits(orders.limit(0), levels, trades, 20).count() == 0


def test_walls_references_and_gates(spark):
    walls = spark.createDataFrame([("A", "bid", 99, 10, 20), ("A", "ask", 101, 10, 20)], "coin string, side string, p8 bigint, from_ts bigint, to_ts bigint")
    tape = spark.createDataFrame([("A", 99, 10, 3, -1), ("A", 99, 20, 4, 1), ("A", 99, 21, 9, -1), ("A", 100, 15, 9, -1)], "coin string, p8 bigint, ts bigint, q8 bigint, sgn int")
    assert {r.side: (r.trades, r.traded8, r.hit8) for r in traded_at(walls, tape, "coin").collect()} == {"bid": (2, 7, 3), "ask": (0, 0, 0)}
    q = spark.createDataFrame([("A", 0, 5, "z", 9.0), ("A", 1, 6, "x", 2.0), ("A", 2, 7, "y", 4.0), ("A", 3, 8, "x", -1.0), ("A", 4, 9, None, 7.0), ("A", 5, 10, "x", 6.0)], "coin string, seq bigint, ts bigint, src string, p double")
    assert [(r.seq, r.n_sources, r.reference) for r in multi_reference(q, "coin", "src", ["x", "y"], "p").orderBy("seq").collect()] == [(1, 1, 2.0), (2, 2, 3.0), (3, 2, 3.0), (4, 2, 3.0), (5, 2, 5.0)]
    one = spark.range(1).select(
        M.passes_magnitude(F.lit(5.0), F.lit(0.1), 6.0, 0.0).alias("a"), M.passes_magnitude(F.lit(5.0), F.lit(0.1), 0.0, 0.1).alias("b"), M.regime_allows(F.lit("neutral"), "any").alias("c"), M.regime_allows(F.lit("neutral"), "trending").alias("d"),
        M.confirms_revert(F.lit(-0.4), F.lit(-0.1), F.lit(True), 0.25).alias("e"), M.confirms_trend(F.lit(-0.4), F.lit(-0.1), F.lit(True), 0.0).alias("f"), M.pattern_confidence(F.lit(4), 2).alias("g"), M.defending_depth(F.lit(0.5), F.lit(-1)).alias("h"),
    ).collect()[0]
    assert tuple(one) == (False, True, True, False, True, False, 0.85, 0.75)
    assert M.parse_flags("limit, 0,follow") == [True, False, False] and M.parse_regimes("Any,chop") == ["any", "sideways"]
    for f in (M.parse_flags, M.parse_regimes):
        with pytest.raises(ValueError, match="bad"):
            f("perhaps")
