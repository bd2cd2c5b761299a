import random

import pytest

from tapeloom.operators.book import Book, fold_books, market_walk
from tapeloom.operators.maker import QuoteConfig, Quoter, target
from tapeloom.operators.sim import Account, Coin, PaperConfig, RestingOrder, Shell, ShellConfig, fee, market_fill, non_overlapping, paper_account, simulate, triple_barrier

E8 = 100_000_000


def test_book_scenarios():
    b = Book()
    for side, p, q in (("bid", 100, 5), ("bid", 99, 7), ("ask", 101, 4), ("ask", 102, 9)):
        b.apply(side, p, q)
    assert b.top(9) == ([(100, 5), (99, 7)], [(101, 4), (102, 9)])
    b.apply("bid", 101, 3)  # crosses the ask at 101
    assert b.top(1) == ([(101, 3)], [(102, 9)]) and b.trimmed == 1
    b.apply("bid", 101, 0)
    b.apply("bid", 50, 0)
    assert b.top(1)[0] == [(100, 5)]
    c = Book(cap=3)
    for k in range(5):
        c.apply("bid", 100 - k, 1)
        c.apply("ask", 101 + k, 1)
    assert [p for p, _ in c.top(9)[0]] == [100, 99, 98] and c.evicted == 4
    assert Book().hash() != b.hash() == b.hash()


def test_fold_equals_a_plain_book(spark):
    r = random.Random(1)
    rows = [(r.choice("AB"), 60_000 * (k // 7) + k, k, r.choice(["bid", "ask"]), r.randrange(90, 110), r.choice([0, 1, 2])) for k in range(500)]
    r.shuffle(rows)
    got = {(x.coin, x.ts): x for x in fold_books(spark.createDataFrame(rows, "coin string, ts bigint, seq bigint, side string, p8 bigint, q8 bigint"), "coin", 60_000, 3).collect()}
    for coin in "AB":
        b, own = Book(), sorted((x for x in rows if x[0] == coin), key=lambda x: x[1:3])
        for k, x in enumerate(own):
            b.apply(*x[3:])
            if k + 1 == len(own) or own[k + 1][1] // 60_000 != x[1] // 60_000:
                g = got.pop((coin, x[1] // 60_000 * 60_000 + 60_000))
                assert ([tuple(y) for y in g.bid], [tuple(y) for y in g.ask]) == b.top(3) and g.book_hash == b.hash() and g.trimmed == b.trimmed
    assert not got


def test_market_walk(spark):
    assert market_fill([(100, 1), (101, 5)], 3) == (3, 302 // 3, 2)
    assert market_fill([(100, 1), (101, 5)], 3, cap=100) == (1, 100, 1)
    lv = spark.createDataFrame([("A", 1, "ask", 100, 1), ("A", 1, "ask", 101, 5), ("A", 1, "bid", 99, 1)], "coin string, ts bigint, side string, p8 bigint, q8 bigint")
    x = market_walk(lv, "coin", 3).collect()[0]
    assert (x.filled8, x.levels, x.avg8, x.complete) == (3, 2, 100, True)
    assert market_walk(lv, "coin", 3, cap8=100).collect()[0].complete is False


def test_fees_and_trips():
    assert fee(200 * E8, E8, 25_000) == 5_000_000 and fee(200 * E8, E8, -2_000) == -400_000
    a = Account()
    a.fill(1, E8, 100 * E8, 25_000)
    a.fill(2, -E8, 110 * E8, 25_000)
    assert (a.realized, a.fees, a.trips[0][1]) == (10 * E8, 5_250_000, 10 * E8 - 5_250_000)
    b = Account()
    for q, p in ((1, 100), (1, 102), (-2, 105)):
        b.fill(0, q * E8, p * E8, 0)
    assert b.realized == 8 * E8 and len(b.trips) == 1
    b.fill(3, E8, 100 * E8, 0)
    b.fill(4, -2 * E8, 90 * E8, 0)  # flips
    assert b.position == -E8 and len(b.trips) == 2 and b.unrealized(80 * E8) == 10 * E8
    c = Account()
    for q, p in ((2, 100), (-1, 110), (-1, 104)):
        c.fill(5, q * E8, p * E8, 100_000)
    # 0.1 % fees: the closing fill made 4, less its own 0.104 and the opening 0.2; the partial close is realized, but no part of the trip
    assert c.realized == 14 * E8 and c.trips == [(5, 4 * E8 - 10_400_000 - 20_000_000, 200 * E8, 5)]


def test_queue_position():
    o = RestingOrder("bid", 100, 1, 5)
    assert o.match(1, 100, 9) == 0 and o.match(-1, 101, 9) == 0  # wrong aggressor, not through
    assert (o.match(-1, 100, 3), o.match(-1, 100, 4)) == (0, 1)


def test_shell_waits_for_latency_and_cools_down():
    s = Shell(ShellConfig(latency_ms=100, hold_ms=1000, cooldown_ms=500, taker8=0))
    for ts, bid, ask, want in ((0, 99, 101, 1), (50, 99, 101, 1), (100, 99, 105, 1), (1100, 110, 112, 0), (1200, 111, 113, 0), (1500, 111, 113, 1), (1701, 111, 113, 1)):
        s.step(ts, bid * E8, ask * E8, want)
    assert [(t, p) for t, p, *_ in s.account.trips] == [(1200, 6 * E8)]  # bought at 105, sold at 111
    assert s.queue  # only the signal after the cool-down was sent


def _walk(seed, n):
    r, x, out = random.Random(seed), 1_000_000, []
    for k in range(n):
        x += r.choice([-100, 100])
        out.append(("A", k * 1000, k, x - 50, x + 50, 0.0))
    return out


def test_a_coin_flip_loses_about_its_fees(spark):
    rows = spark.createDataFrame(_walk(0xC0FFEE, 20_000), "coin string, ts bigint, seq bigint, b8 bigint, a8 bigint, x double")
    signal = lambda c, k, d: (lambda coin: (lambda e: coin.side()))(Coin(99))
    configs = [{"hold_ms": 20_000, "cooldown_ms": 0, "taker8": f} for f in (0, 50_000)]
    got = simulate(rows, "coin", configs, signal).groupBy("config_id").sum("pnl8").collect()
    trips = simulate(rows, "coin", configs, signal).where("config_id = 0").count()
    free, paid = (x["sum(pnl8)"] for x in sorted(got, key=lambda x: x.config_id))
    assert trips > 100 and paid < free < abs(paid) * 2 and paid < 0
    again = simulate(rows.repartition(7), "coin", configs, signal).groupBy("config_id").sum("pnl8").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    apart = simulate(rows, "coin", configs, signal, together=1).groupBy("config_id").sum("pnl8").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, apart))
    assert "CartesianProduct" not in (plan := rows.sparkSession._jvm.PythonSQLUtils.explainString(simulate(rows, "coin", configs, signal)._jdf.queryExecution(), "simple")) and "NestedLoop" not in plan


def test_overlaps_and_barriers(spark):
    s = spark.createDataFrame([("A", 0, 10), ("A", 5, 8), ("A", 10, 20), ("A", 11, 12), ("B", 5, 6)], "key string, s bigint, e bigint")
    assert sorted(tuple(x) for x in non_overlapping(s, "key", "s", "e").collect()) == [("A", 0, 10), ("A", 11, 12), ("B", 5, 6)]
    px = [100.0, 100.3, 100.5, 99.0, 99.0]
    bars = spark.createDataFrame([("A", k, int(p * 1e6), int(p * 1e6), int(p * 1e6)) for k, p in enumerate(px)], "key string, no bigint, mid8 bigint, b8 bigint, a8 bigint")
    sig = spark.createDataFrame([("A", 0, True), ("A", 0, False), ("A", 3, True), ("A", 4, True)], "key string, no bigint, is_long boolean")
    got = {(x.no, x.is_long): (x.exit_no, x.barrier, round(x.gross_bps, 3)) for x in triple_barrier(bars, sig, "key", 4, 40.0, 45.0).collect()}
    assert got == {(0, True): (2, "target", 40.0), (0, False): (2, "stop", -45.0), (3, True): (4, "time", 0.0)}
    for target_bps, stop_bps, want in ((0.0, 0.0, (4, "time", -100.0)), (0.0, 45.0, (3, "stop", -45.0)), (60.0, 0.0, (4, "time", -100.0))):
        got = {(x.no, x.is_long): (x.exit_no, x.barrier, round(x.gross_bps, 3)) for x in triple_barrier(bars, sig, "key", 4, target_bps, stop_bps).collect()}
        assert got[0, True] == want


def test_paper_account_halts_a_losing_day():
    p = paper_account([(k, -0.01) for k in range(100)], PaperConfig(leverage=5, margin_share=0.2, daily_limit=0.05))
    assert p["halted_days"] == 1 and p["taken"] < 100 and not p["ruined"]
    assert paper_account([(0, -0.5), (1, -0.5)], PaperConfig(daily_limit=0)) == {"final": 125.0, "taken": 2, "halted_days": 0, "max_drawdown": 0.75, "ruined": False}
    assert paper_account([(0, -1.0), (1, 1.0)]) == {"final": 0.0, "taken": 1, "halted_days": 0, "max_drawdown": 0.0, "ruined": True}
    assert paper_account([]) == {"final": 500.0, "taken": 0, "halted_days": 0, "max_drawdown": 0.0, "ruined": False}


def test_quoter():
    c = QuoteConfig(offset_bps=10, reprice_bps=1, danger_bps=100, qty8=10, max_inventory8=20, maker8=0)
    assert target(100_000, "bid", 0, c) == 99_900 and target(100_000, "bid", 20, c) < 99_900 < target(100_000, "bid", -20, c)
    q = Quoter(c)
    q.step(0, "quote", 99_990, 100_010, 0)
    assert set(q.orders) == {"bid", "ask"} and q.step(1, "trade", 99_950, 5, -1) is None
    assert q.step(2, "trade", 99_900, 4, -1)[1] == 4
    q.step(3, "quote", 90_000, 90_010, 0)
    assert not q.orders  # a jump pulls the quotes
    with pytest.raises(ValueError):
        QuoteConfig(offset_bps=1000)
