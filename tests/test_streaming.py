import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators.bars import time_bars
from tapeloom.operators.book import Book
from tapeloom.operators.late import late_corrected
from tapeloom.streaming import bars as stream
from tapeloom.streaming.late import EMPTY, fold, late_stream, replay

TAPE = "sym string, ts bigint, seq bigint, p8 bigint, q8 bigint, sgn int"


def in_files(spark, path, frames, schema):
    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{k}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def drain(spark, df, path, mode):
    got = []

    def keep(batch, _):
        got.extend(batch.collect())

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return got


def tape(n=400):
    r = random.Random(2)
    t, out = 1_600_000_000_000, []
    for k in range(n):
        t += r.randrange(0, 20_000)
        out.append((r.choice("AB"), t, k, r.randrange(90, 110), r.randrange(1, 9), r.choice([1, -1])))
    return out


def test_time_bars_equal_the_batch(spark, tmp_path):
    rows = tape()
    src = in_files(spark, str(tmp_path), [rows[:200], rows[200:]], TAPE)
    final = {}
    for x in drain(spark, stream.time_bars(src), str(tmp_path), "update"):
        final[x.sym, x.ts] = x
    want = time_bars(spark.createDataFrame(rows, TAPE), "sym", 300_000).collect()
    assert len(want) == len(final)
    for w in want:
        g = final[w.sym, w.ts]
        assert (w.trades, w.vol8, w.buy8, w.open8, w.high8, w.low8, w.close8) == (g.trades, g.vol8, g.buy8, g.open8, g.high8, g.low8, g.close8)


def test_volume_bars_do_not_depend_on_batches(spark, tmp_path):
    rows = tape()
    got = {}
    for name, cuts in (("one", [rows]), ("many", [rows[k : k + 90] for k in range(0, 400, 90)])):
        src = in_files(spark, f"{tmp_path}/{name}", cuts, TAPE)
        got[name] = sorted(tuple(x) for x in drain(spark, stream.volume_bars(src, 50), f"{tmp_path}/{name}", "append"))
    assert got["one"] == got["many"] and len(got["one"]) > 20


def test_books_are_kept_between_batches(spark, tmp_path):
    r = random.Random(7)
    rows = [("A", k, k, r.choice(["bid", "ask"]), r.randrange(95, 105), r.choice([0, 1, 2, 3])) for k in range(300)]
    src = in_files(spark, str(tmp_path), [rows[:100], rows[100:200], rows[200:]], "coin string, ts bigint, seq bigint, side string, p8 bigint, q8 bigint")
    last = max(drain(spark, stream.books(src), str(tmp_path), "update"), key=lambda x: x.ts)
    b = Book()
    for _, _, _, side, p, q in rows:
        b.apply(side, p, q)
    bid, ask = b.top(5)
    assert (last.bid_p8, last.bid_q8, last.ask_p8, last.ask_q8) == ([p for p, _ in bid], [q for _, q in bid], [p for p, _ in ask], [q for _, q in ask])


def test_late_stream_ends_where_the_batch_does(spark, tmp_path):
    r = random.Random(3)
    base = 1_600_000_020_000
    rows = []
    for k in range(300):
        t = base + r.randrange(0, 240_000)
        rows.append(("A", t, t + r.choice([5, 50, 70_000, 200_000, 800_000]), float(r.randrange(1, 99)), float(r.randrange(1, 9)), k))
    rows.sort(key=lambda x: x[2])
    schema = "sym string, ts bigint, arr bigint, price double, qty double, o bigint"
    src = in_files(spark, str(tmp_path), [rows[:150], rows[150:260], rows[260:]], schema)
    final = {}
    for x in drain(spark, late_stream(src, "sym", "ts", "arr", "price", "qty", "o"), str(tmp_path), "update"):
        if x.period_ms not in final or x.revision >= final[x.period_ms].revision:
            final[x.period_ms] = x
    want = late_corrected(spark.createDataFrame(rows, schema), ["sym"], "ts", "arr", "price", "qty", "o").where("is_final").collect()
    assert {w.period_ms: (w.events, w.qty, w.low, w.high, w.open, w.close, w.refused) for w in want} == {k: (g.events, g.qty, g.low, g.high, g.open, g.close, g.refused) for k, g in final.items()}


@pytest.mark.parametrize("start", [0, 3, 17, 39])
def test_replay_from_a_checkpoint_is_the_whole_fold(start):
    r = random.Random(start)
    events = [(k, k, k, float(r.randrange(9)), 1.0) for k in range(40)]
    marks: list = []
    whole, n = replay(events, marks, 0, 8)
    again, m = replay(events, marks, start, 8)
    state = EMPTY
    for e in events:
        state = fold(state, e)
    assert whole == again == state and n == 40 and m == 40 - start // 8 * 8 and len(marks) == 5


def test_late_stream_keeps_its_checkpoints_and_takes_events_as_the_batch_does(spark, tmp_path):
    """The second micro-batch replays from the checkpoint before its first event; rows of one instant that differ in any column are two; nulls count."""
    base = 1_600_000_020_000
    row = lambda k, t, late=0, p=5.0, q=1.0, side="b": ("A", base + t, base + t + 9 + late, p, q, side, k)
    one = [row(k, 100 * k) for k in range(200)] + [row(300, 19_950, side="s"), row(301, 19_950, side="b"), row(302, 19_960, p=None), row(303, 19_970, q=None)]
    two = [row(400, 15_050, 100_000), row(401, 19_950, 100_000, side="s"), row(402, 100, 900_000, side="z")]
    schema = "sym string, ts bigint, arr bigint, price double, qty double, side string, o bigint"
    got = drain(spark, late_stream(in_files(spark, str(tmp_path), [one, two], schema), "sym", "ts", "arr", "price", "qty", "o", every=16), str(tmp_path), "update")
    first, second = sorted(got, key=lambda x: x.revision)
    assert (first.events, first.replayed, first.revision, second.events, second.refused) == (204, 204, 0, 205, 1)
    assert second.replayed == 205 - 151 // 16 * 16
    want = late_corrected(spark.createDataFrame(one + two, schema), ["sym"], "ts", "arr", "price", "qty", "o").where("is_final").collect()[0]
    assert (second.events, second.qty, second.notional, second.low, second.close, second.refused) == (want.events, want.qty, want.notional, want.low, want.close, want.refused)


def test_sliding_and_session_windows(spark, tmp_path):
    rows = tape(100)
    src = in_files(spark, f"{tmp_path}/a", [rows], TAPE)
    assert sum(x.n for x in drain(spark, stream.sliding_flow(src), f"{tmp_path}/a", "update")) == 1000
    late = [("C", rows[-1][1] + 3_600_000 * k, 1000 + k, 1, 1, 1) for k in (1, 2)]
    src = in_files(spark, f"{tmp_path}/c", [rows, late[:1], late[1:]], TAPE)
    gap, got = 30_000, [x for x in drain(spark, stream.bursts(src), f"{tmp_path}/c", "append") if x.sym != "C"]
    want = []
    for sym in "AB":
        at = [x for x in rows if x[0] == sym]
        cuts = [0, *[k for k in range(1, len(at)) if at[k][1] - at[k - 1][1] >= gap], len(at)]
        want += [(sym, at[a][1], b - a) for a, b in zip(cuts, cuts[1:])]
    # two far later rows of another source let the watermark pass all sessions
    done = {(x.sym, x.from_ts, x.n) for x in got}
    assert done == set(want) and len(want) > 4
