import struct
from datetime import date

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tapeloom.sources import files
from tapeloom.sources.packed import PackedEvents, checksum, decode, encode


def test_records_and_checksum():
    b = pa.record_batch([pa.array([5, 6]), pa.array([7, 8]), pa.array([-1, 2]), pa.array([3, 4]), pa.array([1, 4], pa.int32()), pa.array([None, 2], pa.int32()), pa.array([0, 1], pa.int32())], names=["exch_ts", "local_ts", "price", "qty", "kind", "side", "flags"])
    data = encode(b)
    assert data == struct.pack("<QQqqBBB5x", 5, 7, -1, 3, 1, 0, 0) + struct.pack("<QQqqBBB5x", 6, 8, 2, 4, 4, 2, 1)
    assert decode(data).to_pylist() == b.to_pylist()
    assert checksum(b"") == 0xCBF29CE484222325 and checksum(b"a") == 0xAF63DC4C8601EC8C and checksum(b"b", checksum(b"a")) == checksum(b"ab") != checksum(b"ba")
    for bad in (data[:-1], struct.pack("<QQqqBBB5x", 5, 7, 1, 3, 9, 0, 0), struct.pack("<QQqqBBB5x", 9, 7, 1, 3, 1, 0, 0), data[40:] + data[:40]):
        with pytest.raises(ValueError):
            decode(bad)


def test_packed_source_round_trip(spark, tmp_path):
    spark.dataSource.register(PackedEvents)
    e = files.synthetic_events(spark, 5_000, 3).drop("src_ordinal")
    path = str(tmp_path / "ev")
    e.repartitionByRange(3, "local_ts").sortWithinPartitions("local_ts").write.format("packed_events").mode("overwrite").save(path)
    back = spark.read.format("packed_events").option("chunkRecords", 700).load(path)
    assert back.count() == 5_000 and back.exceptAll(e.select(back.columns)).count() == 0
    e.limit(10).coalesce(1).sortWithinPartitions("local_ts").write.format("packed_events").mode("overwrite").save(path)
    assert spark.read.format("packed_events").load(path).count() == 10
    with pytest.raises(PySparkException):
        e.limit(50).coalesce(1).sortWithinPartitions(F.desc("local_ts")).write.format("packed_events").mode("append").save(str(tmp_path / "bad"))


def test_feed_folders(spark, tmp_path):
    root = str(tmp_path)
    p = files.hours(root, "AAA", "trade", date(2020, 1, 1), date(2020, 1, 2))
    assert len(p) == 48 and p[25].endswith("AAA/trade/2020-01-02/01.parquet")
    for k in (3, 30):
        spark.createDataFrame([(k, k, "AAA", 1.0, 1.0, True), (k + 1, None, "AAA", None, 1.0, False)], files.TRADE).write.parquet(p[k])
    t = files.read_feed(spark, root, "trade", files.TRADE)
    assert sorted((str(r.date), r.hour, r.feed_key) for r in t.select("date", "hour", "feed_key").distinct().collect()) == [("2020-01-01", 3, "AAA"), ("2020-01-02", 6, "AAA")]
    assert files.lenient(t, ["price"]).count() == 2
    with pytest.raises(PySparkException):
        files.strict(t, ["price"]).collect()


def test_bar_and_signal_files(spark, tmp_path):
    day = 86_400_000_000_000
    rows = [(day + 2, 30.0, 1.23456789), (day + 1, 10.0, None), (2 * day, 5.0, float("nan")), (2 * day + 1, 4.0, 2.0)]
    path = str(tmp_path / "bars")
    files.write_bars(spark.createDataFrame(rows, "ts bigint, cum_vol double, x double"), path, {"x": 3})
    b = files.read_bars(spark, path, "ts bigint, cum_vol double, x double, missing double", nan_defaults=True)
    got = sorted((r.ts, r.bar_index, r.bar_vol, str(r.date)) for r in b.collect())
    assert got == [(day + 1, 0, 10.0, "1970-01-02"), (day + 2, 1, 20.0, "1970-01-02"), (2 * day, 0, 5.0, "1970-01-03"), (2 * day + 1, 1, 0.0, "1970-01-03")]
    assert sorted(r.x for r in b.where("not isnan(x)").collect()) == [1.235, 2.0] and b.where("isnan(missing)").count() == 4
    assert files.day_window(b, "1970-01-03", "1970-01-03").count() == 2
    (tmp_path / "s.csv").write_text("bar_index,direction,expected_move_bps,hold_bars,confidence\n0,Long,5,3,0.9\n1,short,5,3,0.2\n7,long,5,3,0.9\n1,flat,1,1,1\n")
    s = files.read_signals(spark, str(tmp_path / "s.csv"), b, 0.5)
    assert [(r.bar_index, r.direction) for r in s.collect()] == [(0, "long")]


def test_scorecard_and_ledger(spark, tmp_path):
    cells = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "name string, net double")
    for _ in range(2):
        files.write_scorecard(cells, str(tmp_path / "s"), str(tmp_path / "l"), top=2)
    assert [r.name for r in spark.read.option("header", "true").csv(str(tmp_path / "s")).collect()] == ["b", "c"]
    assert spark.read.parquet(str(tmp_path / "l")).count() == 6


def test_synthetic_tape_is_the_same_in_any_partitioning(spark):
    a, b = files.synthetic_events(spark, 2_000, 5, 3), files.synthetic_events(spark, 2_000, 5, 11)
    assert a.exceptAll(b).count() == 0 == a.where("local_ts < exch_ts").count() and a.select("kind", "side").distinct().count() == 8
    assert files.synthetic_events(spark, 2_000, 6).exceptAll(a).count() > 1_900
