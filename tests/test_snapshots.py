from pyspark.sql import functions as F

from tapeloom.operators.snapshots import snapshot_diff

SCHEMA = "coin string, at bigint, side string, p bigint, q bigint, rcv bigint, seq bigint, target int, h int, new string"


def diff(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], SCHEMA)
    got = snapshot_diff(df, ["coin"], "at", ["side", "p"], ["q"], ["rcv", "seq"], F.col("q").isNull() | (F.col("q") == 0)).collect()
    return sorted(tuple(r) for r in got)


def test_kinds_versions_and_days(spark):
    day = 86_400_000
    rows = [
        ("A", 1, "bid", 10, 5, 1, 1), ("A", 1, "bid", 11, 5, 1, 2), ("A", 1, "ask", 12, 7, 1, 3),
        ("A", 2, "bid", 10, 5, 1, 4), ("A", 2, "ask", 12, 8, 1, 5), ("A", 2, "ask", 13, 1, 1, 6),
        ("A", 2, "ask", 13, 0, 2, 7),  # the later delivery says it is not there
        ("A", 3, "bid", 10, None, 1, 8), ("A", 3, "ask", 12, 8, 1, 9), ("A", 3, "ask", 12, 9, 1, 10),
        ("A", day + 1, "bid", 99, 1, 1, 11),  # the first of a day has no cases
        (None, 2, "bid", 1, 1, 1, 12), ("A", None, "bid", 1, 1, 1, 13), ("A", 2, None, 1, 1, 1, 14),
    ]
    assert diff(spark, rows) == [
        ("A", 2, "ask", 12, "changed"), ("A", 2, "bid", 11, "removed"), ("A", 3, "ask", 12, "changed"), ("A", 3, "bid", 10, "removed"),
    ]


def test_empty_and_repeats(spark):
    assert diff(spark, []) == []
    rows = [("A", 1, "bid", 10, 5, 1, k) for k in range(50)] + [("A", 2, "bid", 10, 5, 1, 100 + k) for k in range(50)]
    assert diff(spark, rows) == []


def test_changes_that_hash_alike(spark):
    # xxhash64 of the two quantities as text is the same
    rows = [("A", 1, "bid", 10, 1105392212317502, 1, 1), ("A", 2, "bid", 10, 2494658712317506, 1, 2), ("A", 3, "bid", 10, 2494658712317506, 1, 3)]
    assert diff(spark, rows) == [("A", 2, "bid", 10, "changed")]


def test_changes_that_read_alike(spark):
    rows = [
        (1, 1.0, None, ["a, b"], 1), (2, 1.0, "\0", ["a, b"], 2), (3, 1.0, "\0", ["a", "b"], 3), (4, 1.0, "\0", ["a", "b"], 4),
        (1, float("nan"), "x", [], 5), (3, float("nan"), "x", [], 6),
    ]
    df = spark.createDataFrame([("A", *r) for r in rows], "coin string, at bigint, key double, text string, list array<string>, seq int")
    got = sorted((r.at, str(r.key), r.change_kind) for r in snapshot_diff(df, ["coin"], "at", ["key"], ["text", "list"], ["seq"], F.lit(False)).collect())
    assert got == [(2, "1.0", "changed"), (2, "nan", "removed"), (3, "1.0", "changed"), (3, "nan", "added"), (4, "nan", "removed")]
