"""Differences between consecutive full snapshots."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.clean import day_start
from tapeloom.session import cut, small


def all_known(columns: list[str]) -> Column:
    """True where no column is null; NaN is a value."""
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def snapshot_index(rows: DataFrame, series: list[str], at: str, span: Column) -> DataFrame:
    """One row per snapshot: series, at, next_at, the following snapshot of the same span (null for the last), and own_at, null for the first."""
    w = Window.partitionBy(*series, span).orderBy(at)
    return rows.select(*series, at).where(all_known([*series, at])).distinct().withColumns({"next_at": F.lead(at).over(w), "own_at": F.when(F.lag(at).over(w).isNotNull(), F.col(at))})


def snapshot_diff(rows: DataFrame, series: list[str], at: str, key: list[str], values: list[str], version: list[str], absent: Column) -> DataFrame:
    """What each snapshot added, removed or changed against the one before it in the same series and UTC day.

    rows: one row per record and snapshot; at: epoch ms of the snapshot; key: the record's key;
    values: the compared columns; version: of several rows of a record in a snapshot the one with
    the largest version counts, and of equal versions the one with the largest values; absent: true
    for a row that says the record is not there. A row with a null series or at is ignored; one with a null key
    only says that the snapshot was taken.
    The first snapshot of a day has no cases. Unchanged records give no row.

    Result: series, at, key, change_kind ('added', 'removed', 'changed').

    Plan: every row goes out twice, as 'new' of its own snapshot and 'old' of the next one, and
    one aggregation by (series, snapshot, key) with a map-side combine compares the values of the
    two sides, not hashes of them, which can be equal for different values. Keys spread a hot series
    over all tasks; the index has one row per snapshot and is broadcast up to 400,000 of them
    (some 40 MB), so that the aggregation's is the only shuffle of the rows.
    """
    cols = [*series, at, *key]
    ver = [F.col(c).alias(f"f{i}") for i, c in enumerate([*version, *values])]
    r = rows.select(*cols, F.struct(*ver, (~F.coalesce(absent, F.lit(False))).alias("there")).alias("ver")).where(all_known(cols))
    index = snapshot_index(rows, series, at, day_start(F.col(at)))
    sides = F.array(F.struct(F.col("own_at").alias("target"), F.lit(True).alias("new")), F.struct(F.col("next_at").alias("target"), F.lit(False).alias("new")))
    index = cut(index)
    tagged = r.join(small(index, index.count(), 400_000), [*series, at]).select(*series, *key, "ver", F.inline(sides)).where("target is not null")
    both = tagged.groupBy(*series, "target", *key).agg(F.expr("max(ver) filter (where new)").alias("ver_new"), F.expr("max(ver) filter (where not new)").alias("ver_old"))
    new, old = (F.coalesce(F.col(f"{v}.there"), F.lit(False)) for v in ("ver_new", "ver_old"))
    same = reduce(and_, [F.col(f"ver_new.f{i}").eqNullSafe(F.col(f"ver_old.f{i}")) for i in range(len(version), len(ver))], F.lit(True))
    kind = F.when(new & ~old, "added").when(old & ~new, "removed").when(new & old & ~same, "changed")
    return both.select(*series, F.col("target").alias(at), *key, kind.alias("change_kind")).where("change_kind is not null")
