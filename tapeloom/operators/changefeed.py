"""Current state from a change feed, column-wise last writer wins, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame


def apply_changes(changes: DataFrame, key: list[str], order: list[str], fields: list[str], ordinal: str, arrival: list[str] | None = None, deletes: str = "false", replaces: str = "false", sets: dict[str, str] | None = None) -> DataFrame:
    """The records that stand after all changes of each key, applied in the order given.

    key: names the record; order: the sequence columns, ordinal the last of them; fields: the
    columns a change may set; deletes, replaces: SQL predicates for a change that removes the
    record, or that sets the whole record, so that older fields no longer count; sets: for a
    field, the SQL predicate under which a change sets it (default: it is not null).
    Rows equal in all columns but ordinal and the arrival columns are one change, at the
    smallest ordinal. A row with a null key or order is ignored; a change that deletes sets
    nothing. A record stands if any field was set, or the record replaced, after its latest
    delete. Equal order with equal ordinal and different fields: the larger value of a field.

    Result: key and fields (null where nothing set the field since the latest delete or replacement).

    Plan: two aggregations with map-side combines, the repeats and then one max_by per field;
    no sort, no window, no join, so a key with a third of the rows is combined before the shuffle.
    """
    spark = changes.sparkSession
    skip = {ordinal, *(arrival or [])}
    kept = [c for c in changes.columns if c not in skip]
    known = " and ".join(f"`{c}` is not null" for c in [*key, *order])
    seq = "struct(" + ", ".join(f"`{c}`" for c in [*order, ordinal]) + ")"
    once = spark.sql(f"select {', '.join(f'`{c}`' for c in kept)}, min(`{ordinal}`) as `{ordinal}` from {{t}} where {known} group by {', '.join(f'`{c}`' for c in kept)}", t=changes)
    n = range(len(fields))
    aggs = ", ".join(f"max_by(v{i}, struct(seq, v{i})) filter (where b{i}) as f{i}, max(seq) filter (where b{i}) as s{i}" for i in n)
    latest = ", ".join(f"case when s{i} > floor_seq or floor_seq is null or (s{i} = floor_seq and not gone) then f{i} end as `{f}`" for i, f in enumerate(fields))
    stands = " or ".join(["not gone and floor_seq is not null", *(f"s{i} > floor_seq or (s{i} is not null and floor_seq is null)" for i in n)])
    by = ", ".join(f"k{i}" for i in range(len(key)))
    # the feed's own columns end here: what follows has names of its own
    marks = f"{seq} as seq, coalesce({deletes}, false) as del, coalesce({replaces}, false) as rep"
    named = ", ".join([*(f"`{c}` as k{i}" for i, c in enumerate(key)), *(f"`{f}` as v{i}" for i, f in enumerate(fields))])
    set_by = ", ".join(f"coalesce(not coalesce({deletes}, false) and ({(sets or {}).get(f, f'`{f}` is not null')}), false) as b{i}" for i, f in enumerate(fields))
    return spark.sql(
        f"""
        with marked as (select {named}, {set_by}, {marks} from {{t}}),
        writers as (
          select {by}, max(seq) filter (where del) as del_seq, max(seq) filter (where del or rep) as floor_seq, {aggs}
          from marked group by {by}),
        floors as (select *, coalesce(del_seq = floor_seq, false) as gone from writers)
        select {", ".join(f"k{i} as `{c}`" for i, c in enumerate(key))}, {latest} from floors where {stands}
        """,
        t=once,
    )
