"""Schemas that drift between files: a column lifespan catalogue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import cut, small

# Fixed values of the file format: delimiters in order of preference, and the spellings of no value.
DELIMITERS = [",", ";", "\t", "|"]
NO_VALUE = ["", "nan", "null", "n/a"]
FILE = ["feed_id", "file_seq"]
MAX_NAMES = 20_000


def _cells(line: Column, delimiter: Column) -> Column:
    """Splits at delimiters outside of double quotes, in linear time."""
    marked = F.transform(F.split(line, '"'), lambda part, i: F.when(i % 2 == 0, F.replace(part, delimiter, F.lit("\x01"))).otherwise(part))
    return F.split(F.array_join(marked, '"'), "\x01")


def _plain(c: Column) -> Column:
    return F.trim(F.replace(F.trim(c), F.lit('"'), F.lit("")))


def _delimiter(header: Column) -> Column:
    outside = F.array_join(F.filter(F.split(header, '"'), lambda _, i: i % 2 == 0), "")
    best = F.array_max(F.transform(F.array(*[F.lit(d) for d in DELIMITERS]), lambda d, i: F.struct(F.length(outside) - F.length(F.replace(outside, d, F.lit(""))), -i, d.alias("d"))))
    return best["d"]


def quantity(text: Column) -> Column:
    """The number in a cell whatever its notation: thousands commas, exponents, per cent signs, unit names; k, m, b and bn after it multiply."""
    whole = F.replace(text, F.lit(","), F.lit(""))
    bare = F.regexp_replace(whole, r"\s*[A-Za-z%]*$", "")
    unit = F.lower(F.regexp_extract(whole, r"([A-Za-z%]*)$", 1))
    by = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit.isin("b", "bn"), 1e9).otherwise(1.0)
    return F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double") * by)


def bar_cells(lines: DataFrame) -> DataFrame:
    """The cells of all files: feed_id, file_seq, symbol, line_no, ts, field, value (null for no value), kind, qty.

    lines: feed_id, file_seq, symbol, line_no (0: the header), raw_line; a repeated line gives its cells again, which
    no operator counts twice. Names are trimmed, without quotes and byte order mark, lower case; a name without text is
    dropped; of equal names in one header each keeps its cells. Lines without a header, null
    keys and cells beyond the header are ignored; missing cells are no values. A header gives
    each of its fields one row with line_no 0, so that empty files keep their schema.
    """
    lines = lines.select(*FILE, "symbol", "line_no", "raw_line").dropna(subset=[*FILE, "line_no", "raw_line"])
    header = lines.where("line_no = 0").groupBy(*FILE).agg(F.min(F.regexp_replace("raw_line", "^﻿", "")).alias("h"))
    header = cut(header.withColumn("d", _delimiter(F.col("h"))).select(*FILE, "d", F.transform(_cells(F.col("h"), F.col("d")), lambda c: F.lower(_plain(c))).alias("names")))
    parsed = lines.join(small(header, header.count()), FILE).withColumn("cells", F.when(F.col("line_no") > 0, F.transform(_cells(F.col("raw_line"), F.col("d")), _plain)).otherwise(F.array().cast("array<string>")))
    parsed = parsed.withColumn("ts", F.get("cells", F.array_position("names", F.lit("ts")).cast("int") - 1).try_cast("bigint"))
    out = parsed.select(*FILE, "symbol", "line_no", "ts", F.posexplode("names").alias("pos", "field"), "cells").where("field not in ('', 'ts')")
    value = F.get("cells", F.col("pos"))
    value = F.when(~F.lower(value).isin(NO_VALUE), value)
    kind = F.when(value.rlike(r"^[+-]?\d+$"), 0).when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), 1).when(value.isNotNull(), 2)
    return out.select(*FILE, "symbol", "line_no", "ts", "field", value.alias("value"), kind.alias("kind"), quantity(value).alias("qty"))


def column_catalogue(cells: DataFrame) -> DataFrame:
    """The schema of every file: feed_id, file_seq, file_no (1 for the first of the feed), field, type (int, double or string; int if it has no values)."""
    fields = cells.groupBy(*FILE, "field").agg(F.coalesce(F.max("kind"), F.lit(0)).alias("k"))
    # a file's number among its feed's: one row per file and field is all that meets here
    number = F.dense_rank().over(Window.partitionBy("feed_id").orderBy("file_seq")).cast("bigint")
    return fields.select(*FILE, number.alias("file_no"), "field", F.element_at(F.array(F.lit("int"), F.lit("double"), F.lit("string")), F.col("k") + 1).alias("type"))


def lifespans(catalogue: DataFrame) -> DataFrame:
    """Islands of files in a row per feed, field and type: first_no, last_no and the file_seq of both."""
    w = Window.partitionBy("feed_id", "field", "type").orderBy("file_no")
    starts = F.when(F.col("file_no") - F.lag("file_no").over(w) == 1, 0).otherwise(1)
    isles = catalogue.withColumn("s", starts).withColumn("isle", F.sum("s").over(w))
    return isles.groupBy("feed_id", "field", "type", "isle").agg(F.min("file_no").alias("first_no"), F.max("file_no").alias("last_no"), F.min("file_seq").alias("first_seq"), F.max("file_seq").alias("last_seq")).drop("isle")


def _aliases(cells: DataFrame, log: DataFrame, order: DataFrame) -> DataFrame:
    """feed_id, file_no, old_field, new_field, old_type, new_type: a gone and a new name with the same quantities in the bars that both files hold.

    log: feed_id, file_no, field, old_type (null for a new name), new_type (null for a gone one). Only the files where a name went and
    another came are looked at, one aggregation by bar and one by pair of names.
    """
    key = ["feed_id", "file_no"]
    moved = log.where("old_type is null or new_type is null").select(*key, "field", F.col("old_type").isNotNull().alias("is_old"), F.coalesce("old_type", "new_type").alias("type"))
    both = moved.groupBy(*key).agg(F.min("is_old").alias("a"), F.max("is_old").alias("b")).where("not a and b").select(*key)
    moved = cut(moved.join(both, key, "left_semi"))
    n_moved, n_files = moved.count(), order.count()
    pairs = moved.select(*key).distinct()
    q = F.coalesce(F.when(F.col("qty") == 0, F.lit("0")).otherwise(F.format_string("%.8e", F.col("qty"))), F.col("value"))
    told = cells.where("ts is not null and value is not null").join(small(order, n_files), FILE).select("feed_id", "ts", "field", q.alias("q"), F.inline(F.array(F.struct(F.col("file_no"), F.lit(False).alias("is_old")), F.struct((F.col("file_no") + 1).alias("file_no"), F.lit(True).alias("is_old")))))
    told = told.join(small(pairs, n_moved), key, "left_semi").join(small(moved, n_moved), [*key, "field", "is_old"], "left")
    item = lambda old: F.collect_set(F.when(F.col("type").isNotNull() & (F.col("is_old") == old), F.struct("field", "q", "type")))
    bars = told.groupBy(*key, "ts").agg(F.min("is_old").alias("in_new"), F.max("is_old").alias("in_old"), item(True).alias("old"), item(False).alias("new")).where("not in_new and in_old")
    none = lambda xs: F.filter(xs, lambda _: F.lit(False))
    lines = F.concat(
        F.flatten(F.transform("old", lambda o: F.transform(F.filter("new", lambda n: n["q"] == o["q"]), lambda n: F.struct(o["field"].alias("old_field"), n["field"].alias("new_field"), o["type"].alias("old_type"), n["type"].alias("new_type"))))),
        F.transform("old", lambda o: F.struct(o["field"].alias("old_field"), F.lit(None).cast("string").alias("new_field"), o["type"].alias("old_type"), F.lit(None).cast("string").alias("new_type"))),
        F.transform("new", lambda n: F.struct(F.lit(None).cast("string").alias("old_field"), n["field"].alias("new_field"), F.lit(None).cast("string").alias("old_type"), n["type"].alias("new_type"))),
    )
    counted = bars.select(*key, F.inline(lines)).groupBy(*key, "old_field", "new_field").agg(F.count("*").alias("n"), F.max("old_type").alias("old_type"), F.max("new_type").alias("new_type"))
    side = lambda c, other: F.max(F.when(F.col(other).isNull(), F.col("n"))).over(Window.partitionBy(*key, c))
    counted = counted.withColumns({"n_old": side("old_field", "new_field"), "n_new": side("new_field", "old_field")})
    match = counted.where("old_field is not null and new_field is not null and n = least(n_old, n_new)")
    best = lambda own, other: F.row_number().over(Window.partitionBy(*key, own).orderBy(F.desc("n"), other))
    return match.withColumns({"a": best("old_field", "new_field"), "b": best("new_field", "old_field")}).where("a = 1 and b = 1").select(*key, "old_field", "new_field", "old_type", "new_type")


def _log(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The catalogue, the order of the files, the starts and endings of lifespans, the aliases."""
    catalogue = cut(column_catalogue(cells))
    spans = lifespans(catalogue)
    order = catalogue.select(*FILE, "file_no").distinct()
    last = order.groupBy("feed_id").agg(F.max("file_no").alias("n_files"))
    starts = spans.where("first_no > 1").select("feed_id", F.col("first_no").alias("file_no"), "field", F.col("type").alias("new_type"))
    ends = spans.join(last, "feed_id").where("last_no < n_files").select("feed_id", (F.col("last_no") + 1).alias("file_no"), "field", F.col("type").alias("old_type"))
    log = cut(starts.join(ends, ["feed_id", "file_no", "field"], "full"))
    return catalogue, order, log, cut(_aliases(cells, log, order))


def schema_changes(cells: DataFrame) -> DataFrame:
    """Every change from a file to the next of its feed: feed_id, file_seq (of the later file), change_kind, old_field, new_field.

    The catalogue's lifespans start and end; a start and an ending of one name at one file is
    'retyped'; a gone and a new name with the same quantities in the repeated bars are 'renamed'
    (and 'retyped' too if their types differ), whatever the notation; the rest is 'added' or 'removed'.
    A gone name matches one new name at most, the one with the most equal quantities, then by name.
    """
    _, order, log, alias = _log(cells)
    key = ["feed_id", "file_no"]
    role = F.when(F.col("old_type").isNull(), "new").when(F.col("new_type").isNull(), "old")
    taken = alias.select(*key, F.inline(F.array(F.struct(F.lit("old").alias("role"), F.col("old_field").alias("field")), F.struct(F.lit("new").alias("role"), F.col("new_field").alias("field")))))
    rest = log.withColumn("role", role).join(taken, [*key, "role", "field"], "left_anti")
    kind = F.when(F.col("role") == "new", "added").when(F.col("role") == "old", "removed").otherwise("retyped")
    rest = rest.select(*key, kind.alias("change_kind"), F.when(F.col("old_type").isNotNull(), F.col("field")).otherwise("").alias("old_field"), F.when(F.col("new_type").isNotNull(), F.col("field")).otherwise("").alias("new_field"))
    kinds = F.when(F.col("old_type") != F.col("new_type"), F.array(F.lit("renamed"), F.lit("retyped"))).otherwise(F.array(F.lit("renamed")))
    return alias.select(*key, F.explode(kinds).alias("change_kind"), "old_field", "new_field").unionByName(rest).join(order, key).select(*FILE, "change_kind", "old_field", "new_field")


def _identities(catalogue: DataFrame, alias: DataFrame) -> DataFrame:
    """feed_id, field, first_no, last_no, canon: what each name of a feed meant from file to file, by the last name that it came to have.

    A feed's catalogue, a line per name and stretch of files, is followed in one task.
    """
    stretches = lifespans(catalogue.select("feed_id", "file_seq", "file_no", "field", F.lit("any").alias("type"))).select("feed_id", "field", "first_no", "last_no", F.lit(None).cast("string").alias("new_field"))
    moves = alias.select("feed_id", F.col("old_field").alias("field"), F.col("file_no").alias("first_no"), F.lit(None).cast("bigint").alias("last_no"), "new_field")

    def follow(feed: pd.DataFrame) -> pd.DataFrame:
        to = {(r.field, int(r.first_no)): r.new_field for r in feed.itertuples() if r.new_field is not None}
        isles = [(r.field, int(r.first_no), int(r.last_no)) for r in feed.itertuples() if r.new_field is None]
        ends = {(f, a): b for f, a, b in isles}
        out = []
        for f, a, b in isles:
            name, end = f, b
            while (new := to.get((name, end + 1))) is not None:
                name, end = new, ends[new, end + 1]
            out.append((feed.feed_id.iat[0], f, a, b, name))
        return pd.DataFrame(out, columns=["feed_id", "field", "first_no", "last_no", "canon"])

    return stretches.unionByName(moves).groupBy("feed_id").applyInPandas(follow, "feed_id bigint, field string, first_no bigint, last_no bigint, canon string")


def _bars(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """consistent_bars, and canon and k (0 int, 1 double, 2 string) of each column."""
    catalogue, order, _, alias = _log(cells)
    ids = cut(_identities(catalogue, alias))
    rows = cells.where("line_no > 0 and ts is not null").join(small(order, order.count()), FILE)
    ids = small(ids, ids.count())
    rows = rows.join(ids, ["feed_id", "field"]).where("file_no between first_no and last_no")
    whole = F.col("qty").isNotNull() & (F.col("qty") == F.floor("qty")) & ~F.col("value").rlike(r"[.eE]")
    kind = F.when(F.col("value").isNull(), F.lit(None)).when(whole, 0).when(F.col("qty").isNotNull(), 1).otherwise(2)
    rows = rows.select("feed_id", "symbol", "ts", "file_no", "canon", F.struct((F.col("field") == F.col("canon")).alias("own"), F.col("field").alias("field"), "value", "qty").alias("v"), kind.alias("kind"))
    types = cut(rows.groupBy("canon").agg(F.coalesce(F.max("kind"), F.lit(0)).alias("k")))
    bar = ["feed_id", "symbol", "ts"]
    one = rows.where("v.value is not null").repartition(*bar).groupBy(*bar, "canon", "file_no").agg(F.min_by("v", F.struct(~F.col("v.own"), F.col("v.field"), F.col("v.value"))).alias("v"), (F.count_distinct(F.coalesce(F.col("v.qty").cast("string"), F.col("v.value"))) > 1).alias("conflict"))
    one = one.groupBy(*bar, "canon").agg(F.max(F.struct("file_no", "v", "conflict")).alias("m"), F.count("*").alias("n_files"))
    name = F.element_at(F.array(F.lit("int"), F.lit("double"), F.lit("string")), F.col("k") + 1)
    one = one.join(small(types, types.count()), "canon")
    return one.select(*bar, F.col("canon").alias("field"), name.alias("type"), F.when(F.col("k") < 2, F.col("m.v.qty")).alias("number"), F.when(F.col("k") == 2, F.col("m.v.value")).alias("text"), F.col("m.conflict").alias("conflict"), "n_files"), types


def consistent_bars(cells: DataFrame) -> DataFrame:
    """All bars in one long table: feed_id, symbol, ts, field, type, number, text, conflict, n_files.

    field is the last name that the feed gave to the column (the alias table is followed within a feed, so that one name
    with two meanings in two feeds stays two columns). type is the widest of the column over all feeds: int and double columns
    have number, notation and units removed; a column with a value that is no quantity is a string and keeps its text.
    A bar that several files repeat is one row per field, with the value of the latest file that has one. conflict: two
    fields of that file have come to the same name and differ here; the one that bears it, then the smallest name, is taken.
    Bars without a readable ts are left out.
    """
    return _bars(cells)[0]


def consistent_table(cells: DataFrame) -> DataFrame:
    """consistent_bars with a row per bar: feed_id, symbol, ts, conflicts (names of the fields that had one) and a BIGINT, DOUBLE or STRING column per field.

    A field named like one of the first four gets a trailing underscore. No lines give a table without fields; bars of which no
    file has any value are left out. More than MAX_NAMES distinct names raise ValueError.
    """
    bars, types = _bars(cells)
    fields = types.limit(MAX_NAMES + 1).collect()
    if len(fields) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} field names")
    pick = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("field", c))))
    rows = bars.groupBy("feed_id", "symbol", "ts").agg(F.sort_array(F.collect_set(F.when(F.col("conflict"), F.col("field")))).alias("conflicts"), pick("number").alias("numbers__"), pick("text").alias("texts__"))
    head = ["feed_id", "symbol", "ts", "conflicts"]
    typed = [lambda f: F.col("numbers__")[f].cast("bigint"), lambda f: F.col("numbers__")[f], lambda f: F.col("texts__")[f]]
    return rows.select(*head, *[typed[r.k](r.canon).alias(r.canon + "_" * (r.canon in head)) for r in sorted(fields)])
