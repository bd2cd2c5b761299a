import pytest

from tapeloom.operators import drift
from tapeloom.operators.drift import bar_cells, column_catalogue, consistent_table, lifespans, schema_changes

SCHEMA = "file_id bigint, feed_id bigint, file_seq bigint, symbol string, line_no int, raw_line string, ts bigint, field string, kind int"


def lines(spark, files):
    rows = [(1, f, s, "X", n, x, 0, "q", 1) for f, s, text in files for n, x in enumerate(text)]
    return spark.createDataFrame(rows + rows[:2], SCHEMA)


A = ["ts,count,Price,usd", "1,10,1.5,2.0e3", "2,11,1.6,2100", "3,12,,2200"]
B = ['﻿"TS" ; "Usd" ; "n_trades";"price"', '2;2100.0;"11";1.6', "3;2200;12;n/a", "4;2300;1.25e1;NaN"]
C = ["ts|usd|price|extra", "3|2200 USD|nan|1", "4|2300 USD|1.75|2", '5|"2,400 USD"|1.8|']


def test_changes_casts_and_lifespans(spark):
    cells = bar_cells(lines(spark, [(7, 10, A), (7, 20, B), (7, 30, C)]))
    got = sorted(tuple(r) for r in schema_changes(cells).collect())
    assert got == [
        (7, 20, "renamed", "count", "n_trades"), (7, 20, "retyped", "count", "n_trades"), (7, 30, "added", "", "extra"), (7, 30, "removed", "n_trades", ""), (7, 30, "retyped", "usd", "usd"),
    ]
    spans = {(r.field, r.type): (r.first_no, r.last_no) for r in lifespans(column_catalogue(cells)).collect()}
    assert spans["price", "double"] == (1, 3) and spans["usd", "double"] == (1, 2) and spans["usd", "string"] == (3, 3)
    table = {r.ts: r for r in consistent_table(cells).collect()}
    assert sorted(table) == [1, 2, 3, 4, 5]
    assert (table[4].n_trades, table[4].price, table[4].usd, table[5].usd, table[1].n_trades) == (12.5, 1.75, 2300.0, 2400.0, 10.0)


def test_one_name_with_two_meanings_text_units_and_conflicts(spark):
    feeds = [
        (1, 1, ["ts,count,venue", "1,10,XA", "2,11,XB"]), (1, 2, ["ts,trades,venue", "2,11,XB", "3,12,XC"]),
        (2, 1, ["ts,count,size", "1,5,1.5k", "2,6,2k"]), (2, 2, ["ts,levels,size", "2,6,2000", "3,7,1.2M"]),
        (3, 1, ["ts,x,price", "1,4,9", "2,5,8"]), (3, 2, ["ts,x", "2,5", "3,6"]), (3, 3, ["ts,price", "3,6", "4,7"]),
    ]
    table = {(r.feed_id, r.ts): r for r in consistent_table(bar_cells(lines(spark, feeds))).collect()}
    assert (table[1, 1].trades, table[1, 3].trades, table[2, 1].levels, table[2, 3].levels) == (10, 12, 5, 7)
    assert "count" not in table[1, 1].asDict() and table[1, 1].levels is None
    assert [table[1, t].venue for t in (1, 2, 3)] == ["XA", "XB", "XC"] and [table[2, t].size for t in (1, 2, 3)] == [1500, 2000, 1200000]
    # x came to be price when price was gone: file 1 holds both, and the one that bears the name is taken
    assert (table[3, 1].price, table[3, 1].conflicts, table[3, 2].price, table[3, 4].price) == (9, ["price"], 5, 7)


def test_headers_only_and_empty(spark):
    cells = bar_cells(lines(spark, [(1, 1, ["ts,a"]), (1, 2, ["ts,a,b"])]))
    assert [tuple(r) for r in schema_changes(cells).collect()] == [(1, 2, "added", "", "b")]
    none = bar_cells(spark.createDataFrame([], SCHEMA))
    assert schema_changes(none).count() == 0 and consistent_table(none).count() == 0


def test_quoted_delimiters_and_long_lines(spark):
    wide = ["ts," + ",".join(f"c{k}" for k in range(3000)), "1," + ",".join(f'"{k},000"' for k in range(3000))]
    cells = bar_cells(lines(spark, [(1, 1, wide)]))
    r = cells.where("field = 'c2999' and line_no = 1").collect()[0]
    assert (r.value, r.qty, r.kind, r.ts) == ("2999,000", 2999000.0, 2, 1)


def test_more_names_than_allowed_raise(spark, monkeypatch):
    monkeypatch.setattr(drift, "MAX_NAMES", 3)
    assert consistent_table(bar_cells(lines(spark, [(1, 1, ["ts,a,b,c", "1,2,3,4"])]))).columns == ["feed_id", "symbol", "ts", "conflicts", "a", "b", "c"]
    with pytest.raises(ValueError, match="more than 3 field names"):
        consistent_table(bar_cells(lines(spark, [(1, 1, ["ts,a,b,c,d", "1,2,3,4,5"])])))
