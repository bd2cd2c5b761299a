import numpy as np
import pyarrow as pa

from tapeloom.llm.layout import boxes, page_lines

BOX = pa.struct([("conf", pa.int32()), ("x0", pa.int32()), ("y0", pa.int32()), ("x1", pa.int32())])


def at(*pages):
    return boxes(pa.array([None if p is None else [{"x0": x, "y0": y, "x1": x1, "conf": 1} for x, y, x1 in p] for p in pages], pa.list_(BOX)))


def test_columns_read_across():
    a = at([(60, 10, 400), (460, 11, 800), (61, 30, 400), (462, 31, 800)])
    assert page_lines("a\nc\nb\nd", 0, a) == ["a", "b", "c", "d"]


def test_joined_lines_and_a_short_column():
    for mark in ("     ", " | ", "   ", "  "):
        a = at([(60, 10, 800), (61, 30, 800), (60, 50, 400)])
        assert page_lines(f"aa aa{mark}cc\nbb{mark}dd\nee", 0, a) == ["aa aa", "bb", "ee", "cc", "dd"]


def test_orders_that_stay():
    a = at(None, [], [(1, 1, 2)], [(60, 10, 400), (61, 30, 400)])
    assert page_lines("b\na", 0, a) == ["b", "a"] == page_lines("b\na", 1, a) == page_lines("b\na", 2, a)
    assert page_lines("a  b\nc", 3, a) == ["a  b", "c"]  # one wide line of two is no joined page
    assert np.array_equal(a[0], [0, 0, 0, 1, 3])
