"""Reading order of scanned pages: columns apart, each from top to bottom."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

# What a scanner that joins neighbouring columns in one line leaves between them.
GUTTERS = [(" | ", re.compile(r" ?\| ")), ("    ", re.compile(r" {4,}")), ("   ", re.compile(r" {3,}")), ("  ", re.compile(r" {2,}"))]
COLUMN_GAP = 100


def boxes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets into the flat arrays x0, y0 and x1 of a batch's line_box."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()  # without the entries of null lists
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    get = lambda k: np.nan_to_num(flat.field(k).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    names = [flat.type.field(i).name for i in range(flat.type.num_fields)]
    return offsets, get(names.index("x0")), get(names.index("y0")), get(names.index("x1"))


def gutter(lines: list[str], width: np.ndarray) -> re.Pattern | None:
    """The pattern between joined columns, if most of the page's wide lines have one."""
    wide = [line for line, w in zip(lines, (width >= 0.75 * width.max()).tolist(), strict=True) if w]
    for mark, pattern in GUTTERS:
        if sum(mark in line for line in wide) >= 0.6 * len(wide):
            return pattern
    return None


def page_lines(text: str, k: int, at: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> list[str]:
    """Lines of page k of a batch in reading order; at is what boxes() gave.

    Without a box for each line the order stays as scanned. Columns are told apart by gaps between the
    left edges; the parts of a joined line go to the column of its left edge and those right of it.
    """
    lines = text.split("\n")
    lo, hi = at[0][k], at[0][k + 1]
    if len(lines) != hi - lo or len(lines) < 2:
        return lines
    x0, y0 = at[1][lo:hi], at[2][lo:hi]
    pattern = gutter(lines, at[3][lo:hi] - x0) if "  " in text or " | " in text else None
    edges = np.sort(x0)
    if edges[-1] - edges[0] < COLUMN_GAP and pattern is None:
        return lines
    starts = edges[1:][np.diff(edges) >= COLUMN_GAP]
    column = np.searchsorted(starts, x0, side="right")
    if pattern is None:
        return [lines[i] for i in np.lexsort((y0, column))]
    parts = [(c + j, y, i, p) for i, (line, c, y) in enumerate(zip(lines, column.tolist(), y0.tolist(), strict=True)) for j, p in enumerate(pattern.split(line))]
    parts.sort(key=lambda p: p[:3])
    return [p[3] for p in parts]
