"""Cells of large polygons, cut top down inside the row.

The depth of the cut follows the polygon, so it cannot be a fixed chain of expressions;
it is a recursion over one feature, run on Arrow batches.  A polygon stays in its task
while it is cut, and a feature of n points costs about n points a level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa

Point = tuple[float, float]
Rings = list[list[Point]]


def _half(ring: list[Point], axis: int, limit: float, above: bool) -> list[Point]:
    """A closed ring cut to one side of a line across ``axis``."""
    other, out = 1 - axis, []
    p = ring[0]
    p_in = p[axis] >= limit if above else p[axis] <= limit
    for q in ring[1:]:
        q_in = q[axis] >= limit if above else q[axis] <= limit
        if p_in != q_in:
            met = p[other] + (limit - p[axis]) / (q[axis] - p[axis]) * (q[other] - p[other])
            out.append((limit, met) if axis == 0 else (met, limit))
        if q_in:
            out.append(q)
        p, p_in = q, q_in
    if out:
        out.append(out[0])
    return out


def clip(rings: Rings, axis: int, low: float, high: float) -> Rings:
    out = []
    for ring in rings:
        cut = _half(ring, axis, low, True)
        cut = _half(cut, axis, high, False) if len(cut) > 3 else cut
        if len(cut) > 3:
            out.append(cut)
    return out


def filling(rings: Rings, low: Point, size: float) -> bool | None:
    """Whether clipped rings fill a cell (True), leave it empty (False) or cross it (None).

    Where every edge runs along a side of the cell, all of the inside is like its middle.
    """
    (x0, y0), inside = low, False
    x1, y1, mx, my = x0 + size, y0 + size, x0 + size / 2, y0 + size / 2
    for ring in rings:
        px, py = ring[0]
        for x, y in ring[1:]:
            if not (x == px and (x == x0 or x == x1) or y == py and (y == y0 or y == y1)):
                return None
            if (py > my) != (y > my) and x > mx:
                inside = not inside
            px, py = x, y
    return inside


def cells(rings: Rings, tile: float, level: int, step: int) -> Iterator[tuple[int, int, int, Rings | None]]:
    """(level, column, row, rings) of the cells of a polygon; whole cells have no rings."""
    size = tile * step ** level
    for x in _places([p[0] for ring in rings for p in ring], size):
        column = clip(rings, 0, x * size, (x + 1) * size)
        if not column:
            continue
        for y in _places([p[1] for ring in column for p in ring], size):
            part = clip(column, 1, y * size, (y + 1) * size)
            full = filling(part, (x * size, y * size), size) if part else False
            if full:
                yield level, x, y, None
            elif full is None and level:
                yield from cells(part, tile, level - 1, step)
            elif full is None:
                yield level, x, y, part


def _places(values: list[float], size: float) -> range:
    first = math.floor(min(values) / size)
    return range(first, max(first, math.ceil(max(values) / size) - 1) + 1)


def cut_batches(tile: float, step: int):
    """Function of Arrow batches: columns to keep, then ``__start`` (level) and ``__r`` (rings)."""
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.schema.names[:-2]
            starts, shapes = batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1)
            for i in range(batch.num_rows):
                rings = [[(p["x"], p["y"]) for p in ring] for ring in shapes[i].as_py() if len(ring) > 3]
                made = list(cells(rings, tile, starts[i], step)) if rings else []
                if not made:
                    continue
                where = pa.array([i] * len(made))
                shape = [r and [[{"x": x, "y": y} for x, y in ring] for ring in r] for *_, r in made]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(where) for c in range(len(kept))), pa.array([m[0] for m in made], pa.int32()),
                     pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()),
                     pa.array([r is None for r in shape]), pa.array(shape, pa.list_(pa.list_(point)))],
                    names=[*kept, "lev", "tx", "ty", "whole", "__r"])
    return run
