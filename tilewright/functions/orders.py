"""Geometries that are their envelope whole: points, lines of one edge along an axis, rectangles.

The matrix of two of them depends on nothing but how their coordinates are ordered on each axis, so the exact kernel judges
each order once, and a pair only needs comparisons.
"""

from __future__ import annotations

import struct
from functools import cache
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G
from . import matrix as M

_POINT, _LINE, _RING = b"\x01" + struct.pack("<I", 1), b"\x01" + struct.pack("<II", 2, 2), b"\x01" + struct.pack("<III", 3, 1, 5)


def fills(raw: bytes, x1: float, y1: float, x2: float, y2: float) -> bool:
    """Is the geometry of this WKB all of its envelope, and the envelope this one? No for any other WKB than ours."""
    if len(raw) == 21 and raw[:5] == _POINT:
        x, y = struct.unpack_from("<2d", raw, 5)
        return x == x1 == x2 and y == y1 == y2 and abs(x) + abs(y) < float("inf")
    if len(raw) == 41 and raw[:9] == _LINE:
        c = struct.unpack_from("<4d", raw, 9)
    elif len(raw) == 93 and raw[:13] == _RING:
        c = struct.unpack_from("<10d", raw, 13)
    else:
        return False
    xs, ys = c[::2], c[1::2]
    if (min(xs), min(ys), max(xs), max(ys)) != (x1, y1, x2, y2) or not all(abs(v) < float("inf") for v in c):
        return False
    if len(xs) == 2:
        return (x1 == x2) != (y1 == y2)
    turns = all((xs[i] == xs[i + 1]) != (ys[i] == ys[i + 1]) for i in range(4)) and xs[0] == xs[4] and ys[0] == ys[4]
    return turns and len({*zip(xs, ys, strict=True)}) == 4


def _sign(a, b) -> int:
    return (a > b) - (a < b) + 1


@cache
def _axis() -> tuple[tuple[int, ...], tuple[tuple[int, int, int, int], ...]]:
    """All orders of two intervals: the number of an order by its comparisons, and an example of each."""
    numbers, examples = [-1] * (81 * 4), []
    for a1, a2, b1, b2 in product(range(4), repeat=4):
        if a1 <= a2 and b1 <= b2:
            k = (((_sign(a1, b1) * 3 + _sign(a1, b2)) * 3 + _sign(a2, b1)) * 3 + _sign(a2, b2)) * 4 + (a1 == a2) * 2 + (b1 == b2)
            if numbers[k] < 0:
                numbers[k] = len(examples)
                examples.append((a1, a2, b1, b2))
    return tuple(numbers), tuple(examples)


def _shape(x1, y1, x2, y2) -> G.Geometry:
    x1, y1, x2, y2 = map(float, (x1, y1, x2, y2))
    if x1 == x2 and y1 == y2:
        return "POINT", [(x1, y1)]
    if x1 == x2 or y1 == y2:
        return "LINESTRING", [[(x1, y1), (x2, y2)]]
    return "POLYGON", [[[(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]]]


@cache
def judged() -> tuple[tuple[str, int], ...]:
    """The kernel's matrix for each order on both axes, and the relations that hold as bits (in the order of M.NAMES)."""
    out = []
    for (a1, a2, b1, b2), (c1, c2, d1, d2) in product(_axis()[1], repeat=2):
        s, t = _shape(a1, c1, a2, c2), _shape(b1, d1, b2, d2)
        im = G.relate(s, t)
        told = M.named(im, G.dimension(s), G.dimension(t))
        out.append((im, sum(told[n] << k for k, n in enumerate(M.NAMES))))
    return tuple(out)


def _table(values, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def order(a: Column, b: Column) -> Column:
    """The number of the order of two envelopes' coordinates: the place in `judged`."""
    sign = lambda p, q: F.signum(p - q)
    flag = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))

    def axis(low: str, high: str) -> Column:
        a1, a2, b1, b2 = a[low], a[high], b[low], b[high]
        # The signs are added up as doubles and cast once: a checked cast of each takes longer than all the rest of a pair.
        signs = (sign(a1, b1) * 27.0 + sign(a1, b2) * 9.0 + sign(a2, b1) * 3.0 + sign(a2, b2)) * 4.0 + 160.0
        k = signs.cast("int") + flag(a1 == a2, 2) + flag(b1 == b2, 1)
        return F.get(_table(_axis()[0], "int"), k)

    return axis("minx", "maxx") * len(_axis()[1]) + axis("miny", "maxy")


def matrix_of(order_: Column) -> Column:
    return F.get(_table([im for im, _ in judged()], "string"), order_)


def bits_of(order_: Column) -> Column:
    return F.get(_table([b for _, b in judged()], "int"), order_)


def relations_of(bits: Column) -> dict[str, Column]:
    return {n: bits.bitwiseAND(F.lit(1 << k)) != 0 for k, n in enumerate(M.NAMES)}
