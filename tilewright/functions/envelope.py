"""Envelopes as structs of four doubles: accessors, tests, tiles and reference points, all as columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relation names of the interface.
RELATIONS = ("equals", "disjoint", "intersects", "touches", "crosses", "within", "contains", "overlaps", "covers", "coveredby", "DE9IM")
SWAPPED = {"within": "contains", "contains": "within", "covers": "coveredby", "coveredby": "covers"}


@dataclass(frozen=True)
class Theta:
    """Width and height of a tile."""

    x: float = 1.0
    y: float = 1.0

    def __mul__(self, n: float | tuple[float, float]) -> Theta:
        nx, ny = n if isinstance(n, tuple) else (n, n)
        return Theta(self.x * nx, self.y * ny)


def box(minx, miny, maxx, maxy) -> Column:
    names = ("minx", "miny", "maxx", "maxy")
    return F.struct(*[(c if isinstance(c, Column) else F.col(c)).cast("double").alias(n) for c, n in zip((minx, miny, maxx, maxy), names, strict=True)])


def width(e: Column) -> Column:
    return e["maxx"] - e["minx"]


def height(e: Column) -> Column:
    return e["maxy"] - e["miny"]


def area(e: Column) -> Column:
    return width(e) * height(e)


def center(e: Column) -> tuple[Column, Column]:
    return (e["minx"] + e["maxx"]) / 2, (e["miny"] + e["maxy"]) / 2


def scaled(e: Column, theta: Theta) -> Column:
    """The envelope in units of tiles."""
    return box(e["minx"] / theta.x, e["miny"] / theta.y, e["maxx"] / theta.x, e["maxy"] / theta.y)


def common(a: Column, b: Column) -> Column:
    """The intersection of two envelopes that intersect."""
    return box(F.greatest(a["minx"], b["minx"]), F.greatest(a["miny"], b["miny"]), F.least(a["maxx"], b["maxx"]), F.least(a["maxy"], b["maxy"]))


def intersects(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])


def inner(a: Column, b: Column) -> Column:
    """The interiors of two boxes meet, as the first place of `box_matrix` tells (2)."""
    return (a["minx"] < b["maxx"]) & (a["maxx"] > b["minx"]) & (a["miny"] < b["maxy"]) & (a["maxy"] > b["miny"])


def contains(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["minx"]) & (a["maxx"] >= b["maxx"]) & (a["miny"] <= b["miny"]) & (a["maxy"] >= b["maxy"])


def same(a: Column, b: Column) -> Column:
    return contains(a, b) & contains(b, a)


def any_side(a: Column, b: Column) -> Column:
    """Any side of one at the coordinate of a side of the other."""
    xs = [(a[p] == b[q]) for p in ("minx", "maxx") for q in ("minx", "maxx")]
    ys = [(a[p] == b[q]) for p in ("miny", "maxy") for q in ("miny", "maxy")]
    out = xs[0]
    for c in xs[1:] + ys:
        out = out | c
    return out


def check(a: Column, b: Column, relation: str) -> Column:
    """The necessary test of envelopes for a relation of their geometries."""
    if relation in ("contains", "covers"):
        return contains(a, b)
    if relation in ("within", "coveredby"):
        return contains(b, a)
    if relation == "equals":
        return same(a, b)
    if relation == "disjoint":
        return ~intersects(a, b)
    if relation == "touches":
        return any_side(a, b)
    if relation in ("intersects", "crosses", "overlaps", "DE9IM"):
        return intersects(a, b)
    return F.lit(False)


def kind(a: Column, b: Column) -> Column:
    """How two envelopes meet: RANK0 not at all, RANK3 containment, RANK1 same extent on one axis, else RANK2."""
    level = ((a["minx"] == b["minx"]) & (a["maxx"] == b["maxx"])) | ((a["miny"] == b["miny"]) & (a["maxy"] == b["maxy"]))
    return F.when(~intersects(a, b), "RANK0").when(contains(a, b) | contains(b, a), "RANK3").when(level, "RANK1").otherwise("RANK2")


def _each(parts_a: Column, parts_b: Column, most: int) -> list[tuple[Column, Column, Column]]:
    """(source, target, do they intersect) for the pairs of up to `most` parts each, targets outermost; no lambda, so that they are compiled."""
    of = lambda parts: [F.get(parts, F.lit(i)) for i in range(most)]
    return [(p, q, F.coalesce(intersects(p, q), F.lit(False))) for q in of(parts_b) for p in of(parts_a)]


def fine_intersects(a: Column, b: Column, parts_a: Column, parts_b: Column, most: int = 0) -> Column:
    """The envelopes and some pair of their parts intersect. `most`, here and below: no entity has more parts (0: not known)."""
    if most:
        return intersects(a, b) & reduce(or_, [hit for _, _, hit in _each(parts_a, parts_b, most)])
    return intersects(a, b) & F.exists(parts_a, lambda p: F.exists(parts_b, lambda q: intersects(p, q)))


def first_meeting(parts_a: Column, parts_b: Column, most: int = 0) -> Column:
    """The first pair (source, target) of parts that intersect, targets outermost; null if there is none."""
    if most:
        return F.coalesce(*[F.when(hit, F.struct(p.alias("source"), q.alias("target"))) for p, q, hit in _each(parts_a, parts_b, most)])
    pairs = F.flatten(F.transform(parts_b, lambda q: F.transform(F.filter(parts_a, lambda p: intersects(p, q)), lambda p: F.struct(p.alias("source"), q.alias("target")))))
    return F.get(pairs, F.lit(0))


def meeting_places(parts_a: Column, parts_b: Column) -> Column:
    """Places (i, j) of all pairs of parts that intersect."""
    def of(p: Column, i: Column) -> Column:
        hits = F.transform(parts_b, lambda q, j: F.when(intersects(p, q), F.struct(i.alias("i"), j.alias("j"))))
        return F.filter(hits, lambda h: h.isNotNull())

    return F.flatten(F.transform(parts_a, of))


def near_days(a: Column, b: Column, days: int = 2) -> Column:
    """Less than `days` apart; also where a time is missing."""
    return F.coalesce(F.abs(F.datediff(a, b)) < days, F.lit(True))


def tile_range(e: Column, theta: Theta) -> Column:
    """First and last tile on each axis, both inclusive; a geometry on a tile's edge counts for both sides' first tile."""
    return F.struct(
        F.floor(e["minx"] / theta.x).alias("x1"), F.floor(e["miny"] / theta.y).alias("y1"), F.floor(e["maxx"] / theta.x).alias("x2"), F.floor(e["maxy"] / theta.y).alias("y2")
    )


def half_open_range(e: Column, theta: Theta) -> Column:
    """Compatibility: floor and ceiling after rounding to 6 places half-even; the last tile is exclusive."""
    low = lambda c, t: F.floor(F.bround(c / t, 6))
    high = lambda c, t: F.ceil(F.bround(c / t, 6))
    return F.struct(low(e["minx"], theta.x).alias("x1"), low(e["miny"], theta.y).alias("y1"), high(e["maxx"], theta.x).alias("x2"), high(e["maxy"], theta.y).alias("y2"))


def tiles(r: Column) -> Column:
    """Structs (tx, ty) of an inclusive range of tiles."""
    return F.flatten(F.transform(F.sequence(r["x1"], r["x2"]), lambda x: F.transform(F.sequence(r["y1"], r["y2"]), lambda y: F.struct(x.alias("tx"), y.alias("ty")))))


def half_open_tiles(e: Column, theta: Theta) -> Column:
    """Compatibility: a zero-extent envelope lies in (0, 0), others in the half-open range."""
    r = half_open_range(e, theta)
    span = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    cells = F.flatten(F.transform(span(r["x1"], r["x2"]), lambda x: F.transform(span(r["y1"], r["y2"]), lambda y: F.struct(x.alias("tx"), y.alias("ty")))))
    zero = F.array(F.struct(F.lit(0).cast("bigint").alias("tx"), F.lit(0).cast("bigint").alias("ty")))
    return F.when((width(e) == 0) & (height(e) == 0), zero).otherwise(cells)


def fine_tiles(parts: Column, theta: Theta) -> Column:
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: tiles(tile_range(p, theta)))))


def reference_tile(a: Column, b: Column, theta: Theta) -> tuple[Column, Column]:
    """The one tile that answers for a pair: that of the low corner of the envelopes' intersection."""
    return F.floor(F.greatest(a["minx"], b["minx"]) / theta.x), F.floor(F.greatest(a["miny"], b["miny"]) / theta.y)


def reference_point(a: Column, b: Column, theta: Theta) -> tuple[Column, Column]:
    """Compatibility: the top-left corner of the intersection in tiles, moved by 1e-8."""
    return F.greatest(a["minx"], b["minx"]) / theta.x + 1e-8, F.least(a["maxy"], b["maxy"]) / theta.y + 1e-8


def tile_count(e: Column, theta: Theta) -> Column:
    """Tiles that an envelope overlaps, per axis one more than ceiling less floor."""
    return (F.ceil(e["maxx"] / theta.x) - F.floor(e["minx"] / theta.x) + 1) * (F.ceil(e["maxy"] / theta.y) - F.floor(e["miny"] / theta.y) + 1)


def common_tiles(a: Column, b: Column, theta: Theta) -> Column:
    x = F.least(F.ceil(a["maxx"] / theta.x), F.ceil(b["maxx"] / theta.x)) - F.greatest(F.floor(a["minx"] / theta.x), F.floor(b["minx"] / theta.x)) + 1
    y = F.least(F.ceil(a["maxy"] / theta.y), F.ceil(b["maxy"] / theta.y)) - F.greatest(F.floor(a["miny"] / theta.y), F.floor(b["miny"] / theta.y)) + 1
    return x * y


def tiles_meet(a: Column, b: Column, tiles_a: Column, tiles_b: Column) -> Column:
    """The envelopes intersect, and the sets of tiles that the parts lie in have one in common."""
    return intersects(a, b) & F.arrays_overlap(tiles_a, tiles_b)


def fine_common_tiles(parts_a: Column, parts_b: Column, theta: Theta, most: int = 0) -> Column:
    """Common tiles summed over all pairs of parts that intersect, without the one more per axis."""
    def one(p: Column, q: Column) -> Column:
        x = F.least(F.ceil(p["maxx"] / theta.x), F.ceil(q["maxx"] / theta.x)) - F.greatest(F.floor(p["minx"] / theta.x), F.floor(q["minx"] / theta.x))
        y = F.least(F.ceil(p["maxy"] / theta.y), F.ceil(q["maxy"] / theta.y)) - F.greatest(F.floor(p["miny"] / theta.y), F.floor(q["miny"] / theta.y))
        return F.when(intersects(p, q), x * y).otherwise(F.lit(0).cast("bigint"))

    if most:
        return reduce(add, [one(p, q) for p, q, _ in _each(parts_a, parts_b, most)])
    return F.aggregate(F.flatten(F.transform(parts_a, lambda p: F.transform(parts_b, lambda q: one(p, q)))), F.lit(0).cast("bigint"), lambda n, c: n + c)


def fine_reference_point(a: Column, b: Column, parts_a: Column, parts_b: Column, theta: Theta, most: int = 0) -> tuple[Column, Column]:
    """`reference_point` of the first parts that meet, of the envelopes if none do."""
    pair = first_meeting(parts_a, parts_b, most)
    return tuple(F.coalesce(p, q) for p, q in zip(reference_point(pair["source"], pair["target"], theta), reference_point(a, b, theta), strict=True))


def split_granularity(e: Column, theta: Theta, base: float = 50.0) -> tuple[Column, Column]:
    """Size of the parts that an envelope is cut into: theta, more or less by the logarithm to `base` of its width in tiles."""
    def ratio(extent: Column, step: float) -> Column:
        times = F.ceil(extent / step).cast("double")
        fewer = F.ceil(times / (F.log10(times + 1) / F.log10(F.lit(base))))
        return F.when(times != 0, times / fewer).otherwise(1.0) * step

    return ratio(width(e), theta.x), ratio(height(e), theta.y)


def fine_tile_count(parts: Column, theta: Theta) -> Column:
    """Over parts, without the one more per axis."""
    def one(p: Column) -> Column:
        return (F.ceil(p["maxx"] / theta.x) - F.floor(p["minx"] / theta.x)) * (F.ceil(p["maxy"] / theta.y) - F.floor(p["miny"] / theta.y))

    return F.aggregate(F.transform(parts, one), F.lit(0).cast("bigint"), lambda n, c: n + c)


def box_relations(a: Column, b: Column) -> dict[str, Column]:
    """The relations of two axis-parallel boxes with an area each, from their corners."""
    meet, has, lies = intersects(a, b), contains(a, b), contains(b, a)
    inner = (a["minx"] < b["maxx"]) & (a["maxx"] > b["minx"]) & (a["miny"] < b["maxy"]) & (a["maxy"] > b["miny"])
    return {
        "contains": has, "coveredby": lies, "covers": has, "crosses": F.lit(False), "equals": has & lies, "intersects": meet,
        "overlaps": inner & ~has & ~lies, "touches": meet & ~inner, "within": lies, "disjoint": ~meet,
    }


def box_matrix(a: Column, b: Column) -> Column:
    """DE-9IM matrix of two axis-parallel boxes with an area each, without a kernel."""
    meet = intersects(a, b)
    inner = (a["minx"] < b["maxx"]) & (a["maxx"] > b["minx"]) & (a["miny"] < b["maxy"]) & (a["maxy"] > b["miny"])
    a_in, b_in, eq = contains(b, a), contains(a, b), same(a, b)
    corner = ((a["minx"] == b["maxx"]) | (a["maxx"] == b["minx"])) & ((a["miny"] == b["maxy"]) | (a["maxy"] == b["miny"]))
    # Within an overlap: do sides lie upon each other, does a side of one run through the inside of the other?
    x_over = F.least(a["maxx"], b["maxx"]) > F.greatest(a["minx"], b["minx"])
    y_over = F.least(a["maxy"], b["maxy"]) > F.greatest(a["miny"], b["miny"])
    side = (((a["minx"] == b["minx"]) | (a["maxx"] == b["maxx"])) & y_over) | (((a["miny"] == b["miny"]) | (a["maxy"] == b["maxy"])) & x_over)
    strictly = lambda p, q: (p["minx"] > q["minx"]) & (p["maxx"] < q["maxx"]) & (p["miny"] > q["miny"]) & (p["maxy"] < q["maxy"])
    crossing = lambda p, q: ((p["minx"] > q["minx"]) & (p["minx"] < q["maxx"])) | ((p["maxx"] > q["minx"]) & (p["maxx"] < q["maxx"])) | ((p["miny"] > q["miny"]) & (p["miny"] < q["maxy"])) | ((p["maxy"] > q["miny"]) & (p["maxy"] < q["maxy"]))
    bb = F.when(side, "1").when(strictly(a, b) | strictly(b, a), "F").otherwise("0")
    ib, bi = F.when(crossing(b, a), "1").otherwise("F"), F.when(crossing(a, b), "1").otherwise("F")
    inside = F.concat(F.lit("2"), ib, F.when(a_in, "F").otherwise("2"), bi, bb, F.when(a_in, "F").otherwise("1"), F.when(b_in, "F").otherwise("2"), F.when(b_in, "F").otherwise("1"), F.lit("2"))
    touch = F.when(corner, "FF2F01212").otherwise("FF2F11212")
    return F.when(~meet, "FF2FF1212").when(eq, "2FFF1FFF2").when(inner, inside).otherwise(touch)
