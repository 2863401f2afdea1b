"""Records of one ESRI shapefile: WKT of its shapes with a field of its attribute table."""

from __future__ import annotations

import struct

from ..functions import geometry as G


def _fields(dbf: bytes) -> tuple[list[tuple[str, int, int]], int, int, int]:
    count, head, size = struct.unpack_from("<IHH", dbf, 4)
    out, at, place = [], 32, 1
    while at < head - 1 and dbf[at] != 0x0D:
        name = dbf[at : at + 11].split(b"\0")[0].decode("latin-1")
        out.append((name, place, dbf[at + 16]))
        place += dbf[at + 16]
        at += 32
    return out, count, head, size


def _signed(ring: list) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring[:-1], ring[1:], strict=True))


def _shape(body: bytes) -> G.Geometry | None:
    (kind,) = struct.unpack_from("<i", body, 0)
    base = kind % 10
    if base == 1:
        return "POINT", [struct.unpack_from("<2d", body, 4)]
    if base == 8:
        (n,) = struct.unpack_from("<i", body, 36)
        return "MULTIPOINT", [struct.unpack_from("<2d", body, 40 + 16 * i) for i in range(n)]
    if base not in (3, 5):
        return None
    parts, n = struct.unpack_from("<2i", body, 36)
    starts = [*struct.unpack_from(f"<{parts}i", body, 44), n]
    at = 44 + 4 * parts
    lines = [[struct.unpack_from("<2d", body, at + 16 * i) for i in range(a, b)] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    if base == 3:
        return ("LINESTRING", lines) if len(lines) == 1 else ("MULTILINESTRING", lines)
    polygons: list[list] = []
    for ring in lines:  # outer rings run clockwise, holes follow theirs
        if _signed(ring) < 0 or not polygons:
            polygons.append([ring])
        else:
            polygons[-1].append(ring)
    return ("POLYGON", polygons) if len(polygons) == 1 else ("MULTIPOLYGON", polygons)


def records(shp: bytes, dbf: bytes, field: str) -> list[dict]:
    fields, count, head, size = _fields(dbf)
    place = next(((p, n) for name, p, n in fields if name.lower() == field.lower()), None)
    out, at, i = [], 100, 0
    while at + 8 <= len(shp) and i < count:
        words = struct.unpack_from(">2i", shp, at)[1]
        g = _shape(shp[at + 8 : at + 8 + 2 * words])
        row = dbf[head + i * size : head + (i + 1) * size]
        value = row[place[0] : place[0] + place[1]].decode("utf-8", "replace").strip() if place else str(i)
        if g is not None and row[:1] != b"*":
            out.append({"id": value, "wkt": G.to_wkt(g)})
        at += 8 + 2 * words
        i += 1
    return out


def encoded(polygons: list[tuple[str, list]]) -> tuple[bytes, bytes]:
    """A shapefile and its attribute table (field ID) of (id, rings) polygons; outer rings are turned clockwise, holes the other way."""
    shapes, width = [], max([len(i) for i, _ in polygons], default=1)
    for _, rings in polygons:
        rings = [r if (_signed(r) < 0) == (k == 0) else r[::-1] for k, r in enumerate(rings)]
        points = [p for r in rings for p in r]
        xs, ys = zip(*points, strict=True)
        starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
        shapes.append(struct.pack(f"<i4d2i{len(rings)}i", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(points), *starts) + b"".join(struct.pack("<2d", *p) for p in points))
    body = b"".join(struct.pack(">2i", i + 1, len(x) // 2) + x for i, x in enumerate(shapes))
    shp = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8) + body
    dbf = struct.pack("<4BIHH20x", 3, 24, 1, 1, len(polygons), 65, 1 + width) + struct.pack("<11sc4xBB14x", b"ID", b"C", width, 0) + b"\r"
    return shp, dbf + b"".join(b" " + i.ljust(width).encode("latin-1") for i, _ in polygons) + b"\x1a"
