"""Geometries as nested columns: polygon -> ring -> vertex, with a type and an SRID.

Everything here maps Column to Column and stays inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WGS84, STATE_PLANE = 4326, 2263
POLYS = "array<array<array<struct<x:double,y:double>>>>"
GEOM = f"struct<type:string,srid:int,polys:{POLYS}>"

# GRS 80 and the zone's parameters (Lambert conformal conic, two standard parallels).
_A, _F = 6378137.0, 1 / 298.257222101
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)
_LAT0, _LON0 = math.radians(40 + 10 / 60), math.radians(-74.0)
_LAT1, _LAT2 = math.radians(41 + 2 / 60), math.radians(40 + 40 / 60)
_FALSE_EAST, _FOOT = 300000.0, 1200 / 3937


def _m(lat: float) -> float:
    return math.cos(lat) / math.sqrt(1 - _E2 * math.sin(lat) ** 2)


def _t(lat: float) -> float:
    s = _E * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (_E / 2)


CONE = (math.log(_m(_LAT1)) - math.log(_m(_LAT2))) / (math.log(_t(_LAT1)) - math.log(_t(_LAT2)))
SCALE = _A * _m(_LAT1) / (CONE * _t(_LAT1) ** CONE)
RHO0 = SCALE * _t(_LAT0) ** CONE
ECCENTRICITY, LON0, FALSE_EAST, FOOT = _E, _LON0, _FALSE_EAST, _FOOT


def geom(kind: Column, srid: Column, polys: Column) -> Column:
    return F.struct(kind.alias("type"), srid.cast("int").alias("srid"), polys.alias("polys"))


def map_vertices(polys: Column, vertex) -> Column:
    """``polys`` with ``vertex(x, y) -> struct<x,y>`` applied to every vertex."""
    return F.transform(polys, lambda rings: F.transform(rings, lambda ring: F.transform(ring, lambda v: vertex(v["x"], v["y"]))))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def wkt_to_geom(wkt: Column, srid: int = STATE_PLANE) -> Column:
    """POLYGON and MULTIPOLYGON text; null for anything malformed, other types, Z
    coordinates, open rings and rings of fewer than four vertices."""
    number = r"([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)"

    def split(text: Column) -> Column:
        body = F.regexp_extract(text, r"(?is)^\s*(?:MULTIPOLYGON|POLYGON)\s*(\(.*\))\s*$", 1)
        json = F.translate(F.regexp_replace(body, number + r"\s+" + number, "[$1,$2]"), "()", "[]")
        return F.struct(
            F.upper(F.regexp_extract(text, r"(?i)^\s*(MULTIPOLYGON|POLYGON)\b", 1)).alias("kind"),
            json.alias("json"),
            F.upper(text).rlike(r"^\s*(MULTI)?POLYGON\s+EMPTY\s*$").alias("empty"),
        )

    def nest(s: Column) -> Column:
        json = F.when(s["kind"] == "POLYGON", F.concat(F.lit("["), s["json"], F.lit("]"))).otherwise(s["json"])
        kind = F.when(s["kind"] == "POLYGON", "Polygon").when(s["kind"] == "MULTIPOLYGON", "MultiPolygon")
        return F.struct(kind.alias("kind"), s["empty"].alias("empty"), F.from_json(json, "array<array<array<array<double>>>>").alias("p"))

    pair = lambda v: (F.size(v) == 2) & F.get(v, 0).isNotNull() & F.get(v, 1).isNotNull()
    closed = lambda r: (F.size(r) >= 4) & F.forall(r, pair) & (F.get(r, 0) == F.get(r, F.size(r) - 1))

    def build(s: Column) -> Column:
        good = s["kind"].isNotNull() & (F.size(s["p"]) > 0) & F.forall(s["p"], lambda rings: (F.size(rings) > 0) & F.forall(rings, closed))
        polys = F.transform(s["p"], lambda rings: F.transform(rings, lambda r: F.transform(r, lambda v: F.struct(F.get(v, 0).alias("x"), F.get(v, 1).alias("y")))))
        polys = F.when(s["empty"], F.array().cast(POLYS)).when(F.coalesce(good, F.lit(False)), polys)
        return F.when(polys.isNotNull(), geom(s["kind"], F.lit(srid), polys))

    return _let(wkt, lambda text: _let(split(text), lambda s: _let(nest(s), build)))


def geom_to_wkt(g: Column) -> Column:
    vertex = lambda v: F.concat_ws(" ", v["x"].cast("string"), v["y"].cast("string"))
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, vertex), ", "), F.lit(")"))
    poly = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")"))

    def text(h: Column) -> Column:
        kind, parts = F.upper(h["type"]), F.array_join(F.transform(h["polys"], poly), ", ")
        return F.when(F.size(h["polys"]) == 0, F.concat(kind, F.lit(" EMPTY"))).when(kind == "POLYGON", F.concat(kind, F.lit(" "), parts)).otherwise(F.concat(kind, F.lit(" ("), parts, F.lit(")")))

    return _let(g, text)


def geom_to_geojson(g: Column) -> Column:
    """The GeoJSON text of a geometry; a Polygon loses the outer level."""
    ring = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, lambda v: F.concat(F.lit("["), v["x"].cast("string"), F.lit(","), v["y"].cast("string"), F.lit("]"))), ","), F.lit("]"))
    poly = lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, ring), ","), F.lit("]"))

    def text(h: Column) -> Column:
        polys = F.transform(h["polys"], poly)
        coords = F.when(h["type"] == "Polygon", F.coalesce(F.get(polys, 0), F.lit("[]"))).otherwise(F.concat(F.lit("["), F.array_join(polys, ","), F.lit("]")))
        return F.when(h.isNotNull(), F.concat(F.lit('{"type":"'), h["type"], F.lit('","coordinates":'), coords, F.lit("}")))

    return _let(g, text)


def geojson_to_geom(kind: Column, coordinates: Column, srid: int = WGS84) -> Column:
    """From the text of ``coordinates``, whose depth follows the type."""

    def build(s: Column) -> Column:
        some = F.filter(s["p"], lambda rings: F.size(rings) > 0)  # an empty Polygon has no ring
        polys = F.transform(some, lambda rings: F.transform(rings, lambda r: F.transform(r, lambda v: F.struct(F.get(v, 0).alias("x"), F.get(v, 1).alias("y")))))
        return F.when(polys.isNotNull(), geom(s["kind"], F.lit(srid), polys))

    json = F.when(kind == "Polygon", F.concat(F.lit("["), coordinates, F.lit("]"))).when(kind == "MultiPolygon", coordinates)
    return _let(F.struct(kind.alias("kind"), F.from_json(json, "array<array<array<array<double>>>>").alias("p")), build)


def _t_of(lat: Column) -> Column:
    s = F.sin(lat) * _E
    return F.tan(math.pi / 4 - lat / 2) / F.pow(2 / (1 + s) - 1, F.lit(_E / 2))


def project_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees to feet east and north."""
    rho = F.pow(_t_of(F.radians(lat)), F.lit(CONE)) * SCALE
    theta = (F.radians(lon) - _LON0) * CONE
    return (rho * F.sin(theta) + _FALSE_EAST) / _FOOT, (RHO0 - rho * F.cos(theta)) / _FOOT


def _projected(lon: Column, lat: Column) -> Column:
    rho = F.pow(_t_of(F.radians(lat)), F.lit(CONE)) * SCALE
    theta = (F.radians(lon) - _LON0) * CONE
    at = lambda s: F.struct(((s["rho"] * F.sin(s["theta"]) + _FALSE_EAST) / _FOOT).alias("x"), ((RHO0 - s["rho"] * F.cos(s["theta"])) / _FOOT).alias("y"))
    return _let(F.struct(rho.alias("rho"), theta.alias("theta")), at)


def _unprojected(x: Column, y: Column) -> Column:
    """Feet to degrees (longitude, latitude), by six fixed-point steps; what the steps
    share is computed once per vertex."""

    def degrees(s: Column, t: Column) -> Column:
        lat = math.pi / 2 - 2 * F.atan(t)
        for _ in range(6):
            lat = math.pi / 2 - 2 * F.atan(t * F.pow(2 / (1 + F.sin(lat) * _E) - 1, F.lit(_E / 2)))
        return F.struct(F.degrees(F.atan2(s["east"], s["north"]) / CONE + _LON0).alias("x"), F.degrees(lat).alias("y"))

    def steps(s: Column) -> Column:
        t = F.pow(F.sqrt(s["east"] * s["east"] + s["north"] * s["north"]) / SCALE, F.lit(1 / CONE))
        return _let(t, lambda t: degrees(s, t))

    return _let(F.struct((x * _FOOT - _FALSE_EAST).alias("east"), (RHO0 - y * _FOOT).alias("north")), steps)


def _moved(g: Column, source: int, target: int, vertex) -> Column:

    def move(h: Column) -> Column:
        there = geom(h["type"], F.lit(target), map_vertices(h["polys"], vertex))
        wrong = F.raise_error(F.concat(F.lit(f"expected SRID {source} or {target}, found "), F.coalesce(h["srid"].cast("string"), F.lit("none"))))
        return F.when(h.isNull(), F.lit(None).cast(GEOM)).when(h["srid"] == target, h).when(h["srid"] == source, there).otherwise(wrong.cast(GEOM))

    return _let(g, move)


def project(g: Column) -> Column:
    """4326 to 2263; a geometry that is there already stays, another SRID raises."""
    return _moved(g, WGS84, STATE_PLANE, _projected)


def unproject(g: Column) -> Column:
    """2263 to 4326, with the same rules."""
    return _moved(g, STATE_PLANE, WGS84, _unprojected)


def circle(x: Column, y: Column, r: Column, segments: int) -> Column:
    """A closed ring of ``segments`` + 1 vertices from the angle 0 on."""
    angle = lambda k: k * (2 * math.pi / segments)
    vertex = lambda k: F.struct((x + r * F.cos(angle(k % segments))).alias("x"), (y + r * F.sin(angle(k % segments))).alias("y"))
    return F.transform(F.sequence(F.lit(0), F.lit(segments)), vertex)


def buffer_point(x: Column, y: Column, r: Column, quad_segs: int = 16, srid: int = STATE_PLANE) -> Column:
    """The polygon around a point; empty unless the radius is above 1e-9."""
    ring = F.array(F.array(circle(x, y, r, 4 * quad_segs)))
    return geom(F.lit("Polygon"), F.lit(srid), F.when(r > 1e-9, ring).otherwise(F.array().cast(POLYS)))


def inside(x: Column, y: Column, polys: Column) -> Column:
    """Even-odd ray cast over all rings, so holes count as outside."""

    def crossings(ring: Column) -> Column:
        def step(n: Column, k: Column) -> Column:
            a, b = F.get(ring, k), F.get(ring, k + 1)
            spans = (a["y"] > y) != (b["y"] > y)
            left = x < F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
            return n + F.when(spans & left, 1).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0), step)

    total = F.aggregate(polys, F.lit(0), lambda n, rings: F.aggregate(rings, n, lambda m, ring: m + crossings(ring)))
    return total % 2 == 1


def bounds(polys: Column) -> Column:
    """``struct<x0,x1,y0,y1>`` of all vertices; nulls for an empty geometry."""
    flat = F.flatten(F.flatten(polys))
    xs, ys = F.transform(flat, lambda v: v["x"]), F.transform(flat, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
