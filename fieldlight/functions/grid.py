"""Grid, tile and distance arithmetic as column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8


def index_of(x: Column, size: float) -> Column:
    """Floor index of a cell (floor, not integer division: it holds below zero)."""
    return F.floor(x / size).cast("long")


def centre_of(i: Column, size: float) -> Column:
    return (i + 0.5) * size


def lattice_bounds(low: Column, high: Column, size: float) -> tuple[Column, Column]:
    """First and last index of cells whose centre lies in [low, high]."""
    return F.ceil(low / size - 0.5).cast("long"), F.floor(high / size - 0.5).cast("long")


def block_id(prefix: Column, x: Column, y: Column, size: float) -> Column:
    return F.concat(prefix, F.lit("-"), index_of(x, size), F.lit("-"), index_of(y, size))


def tile3_id(lon: Column, lat: Column) -> Column:
    """Three-degree tile by its south-west corner; a point on a top edge belongs to the tile below."""
    south, west = (F.ceil(lat / 3) * 3 - 3).cast("int"), (F.floor(lon / 3) * 3).cast("int")
    ns = F.when(south < 0, "S").otherwise("N")
    ew = F.when(west < 0, "W").otherwise("E")
    return F.concat(ns, F.lpad(F.abs(south).cast("string"), 2, "0"), ew, F.lpad(F.abs(west).cast("string"), 3, "0"))


def tile3_bounds(tile: Column) -> list[Column]:
    south = F.substring(tile, 2, 2).cast("int") * F.when(F.substring(tile, 1, 1) == "S", -1).otherwise(1)
    west = F.substring(tile, 5, 3).cast("int") * F.when(F.substring(tile, 4, 1) == "W", -1).otherwise(1)
    return [west.alias("west"), south.alias("south"), (west + 3).alias("east"), (south + 3).alias("north")]


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """Zone code; null outside 80 S to 84 N. 180 E falls in zone 60."""
    zone = F.floor((F.least(lon, F.lit(179.999999999)) + 180) / 6).cast("int") + 1
    return F.when((lat >= -80) & (lat <= 84), F.when(lat >= 0, 32600).otherwise(32700) + zone)


_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4, 13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4, 61 / 240 * _N**3 - 103 / 140 * _N**4, 49561 / 161280 * _N**4)
_BETA = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 / 1440 * _N**4, 17 / 480 * _N**3 - 37 / 840 * _N**4, 4397 / 161280 * _N**4)
_DELTA = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4, 7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4, 56 / 15 * _N**3 - 136 / 35 * _N**4, 4279 / 630 * _N**4)
_E = math.sqrt(_F * (2 - _F))


def to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series of the transverse Mercator projection."""
    zone = F.pmod(epsg, F.lit(100))
    lam = F.radians(lon - (zone * 6 - 183))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = F.when(epsg >= 32700, 1e7).otherwise(0.0)
    return 500000.0 + 0.9996 * _R * x, south + 0.9996 * _R * y


def from_utm(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude; the inverse series of the same projection."""
    south = F.when(epsg >= 32700, 1e7).otherwise(0.0)
    xi, eta = (y - south) / (0.9996 * _R), (x - 500000.0) / (0.9996 * _R)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    zone = F.pmod(epsg, F.lit(100))
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (zone * 6 - 183), F.degrees(lat)


def snap_centre(x: Column, y: Column, size: float = 10.0) -> tuple[Column, Column]:
    """Centre of the cell of a point; an exact edge goes east and south."""
    return F.floor(F.bround(x, 3) / size) * size + size / 2, F.ceil(F.bround(y, 3) / size) * size - size / 2


def pixel_id(epsg: Column, x: Column, y: Column, size: int = 10) -> Column:
    return F.concat(F.lit("utm-"), epsg, F.lit(f"-{size}m-"), x, F.lit("-"), y)


def chunk_local(x: Column, y: Column, cells: int = 256) -> list[Column]:
    """Chunk indices and top-down row and column inside the chunk."""
    cx, cy = F.floor(x / cells).cast("long"), F.floor(y / cells).cast("long")
    return [cx.alias("chunk_x"), cy.alias("chunk_y"), (cells - 1 - (y - cy * cells)).cast("long").alias("local_row"), (x - cx * cells).cast("long").alias("local_col")]


def antimeridian_parts(west: Column, south: Column, east: Column, north: Column) -> Column:
    """One box, or two where west is beyond east."""
    box = lambda w, e: F.struct(w.alias("west"), south.alias("south"), e.alias("east"), north.alias("north"))
    return F.when(west > east, F.array(box(west, F.lit(180.0)), box(F.lit(-180.0), east))).otherwise(F.array(box(west, east)))
