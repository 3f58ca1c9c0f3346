"""Column expressions for positions on the sphere (y points north) and on the unfolded net."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import as_column

# fixed values: row and column of each base face on the unfolded net
FACE_R = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
FACE_P = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)


def face_value(face, table: tuple[int, ...]) -> Column:
    """The face's entry of a table, null for a face out of range."""
    return F.get(F.array(*[F.lit(float(v)) for v in table]), as_column(face).cast("int"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often `use` names it and wherever a filter is pushed."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _named(**c: Column) -> Column:
    return F.struct(*[x.alias(n) for n, x in c.items()])


def points_of(places: Column) -> Column:
    """array<struct<z, phi>>: sine of latitude and eighths of a turn of an array of struct<r, p, u, v> (net row and column of
    the face, place in it)."""
    ringed = F.transform(places, lambda s: _named(ring=F.least(F.greatest(s["r"] - s["u"] - s["v"], F.lit(1e-6)), F.lit(4 - 1e-6)), raw=s["p"] - s["u"] + s["v"]))
    nearby = F.transform(ringed, lambda s: _named(ring=s["ring"], raw=s["raw"], near=_near(s["raw"])))
    return F.transform(nearby, lambda s: _named(z=_height(s["ring"]), phi=_turn(s["ring"], s["raw"], s["near"])))


def vectors_of(places: Column) -> Column:
    """array<struct<x, y, z>>: unit vectors of such an array."""
    return F.transform(points_of(places), lambda s: _named(**dict(zip("xyz", point_vector(s["z"], s["phi"]), strict=True))))


def _near(raw: Column) -> Column:
    """The odd eighth of a turn in the middle of the quarter that holds `raw`."""
    return raw - F.pmod(raw, F.lit(8.0)) + 2 * F.floor(F.pmod(raw, F.lit(8.0)) / 2) + 1


def _height(ring: Column) -> Column:
    return F.when(ring <= 1, 1 - ring * ring / 3).when(ring <= 3, 2 * (2 - ring) / 3).otherwise(-1 + (4 - ring) * (4 - ring) / 3)


def _turn(ring: Column, raw: Column, near: Column) -> Column:
    return F.when(ring < 1, near + (raw - near) / ring).when(ring > 3, near + (raw - near) / (4 - ring)).otherwise(raw)


def with_points(df: DataFrame, places: dict[str, tuple]) -> DataFrame:
    """Adds <name>_z (sine of latitude) and <name>_phi (eighths of a turn) for places (face, u, v).

    Each step names the columns of the one before, so that expressions stay small.
    """
    steps: dict[str, Column] = {}
    for name, (face, u, v) in places.items():
        u, v = as_column(u).cast("double"), as_column(v).cast("double")
        # kept away from the poles, where the longitude is undefined
        steps[f"{name}_ring"] = F.least(F.greatest(face_value(face, FACE_R) - u - v, F.lit(1e-6)), F.lit(4 - 1e-6))
        steps[f"{name}_raw"] = face_value(face, FACE_P) - u + v
    df = df.withColumns(steps)
    df = df.withColumns({f"{n}_near": _near(F.col(f"{n}_raw")) for n in places})
    steps = {}
    for name in places:
        ring, raw, near = (F.col(f"{name}_{c}") for c in ("ring", "raw", "near"))
        steps[f"{name}_z"] = _height(ring)
        steps[f"{name}_phi"] = _turn(ring, raw, near)
    return df.withColumns(steps).drop(*[f"{n}_{c}" for n in places for c in ("ring", "raw", "near")])


def with_vectors(df: DataFrame, places: dict[str, tuple]) -> DataFrame:
    """Adds the unit vectors <name>_vx, _vy, _vz of places (face, u, v)."""
    df = with_points(df, places)
    df = df.withColumns({f"{n}_v{c}": x for n in places for c, x in zip("xyz", point_vector(F.col(f"{n}_z"), F.col(f"{n}_phi")), strict=True)})
    return df.drop(*[f"{n}_{c}" for n in places for c in ("z", "phi")])


def lonlat_of(z: Column, phi: Column) -> tuple[Column, Column]:
    """Longitude in (-180, 180] and latitude, in degrees."""
    a = phi * (pi / 4)
    return F.degrees(F.atan2(F.sin(a), F.cos(a))), F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), z))))


def vector(lon, lat) -> tuple[Column, Column, Column]:
    lon, lat = F.radians(as_column(lon)), F.radians(as_column(lat))
    return F.cos(lat) * F.cos(lon), F.sin(lat), F.cos(lat) * F.sin(lon)


def point_vector(z: Column, phi: Column) -> tuple[Column, Column, Column]:
    a = phi * (pi / 4)
    flat = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    return flat * F.cos(a), z, flat * F.sin(a)


def angle(a: tuple, b: tuple) -> Column:
    """Between two unit vectors, in radians."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))


def ring_and_raw(t: Column, z: Column) -> tuple[Column, Column]:
    """Ring and net abscissa of a longitude (t, in 45 degrees, 0 to 8) and a sine of latitude."""
    cap = F.sqrt(F.greatest(F.lit(0.0), 3 * (1 - F.abs(z))))
    belt = F.abs(z) <= 2.0 / 3
    near = 2 * F.floor(t / 2) + 1
    return F.when(belt, 2 - 1.5 * z).when(z > 0, cap).otherwise(4 - cap), F.when(belt, t).otherwise(near + (t - near) * cap)


def face_uv(ring: Column, raw: Column) -> Column:
    """struct<face, u, v>: the face whose unit square holds the place, in closed form."""
    tries = []
    for face in range(12):
        for turn in (-8, 0, 8):
            u = (FACE_R[face] - ring - raw - turn + FACE_P[face]) / 2
            v = (FACE_R[face] - ring + raw + turn - FACE_P[face]) / 2
            tries.append(F.when((u >= 0) & (u < 1) & (v >= 0) & (v < 1), F.struct(F.lit(face).alias("face"), u.alias("u"), v.alias("v"))))
    return F.coalesce(*tries)
