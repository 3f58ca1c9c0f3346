"""Bounding caps of tiles in arrays, for tests of many (cone, tile) pairs: the numbers that algebra.cap_of gives by column expressions."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import FACE_P, FACE_R

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not have this package

TABLE = 5  # levels of up to 12 * 4**5 tiles are looked up, finer ones computed for each pair
STEP = 4  # levels at a time: at most 4**STEP tiles below one
ROWS = 2048  # whose tiles are in memory at a time
TILES = "array<struct<order: int, x: long, y: long>>"


def _vectors(face: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Unit vectors (3, n) of places on faces, as geometry.point_vector gives them."""
    r, p = np.array(FACE_R, float)[face], np.array(FACE_P, float)[face]
    ring, raw = np.clip(r - u - v, 1e-6, 4 - 1e-6), p - u + v
    turn = np.fmod(np.fmod(raw, 8.0) + 8.0, 8.0)
    near = raw - turn + 2 * np.floor(turn / 2) + 1
    z = np.where(ring <= 1, 1 - ring * ring / 3, np.where(ring <= 3, 2 * (2 - ring) / 3, -1 + (4 - ring) * (4 - ring) / 3))
    a = np.where(ring < 1, near + (raw - near) / ring, np.where(ring > 3, near + (raw - near) / (4 - ring), raw)) * (np.pi / 4)
    flat = np.sqrt(np.maximum(0.0, 1 - z * z))
    return np.stack([flat * np.cos(a), z, flat * np.sin(a)])


def caps(face: np.ndarray, x: np.ndarray, y: np.ndarray, level: int, scale: float = 1.12) -> np.ndarray:
    """(4, n): centre and angular radius of the caps of tiles of one level (2**level on a face's side)."""
    side = 2.0**level
    u0, v0, u1, v1 = x / side, y / side, (x + 1) / side, (y + 1) / side
    centre = _vectors(face, (u0 + u1) / 2, (v0 + v1) / 2)
    gap = np.max([np.square(_vectors(face, u, v) - centre).sum(0) for u, v in ((u0, v0), (u1, v0), (u1, v1), (u0, v1))], axis=0)
    return np.vstack([centre, np.arcsin(np.minimum(1.0, np.sqrt(gap) * scale))])


_tables: dict[int, np.ndarray] = {}


def _table(level: int) -> np.ndarray:
    if level not in _tables:
        face, y, x = np.indices((12, 1 << level, 1 << level)).reshape(3, -1)
        _tables[level] = caps(face, x, y, level)
    return _tables[level]


def tiles_below(level: int, levels: int, cone: Column, reach: float, last: float | None = None, target: int | None = None) -> Column:
    """array<struct<order, x, y>>: the tiles `levels` below the row's tile (face, x, y of `level`; order counts from level 0) that
    its cone (vx, vy, vz and half angle `cone`) comes to. A tile goes on to its four children while its cap, `reach` times as
    wide, meets the cone; those of the last level are kept if their cap, `last` times as wide, does (None: all). With a `target`
    the result has several levels: a tile that does not go on is kept, and `cone` is the angle at that level, doubled for each
    level that a tile's children are above it, pi at most.

    A null direction or angle meets no tile; NaN counts as it does in column expressions, as larger than any number.
    """

    @F.arrow_udf(TILES)
    def below(vx: pa.Array, vy: pa.Array, vz: pa.Array, cone: pa.Array, face: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        given = _given(vx, vy, vz, cone)
        tiles = [a.to_numpy(zero_copy_only=False).astype(np.int64) for a in (face, x, y)]
        parts = [_descend(slice(a, a + ROWS), given, tiles, level, levels, reach, last, target) for a in range(0, len(vx), ROWS)]
        return _lists(np.concatenate(parts, axis=1), len(vx))

    return below(*[F.col(c).cast("double") for c in ("vx", "vy", "vz")], cone.cast("double"), "face", "x", "y")


def _given(*columns: pa.Array) -> np.ndarray:
    """(5, n): vx, vy, vz, cone, and 1 where none of them is null."""
    known = np.logical_and.reduce([a.is_valid().to_numpy(zero_copy_only=False) for a in columns])
    return np.vstack([*[a.to_numpy(zero_copy_only=False) for a in columns], known])


def _meet(level: int, given: np.ndarray, face: np.ndarray, x: np.ndarray, y: np.ndarray, reach: float, target: int | None = None) -> np.ndarray:
    cx, cy, cz, cap = _table(level)[:, (face << level | y) << level | x] if level <= TABLE else caps(face, x, y, level)
    vx, vy, vz, cone, known = given
    cone = cone if target is None else np.fmin(np.pi, cone * 2.0 ** (target - level - 1))
    angle = np.arccos(np.fmin(1.0, np.maximum(-1.0, cx * vx + cy * vy + cz * vz)))
    return (known > 0) & ~(angle - cap * reach > cone)


def _descend(rows: slice, given: np.ndarray, tiles: list[np.ndarray], level: int, levels: int, reach: float, last: float | None, target: int | None) -> np.ndarray:
    """(4, n): row, order, x, y of what is found for some rows, by rows."""
    face, x, y = (t[rows] for t in tiles)
    row, done = np.arange(rows.start, rows.start + len(face)), []
    for at in range(level, level + levels):
        met = _meet(at, given[:, row], face, x, y, reach, target)
        if target is not None:
            done.append(np.stack([row, np.full(len(row), at), x, y])[:, ~met])
        on = np.flatnonzero(met)
        row, face = row[on].repeat(4), face[on].repeat(4)
        x, y = x[on].repeat(4) * 2 + np.tile([0, 1, 0, 1], len(on)), y[on].repeat(4) * 2 + np.tile([0, 0, 1, 1], len(on))
    found = np.stack([row, np.full(len(row), level + levels), x, y])
    if last is not None:
        found = found[:, _meet(level + levels, given[:, row], face, x, y, last)]
    found = np.concatenate([*done, found], axis=1)
    return found[:, np.argsort(found[0], kind="stable")] if done else found


def _lists(found: np.ndarray, n: int) -> pa.Array:
    row, order, x, y = found
    ends = np.append(0, np.cumsum(np.bincount(row, minlength=n))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(order.astype(np.int32)), pa.array(x), pa.array(y)], ["order", "x", "y"]))
