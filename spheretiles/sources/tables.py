"""Readers of the table layouts: flat, block, face-grid and ring maps, particles, cubes, rasters. Checks are one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.geometry import FACE_P, FACE_R, face_value


def order_of(count: int) -> int:
    """The order whose 12 * 4**order cells a full map of `count` rows has."""
    order = (max(1, count // 12).bit_length() - 1) // 2
    if count != 12 * 4**order:
        raise ValueError(f"{count} rows are no full map: 12 * 4**order is needed")
    return order


def read_flat_map(df: DataFrame, cell: str = "cell", value: str = "value") -> tuple[DataFrame, int]:
    """(cell, value) and the order, found from the number of rows; cells must lie in range."""
    n, low, high = df.agg(F.count("*"), F.min(cell), F.max(cell)).first()
    order = order_of(n)
    if low < 0 or high >= n:
        raise ValueError("cell ids outside the map")
    return df.select(F.col(cell).cast("long").alias("cell"), F.col(value).cast("float").alias("value")), order


def read_block_map(df: DataFrame) -> tuple[DataFrame, int]:
    """(block, values[]) as (cell, value), and the order. 12 * 4**k blocks of equal power-of-four length are needed."""
    n, short, long, low, high = df.agg(F.count("*"), F.min(F.size("values")), F.max(F.size("values")), F.min("block"), F.max("block")).first()
    block_order, each = order_of(n), long
    inner = (each.bit_length() - 1) // 2
    if short != long or 4**inner != each or low < 0 or high >= n:
        raise ValueError("blocks must be numbered 0 .. n-1 and hold 4**k values each")
    out = df.select("block", F.posexplode("values").alias("at", "value"))
    return out.select((F.col("block").cast("long") * each + F.col("at")).alias("cell"), F.col("value").cast("float").alias("value")), block_order + inner


def read_face_grid(df: DataFrame, axes: str = "even_x") -> tuple[DataFrame, int]:
    """(face, iy, values[]) as (cell, value), and the order. Twelve square faces are needed."""
    n, faces, short, long = df.agg(F.count("*"), F.countDistinct("face"), F.min(F.size("values")), F.max(F.size("values"))).first()
    order = long.bit_length() - 1
    if faces != 12 or short != long or 1 << order != long or n != 12 * long:
        raise ValueError("twelve faces of n rows with n values are needed, n a power of two")
    out = df.select("face", F.col("iy").cast("long").alias("iy"), F.posexplode("values").alias("ix", "value"))
    return out.select(C.nested_id("face", F.col("ix").cast("long"), F.col("iy"), order, axes).alias("cell"), F.col("value").cast("float").alias("value")), order


def ring_ids(df: DataFrame, order: int, cell: str = "cell", axes: str = "odd_x") -> DataFrame:
    """Adds the RING id of each NESTED cell (published formula, in longs)."""
    n = 1 << order
    even, odd = C.cell_xy(cell, order, "even_x")
    # the formula wants x in the even bits; with axes="even_x" the mirrored convention is asked for
    ix, iy = (even, odd) if axes == "odd_x" else (odd, even)
    df = df.withColumns({"__f": C.face_of(cell, order), "__x": ix, "__y": iy})
    df = df.withColumn("__jr", face_value("__f", FACE_R).cast("long") * n - F.col("__x") - F.col("__y") - 1)
    jr = F.col("__jr")
    north, south = jr < n, jr > 3 * n
    df = df.withColumn("__nr", F.when(north, jr).when(south, 4 * n - jr).otherwise(F.lit(n)).cast("long"))
    nr = F.col("__nr")
    before = F.when(north, 2 * nr * (nr - 1)).when(south, 12 * n * n - 2 * nr * (nr + 1)).otherwise(2 * n * (n - 1) + 4 * n * (jr - n))
    shift = F.when(north | south, F.lit(0)).otherwise((jr - n).bitwiseAND(F.lit(1).cast("long")))
    jp = F.floor((face_value("__f", FACE_P).cast("long") * nr + F.col("__x") - F.col("__y") + 1 + shift) / 2)
    df = df.withColumns({"__before": before.cast("long"), "__jp": jp.cast("long")})
    jp = F.col("__jp")
    jp = F.when(jp > 4 * n, jp - 4 * n).when(jp < 1, jp + 4 * n).otherwise(jp)
    return df.withColumn("ring", F.col("__before") + jp - 1).drop("__f", "__x", "__y", "__jr", "__nr", "__before", "__jp")


def read_ring_map(df: DataFrame, ring: str = "ring", value: str = "value") -> tuple[DataFrame, int]:
    """A RING-ordered map as (cell, value), and the order: nested ids get their ring id and meet the map in an equi join."""
    order = order_of(df.count())
    nested = ring_ids(df.sparkSession.range(12 * 4**order).withColumnRenamed("id", "cell"), order)
    return nested.join(df.select(F.col(ring).cast("long").alias("ring"), F.col(value).cast("float").alias("value")), "ring").select("cell", "value"), order


def read_particles(df: DataFrame, order: int, cell: str = "cell", value: str | None = "value") -> DataFrame:
    """Particles in range with finite value. The range test reaches the Parquet scan."""
    df = df.where((F.col(cell) >= 0) & (F.col(cell) < 12 * 4**order))
    if value is None:
        return df.select(F.col(cell).cast("long").alias("cell"))
    v = F.col(value).cast("float")
    return df.select(F.col(cell).cast("long").alias("cell"), v.alias("value")).where(finite("value"))


def finite(value):
    v = F.col(value) if isinstance(value, str) else value
    return ~F.isnan(v) & (F.abs(v) < float("inf"))


def not_nan(value):
    v = F.col(value) if isinstance(value, str) else value
    return v.isNotNull() & ~F.isnan(v)


def read_cube_slice(cube: DataFrame, picks: dict[str, int], axes: tuple[str, ...] = ("time", "level")) -> DataFrame:
    """One index on each axis of `axes`, by name (case and underscores aside) or number; negative ones count from the end.

    Partition columns prune files; the axis length is looked up (max + 1) only for a negative index.
    """
    plain = lambda s: str(s).lower().replace("_", "").replace("-", "").replace(" ", "")
    chosen: dict[str, int] = {}
    for given, index in picks.items():
        name = axes[int(given)] if str(given).isdigit() and int(given) < len(axes) else next((a for a in axes if plain(a) == plain(given)), None)
        if name is None:
            raise ValueError(f"no axis {given!r}")
        if name in chosen:
            raise ValueError(f"axis {name} is chosen twice")
        chosen[name] = int(index)
    if missing := [a for a in axes if a not in chosen]:
        raise ValueError(f"no index for {', '.join(missing)}")
    out = cube
    for name, index in chosen.items():
        if index < 0:
            index += cube.agg(F.max(name)).first()[0] + 1
        out = out.where(F.col(name) == index)
    return out.drop(*axes)


def read_raster(df: DataFrame, nodata: float | None) -> tuple[DataFrame, dict]:
    """(row, col, value) with nodata as NaN; width, height and the registration they imply (gridline: width = 2 height - 1)."""
    height, width = df.agg(F.max("row") + 1, F.max("col") + 1).first()
    v = F.col("value").cast("float")
    value = v if nodata is None else F.when(v == F.lit(nodata).cast("float"), F.lit(float("nan")).cast("float")).otherwise(v)
    kind = "gridline" if width == 2 * height - 1 else "pixel"
    return df.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), value.alias("value")), {"width": width, "height": height, "registration": kind}


def mosaic_raster(pieces: DataFrame, resolution: float, name: str = "name") -> DataFrame:
    """Pixels of named pieces in one global grid: _N15W030_ in a name is the north-west corner in whole degrees."""
    token = lambda g: F.regexp_extract(name, r"_([NS])(\d{2})([EW])(\d{3})_", g)
    north = token(2).cast("int") * F.when(token(1) == "N", 1).otherwise(-1)
    west = token(4).cast("int") * F.when(token(3) == "E", 1).otherwise(-1)
    return pieces.select(
        (F.round((90 - north) / resolution).cast("long") + F.col("row")).alias("row"), (F.round((west + 180) / resolution).cast("long") + F.col("col")).alias("col"), F.col("value")
    )
