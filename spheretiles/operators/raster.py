"""Longitude/latitude rasters to cells: bicubic (Catmull-Rom), periodic in x, clamped in y."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .algebra import cells_to_lonlat


def weights(t: Column) -> list[Column]:
    """Catmull-Rom weights of the offsets -1, 0, 1, 2."""
    t2, t3 = t * t, t * t * t
    return [(-t + 2 * t2 - t3) / 2, (2 - 5 * t2 + 3 * t3) / 2, (t + 4 * t2 - 3 * t3) / 2, (t3 - t2) / 2]


def pixel_places(df: DataFrame, width: int, height: int, registration: str) -> tuple[DataFrame, int]:
    """Adds px, py of (lon, lat), and the number of columns after which a row repeats."""
    if registration == "gridline":
        cycle = width - 1
        x, y = F.pmod((F.col("lon") + 180) * cycle / 360, F.lit(float(cycle))), (90 - F.col("lat")) * (height - 1) / 180
    else:
        cycle = width
        x, y = F.pmod((F.col("lon") + 180) * width / 360 - 0.5, F.lit(float(width))), (90 - F.col("lat")) * height / 180 - 0.5
    return df.withColumns({"px": x, "py": F.least(F.greatest(y, F.lit(0.0)), F.lit(float(height - 1)))}), cycle


def _repeats(at: Column, size: int, cycle: bool) -> Column:
    """Places of row or column `at` on a grid that goes on by one before and two after: round a cycle, or with its edges kept."""
    if cycle:
        return F.filter(F.array(*[at + F.lit(k * size) for k in (-1, 0, 1, 2)]), lambda v: v.between(-1, size + 1))
    beyond = F.when(at == size - 1, F.array(*[F.lit(v).cast("long") for v in (size, size + 1)])).otherwise(F.array().cast("array<long>"))
    before = F.when(at == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.concat(F.array(at), before, beyond)


def _holders(places: Column, size: int, side: int) -> Column:
    """array<struct<block, at>>: the blocks of `side` pixels, and three more, that hold each of the places, and where."""
    last = -(-size // side) - 1
    each = F.transform(places, lambda v: F.struct(F.floor((v + 1) / side).alias("block"), F.pmod(v + 1, F.lit(side)).alias("at")))
    held = F.flatten(F.transform(each, lambda e: F.array(*[F.struct((e["block"] - k).alias("block"), (e["at"] + k * side).alias("at")) for k in range(1 - (-3 // side))])))
    return F.filter(held, lambda e: e["block"].between(0, last) & (e["at"] < side + 3))


def raster_blocks(raster: DataFrame, info: dict, side: int = 64) -> DataFrame:
    """(by, bx, values): the raster in blocks of side x side pixels with a halo, row after row, side + 3 to a row.

    A block carries one pixel before its first and two after its last, round the date line and past the poles as resampling
    wants them, so that the 4 x 4 pixels of a position are in one block. Absent pixels are NaN; one given twice is an error.
    """
    wide = side + 3
    cycle = info["width"] - 1 if info["registration"] == "gridline" else info["width"]
    kind = "float" if raster.schema["value"].dataType.typeName() == "float" else "double"

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        at = rows.column("at").to_numpy()
        if len(np.unique(at)) < len(at):
            raise ValueError("a pixel of the raster is given twice")
        values = np.full(wide * wide, np.nan, np.float32 if kind == "float" else np.float64)
        values[at] = rows.column("value").fill_null(float("nan")).to_numpy()
        return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), pa.array([values])], names=["by", "bx", "values"])

    inside = raster.where(F.col("row").between(0, info["height"] - 1) & F.col("col").between(0, cycle - 1))
    row, col = F.col("row").cast("long"), F.col("col").cast("long")
    placed = inside.select("value", F.explode(_holders(_repeats(row, info["height"], False), info["height"], side)).alias("r"), col.alias("col"))
    placed = placed.select("value", "r", F.explode(_holders(_repeats(F.col("col"), cycle, True), cycle, side)).alias("c"))
    placed = placed.select(F.col("r.block").alias("by"), F.col("c.block").alias("bx"), (F.col("r.at") * wide + F.col("c.at")).alias("at"), "value")
    return placed.groupBy("by", "bx").applyInArrow(build, f"by long, bx long, values array<{kind}>")


def resample_blocks(blocks: DataFrame, info: dict, cells: DataFrame, order: int, axes: str = "odd_x", side: int = 64) -> DataFrame:
    """(cell, value) of each cell centre from `blocks`, as raster_blocks made them with the same `side`: a cell meets one block."""
    placed, cycle = pixel_places(cells_to_lonlat(cells, order, axes=axes).select("cell", "lon", "lat"), info["width"], info["height"], info["registration"])
    # a position just below the date line may round up to a whole cycle, which is column 0
    placed = placed.select("cell", "px", "py", F.pmod(F.floor("px"), F.lit(cycle)).alias("x1"), F.floor("py").alias("y1"))
    placed = placed.select("cell", (F.col("px") - F.floor("px")).alias("tx"), (F.col("py") - F.col("y1")).alias("ty"), F.floor(F.col("y1") / side).alias("by"), F.floor(F.col("x1") / side).alias("bx"), (F.col("y1") % side * (side + 3) + F.col("x1") % side).cast("int").alias("at"))
    met = placed.join(blocks, ["by", "bx"], "left")
    wx, wy = weights(F.col("tx")), weights(F.col("ty"))
    pixel = lambda j, i: F.coalesce(F.get("values", F.col("at") + (j * (side + 3) + i)).cast("double"), F.lit(float("nan")))
    across = lambda j: reduce(lambda a, b: a + b, [wx[i] * pixel(j, i) for i in range(4)])
    return met.select("cell", reduce(lambda a, b: a + b, [wy[j] * across(j) for j in range(4)]).alias("value"))


def resample_raster(raster: DataFrame, info: dict, cells: DataFrame, order: int, axes: str = "odd_x", side: int = 64) -> DataFrame:
    """(cell, value) of each cell centre from its 4 x 4 pixels; one that is NaN or absent from `raster` gives NaN.

    The raster is cut into blocks with a halo, written once; a small one is broadcast (Spark knows the size of what was
    written), a large one is joined by block. The sum is double; cast to float when stored in tiles. Cells that repeat stay.
    """
    return resample_blocks(written(raster_blocks(raster, info, side)), info, cells, order, axes, side)


def raster_gaps(raster: DataFrame, info: dict) -> DataFrame:
    """One row: pixels, missing, repeated, outside; a complete raster has zeros in the last three."""
    inside = F.col("row").between(0, info["height"] - 1) & F.col("col").between(0, info["width"] - 1)
    each = raster.groupBy("row", "col").agg(F.count("*").alias("n"), F.first(inside).alias("inside"))
    good = F.count_if("inside")
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("pixels"), (F.lit(info["height"] * info["width"]) - good).alias("missing"),
        F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(~F.col("inside")).alias("outside"),
    )
